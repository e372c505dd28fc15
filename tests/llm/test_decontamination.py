import hashlib
import random
import re

import pytest
from llm_rows import make_text, plain_rows

from obslab.llm import decontamination

ITEMS = "item_id string, text string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=10):
    """Every window at every place."""
    out = []
    for doc_id, text, *_ in docs:
        w, hit, met = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            for i in range(max(1, len(p) - window + 1) if p else 0):
                part = p[i : i + window]
                for s in range(len(w) - len(part) + 1):
                    if w[s : s + len(part)] == part:
                        hit.update(range(s, s + len(part)))
                        met.add(item or "")
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(5)
    items = [(f"i{k}", make_text(rng, n, 300)) for k, n in enumerate((30, 12, 10, 9, 3, 1, 25, 25))]
    items += [items[0], ("copy", items[0][1]), ("empty", ""), ("null", None), (None, make_text(rng, 15, 50)), ("marks", " .,;! "), ("rep", "na " * 14)]
    docs = plain_rows(30, seed=3)
    for n, (name, passage) in enumerate(items[:9]):
        text = make_text(rng, 60, 4000)
        cut = words(passage)
        docs.append((2000 + n, f"{text} {passage.upper() if n % 2 else passage} {text}", "en", "s", 0))
        docs.append((2100 + n, " ".join(cut[2:12]) + "; " + text, "en", "s", 0))
        docs.append((2200 + n, text + " " + " ".join(cut[-9:]), "en", "s", 0))
    docs += [(2300, "na " * 30, "en", "s", 0), (2301, "NA-na na", "en", "s", 0), docs[-1], docs[-2], (2302, items[12][1] * 2, None, None, 0)]
    return docs, items


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_equals_brute_force(make, odd_rows, limit):
    docs, items = planted()
    docs = docs + [r for r in odd_rows if len(r[1] or "") < 10000]
    got = decontamination.report(make(*docs).repartition(3), make(*items, schema=ITEMS), limit=limit)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_only_short_items(make):
    docs = [(1, "one two three", "en", "s", 0), (2, "two one", "en", "s", 0), (3, "Three.", "en", "s", 0)]
    items = [("a", "two three"), ("b", "three")]
    got = decontamination.report(make(*docs), make(*items, schema=ITEMS))
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items)


def test_spans_join_overlaps(make):
    text = "x0 " + " ".join(f"w{i}" for i in range(12)) + " x1 " + " ".join(f"w{i}" for i in range(2, 12))
    _, found, _ = decontamination.occurrences(make((1, text, "en", "s", 0)), make(("a", " ".join(f"w{i}" for i in range(12))), schema=ITEMS))
    assert sorted((r["start"], r["end"]) for r in decontamination.spans(found).collect()) == [(1, 13), (14, 24)]


def test_empty_tables_and_clashes(make, none, odd, clashing):
    no_items = make(schema=ITEMS)
    assert decontamination.report(none, no_items).count() == 0
    assert decontamination.report(none, make(("a", "b"), schema=ITEMS)).count() == 0
    clean = decontamination.report(odd, no_items)
    assert clean.count() == odd.count() and clean.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    items = make(("a", "key at all"), schema=ITEMS).selectExpr("*", "1 as words", "2 as `key`", "3 as _row_1", "4 as window")
    named = clashing.selectExpr("*", "1 as _row_1", "2 as window", "3 as n", "4 as s", "5 as item", "6 as start")
    both = [decontamination.report(d, i).collect() for d, i in ((odd, items), (named, items))]
    assert sorted(map(repr, both[0])) == sorted(map(repr, both[1]))
    assert sum(r["contaminated"] for r in both[0]) == 2


def test_native(shipped, odd, make):
    plan = decontamination.report(odd, make(("a", "key at all"), schema=ITEMS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
