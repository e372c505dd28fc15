import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obslab.llm import collocations, sorted_tables

SCHEMA = "doc_id bigint, text string, lang string"


def pieces_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows, least, most=4, top=2000):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for words in pieces_of(text):
            total[lang or "und"] += len(words)
            for size in range(1, most + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def table(n=250, seed=4):
    """Words by a steep law, some fixed phrases, all kinds of breaks."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "a b", "x-y", "Up"]
    fixed = ["new york city hall", "big Apple pie", "ab cd", "one two three four five six"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(fixed) if rng.random() < 0.15 else words[min(int(rng.expovariate(0.12)), len(words) - 1)])
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! ?"]))
        rows.append((i, "".join(parts), ("en", "de", None, "und")[i % 4]))
    return rows + rows[:20] + [(None, None, "en"), (1, "", "fr"), (2, " .,; ", None), (3, "solo", "it"), (4, "long " * 30000, "en")]


@pytest.fixture
def small_tiles(monkeypatch):
    """Tiles of 4 x 4, two dense ones held at a time, small buckets and files: every way is taken."""
    for name, value in (("TILE_BITS", 2), ("HELD_TILES", 2), ("BUCKET_CELLS", 500), ("GATHERED", 50)):
        monkeypatch.setattr(collocations, name, value)


@pytest.mark.parametrize("least", [3, 30])
def test_equals_brute_force(shipped, least):
    rows = table()
    got = collocations.collocations(shipped.createDataFrame(rows, SCHEMA).repartition(3), least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == brute(rows, least) and len(found) > 5


def test_tops_and_levels_of_merging(shipped):
    """Short stretches of words, files of few keys and two levels of merging give the same."""
    rows = table(120, 9)
    got = collocations.collocations(shipped.createDataFrame(rows, SCHEMA).repartition(7), least=2, top=5, fan=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, top=5)


def test_all_phrases(shipped):
    rows = table(60, 1)
    found, totals = collocations.phrases(shipped.createDataFrame(rows, SCHEMA), least=2)
    counts = Counter()
    for _, text, lang in rows:
        for words in pieces_of(text):
            counts.update((lang or "und", " ".join(words[i : i + s])) for s in (1, 2, 3, 4) for i in range(len(words) - s + 1))
    assert {(r["lang"], r["phrase"]): r["n"] for r in found.collect()} == {k: n for k, n in counts.items() if n >= 2}


def test_empty_tables(shipped, make):
    assert collocations.collocations(shipped.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(shipped.createDataFrame([(1, None, None), (2, "a b", "en")], SCHEMA)).count() == 0
    only_words = shipped.createDataFrame([(1, "a. b. " * 40, "en")], SCHEMA)
    assert collocations.collocations(only_words).count() == 0


def test_clashing_columns(clashing, odd):
    named = clashing.selectExpr("*", "1 as word", "2 as start", "3 as id", "4 as n", "5 as bucket", "6 as part", "7 as phrase", "8 as cells")
    both = [sorted(tuple(r) for r in collocations.collocations(d, least=2).collect()) for d in (odd, named)]
    assert both[0] == both[1] and both[0]


def test_scores_beyond_64_bits(shipped):
    expression = f"cast({collocations.SCALE} as decimal(7,0)) * cast({10**13} as decimal(20,0)) div cast({2 * 10**13 + 1} as decimal(20,0))"
    assert shipped.range(1).select(F.expr(expression)).first()[0] == collocations.SCALE * 10**13 // (2 * 10**13 + 1)


def test_tiles_add_up(monkeypatch, small_tiles):
    """Cells of two languages, met in many small batches by two tasks."""
    rng = np.random.default_rng(3)
    width, want, rows = 40, Counter(), []
    for task in range(2):
        cells = collocations._Cells(width, 3)
        for _ in range(30):
            left = rng.integers(0, 40, 200)
            start = np.where(left < 23, 0, 23)
            right = np.where(left < 23, rng.integers(0, 23, 200), rng.integers(23, 40, 200))
            want.update(zip(left.tolist(), right.tolist()))
            rows += [b for b in collocations._cell_rows(cells.add(left, right, start, start), task)]
        rows += list(collocations._cell_rows(cells.flush(), task))
    whole = pa.Table.from_batches(rows).sort_by([("bucket", "ascending"), ("part", "ascending")])
    assert min(whole["bucket"].to_pylist()) < 0 <= max(whole["bucket"].to_pylist())
    got = Counter()
    for _, _, cells, counts in collocations._tiles(whole.to_batches(max_chunksize=7), width, 1 << 62):
        got.update({divmod(c, width): n for c, n in zip(cells.tolist(), counts.tolist())})
    assert got == want


def test_sorted_tables_find_repeated_and_missing_keys(shipped):
    rows = [(k, k * 2, k + 1) for k in range(-50, 50, 3)] + [(7, 70, 71), (7, 72, 73), (-(2**63), 5, 6), (2**63 - 1, 8, 9)]
    table = sorted_tables.write_sorted(shipped.createDataFrame(rows, "k bigint, c bigint, v bigint"), "k", ["c", "v"], file_keys=4)
    keys, checks = np.array([7, 7, 7, 1, 2**63 - 1, -(2**63), 0]), np.array([70, 72, 99, 2, 8, 5, 0])
    found, (_, values) = table.find(keys, checks)
    assert found.tolist() == [True, True, False, True, True, True, False] and values[found].tolist() == [71, 73, 2, 9, 6]
    assert len(table.files) > 3 and not sorted_tables.write_sorted(shipped.createDataFrame([], "k bigint, c bigint"), "k", ["c"]).find(keys)[0].any()
