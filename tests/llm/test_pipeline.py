import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from llm_rows import ODD, SCHEMA, plain_rows, words_of

from obslab.llm.common import stored


@pytest.fixture(scope="module")
def source():
    rows = plain_rows(60, 11)
    copies = [(200 + i, rows[i % 3][1], "en", "s1", 0) for i in range(9)]
    near = [(300 + i, rows[5][1].replace(rows[5][1].split()[7], f"other{i}", 1), "en", "s2", 0) for i in range(6)]
    secret = [(400, plain_rows(1, 99)[0][1] + f"\nThe token = \"{'a1b2c3' * 6}\" was there.", "en", "s0", 0)]
    junk = [(500, "home | news | more | login\n" * 60, "en", "s0", 0)]
    return rows + copies + near + secret + junk + [rows[20], rows[20]] + [r for r in ODD if r[0] != 1008]


@pytest.fixture(scope="module")
def steps(shipped, source):
    docs, out = shipped.createDataFrame(source, SCHEMA).repartition(3), {}
    for name, stage in cp.STAGES:
        docs = out[name] = stored(stage(shipped, docs, ""), "test")
        assert name == cp.STAGES[-1][0] or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return {k: v.collect() for k, v in out.items()}


def test_quality_keeps_clean_documents(steps, source):
    kept = {r.doc_id for r in steps["quality rules"]}
    assert set(range(60)) <= kept and not kept & {500, 1000, 1001, 1002, 1003}
    texts = {r.doc_id: r.text for r in steps["quality rules"]}
    assert all(texts[i] == t for i, t, *_ in source if i is not None and i < 60)


def test_one_of_each_class_stays(steps):
    keys = Counter(r.doc_id for r in steps["near copies"])
    assert max(keys.values()) == 1 and not set(keys) & {*range(200, 209), *range(300, 306)} and set(range(60)) <= set(keys)


def test_secrets_go(steps):
    texts = {r.doc_id: r for r in steps["secrets"]}
    assert len(steps["secrets"]) == len(steps["near copies"])
    assert "[secret]" in texts[400].text and texts[400].n_chars == len(texts[400].text)
    assert not any(re.search("a1b2c3a1b2c3", r.text) for r in steps["secrets"])


def test_sources_meet_their_weights(steps):
    before, after = Counter(), Counter()
    for r in steps["secrets"]:
        before[r.source] += len(words_of(r.text))
    for r in steps["mix"]:
        after[r.source] += len(words_of(r.text))
    order = sorted(s for s in before if s is not None)
    assert max(Counter((r.doc_id, r.text) for r in steps["mix"]).values()) <= 3
    assert after[order[0]] < after[order[1]] * 1.2 and sum(after.values()) == pytest.approx(sum(before.values()), rel=0.2)


def test_packing_takes_every_document(steps):
    tokens = Counter()
    for r in steps["packing"]:
        tokens[r.doc_id] += r.length
    docs = Counter(r.doc_id for r in steps["mix"])
    assert set(tokens) == set(docs)
    whole = {(r.doc_id, r.doc_tokens) for r in steps["packing"]}
    assert all(sum(n for k, n in whole if k == i) * docs[i] == tokens[i] for i in docs)


def test_extra_columns_and_empty_tables(shipped, source):
    wide = shipped.createDataFrame(source[:30], SCHEMA).selectExpr("*", "'x' as quality", "1 as row_no", "'k' as key", "2 as size", "'t' as target", "'r' as rules", "3 as copies")
    for table in (wide, wide.where("false"), shipped.createDataFrame(ODD, SCHEMA)):
        docs = table
        for name, stage in cp.STAGES[:-1]:
            docs = stored(stage(shipped, docs, ""), "test")
            assert docs.columns == table.columns, name
        cp.STAGES[-1][1](shipped, docs, "").collect()
