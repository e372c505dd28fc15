import hashlib

from llm_rows import words_of
from pyspark.sql import functions as F

from obslab.llm import fingerprints as fp


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_likeness(odd, odd_rows):
    rows = fp.edit_likeness(odd).collect()
    order = sorted(((t or ""), i) for i, t, *_ in odd_rows)
    order = [t for t, i in sorted(order, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))]
    want = sorted(
        (len(a), hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest())
        for a, b in zip(order, order[1:] + order[:1])
    )
    assert sorted((r.n_chars, r.edited_sha256) for r in rows) == want
    for a, b in zip(order, order[1:] + order[:1]):
        edited = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        near = [r for r in rows if r.edited_sha256 == sha and r.n_chars == len(a)]
        assert min(abs(r.near_edited - jaccard(shingles(a), shingles(edited))) for r in near) < 0.2
        assert min(abs(r.near_next - jaccard(shingles(a), shingles(b))) for r in near) < 0.2


def test_equal_texts_have_equal_fingerprints(odd):
    rows = fp.fingerprints(odd).groupBy("text").agg(F.count_distinct("fingerprint").alias("n")).collect()
    assert {r.n for r in rows} == {1}


def test_successors_over_many_cells(make, monkeypatch):
    monkeypatch.setattr(fp, "CELL_ROWS", 1)
    keys = [None, -5, 3, 3, 900, 901, 902, 10**6, 10**15]
    table = make(*((k, f"t{i}", "", "", 0) for i, k in enumerate(keys)))
    rows = fp.with_next(fp.in_cells(table.select("doc_id", "text"), "doc_id", "text"), "doc_id", "text", ["text"]).collect()
    assert {(r.text, r.next_text) for r in rows} == {(f"t{i}", f"t{(i + 1) % len(keys)}") for i in range(len(keys))}


def test_one_document_is_its_own_successor(make):
    row = fp.edit_likeness(make((5, "abcdefgh", "", "", 0))).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0


def test_sketches_merge_and_estimate(make):
    parts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 3000), (1500, 4500))]
    table = fp.fingerprints(make(*((i, t, "", "", 0) for i, t in enumerate(parts))))
    merged = fp.merge_all(table.withColumn("g", F.lit(1)), ["g"])
    a, b = table.where("doc_id = 0").selectExpr("fingerprint as a"), table.where("doc_id = 1").selectExpr("fingerprint as b")
    r = a.crossJoin(b).crossJoin(merged).select(
        (fp.merge(F.col("a"), F.col("b")) == F.col("fingerprint")).alias("same"), fp.resemblance(F.col("a"), F.col("b")).alias("like"),
        fp.containment(F.col("a"), F.col("b")).alias("inside"), fp.distinct_shingles(F.col("fingerprint")).alias("n"),
    ).first()
    assert r.same and abs(r.like - 1 / 3) < 0.15 and abs(r.inside - 0.5) < 0.2 and abs(r.n / 4490 - 1) < 0.3


def test_empty_table_and_clashing_columns(none, clashing):
    assert fp.edit_likeness(none).collect() == []
    assert fp.edit_likeness(clashing).count() == clashing.count()
    assert fp.fingerprints(clashing).count() == clashing.count()


def test_distant_ids(make, monkeypatch):
    monkeypatch.setattr(fp, "CELL_ROWS", 4)
    ids = [-6 * 10**18, -(2**63), 5 * 10**18, 2**63 - 1, *range(100), *range(2**60, 2**60 + 40), None]
    rows = [(i, f"text of {i} with some words", "", "", 0) for i in ids]
    celled = fp.in_cells(make(*rows).select("doc_id", "text"), "doc_id", "text")
    sizes = [r["count"] for r in celled.where("NOT _guest").groupBy("_cell").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 50
    found = {r.doc_id: r.next_text for r in fp.with_next(celled, "doc_id", "text", ["text"]).collect()}
    order = [None, *sorted(i for i in ids if i is not None)]
    assert found == {a: f"text of {b} with some words" for a, b in zip(order, order[1:] + order[:1])}
