from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from obslab.operators import leakage, ranking, splits
from obslab.plans.study import protocol, with_folds
from obslab.spec import DatasetSpec

SPEC = DatasetSpec(label="y", numeric=("x",), key=("id",), labels=("a", "b", "c"))


def labelled(spark, sizes):
    rows = [(i, label) for i, label in enumerate(name for name, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "id bigint, y string").withColumn("x", F.col("id").cast("double"))


SIZES = {"a": 151, "b": 68, "c": 123}


def test_known_split_and_fold_sizes(spark):
    rows = protocol(labelled(spark, SIZES), SPEC)
    test = rows.where("split = 'test'").groupBy("y").count()
    assert {r["y"]: r["count"] for r in test.collect()} == {"a": 38, "b": 17, "c": 31}
    folds = rows.where("split = 'train'").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [52, 51, 51, 51, 51]
    per_class = rows.where("fold > 0").groupBy("y", "fold").count().groupBy("y").agg(
        (F.max("count") - F.min("count")).alias("spread"))
    assert all(r["spread"] <= 1 for r in per_class.collect())


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_membership_does_not_depend_on_layout_or_later_rows(spark, partitions):
    rows = labelled(spark, SIZES)
    place = lambda df: {r["id"]: r["fold"] for r in with_folds(df, SPEC).collect()}
    assert place(rows) == place(rows.orderBy(F.rand(1)).repartition(partitions))
    other = {r["id"] for r in splits.stratified_split(rows, SPEC, seed=1).where("split = 'test'").collect()}
    assert other != {r["id"] for r in splits.stratified_split(rows, SPEC).where("split = 'test'").collect()}


def test_rank_selection_refines_large_buckets(spark, monkeypatch):
    """With tiny limits every bucket is refined until single rows are left."""
    monkeypatch.setattr(ranking, "WIDTH", 1)
    monkeypatch.setattr(ranking, "SMALL", 2)
    rows = splits._hashed(labelled(spark, SIZES), ["id"], "7").select("y", ranking.HASH)
    ordered = {}
    for r in rows.collect():
        ordered.setdefault(r["y"], []).append(r[ranking.HASH])
    wanted = {"a": [0, 1, 75, 151], "b": [68], "c": [5, 60]}
    got = ranking.select_ranks(rows, "y", ranking.bucket_counts(rows, "y"), wanted)
    for label, ranks in wanted.items():
        hashes = ["", *sorted(ordered[label])]
        assert got[label] == [hashes[r] for r in ranks]


def test_repeated_keys_are_refused_instead_of_refined_for_ever(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL", 2)
    rows = labelled(spark, SIZES).withColumn("id", F.lit(1))
    with pytest.raises(ValueError, match="unique row key"):
        splits.stratified_split(rows, SPEC)


def test_quotas_are_exact():
    assert splits.test_quotas({"a": 1, "b": 1, "c": 1}, 0.25) == {"a": 1, "b": 0, "c": 0}
    assert splits.test_quotas({"a": 4, "b": 8}, 0.25) == {"a": 1, "b": 2}
    assert splits.fold_quotas({"a": 3, "b": 4}, 3) == {"a": [1, 2, 3], "b": [2, 3, 4]}


def test_subsets_are_nested_and_stratified(spark):
    marked = splits.nested_subsets(labelled(spark, SIZES), SPEC)
    long = splits.explode_subsets(marked)
    counts = {(r["fraction"], r["y"]): r["count"] for r in long.groupBy("fraction", "y").count().collect()}
    for fraction in splits.LEARNING_FRACTIONS:
        for label, n in SIZES.items():
            assert counts[fraction, label] == max(1, round(fraction * n))
    by_fraction = {}
    for r in long.collect():
        by_fraction.setdefault(r["fraction"], set()).add(r["id"])
    chain = [by_fraction[f] for f in splits.LEARNING_FRACTIONS]
    assert all(a < b for a, b in zip(chain, chain[1:])) and len(chain[-1]) == 342
    for bad in [(0.0, 1.0), (0.5, 1.1), (-0.2,), (0.6, 0.2)]:
        with pytest.raises(ValueError):
            splits.nested_subsets(labelled(spark, SIZES), SPEC, bad)


def test_positions_are_dense_and_permutation_keeps_the_values(spark):
    rows = labelled(spark, SIZES)
    ranked = ranking.positions(splits._hashed(rows, ["id"], "s").repartition(5), width=1).collect()
    assert sorted(r["position"] for r in ranked) == list(range(342))
    by_hash = sorted(ranked, key=lambda r: r[ranking.HASH])
    assert [r["position"] for r in by_hash] == list(range(342))
    got = splits.permuted_column(rows, "x", ["id"]).collect()
    assert Counter(r["x"] for r in got) == Counter(r["x_permuted"] for r in got)
    assert sum(r["x"] == r["x_permuted"] for r in got) < 20


def test_rows_without_label_stay_and_get_no_place(spark):
    rows = labelled(spark, {"a": 8, "b": 8}).unionByName(spark.createDataFrame([(99, None, 1.0)], "id bigint, y string, x double"))
    got = {r["id"]: r["split"] for r in splits.stratified_split(rows, SPEC).collect()}
    assert len(got) == 17 and got[99] is None


def test_only_buckets_that_differ_are_joined(spark):
    schema = "id bigint, part string, split string, fold int"
    rows = [(i, "p", "train" if i % 3 else "test", i % 5) for i in range(500)]
    saved = spark.createDataFrame(rows, schema)
    again = spark.createDataFrame(rows[::-1], schema)
    key, columns = ["id", "part"], ["split", "fold"]
    assert leakage.differing_buckets(saved, again, key, columns).isEmpty()
    assert leakage.protocol_diff(saved, again, key, columns).isEmpty()
    # One row moves, one is twice there, one is missing, one's values change places with nulls, and one has no whole key.
    changed = [r for r in rows if r[0] not in (7, 9, 11)] + [(7, "p", "other", 2), rows[8], (11, "p", None, 1), (None, "p", "train", 1)]
    other = spark.createDataFrame(changed, schema)
    assert leakage.differing_buckets(saved, other, key, columns).count() == 5
    for buckets in (1, 3, 4096):
        got = leakage.protocol_diff(saved, other, key, columns, buckets)
        plain = saved.selectExpr(*key, "split s", "fold f").join(other, key, "full_outer").where("not (s <=> split and f <=> fold)")
        assert sorted(map(str, (r.id for r in got.collect()))) == sorted(map(str, (r.id for r in plain.collect())))
    swapped = [spark.createDataFrame([(1, "p", *v)], "id bigint, part string, split string, fold string") for v in ((None, "a"), ("a", None))]
    assert leakage.protocol_diff(*swapped, key, columns).count() == 1


def test_protocol_difference(spark):
    rows = labelled(spark, SIZES)
    same = leakage.protocol_diff(protocol(rows, SPEC), protocol(rows.repartition(3), SPEC), ["id"], ["split", "fold"])
    assert same.count() == 0
    fewer = protocol(rows, SPEC).where("id != 5")
    got = leakage.protocol_diff(protocol(rows, SPEC), fewer, ["id"], ["split", "fold"]).collect()
    assert [r["id"] for r in got] == [5] and got[0]["recomputed_split"] is None


def test_overlap_per_boundary_equals_pairwise_counts(spark):
    rows = protocol(labelled(spark, SIZES), SPEC).withColumn("t", (F.col("id") / 3).cast("int"))
    got = {r["boundary"]: r for r in leakage.protocol_overlap(rows, ["t"], 5).collect()}
    local = rows.select("t", "fold").collect()
    for name, fold in [("holdout", 0), *((f"fold_{i}", i) for i in range(1, 6))]:
        left = Counter(r["t"] for r in local if r["fold"] > 0 and r["fold"] != fold)
        right = Counter(r["t"] for r in local if r["fold"] == fold)
        common = left.keys() & right.keys()
        expected = (sum(left.values()), sum(right.values()), len(common),
                    sum(left[t] for t in common), sum(right[t] for t in common))
        assert tuple(got[name])[1:] == expected


def test_repeated_keys_and_foreign_labels_are_refused(spark):
    rows = spark.range(1000).select((F.col("id") % 5).alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"), "id")
    spec = DatasetSpec(label="y", numeric=("id",), key=("k",), labels=("a", "b"))
    with pytest.raises(ValueError, match="repeat"):
        splits.stratified_split(rows, spec).count()
    with pytest.raises(ValueError, match="outside"):
        splits.stratified_split(rows, replace(spec, key=("id",), labels=("a", "c"))).count()
