import pytest
from pyspark.sql import functions as F

from core_rows import log_row, reference_rows
from dataclasses import replace
from obslab.operators import duplicates, gates, leakage, skew
from obslab.operators.prepare import prepare_dataset, source_rows
from obslab.spec import BODY_MEASURES, DatasetSpec

SPEC = replace(BODY_MEASURES, key=("row",))


def report_of(prepared):
    return prepared.report.first().asDict()


def test_only_independent_confirmation_becomes_label(reference, make_log):
    log = make_log(log_row(), log_row(row=2, validated_species="", bill_length_mm="invalid"))
    prepared = prepare_dataset(reference, log, SPEC)
    confirmed = source_rows(prepared.snapshot, "confirmed").collect()
    assert [(r["species"], r["sex"]) for r in confirmed] == [("Chinstrap", "unknown")]
    report = report_of(prepared)
    assert (report["confirmed_count"], report["ignored_unconfirmed"]) == (1, 1)
    assert report["confirmed_class_counts"] == {"Adelie": 0, "Chinstrap": 1, "Gentoo": 0}
    assert report["class_counts"] == {"Adelie": 12, "Chinstrap": 13, "Gentoo": 12}
    assert len(report["warnings"]) == 1


def test_without_log_rows_all_reference_rows_stay(reference, make_log):
    report = report_of(prepare_dataset(reference, make_log(log_row()).limit(0), SPEC))
    assert (report["rows"], report["confirmed_count"], report["duplicates_removed"], report["warnings"]) == (36, 0, 0, [])


def test_context_and_spelling_do_not_make_rows_new(reference, make_log):
    first = reference_rows()[0]
    copy = {k: str(first[k]) for k in BODY_MEASURES.numeric}
    log = make_log(
        log_row(row=2, **copy, sex=" Male ", validated_species="Adelie"), log_row(row=3),
        log_row(row=4, island="Torgersen", sex="unknown", bill_depth_mm="18.00"),
    )
    prepared = prepare_dataset(reference, log, SPEC)
    report = report_of(prepared)
    assert (report["rows"], report["duplicates_removed"], report["confirmed_count"]) == (37, 2, 1)
    assert source_rows(prepared.snapshot, "confirmed").first()["row"] == 3
    assert prepared.snapshot.select("feature_id").distinct().count() == 37


@pytest.mark.parametrize("with_reference", [False, True])
def test_contradicting_labels_stop_the_strict_job(reference, make_log, with_reference):
    first = reference_rows()[0]
    same = {k: str(first[k]) for k in BODY_MEASURES.numeric}
    rows = [log_row(**same, sex="male", validated_species="Gentoo")] if with_reference else [
        log_row(), log_row(row=2, validated_species="Gentoo")]
    with pytest.raises(ValueError, match="contradicting"):
        prepare_dataset(reference, make_log(*rows), SPEC)
    lenient = prepare_dataset(reference, make_log(*rows), SPEC, strict=False)
    assert lenient.conflicts.count() == 1
    assert lenient.snapshot.count() == (35 if with_reference else 36)


def test_invalid_rows_stop_the_strict_job_with_their_place(reference, make_log):
    log = make_log(log_row(row=77, body_mass_g="heavy"))
    with pytest.raises(ValueError, match=r"confirmed row \[77\].*body_mass_g"):
        prepare_dataset(reference, log, SPEC)
    assert prepare_dataset(reference, log, SPEC, strict=False).quarantine.first()["errors"] == ["body_mass_g:invalid_number"]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_identities_are_stable_under_order_spelling_and_partitions(reference, make_log, partitions):
    first = prepare_dataset(reference, make_log(log_row()), SPEC)
    shuffled = reference.orderBy(F.desc("row")).repartition(partitions)
    second = prepare_dataset(shuffled, make_log(log_row(body_mass_g="4300.00", island="x", sex="unknown")), SPEC)
    ids = lambda p: {r["record_id"] for r in p.snapshot.collect()}
    assert ids(first) == ids(second)
    assert all(len(i) == 64 for i in ids(first))
    assert report_of(first)["reference_fingerprint"] == report_of(second)["reference_fingerprint"]


def test_tampered_rows_are_found(reference, make_log):
    snapshot = prepare_dataset(reference, make_log(log_row()), SPEC).snapshot
    assert gates.tampered_rows(snapshot, SPEC).count() == 0
    changed = snapshot.withColumn("bill_length_mm", F.when(F.col("row") == 1005, 1.0).otherwise(F.col("bill_length_mm")))
    assert [r["row"] for r in gates.tampered_rows(changed, SPEC).collect()] == [1005]
    relabelled = snapshot.withColumn("species", F.lit("Gentoo"))
    assert gates.tampered_rows(relabelled, SPEC).count() == 25


SMALL = DatasetSpec(label="y", numeric=("a",), categorical=("b",), key=("id",), labels=("p", "q", "r"))


def hot_rows(spark, n=3000):
    """A third of all rows repeats one combination."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        "id", F.when(hot, 7.0).otherwise((F.col("id") % 50).cast("double")).alias("a"),
        F.when(hot, "h").otherwise(F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise("k")).alias("b"),
        F.when(F.col("id") % 5 == 0, "p").when(F.col("id") % 7 == 0, "q").otherwise("r").alias("y"),
    )


def test_first_wins_equals_brute_force(spark):
    rows = hot_rows(spark)
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        group = expected.setdefault((r["a"], r["b"]), [r["id"], r["y"], 0, set()])
        group[2] += 1
        group[3].add(r["y"])
    got = duplicates.dedupe_first_wins(rows.repartition(9), SMALL, ["id"]).collect()
    assert {(r["a"], r["b"]): (r["id"], r["y"], r["copies"], r["conflict"]) for r in got} == {
        k: (i, y, n, len(ys) > 1) for k, (i, y, n, ys) in expected.items()}


def test_conflicts_equal_brute_force(spark):
    rows = hot_rows(spark)
    places, counts = {}, {}
    for r in rows.orderBy("id").collect():
        places.setdefault((r["a"], r["b"]), {}).setdefault(r["y"], r["id"])
        counts[r["a"], r["b"], r["y"]] = counts.get((r["a"], r["b"], r["y"]), 0) + 1
    expected = set()
    for (a, b), by_label in places.items():
        first = min(by_label, key=by_label.get)
        expected |= {(a, b, first, by_label[first], y, at, counts[a, b, y]) for y, at in by_label.items() if y != first}
    got = duplicates.label_conflicts(rows, SMALL, ["id"]).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_duplicate_summary_counts_missing_values_as_equal(spark):
    frame = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y"), (3, "y"), (3, "y")], "a int, b string")
    assert tuple(duplicates.duplicate_summary(frame, ["a", "b"]).first()) == (6, 2, 5, 3)
    assert tuple(duplicates.duplicate_summary(frame.limit(0), ["a", "b"]).first()) == (0, 0, 0, 0)


def test_hot_keys_are_found(spark):
    rows = hot_rows(spark, 9000)
    found = skew.hot_keys(rows, ["a", "b"], share=0.2)
    expected = spark.createDataFrame([(7.0, "h")], "a double, b string").select(F.xxhash64("a", "b")).first()[0]
    assert found == [expected]
    assert skew.hot_keys(spark.range(5000), ["id"]) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(spark, how):
    left = hot_rows(spark, 6000).fillna("none", ["b"])
    right = spark.createDataFrame([(7.0, "h", 1), (3.0, "k", 2), (4.0, "none", 3)], "a double, b string, z int")
    hot = skew.hot_keys(left, ["a", "b"])
    assert hot
    plain = left.join(right, ["a", "b"], how)
    salted = skew.salted_join(left, right, ["a", "b"], how, ["id"], hot)
    assert salted.columns == plain.columns
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()), key=lambda t: t)


def test_holdout_exclusion_ignores_source_and_label(spark):
    rows = hot_rows(spark).withColumn("b", F.coalesce("b", F.lit("none")))
    held = rows.where("id in (0, 1)")
    left = leakage.exclude_holdout(rows, held, ["a", "b"], ["id"])
    assert left.where("a = 7.0 and b = 'h'").count() == 0
    gone = {(r["a"], r["b"]) for r in held.collect()}
    assert left.count() == sum((r["a"], r["b"]) not in gone for r in rows.collect())


def test_split_overlap_counts(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", 1.0), (4, "x", None), (5, "z", 1.0)],
                                 "id int, b string, a double")
    got = leakage.split_overlap(rows, F.col("id") <= 3, F.col("id") > 3, ["b", "a"], ["id"])
    assert {r["measure"]: r["n"] for r in got.collect()} == {
        "shared_feature_combinations": 1, "left_rows_with_match": 2, "right_rows_with_match": 1, "shared_rows": 0}


def test_set_comparisons(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "record_id string")
    assert leakage.snapshot_diff(ids("a", "b"), ids("b", "a")).first()["same_ids"]
    assert not leakage.snapshot_diff(ids("a", "b"), ids("a", "b", "b")).first()["same_ids"]
    assert tuple(leakage.manifest_diff(ids("a", "c"), ids("a", "b"), ids("c")).first()) == (1, 1, True, True)
    assert tuple(leakage.manifest_diff(ids("a"), ids("a"), ids("a", "b")).first()) == (0, 0, False, False)
