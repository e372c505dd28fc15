import pytest
from pyspark.sql import functions as F

from core_rows import log_row
from obslab.operators import cleaning, gates
from obslab.spec import BODY_MEASURES as SPEC, DatasetSpec


def test_clean_drops_missing_measures_and_keeps_missing_categories(spark):
    rows = [("A", 1.0, 2.0, 3.0, 4.0, "male", "X", 2007), ("B", None, 2.0, 3.0, 4.0, "male", "X", 2007),
            ("C", 1.0, 2.0, 3.0, 4.0, None, "X", 2007)]
    frame = spark.createDataFrame(rows, ["species", *SPEC.numeric, "sex", "island", "year"])
    got = cleaning.clean(frame, SPEC)
    assert "year" not in got.columns
    assert sorted(r["species"] for r in got.collect()) == ["A", "C"]


@pytest.mark.parametrize("field,value,code", [
    ("bill_length_mm", "", "bill_length_mm:invalid_number"),
    ("bill_length_mm", "text", "bill_length_mm:invalid_number"),
    ("bill_length_mm", "NaN", "bill_length_mm:invalid_number"),
    ("bill_depth_mm", "inf", "bill_depth_mm:invalid_number"),
    ("flipper_length_mm", "0", "flipper_length_mm:invalid_number"),
    ("body_mass_g", "-100", "body_mass_g:invalid_number"),
    ("sex", "other", "sex:unknown_category"),
    ("validated_species", "Emperor", "species:unknown_label"),
])
def test_training_rules(make_log, field, value, code):
    confirmed = cleaning.only_confirmed(make_log(log_row(**{field: value})), SPEC)
    assert cleaning.normalise(confirmed, SPEC, "train").first()["errors"] == [code]


def test_unconfirmed_rows_are_left_out_before_any_rule(make_log):
    log = make_log(log_row(), log_row(validated_species=" \t", bill_length_mm="invalid"), log_row(validated_species=None))
    good, broken = cleaning.validate(cleaning.only_confirmed(log, SPEC), SPEC)
    assert (good.count(), broken.count()) == (1, 0)
    assert log.where(cleaning.is_unconfirmed(SPEC)).count() == 2


@pytest.mark.parametrize("mode,expected", [
    ("train", ["unknown", "unknown", "unknown", "female", "male", "none such"]),
    ("serve", ["unknown", "unknown", " NA ", " Female", "MALE", "none such"]),
    ("audit", ["unknown", "unknown", "na", "female", "male", "none such"]),
])
def test_category_spelling_per_mode(make_log, mode, expected):
    spellings = [None, "", " NA ", " Female", "MALE", "none such"]
    log = make_log(*[log_row(row=i, sex=s) for i, s in enumerate(spellings)])
    got = cleaning.normalise(log, SPEC, mode).orderBy("row").collect()
    assert [r["sex"] for r in got] == expected


def test_serving_codes_tell_the_reasons_apart(make_log):
    cases = {None: "missing", "": "missing", "x": "not_a_number", "inf": "not_finite", "0": "not_positive", "70": None}
    log = make_log(*[log_row(row=i, bill_length_mm=v) for i, v in enumerate(cases)])
    got = [r["errors"] for r in cleaning.normalise(log, SPEC, "serve").orderBy("row").collect()]
    assert got == [[f"bill_length_mm:{c}"] if c else [] for c in cases.values()]


def test_first_code_follows_label_measures_categories(make_log):
    broken = cleaning.only_confirmed(make_log(log_row(sex="x", body_mass_g="x", validated_species="x")), SPEC)
    codes = cleaning.normalise(broken, SPEC, "train").first()["errors"]
    assert [c.split(":")[0] for c in codes] == ["species", "body_mass_g", "sex"]


def test_scatter_frame_checks_axes_and_marks_new_rows(spark, reference):
    new = spark.createDataFrame([(50.0, 17.0)], "bill_length_mm double, bill_depth_mm double")
    got = cleaning.scatter_frame(reference, SPEC, "bill_length_mm", "bill_depth_mm", new)
    assert {r["role"]: r["count"] for r in got.groupBy("role").count().collect()} == {"reference": 36, "new": 1}
    with pytest.raises(ValueError):
        cleaning.scatter_frame(reference, SPEC, "sex", "bill_depth_mm")
    with pytest.raises(ValueError):
        cleaning.scatter_frame(reference, SPEC, "bill_length_mm", "body_mass_g", new)


def test_gates(spark, reference):
    report = {r["rule"]: r["violations"] for r in gates.snapshot_gate(reference, SPEC).collect()}
    assert not any(report.values())
    broken = reference.withColumn("sex", F.lit("x")).where("species != 'Gentoo'")
    report = {r["rule"]: r["violations"] for r in gates.snapshot_gate(broken, SPEC).collect()}
    assert report["sex_is_allowed"] == 24 and report["has_Gentoo"] == 1
    with pytest.raises(ValueError, match="has_Gentoo"):
        gates.require(gates.snapshot_gate(broken, SPEC))
    assert {r["rule"] for r in gates.snapshot_gate(reference.limit(0), SPEC).where("not passed").collect()} >= {"not_empty"}


def test_probability_and_range_gates(spark):
    rows = [({"a": 0.25, "b": 0.75},), ({"a": 0.5, "b": 0.6},), ({"a": 1.0},), ({"a": -0.1, "b": 1.1},),
            ({"a": float("nan"), "b": 1.0},), (None,)]
    frame = spark.createDataFrame(rows, "probabilities map<string,double>")
    assert gates.probability_violations(frame, ("a", "b")).count() == 5
    ranges = spark.createDataFrame(
        [("x", 1.0, 2.0, 3.0), ("y", 0.0, 2.0, 3.0), ("z", 3.0, 2.0, 4.0), ("w", 1.0, 2.0, float("inf"))],
        "feature string, minimum double, median double, maximum double")
    assert sorted(r["feature"] for r in gates.range_violations(ranges).collect()) == ["w", "y", "z"]


def test_agreeing_and_contradicting_confirmations(spark):
    log = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id int, c string")
    labels = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "id int, y string")
    spec = DatasetSpec(label="y", numeric=("id",), labels=("a", "b"))
    got = {r["id"]: r[spec.confirmed] for r in cleaning.attach_labels(log, labels, ["id"], spec).collect()}
    assert got == {1: "a", 2: None, 3: None}
    assert [tuple(r) for r in cleaning.contradicting_labels(labels, ["id"], spec).collect()] == [(2, "a", "b")]
