import math
from collections import Counter

import numpy as np
import pytest

from obslab.operators import metrics


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "actual string, predicted string")


def by_hand(pairs, labels):
    n = len(pairs)
    cells = Counter(pairs)
    rows = {c: sum(k for (a, _), k in cells.items() if a == c) for c in labels}
    cols = {c: sum(k for (_, p), k in cells.items() if p == c) for c in labels}
    hits = {c: cells[c, c] for c in labels}
    present = [c for c in labels if rows[c] + cols[c]]
    accuracy = sum(hits.values()) / n
    expected = sum(rows[c] * cols[c] for c in labels) / n**2
    f1 = [2 * hits[c] / (rows[c] + cols[c]) for c in present]
    return accuracy, sum(f1) / len(f1), (accuracy - expected) / (1 - expected) if expected != 1 else None


@pytest.mark.parametrize("seed", range(4))
def test_metrics_equal_the_formulas(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(a, a if rng.random() < 0.6 else p) for a, p in
             zip(rng.choice(["a", "b", "c"], 200, p=[0.7, 0.2, 0.1]).tolist(), rng.choice(["a", "b", "c", "d"], 200).tolist())]
    got = metrics.classification_metrics(metrics.confusion_cube(scored(spark, pairs), "actual", "predicted")).first()
    assert np.allclose([got["accuracy"], got["macro_f1"], got["cohen_kappa"]], by_hand(pairs, "abcd"))


def test_absent_classes_are_left_out_of_macro_f1_but_not_of_the_matrix(spark):
    cube = metrics.confusion_cube(scored(spark, [("a", "a"), ("b", "b")]), "actual", "predicted")
    assert metrics.classification_metrics(cube).first()["macro_f1"] == 1.0
    matrix = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(cube, "abc").collect()}
    assert len(matrix) == 9 and matrix["c", "c"] == 0 and matrix["a", "a"] == 1
    report = {r["class"]: r for r in metrics.classification_report(cube, "abc").collect()}
    assert report["c"]["f1"] == 0 and report["macro avg"]["f1"] == pytest.approx(2 / 3)
    assert report["weighted avg"]["f1"] == 1.0 and report["accuracy"]["support"] == 2


def test_kappa_is_undefined_when_chance_agreement_is_total(spark):
    cube = metrics.confusion_cube(scored(spark, [("a", "a")] * 3), "actual", "predicted")
    assert metrics.classification_metrics(cube).first()["cohen_kappa"] is None


def test_fold_summary_uses_population_deviation(spark):
    rows = [("v", 2, 0.8), ("v", 1, 1.0), ("v", 3, 0.9)]
    frame = spark.createDataFrame(rows, "variant string, fold int, accuracy double")
    got = metrics.fold_summary(frame, ["variant"], ["accuracy"]).first()
    assert got["accuracy_scores"] == [1.0, 0.8, 0.9]
    assert math.isclose(got["accuracy_std"], np.std([0.8, 1.0, 0.9]))


@pytest.mark.parametrize("tolerance,chosen", [(0.005, "compact"), (0.0, "best")])
def test_smallest_variant_within_tolerance_wins(spark, tolerance, chosen):
    rows = [("best", 0.99, 100.0), ("compact", 0.986, 40.0), ("too_weak", 0.98, 10.0)]
    frame = spark.createDataFrame(rows, "variant string, validation_macro_f1_mean double, tree_nodes_mean double")
    got = {r["variant"]: r for r in metrics.select_variant(frame, tolerance).collect()}
    assert [v for v, r in got.items() if r["recommended"]] == [chosen]
    assert got["best"]["is_best"] and not got["too_weak"]["eligible"]


def test_equal_variants_go_to_the_smaller_name(spark):
    rows = [("b", 0.9, 5.0), ("a", 0.9, 5.0)]
    frame = spark.createDataFrame(rows, "variant string, validation_macro_f1_mean double, tree_nodes_mean double")
    got = {r["variant"]: (r["is_best"], r["recommended"]) for r in metrics.select_variant(frame).collect()}
    assert got == {"a": (True, True), "b": (False, False)}


def test_regression_flag_tolerates_rounding(spark):
    row = lambda *v: spark.createDataFrame([v], "accuracy double, macro_f1 double, cohen_kappa double")
    got = metrics.metric_regression(row(0.9, 0.8, 0.7 - 1e-12), row(0.9, 0.9, 0.7)).collect()
    assert {r["metric"]: r["worse"] for r in got} == {"accuracy": False, "macro_f1": True, "cohen_kappa": False}
