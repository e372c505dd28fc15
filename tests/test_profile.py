import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obslab.operators import profile
from obslab.spec import DatasetSpec


@pytest.mark.parametrize("partitions", [1, 7])
def test_order_statistics_equal_exact_quantiles(spark, partitions):
    rng = np.random.default_rng(3)
    n = 5000
    # A third of one group is a single value; the other columns are continuous and heavy-tailed.
    data = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.7, "big", "small"),
        "hot": np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 20, n)),
        "tail": rng.pareto(1.2, n),
        "sign": rng.normal(size=n),
    })
    data.loc[::13, "sign"] = np.nan
    columns, marks = ["hot", "tail", "sign"], (0.0, 0.25, 0.5, 0.9, 1.0)
    frame = spark.createDataFrame(data.astype(object).where(data.notna(), None), "g string, hot double, tail double, sign double")
    got = profile.order_statistics(frame.repartition(partitions), columns, marks, ("g",), accuracy=200).collect()
    assert len(got) == 6
    for r in got:
        values = data.loc[data["g"] == r["g"], r["feature"]].dropna()
        assert r["n"] == len(values)
        assert np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(values, marks), rtol=0, atol=1e-12)
        assert np.allclose([r["mean"], r["std"]], [values.mean(), values.std(ddof=1)])


def test_many_groups_take_the_distributed_way(spark, monkeypatch):
    monkeypatch.setattr(profile, "GROUP_LIMIT", 3)
    frame = spark.range(4000).select((F.col("id") % 5 * (F.col("id") % 3)).alias("g"), F.col("id").cast("double").alias("x"))
    got = {r["g"]: r["q0"] for r in profile.order_statistics(frame, ["x"], (0.5,), ("g",), accuracy=100).collect()}
    local = frame.toPandas()
    assert got == local.groupby("g")["x"].median().to_dict() and len(got) > 3


def test_tiny_groups(spark):
    frame = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 4.0), ("c", None)], "g string, x double")
    got = {r["g"]: (r["n"], r["q0"]) for r in profile.order_statistics(frame, ["x"], (0.5,), ("g",)).collect()}
    assert got == {"a": (1, 2.0), "b": (2, 2.5)}


def test_crosstab_leaves_out_missing_factors_and_fills_absent_cells(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "y"), ("b", None)], "p string, q string")
    got = {(r["p"], r["q"]): r["n"] for r in profile.crosstab(frame, "p", "q", (("a", "b"), ("x", "y"))).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1, ("a", "All"): 2, ("b", "All"): 1,
                   ("All", "x"): 2, ("All", "y"): 1, ("All", "All"): 3}


def test_counts(spark):
    spec = DatasetSpec(label="y", numeric=("x",), labels=("a", "b", "c"))
    frame = spark.createDataFrame([("a", 1.0), ("a", None), ("c", 2.0), (None, 3.0)], "y string, x double")
    assert {r["y"]: r["n"] for r in profile.class_counts(frame, spec).collect()} == {"a": 2, "b": 0, "c": 1}
    assert {r["column"]: r["n_missing"] for r in profile.null_counts(frame).collect()} == {"y": 1, "x": 1}
    assert {r["y"]: r["n"] for r in profile.value_counts(frame, "y").collect()} == {"a": 2, "c": 1, None: 1}
    assert [r["y"] for r in profile.distinct_values(frame, "y").collect()] == ["a", "c"]
    assert [r["passed"] for r in profile.min_class_gate(frame, spec, 2).orderBy("y").collect()] == [True, False, False]
    shape = profile.table_shape(frame).orderBy("position").collect()
    assert [(r["column"], r["type"], r["n_rows"], r["n_columns"]) for r in shape] == [
        ("y", "string", 4, 2), ("x", "double", 4, 2)]
