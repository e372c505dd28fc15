"""The check that a model has to pass before it is stored with a version and before the version is adopted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.operators import gates
from obslab.operators.models import FittedModel
from obslab.operators.profile import feature_ranges


def release_check(model: FittedModel, golden: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Score a golden table and one row of feature medians; report broken rules.

    A model may be released when every rule has zero violations.
    """
    spec = model.spec
    example = golden.sparkSession.range(1).select(
        *[F.lit(float(medians[c])).alias(c) for c in spec.numeric], *[F.lit(spec.fill).alias(c) for c in spec.categorical]
    )
    rows = golden.select(*[F.col(c).cast("double").alias(c) for c in spec.numeric], *spec.categorical).unionByName(example)
    # One pass answers both rules, because scoring is what takes the time.
    predicted = F.col(f"predicted_{spec.label}")
    broken = model.predict(rows).agg(
        F.count_if(~F.coalesce(predicted.isin(*spec.labels), F.lit(False))).alias("predicted_label_is_allowed"),
        F.count_if(gates.improper(F.col("probabilities"), spec.labels)).alias("probabilities_are_proper"),
    )
    report = broken.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in broken.columns])))
    if model.ranges:
        limits = [(c, float(low), float(medians[c]), float(high)) for c, (low, high) in model.ranges.items()]
        disordered = gates.range_violations(
            golden.sparkSession.createDataFrame(limits, "feature string, minimum double, median double, maximum double")
        )
        report = report.unionByName(disordered.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit("ranges_are_ordered").alias("rule"), "violations"))
    return report.withColumn("passed", F.col("violations") == 0)


def require_release(model: FittedModel, golden: DataFrame) -> None:
    """Raises, naming the broken rules, unless the model passes on ``golden`` and its medians."""
    limits = feature_ranges(golden.select(*(F.col(c).cast("double").alias(c) for c in model.spec.numeric)), model.spec)
    medians = {r["feature"]: r["median"] for r in limits.collect()}
    broken = [r["rule"] for r in release_check(model, golden, medians).where("not passed").collect()]
    if broken:
        raise ValueError(f"the model may not be released: {broken}")
