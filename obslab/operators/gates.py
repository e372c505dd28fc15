"""Whole-table gates: one aggregate per gate, one report row per rule."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.functions.identity import feature_id, record_id
from obslab.functions.text import is_finite, is_measure
from obslab.operators.cleaning import ERRORS, normalise
from obslab.spec import DatasetSpec

SOURCES = ("reference", "confirmed")
# Allowed deviation of a probability sum from one.
SUM_TOLERANCE = 1e-8


def snapshot_gate(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Report ``(rule, violations, passed)`` for a training snapshot."""
    counts: dict[str, Column] = {"not_empty": (F.count(F.lit(1)) == 0).cast("bigint")}
    for c in spec.numeric:
        counts[f"{c}_is_measure"] = F.count_if(~is_measure(F.col(c).cast("double")))
    for c, allowed in spec.categories.items():
        counts[f"{c}_is_allowed"] = F.count_if(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)))
    counts[f"{spec.label}_is_allowed"] = F.count_if(
        ~F.coalesce(F.col(spec.label).isin(*spec.labels), F.lit(False))
    )
    if "source" in df.columns:
        counts["source_is_known"] = F.count_if(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)))
    for name in spec.class_order:
        counts[f"has_{name}"] = (F.count_if(F.col(spec.label) == F.lit(name)) == 0).cast("bigint")
    return _report(df, counts)


def _report(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    names = list(counts)
    totals = df.agg(*[counts[n].alias(f"g{i}") for i, n in enumerate(names)])
    rows = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"g{i}").cast("bigint").alias("violations")) for i, n in enumerate(names)
    ])
    return totals.select(F.inline(rows)).withColumn("passed", F.col("violations") == 0)


def training_gate(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One pass over a stored snapshot before it is used for an evaluation.

    Rows must be valid, ids must follow from the values, sources must be known
    and the reference part must hold every label.
    """
    checked = normalise(df, spec, "train")
    is_reference = F.col("source") == SOURCES[0]
    rules = {
        "not_empty": (F.count(F.lit(1)) == 0).cast("bigint"),
        "rows_are_valid": F.count_if(F.size(ERRORS) > 0),
        "source_is_known": F.count_if(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))),
        "ids_unchanged": F.count_if(_tampered(spec)),
    }
    for name in spec.class_order:
        present = F.count_if(is_reference & (F.col(spec.label) == F.lit(name)))
        rules[f"reference_has_{name}"] = (present == 0).cast("bigint")
    return _report(checked, rules)


def coverage_rules(spec: DatasetSpec) -> list[str]:
    """The rules of ``snapshot_gate`` that ask for rows, not whether rows are valid."""
    return ["not_empty", *(f"has_{name}" for name in spec.class_order)]


def require(report: DataFrame, spared: Collection[str] = ()) -> list[str]:
    """Raise when any rule of a gate report failed but the spared ones, whose failures are given back.

    The report has one row per rule.
    """
    failed = sorted(r["rule"] for r in report.where(~F.col("passed")).collect())
    if not set(failed) <= set(spared):
        raise ValueError(f"gate failed: {failed}")
    return failed


def tampered_rows(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows whose stored ids no longer follow from their normalised values."""
    return normalise(df, spec, "train").where(_tampered(spec))


def _tampered(spec: DatasetSpec) -> Column:
    return ~F.col("feature_id").eqNullSafe(feature_id(spec)) | ~F.col("record_id").eqNullSafe(record_id(spec))


def probability_violations(scored: DataFrame, labels: tuple[str, ...], column: str = "probabilities") -> DataFrame:
    """Rows whose class probabilities are not a distribution over exactly the allowed classes."""
    return scored.where(improper(F.col(column), labels))


def improper(probabilities: Column, labels: tuple[str, ...]) -> Column:
    """Whether a map is not a distribution over exactly the allowed classes.

    The map is named once only: a filter is moved below the model, which would answer again for every time it is named.
    """
    def proper(found: Column) -> Column:
        values = F.map_values(found)
        return (
            F.array_sort(F.map_keys(found)).eqNullSafe(F.array(*[F.lit(v) for v in sorted(labels)]))
            & F.forall(values, lambda p: is_finite(p) & (p >= 0) & (p <= 1))
            & (F.abs(F.aggregate(values, F.lit(0.0), lambda acc, p: acc + p) - 1) <= SUM_TOLERANCE)
        )

    return F.exists(F.array(probabilities), lambda found: ~F.coalesce(proper(found), F.lit(False)))


def range_violations(ranges: DataFrame) -> DataFrame:
    """Ranges must satisfy 0 < minimum <= median <= maximum, all finite."""
    low, mid, high = F.col("minimum"), F.col("median"), F.col("maximum")
    proper = is_finite(low) & is_finite(mid) & is_finite(high) & (low > 0) & (low <= mid) & (mid <= high)
    return ranges.where(~proper)
