"""Flags for measures outside the range seen in training."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.functions.display import general
from obslab.spec import DatasetSpec

Ranges = Mapping[str, tuple[float, float]]


def collect_ranges(ranges: DataFrame) -> dict[str, tuple[float, float]]:
    """Model metadata: one row per numeric feature of the spec."""
    rows = ranges.select("feature", "minimum", "maximum").collect()
    return {r["feature"]: (r["minimum"], r["maximum"]) for r in rows}


def out_of_range(spec: DatasetSpec, ranges: Ranges) -> Column:
    """Names of the features outside their inclusive range; rows are never dropped."""
    return F.array_compact(F.array(*[
        F.when((F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1]), F.lit(c)) for c in spec.numeric
    ]))


def range_warnings(spec: DatasetSpec, ranges: Ranges) -> Column:
    """One readable warning per feature outside its range."""
    def text(c: str) -> Column:
        low, high = (general(F.lit(float(v))) for v in ranges[c])
        return F.concat(
            F.lit(f"{c}: value "), general(F.col(c)), F.lit(" is outside the training range "), low, F.lit(" to "), high
        )

    return F.array_compact(F.array(*[
        F.when((F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1]), text(c)) for c in spec.numeric
    ]))


def flag_ranges(df: DataFrame, spec: DatasetSpec, ranges: Ranges) -> DataFrame:
    return df.withColumns({"out_of_range": out_of_range(spec, ranges), "warnings": range_warnings(spec, ranges)})
