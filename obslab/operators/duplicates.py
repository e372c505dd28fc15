"""Exact duplicates, first-wins de-duplication and label conflicts.

Everything here is a grouped aggregate with map-side combining: a group of
copies shrinks to one row per map task before it is shuffled, however large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.spec import DatasetSpec


def duplicate_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, repeated groups, rows in them and redundant rows; missing equals missing."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    repeated = F.col("copies") > 1
    zero = F.lit(0)
    return groups.agg(
        F.coalesce(F.sum("copies"), zero).alias("row_count"),
        F.count_if(repeated).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(repeated, F.col("copies"))), zero).alias("rows_in_duplicate_groups"),
        F.coalesce(F.sum(F.col("copies") - 1), zero).alias("redundant_rows"),
    )


def group_identities(df: DataFrame, spec: DatasetSpec, order: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """One row per feature combination: its first row, its copies, its label conflict.

    ``order`` ranks the copies; ``carried`` columns are taken from the first one.
    """
    first = F.min(F.struct(*order, F.col(spec.label).alias("first_label"), *carried)).alias("first")
    return (
        df.groupBy(*spec.features)
        .agg(
            first,
            F.count(F.lit(1)).alias("copies"),
            (F.min(spec.label) != F.max(spec.label)).alias("conflict"),
        )
        .select(
            *spec.features,
            F.col("first.first_label").alias(spec.label),
            *(F.col("first")[c].alias(c) for c in dict.fromkeys([*order, *carried])),
            "copies",
            "conflict",
        )
    )


def dedupe_first_wins(df: DataFrame, spec: DatasetSpec, order: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The first row of every feature combination with the number of its copies."""
    return group_identities(df, spec, order, carried)


def label_conflicts(df: DataFrame, spec: DatasetSpec, order: Sequence[str]) -> DataFrame:
    """Feature combinations carrying several labels: per label its rows and first location.

    Two combining steps (per label, then per combination with at most one entry
    per label) replace a self join that would emit every pair of a group.
    """
    place: Column = F.min(F.struct(*order)).alias("place")
    per_label = df.groupBy(*spec.features, spec.label).agg(F.count(F.lit(1)).alias("n"), place)
    entry = F.struct(F.col("place"), F.col(spec.label).alias("label"), F.col("n"))
    groups = (
        per_label.groupBy(*spec.features)
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .where(F.size("entries") > 1)
    )
    # array_sort orders by place, so entry 0 is the row the others contradict.
    return groups.select(
        *spec.features,
        F.col("entries")[0]["label"].alias("first_label"),
        *(F.col("entries")[0]["place"][c].alias(f"first_{c}") for c in order),
        F.explode(F.slice("entries", 2, F.size("entries"))).alias("other"),
    ).select(
        "*",
        F.col("other.label").alias("conflicting_label"),
        *(F.col("other.place")[c].alias(f"conflicting_{c}") for c in order),
        F.col("other.n").alias("conflicting_rows"),
    ).drop("other")
