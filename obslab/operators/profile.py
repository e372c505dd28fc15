"""Profiling: counts, cross-tabs, exact order statistics, missingness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obslab.functions.display import half_even
from obslab.spec import DatasetSpec

# Rank error of the bracketing sketch is 1/ACCURACY of the rows of a group.
ACCURACY = 50_000
# Groups whose statistics may be held by the driver and broadcast.
GROUP_LIMIT = 10_000


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, missing values counted as a value of their own."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str, levels: tuple[Sequence, Sequence] | None = None) -> DataFrame:
    """Counts of two factors with ``All`` margins, long form ``(a, b, n)``.

    Rows with a missing factor are left out. The pair counts are made first, so
    the margins are summed from the few cells instead of expanding every row.
    ``levels`` zero-fills the cells that never occur.
    """
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if levels:
        cells = cells.unionByName(_grid(df, a, b, levels, cells))
    margin = lambda c: F.when(F.grouping(c) == 1, F.lit("All")).otherwise(F.col(c).cast("string")).alias(f"{c}_level")
    return (
        cells.cube(a, b)
        .agg(F.sum("n").alias("n"), margin(a), margin(b))
        .select(F.col(f"{a}_level").alias(a), F.col(f"{b}_level").alias(b), F.coalesce("n", F.lit(0)).alias("n"))
    )


def _grid(df: DataFrame, a: str, b: str, levels, cells: DataFrame) -> DataFrame:
    kinds = dict(cells.dtypes)
    one = df.sparkSession.range(1)
    lits = [F.array(*[F.lit(v).cast(kinds[c]) for v in values]) for c, values in zip((a, b), levels)]
    return (
        one.select(F.explode(lits[0]).alias(a))
        .select(a, F.explode(lits[1]).alias(b))
        .select(a, b, F.lit(0).cast("bigint").alias("n"))
    )


def missing_crosstab(df: DataFrame, spec: DatasetSpec, category: str) -> DataFrame:
    """Any measure missing x category missing, with margins."""
    flagged = df.select(
        reduce(or_, [F.col(c).isNull() for c in spec.numeric]).cast("string").alias("measure_missing"),
        F.col(category).isNull().cast("string").alias("category_missing"),
    )
    return crosstab(flagged, "measure_missing", "category_missing")


def null_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return unpivot_row(counts, df.columns, "column", "n_missing")


def table_shape(df: DataFrame) -> DataFrame:
    """One row per column: position, type and the table's row and column count."""
    kinds = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"))
        for i, (c, t) in enumerate(df.dtypes, start=1)
    ])
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.inline(kinds), "n_rows")
        .withColumn("n_columns", F.lit(len(df.columns)))
    )


def head_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def class_counts(df: DataFrame, spec: DatasetSpec, where: Column | None = None, name: str = "n") -> DataFrame:
    """Rows per allowed label, zero where a label never occurs; one map-side pass."""
    rule = F.lit(True) if where is None else where
    counts = df.agg(*[
        F.count_if((F.col(spec.label) == F.lit(v)) & rule).alias(f"c{i}") for i, v in enumerate(spec.class_order)
    ])
    rows = F.array(*[
        F.struct(F.lit(v).alias(spec.label), F.col(f"c{i}").alias(name)) for i, v in enumerate(spec.class_order)
    ])
    return counts.select(F.inline(rows))


def min_class_gate(df: DataFrame, spec: DatasetSpec, minimum: int) -> DataFrame:
    """Every allowed label needs at least ``minimum`` rows (one per fold)."""
    return class_counts(df, spec).withColumn("passed", F.col("n") >= minimum)


def unpivot_row(df: DataFrame, columns: Sequence[str], key: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(key), F.col(c).alias(value)) for c in columns])
    return df.select(F.inline(pairs))


def measures_long(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``(groups, feature, value)``: one narrow row per non-missing measure."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    return df.select(*groups, F.inline(pairs)).where(F.col("value").isNotNull())


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    groups: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact quantiles (linear interpolation) with count, mean, sample std, min and max.

    A mergeable sketch first brackets each quantile; then the rows below each
    bracket are counted, and only values inside one leave their row. Both are
    combined on the map side, and the exact value is read off those few counts.
    No row is repeated for a measure or a quantile, and no group is
    ever held whole, unlike an aggregate that keeps every distinct value.
    A bracket that misses its quantile stops the job rather than give a wrong value.
    """
    keys, size = [*groups, "feature"], len(probabilities)
    margin = 4.0 / accuracy
    lows = [max(0.0, p - margin) for p in probabilities]
    highs = [min(1.0, p + margin) for p in probabilities]
    # Columns by number: names of measures may clash with those of groups and results.
    wide = df.select(*groups, *[F.col(c).cast("double").alias(f"v{m}") for m, c in enumerate(columns)])
    stats = wide.groupBy(*groups).agg(*[
        F.struct(
            F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("minimum"),
            F.max(v).alias("maximum"), F.percentile_approx(v, lows + highs, accuracy).alias("marks"),
        ).alias(f"s{m}")
        for m, v in enumerate(f"v{m}" for m in range(len(columns)))
    ])
    # One row per group. The usual few are held as a small table and broadcast; very many stay distributed.
    held = stats.take(GROUP_LIMIT + 1)
    few = len(held) <= GROUP_LIMIT
    small = F.broadcast if few else (lambda table: table)
    if few:
        stats = df.sparkSession.createDataFrame(held, stats.schema)
    cells = [(m, i) for m in range(len(columns)) for i in range(size)]

    def limits(m: int, i: int) -> tuple[Column, Column]:
        s = F.col(f"s{m}")
        return (s["minimum"] if lows[i] == 0 else s["marks"][i]), (s["maximum"] if highs[i] == 1 else s["marks"][size + i])

    def named(table: DataFrame, part: str) -> DataFrame:
        """Long form of one struct a measure."""
        long = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{part}{m}").alias("_s")) for m, c in enumerate(columns)])
        return table.select(*groups, F.inline(long))

    basics = named(stats, "s").select(*keys, "_s.*").where("n > 0")
    if groups:
        bracketed = wide.join(small(stats), list(groups))
    else:
        known = stats.first()
        marked = [F.lit(known[f"s{m}"]["marks"]).cast("array<double>") for m in range(len(columns))]
        bracketed = wide.withColumns({
            f"s{m}": F.struct(
                F.lit(known[f"s{m}"]["minimum"]).cast("double").alias("minimum"), F.lit(known[f"s{m}"]["maximum"]).cast("double").alias("maximum"),
                (F.array(*map(F.lit, known[f"s{m}"]["marks"])) if known[f"s{m}"]["marks"] else marked[m]).alias("marks"))
            for m in range(len(columns))
        })
    # Rows below a bracket are only counted; rows of a bracket, a few in 50,000, become (measure, quantile, value).
    below = named(bracketed.groupBy(*groups).agg(*[
        F.array(*[F.count_if(F.col(f"v{m}") < limits(m, i)[0]) for i in range(size)]).alias(f"b{m}") for m in range(len(columns))
    ]), "b").select(*keys, F.posexplode("_s").alias("ix", "below"))
    inside = F.array_compact(F.array(*[
        F.when(F.col(f"v{m}").between(*limits(m, i)), F.struct(
            F.lit(columns[m]).alias("feature"), F.lit(i).alias("ix"), F.col(f"v{m}").alias("value")))
        for m, i in cells
    ]))
    counted = bracketed.select(*groups, F.inline(inside)).groupBy(*keys, "ix", "value").agg(F.count(F.lit(1)).alias("k"))
    running = Window.partitionBy(*keys, "ix").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    p = F.element_at(F.array(*[F.lit(float(v)) for v in probabilities]), F.col("ix") + 1)
    position = p * (F.col("n") - 1)
    reached = (
        counted.withColumn("_inside", F.sum("k").over(running))
        .join(small(below), [*keys, "ix"]).join(small(basics.select(*keys, "n")), keys)
        .withColumn("upto", F.col("below") + F.col("_inside"))
        .withColumn("rank", F.floor(position))
        .withColumn("share", position - F.floor(position))
        .groupBy(*keys, "ix")
        .agg(
            F.first("share").alias("share"),
            F.max(F.col("below") > F.col("rank")).alias("too_low"),
            F.min(F.when(F.col("upto") > F.col("rank"), F.col("value"))).alias("lower"),
            F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("value"))).alias("upper"),
        )
    )
    missed = F.col("too_low") | F.col("lower").isNull() | (F.col("upper").isNull() & (F.col("share") > 0))
    exact = F.col("lower") + F.when(F.col("share") > 0, F.col("share") * (F.col("upper") - F.col("lower"))).otherwise(0.0)
    checked = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank"))).otherwise(exact)
    values = reached.groupBy(*keys).agg(*[
        F.max(F.when(F.col("ix") == i, checked)).alias(f"q{i}") for i in range(size)
    ])
    return values.join(small(basics.drop("marks")), keys).select(
        *keys, "n", "mean", "std", "minimum", "maximum", *[f"q{i}" for i in range(size)]
    )


def describe_numeric(df: DataFrame, columns: Sequence[str], decimals: int = 2) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per measure, rounded half-even."""
    table = order_statistics(df, columns, (0.25, 0.5, 0.75))
    names = {"mean": "mean", "std": "std", "minimum": "min", "q0": "p25", "q1": "p50", "q2": "p75", "maximum": "max"}
    return table.select("feature", "n", *[half_even(F.col(c), decimals).alias(a) for c, a in names.items()])


def class_ranges(df: DataFrame, spec: DatasetSpec, decimals: int | None = 2) -> DataFrame:
    """Min, median and max of every measure within every label."""
    table = order_statistics(df, spec.numeric, (0.5,), groups=(spec.label,))
    return _ranges(table, (spec.label, "feature"), decimals)


def feature_ranges(df: DataFrame, spec: DatasetSpec, decimals: int | None = None) -> DataFrame:
    """Min, max and median of every measure over the whole table."""
    return _ranges(order_statistics(df, spec.numeric, (0.5,)), ("feature",), decimals)


def _ranges(table: DataFrame, keys: Sequence[str], decimals: int | None) -> DataFrame:
    names = {"minimum": "minimum", "q0": "median", "maximum": "maximum"}
    shown = lambda c: F.col(c) if decimals is None else half_even(F.col(c), decimals)
    return table.select(*keys, *[shown(c).alias(a) for c, a in names.items()])


def approximate_ranges(df: DataFrame, spec: DatasetSpec, accuracy: int = ACCURACY) -> DataFrame:
    """One-pass ranges whose median may be off by 1/accuracy of the rows."""
    return measures_long(df, spec.numeric).groupBy("feature").agg(
        F.min("value").alias("minimum"),
        F.percentile_approx("value", 0.5, accuracy).alias("median"),
        F.max("value").alias("maximum"),
    )
