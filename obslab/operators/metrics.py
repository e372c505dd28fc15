"""Quality metrics, all derived from one confusion cube.

The cube ``(keys..., actual, predicted, n)`` is sized by runs x labels squared,
independent of the number of scored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("accuracy", "macro_f1", "cohen_kappa")
REGRESSION_TOLERANCE = 1e-9
SELECTION_TOLERANCE = 0.005
_EDGE = 1e-12


def confusion_cube(scored: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(cube: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Dense long form over the allowed labels, zero where a pair never occurs."""
    names = F.array(*[F.lit(v) for v in labels])
    empty = (
        cube.select(*keys).distinct() if keys else cube.sparkSession.range(1).select()
    ).select(*keys, F.explode(names).alias("actual")).select(*keys, "actual", F.explode(names).alias("predicted"))
    known = F.col("actual").isin(*labels) & F.col("predicted").isin(*labels)
    return (
        cube.where(known).select(*keys, "actual", "predicted", "n")
        .unionByName(empty.withColumn("n", F.lit(0).cast("bigint")))
        .groupBy(*keys, "actual", "predicted").agg(F.sum("n").alias("n"))
    )


def class_table(cube: DataFrame, keys: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """Per run and class: hits, support and predicted rows; ``labels`` adds absent classes as zeros."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    entry = lambda c, hits, support, named: F.struct(
        F.col(c).alias("class"), hits.cast("bigint").alias("hits"),
        support.cast("bigint").alias("support"), named.cast("bigint").alias("named"),
    )
    zero = F.lit(0)
    entries = [entry("actual", hit, F.col("n"), zero), entry("predicted", zero, zero, F.col("n"))]
    sides = cube.select(*keys, F.inline(F.array(*entries)))
    if labels:
        runs = cube.select(*keys).distinct() if keys else cube.sparkSession.range(1).select()
        zeros = [zero.cast("bigint").alias(c) for c in ("hits", "support", "named")]
        names = F.array(*[F.lit(v) for v in labels])
        sides = sides.unionByName(runs.select(*keys, F.explode(names).alias("class"), *zeros))
    return sides.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("hits", "support", "named")])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _f1() -> Column:
    return _ratio(2 * F.col("hits"), F.col("support") + F.col("named"))


def classification_metrics(cube: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro-F1 over the classes that occur, Cohen's kappa (null when undefined)."""
    rows = F.sum("support")
    expected = F.sum(F.col("support").cast("double") * F.col("named")) / (rows.cast("double") * rows)
    observed = F.sum("hits") / rows
    # Added in the order of the classes, so that the last bit does not depend on the order in which they come together.
    occurring = F.when(F.col("support") + F.col("named") > 0, F.struct("class", _f1().alias("f1")))
    scores = F.array_sort(F.collect_list(occurring))
    return class_table(cube, keys).groupBy(*keys).agg(
        rows.alias("n"),
        observed.alias("accuracy"),
        F.try_divide(F.aggregate(scores, F.lit(0.0), lambda total, score: total + score["f1"]), F.size(scores)).alias("macro_f1"),
        ((observed - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("cohen_kappa"),
    )


def classification_report(cube: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per allowed class, then the three summary rows."""
    classes = class_table(cube, labels=labels).select(
        "class",
        _ratio(F.col("hits"), F.col("named")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _f1().alias("f1"),
        "support", "hits",
    )
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    accuracy = F.sum("hits") / total
    row = lambda name, p, r, f: F.struct(
        F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), total.alias("support")
    )
    summary = classes.agg(F.array(
        row("accuracy", accuracy, accuracy, accuracy),
        row("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
        row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
    ).alias("rows"))
    return classes.drop("hits").unionByName(summary.select(F.inline("rows")))


def fold_summary(
    scores: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS, order: str = "fold", listed: bool = True
) -> DataFrame:
    """Mean and population std over folds, with the single scores in fold order."""
    parts = []
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
        if listed:
            # One score per fold of a variant.
            ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(m).alias("score"))))
            parts.append(F.transform(ordered, lambda pair: pair["score"]).alias(f"{m}_scores"))
    return scores.groupBy(*keys).agg(*parts)


def learning_summary(curve: DataFrame, metrics: Sequence[str]) -> DataFrame:
    parts = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return curve.groupBy("fraction").agg(F.avg("n_train").alias("n_train_mean"), *parts)


def metric_regression(candidate: DataFrame, baseline: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Side by side per metric; ``worse`` marks a candidate below the baseline beyond rounding."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics
        ])))

    both = long(candidate, "candidate").join(long(baseline, "baseline"), "metric")
    return both.withColumn("worse", F.col("candidate") < F.col("baseline") - REGRESSION_TOLERANCE)


def select_variant(summary: DataFrame, tolerance: float = SELECTION_TOLERANCE, name: str = "variant",
                   score: str = "validation_macro_f1_mean", size: str = "tree_nodes_mean") -> DataFrame:
    """The smallest variant whose score is within ``tolerance`` of the best one.

    The table has one row per variant; equal sizes go to the better score, then
    to the name. Marks every row as best, eligible and recommended.
    """
    table = Window.partitionBy(F.lit(0))
    best_first = F.row_number().over(table.orderBy(F.col(score).desc(), F.col(name)))
    eligible = F.col(score) >= F.max(score).over(table) - tolerance - _EDGE
    chosen_first = table.orderBy(F.col("eligible").desc(), F.col(size), F.col(score).desc(), F.col(name))
    return (
        summary.withColumn("is_best", best_first == 1)
        .withColumn("eligible", eligible)
        .withColumn("recommended", F.row_number().over(chosen_first) == 1)
    )
