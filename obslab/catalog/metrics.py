"""Quality metrics of a rule that stands in for a classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from obslab.catalog.tables import ORDERS, table
from obslab.functions.display import half_even
from obslab.operators import metrics

_LABELS = ORDERS.class_order
_SCORES = ("accuracy", "macro_f1", "cohen_kappa")


def _scored(spark, sf_dir):
    """Two price rules as predictions; the five priorities serve as folds."""
    price = F.col("o_totalprice")
    cheap = F.when(price < 150000, "F").when(price < 330000, "O").otherwise("P")
    keyed = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).otherwise(cheap)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("actual"), cheap.alias("price_rule"), keyed.alias("keyed_rule"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("fold"),
    )


def _cube(spark, sf_dir, *keys, rule="price_rule"):
    return metrics.confusion_cube(_scored(spark, sf_dir), "actual", rule, keys)


def _rounded(df, *kept):
    return df.select(*kept, *[half_even(F.col(c), 9).alias(c) for c, t in df.dtypes if t == "double" and c not in kept])


def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_cube(spark, sf_dir, "fold"), (*_LABELS, "X"), ["fold"])


def classification_metrics(spark, sf_dir):
    return _rounded(metrics.classification_metrics(_cube(spark, sf_dir, "fold"), ["fold"]), "fold", "n")


def classification_report(spark, sf_dir):
    return _rounded(metrics.classification_report(_cube(spark, sf_dir), _LABELS), "class", "support")


def _variant_scores(spark, sf_dir):
    table_of = lambda rule: metrics.classification_metrics(
        _cube(spark, sf_dir, "fold", rule=rule), ["fold"]).withColumn("variant", F.lit(rule))
    return table_of("price_rule").unionByName(table_of("keyed_rule"))


def fold_summary(spark, sf_dir):
    summary = metrics.fold_summary(_variant_scores(spark, sf_dir), ["variant"])
    listed = [
        F.array_join(F.transform(f"{m}_scores", lambda v: F.format_string("%.6f", v)), ",").alias(f"{m}_scores")
        for m in _SCORES
    ]
    flat = [half_even(F.col(f"{m}_{n}"), 9).alias(f"{m}_{n}") for m in _SCORES for n in ("mean", "std")]
    return summary.select("variant", *flat, *listed)


def learning_summary(spark, sf_dir):
    """Both rules as two points of a learning curve."""
    curve = _variant_scores(spark, sf_dir).withColumns({
        "fraction": F.when(F.col("variant") == "price_rule", 0.5).otherwise(1.0), "n_train": F.col("n"),
    })
    return _rounded(metrics.learning_summary(curve, ["accuracy", "macro_f1"]), "fraction")


def metric_regression(spark, sf_dir):
    score = lambda rule: metrics.classification_metrics(_cube(spark, sf_dir, rule=rule))
    return _rounded(
        metrics.metric_regression(score("price_rule"), score("keyed_rule"), _SCORES), "metric", "worse"
    )


def variant_selection(spark, sf_dir):
    """Customers' market segments as variants, sized by their number of orders."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    summary = orders.join(customers, "o_custkey").groupBy(F.col("c_mktsegment").alias("variant")).agg(
        half_even(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 9).alias("validation_macro_f1_mean"),
        F.count(F.lit(1)).cast("double").alias("tree_nodes_mean"),
    )
    return metrics.select_variant(summary, 0.01)


QUERIES = {
    "confusion_matrix": confusion_matrix,
    "classification_metrics": classification_metrics,
    "classification_report": classification_report,
    "fold_summary": fold_summary,
    "learning_summary": learning_summary,
    "metric_regression": metric_regression,
    "variant_selection": variant_selection,
}

_CHEAP = "CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 330000 THEN 'O' ELSE 'P' END"
_SCORED = f"""
  SELECT o_orderstatus AS actual, {_CHEAP} AS price_rule,
         CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE {_CHEAP} END AS keyed_rule,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS fold
  FROM orders
"""


def _classes_sql(rule: str, key: str) -> str:
    return f"""
      SELECT k, c, count(*) FILTER (a = c AND p = c) AS hits, count(*) FILTER (a = c) AS support,
             count(*) FILTER (p = c) AS named
      FROM (SELECT {key} AS k, actual AS a, {rule} AS p FROM ({_SCORED})), (SELECT unnest(['F', 'O', 'P']) AS c)
      GROUP BY k, c
    """


def _metrics_sql(rule: str, key: str = "fold") -> str:
    return f"""
      SELECT k, n, accuracy, macro_f1, (accuracy - pe) / nullif(1 - pe, 0) AS cohen_kappa
      FROM (SELECT k, CAST(sum(support) AS BIGINT) AS n, sum(hits) / sum(support) AS accuracy,
                   avg(CASE WHEN support + named > 0 THEN 2.0 * hits / (support + named) END) AS macro_f1,
                   sum(CAST(support AS DOUBLE) * named) / (CAST(sum(support) AS DOUBLE) * sum(support)) AS pe
            FROM ({_classes_sql(rule, key)}) GROUP BY k)
    """


def _r(expression: str, name: str) -> str:
    return f"round_even({expression}, 9) AS {name}"


_BOTH = f"""
  SELECT 'price_rule' AS variant, * FROM ({_metrics_sql('price_rule')})
  UNION ALL SELECT 'keyed_rule', * FROM ({_metrics_sql('keyed_rule')})
"""

SQL = {
    "confusion_matrix": f"""
        SELECT fold, a AS actual, p AS predicted, count(s.actual) AS n
        FROM (SELECT DISTINCT fold FROM ({_SCORED})), (SELECT unnest(['F', 'O', 'P', 'X']) AS a),
             (SELECT unnest(['F', 'O', 'P', 'X']) AS p) LEFT JOIN ({_SCORED}) s
             ON s.fold = fold AND s.actual = a AND s.price_rule = p
        GROUP BY ALL
    """.replace("(SELECT DISTINCT fold FROM", "(SELECT DISTINCT fold AS run FROM").replace(
        "SELECT fold, a AS actual", "SELECT run AS fold, a AS actual").replace("s.fold = fold", "s.fold = run"),
    "classification_metrics": f"""
        SELECT k AS fold, n, {", ".join(_r(m, m) for m in _SCORES)} FROM ({_metrics_sql('price_rule')})
    """,
    "classification_report": f"""
        WITH c AS (SELECT c AS class, CASE WHEN named > 0 THEN hits / named ELSE 0 END AS precision,
                          CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
                          CASE WHEN support + named > 0 THEN 2.0 * hits / (support + named) ELSE 0 END AS f1,
                          support, hits FROM ({_classes_sql('price_rule', '0')})),
             t AS (SELECT CAST(sum(support) AS BIGINT) AS total FROM c)
        SELECT class, {", ".join(_r(m, m) for m in ("precision", "recall", "f1"))}, support
        FROM (SELECT class, precision, recall, f1, support FROM c
              UNION ALL SELECT 'accuracy', sum(hits) / any_value(total), sum(hits) / any_value(total),
                               sum(hits) / any_value(total), any_value(total) FROM c, t
              UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), any_value(total) FROM c, t
              UNION ALL SELECT 'weighted avg', sum(precision * support) / any_value(total),
                               sum(recall * support) / any_value(total), sum(f1 * support) / any_value(total),
                               any_value(total) FROM c, t)
    """,
    "fold_summary": f"""
        SELECT variant,
               {", ".join(_r(f"avg({m})", f"{m}_mean") + ", " + _r(f"stddev_pop({m})", f"{m}_std") for m in _SCORES)},
               {", ".join(f"string_agg(format('{{:.6f}}', {m}), ',' ORDER BY k) AS {m}_scores" for m in _SCORES)}
        FROM ({_BOTH}) GROUP BY variant
    """,
    "learning_summary": f"""
        SELECT CASE variant WHEN 'price_rule' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS fraction,
               {_r("avg(n)", "n_train_mean")}, {", ".join(
                   _r(f"avg({m})", f"{m}_mean") + ", " + _r(f"stddev_pop({m})", f"{m}_std")
                   for m in ("accuracy", "macro_f1"))}
        FROM ({_BOTH}) GROUP BY variant
    """,
    "metric_regression": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {_r('a.' + m, 'candidate')}, {_r('b.' + m, 'baseline')}, a.{m} < b.{m} - 1e-9 AS worse"
        f" FROM ({_metrics_sql('price_rule', '0')}) a, ({_metrics_sql('keyed_rule', '0')}) b"
        for m in _SCORES
    ),
    "variant_selection": """
        WITH s AS (SELECT c_mktsegment AS variant,
                          round_even(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 9) AS validation_macro_f1_mean,
                          CAST(count(*) AS DOUBLE) AS tree_nodes_mean
                   FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
             e AS (SELECT *, validation_macro_f1_mean >= max(validation_macro_f1_mean) OVER () - 0.01 - 1e-12 AS eligible
                   FROM s)
        SELECT *, row_number() OVER (ORDER BY validation_macro_f1_mean DESC, variant) = 1 AS is_best,
               row_number() OVER (ORDER BY eligible DESC, tree_nodes_mean, validation_macro_f1_mean DESC, variant) = 1
                 AS recommended
        FROM e
    """,
}
