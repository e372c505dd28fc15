"""Splits, folds, subsets, permutations and protocol checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from obslab.catalog.tables import ORDERS, table
from obslab.operators import leakage, profile
from obslab.operators.splits import (
    FOLDS, LEARNING_FRACTIONS, explode_subsets, nested_subsets, permuted_column, stratified_split,
)
from obslab.plans.study import protocol, with_folds

_ROWS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*_ROWS)


def split(spark, sf_dir):
    return stratified_split(_orders(spark, sf_dir), ORDERS).select("o_orderkey", "split")


def split_counts(spark, sf_dir):
    rows = stratified_split(_orders(spark, sf_dir), ORDERS)
    return rows.groupBy("split", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def folds(spark, sf_dir):
    return with_folds(_orders(spark, sf_dir), ORDERS).select("o_orderkey", "fold")


def fold_counts(spark, sf_dir):
    rows = with_folds(_orders(spark, sf_dir), ORDERS)
    return rows.groupBy("fold", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def subsets(spark, sf_dir):
    marked = nested_subsets(_orders(spark, sf_dir), ORDERS)
    return explode_subsets(marked).groupBy("fraction", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum")
    )


def permuted(spark, sf_dir):
    return permuted_column(_orders(spark, sf_dir), "o_totalprice", ["o_orderkey"]).select(
        "o_orderkey", "o_totalprice", "o_totalprice_permuted"
    )


def min_class_gate(spark, sf_dir):
    training = stratified_split(_orders(spark, sf_dir), ORDERS).where("split = 'train'")
    return profile.min_class_gate(training, ORDERS, FOLDS)


def protocol_diff(spark, sf_dir):
    """The stored protocol against one recomputed with another seed: rows that moved."""
    saved = protocol(_orders(spark, sf_dir), ORDERS)
    other = protocol(_orders(spark, sf_dir), ORDERS, seed=43)
    moved = leakage.protocol_diff(saved, other, ["o_orderkey"], ["split", "fold"])
    return moved.select("o_orderkey", "saved_split", "recomputed_split", "saved_fold", "recomputed_fold")


def overlap(spark, sf_dir):
    """Combinations of priority and price step shared across the hold-out and every fold."""
    rows = protocol(table(spark, sf_dir, "orders").select(*_ROWS, "o_orderpriority"), ORDERS).withColumn(
        "price_step", F.floor(F.col("o_totalprice") / 100)
    )
    return leakage.protocol_overlap(rows, ["price_step", "o_orderpriority"], FOLDS)


QUERIES = {
    "stratified_split": split,
    "split_counts": split_counts,
    "stratified_folds": folds,
    "fold_counts": fold_counts,
    "nested_subsets": subsets,
    "permuted_column": permuted,
    "min_class_gate": min_class_gate,
    "protocol_diff": protocol_diff,
    "protocol_overlap": overlap,
}


def split_sql(seed: int = 42) -> str:
    """Rank within the label by hash; quotas by largest remainder."""
    return f"""
      SELECT o.o_orderkey, o.o_orderstatus,
             CASE WHEN row_number() OVER (PARTITION BY o.o_orderstatus ORDER BY md5('{seed}:' || o.o_orderkey)) <= quota
                  THEN 'test' ELSE 'train' END AS split
      FROM orders o JOIN (
        SELECT o_orderstatus,
               whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, o_orderstatus) <= wanted - sum(whole) OVER ()
                            THEN 1 ELSE 0 END AS quota
        FROM (SELECT o_orderstatus, wanted, CAST(floor(wanted * n / size) AS BIGINT) AS whole,
                     CAST(wanted * n AS BIGINT) % CAST(size AS BIGINT) AS rest
              FROM (SELECT o_orderstatus, n, sum(n) OVER () AS size, CAST(ceil(sum(n) OVER () * 0.25) AS BIGINT) AS wanted
                    FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)))
      ) q USING (o_orderstatus)
    """


def fold_sql(seed: int = 42, folds: int = FOLDS) -> str:
    """Round-robin quotas over the label-sorted training rows, filled in hash order."""
    return f"""
      WITH train AS (SELECT * FROM ({split_sql(seed)}) WHERE split = 'train'),
           c AS (SELECT o_orderstatus, n, coalesce(sum(n) OVER (ORDER BY o_orderstatus
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                 FROM (SELECT o_orderstatus, count(*) AS n FROM train GROUP BY 1)),
           q AS (SELECT o_orderstatus, f, sum(CAST(floor((start + n - f + {folds - 1}) / {folds}) AS BIGINT)
                                             - CAST(floor((start - f + {folds - 1}) / {folds}) AS BIGINT))
                        OVER (PARTITION BY o_orderstatus ORDER BY f) AS upto
                 FROM c, (SELECT unnest(range({folds})) AS f)),
           r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus
                        ORDER BY md5('{seed}:fold:' || o_orderkey)) AS place FROM train)
      SELECT r.o_orderkey, r.o_orderstatus, CAST(1 + count(*) FILTER (q.upto < r.place) AS INTEGER) AS fold
      FROM r JOIN q USING (o_orderstatus) GROUP BY r.o_orderkey, r.o_orderstatus, r.place
    """


def _protocol_sql(seed: int) -> str:
    return f"""
      SELECT s.o_orderkey, s.split, CAST(coalesce(f.fold, 0) AS VARCHAR) AS fold
      FROM ({split_sql(seed)}) s LEFT JOIN ({fold_sql(seed)}) f USING (o_orderkey)
    """


_TUPLES = f"""
  SELECT b.boundary, s, t, count(*) FILTER (l) AS l, count(*) FILTER (r) AS r
  FROM (SELECT floor(o_totalprice / 100) AS s, o_orderpriority AS t, CAST(fold AS INTEGER) AS fold
        FROM orders JOIN ({_protocol_sql(42)}) USING (o_orderkey)) o,
       (SELECT 'holdout' AS boundary, 0 AS f UNION ALL SELECT 'fold_' || i, i FROM range(1, {FOLDS + 1}) x(i)) b,
       LATERAL (SELECT fold = f AS r, fold > 0 AND fold <> f AS l)
  GROUP BY ALL
"""

SQL = {
    "stratified_split": f"SELECT o_orderkey, split FROM ({split_sql()})",
    "split_counts": f"SELECT split, o_orderstatus, count(*) AS n FROM ({split_sql()}) GROUP BY 1, 2",
    "stratified_folds": f"SELECT o_orderkey, fold FROM ({fold_sql()})",
    "fold_counts": f"SELECT fold, o_orderstatus, count(*) AS n FROM ({fold_sql()}) GROUP BY 1, 2",
    "nested_subsets": f"""
        SELECT fraction, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
        FROM (SELECT o_orderkey, o_orderstatus,
                     row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:subset:' || o_orderkey)) AS place,
                     count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders),
             (SELECT unnest([{", ".join(str(f) for f in LEARNING_FRACTIONS)}]::DOUBLE[]) AS fraction)
        WHERE place <= greatest(1, round_even(fraction * size, 0))
        GROUP BY 1, 2
    """,
    "permuted_column": """
        SELECT a.o_orderkey, a.o_totalprice, b.o_totalprice AS o_totalprice_permuted
        FROM (SELECT *, row_number() OVER (ORDER BY md5('42:to:' || o_orderkey)) AS place FROM orders) a
        JOIN (SELECT *, row_number() OVER (ORDER BY md5('42:from:' || o_orderkey)) AS place FROM orders) b USING (place)
    """,
    "min_class_gate": f"""
        SELECT o_orderstatus, count(*) AS n, count(*) >= {FOLDS} AS passed
        FROM ({split_sql()}) WHERE split = 'train' GROUP BY 1
    """,
    "protocol_overlap": f"""
        SELECT boundary, CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(r) AS BIGINT) AS right_rows,
               count(*) FILTER (l > 0 AND r > 0) AS shared_feature_combinations,
               CAST(coalesce(sum(l) FILTER (r > 0), 0) AS BIGINT) AS left_rows_with_match,
               CAST(coalesce(sum(r) FILTER (l > 0), 0) AS BIGINT) AS right_rows_with_match
        FROM ({_TUPLES}) GROUP BY boundary
    """,
    "protocol_diff": f"""
        SELECT a.o_orderkey, a.split AS saved_split, b.split AS recomputed_split,
               a.fold AS saved_fold, b.fold AS recomputed_fold
        FROM ({_protocol_sql(42)}) a JOIN ({_protocol_sql(43)}) b USING (o_orderkey)
        WHERE a.split <> b.split OR a.fold <> b.fold
    """,
}
