"""Loading and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obslab.catalog.tables import LINES, ORDERS, PARTS, PARTS_SQL, PRIORITIES, parts_with_gaps, table
from obslab.functions.display import fixed, general, half_up, percent
from obslab.operators import profile
from obslab.operators.cleaning import clean, rows_with_nulls
from obslab.sources.tables import load_table

_MEASURES = LINES.numeric


def load_gate(spark, sf_dir):
    loaded = load_table(spark, f"{sf_dir}/orders.parquet", ORDERS).select(*ORDERS.role_columns)
    counts = loaded.agg(*[F.count(c).alias(c) for c in loaded.columns])
    return profile.unpivot_row(counts, loaded.columns, "column", "n_present")


def table_shape(spark, sf_dir):
    return profile.table_shape(table(spark, sf_dir, "orders"))


def head_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return profile.head_rows(rows, ["o_orderkey"])


def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority").orderBy(
        F.col("n").desc(), "o_orderpriority"
    )


def crosstab_margins(spark, sf_dir):
    levels = (ORDERS.labels, PRIORITIES)
    return profile.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", levels)


def describe_numeric(spark, sf_dir):
    return profile.describe_numeric(table(spark, sf_dir, "lineitem"), _MEASURES)


def class_ranges(spark, sf_dir):
    return profile.class_ranges(table(spark, sf_dir, "lineitem"), LINES)


def class_counts(spark, sf_dir):
    return profile.class_counts(table(spark, sf_dir, "lineitem"), LINES)


def distinct_values(spark, sf_dir):
    return profile.distinct_values(parts_with_gaps(spark, sf_dir), "p_type")


def feature_ranges(spark, sf_dir):
    return profile.feature_ranges(table(spark, sf_dir, "lineitem"), LINES, decimals=6)


def rounded_medians(spark, sf_dir):
    ranges = profile.feature_ranges(table(spark, sf_dir, "lineitem"), LINES)
    return ranges.select("feature", half_up(F.col("median"), 1).alias("median"))


def formatted_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
        F.max("l_extendedprice").alias("top"), F.max("l_tax").alias("tax"),
    )
    share = F.col("n_open") / F.col("n")
    return rows.select(
        "l_returnflag", fixed(share, 3).alias("fixed"), percent(share, 2).alias("percent"),
        general(F.col("top")).alias("top"), general(F.col("tax")).alias("tax"),
    )


def clean_table(spark, sf_dir):
    return clean(parts_with_gaps(spark, sf_dir), PARTS)


def null_counts(spark, sf_dir):
    return profile.null_counts(parts_with_gaps(spark, sf_dir))


def null_rows(spark, sf_dir):
    return rows_with_nulls(parts_with_gaps(spark, sf_dir))


def missing_crosstab(spark, sf_dir):
    return profile.missing_crosstab(parts_with_gaps(spark, sf_dir), PARTS, "p_type")


QUERIES = {
    "load_gate": load_gate,
    "table_shape": table_shape,
    "head_rows": head_rows,
    "value_counts": value_counts,
    "crosstab_margins": crosstab_margins,
    "describe_numeric": describe_numeric,
    "class_ranges": class_ranges,
    "class_counts": class_counts,
    "distinct_values": distinct_values,
    "feature_ranges": feature_ranges,
    "rounded_medians": rounded_medians,
    "formatted_metrics": formatted_metrics,
    "clean_table": clean_table,
    "null_counts": null_counts,
    "rows_with_nulls": null_rows,
    "missing_crosstab": missing_crosstab,
}


def _each(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


SQL = {
    "load_gate": _each('SELECT \'{c}\' AS "column", count({c}) AS n_present FROM orders', ORDERS.role_columns),
    "table_shape": """
        SELECT t.position, t."column", t.type, n.n_rows, 6 AS n_columns
        FROM (VALUES (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'),
                     (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp_ntz'),
                     (6, 'o_orderpriority', 'string')) AS t(position, "column", type),
             (SELECT count(*) AS n_rows FROM orders) n
    """,
    "head_rows": """
        SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5
    """,
    "value_counts": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "crosstab_margins": """
        SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority,
               count(*) AS n
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
    "describe_numeric": _each(
        "SELECT '{c}' AS feature, count({c}) AS n, round_even(avg({c}), 2) AS mean,"
        " round_even(stddev_samp({c}), 2) AS std, round_even(min({c}), 2) AS min,"
        " round_even(quantile_cont({c}, 0.25), 2) AS p25, round_even(quantile_cont({c}, 0.5), 2) AS p50,"
        " round_even(quantile_cont({c}, 0.75), 2) AS p75, round_even(max({c}), 2) AS max FROM lineitem",
        _MEASURES,
    ),
    "class_ranges": _each(
        "SELECT l_returnflag, '{c}' AS feature, round_even(min({c}), 2) AS minimum,"
        " round_even(median({c}), 2) AS median, round_even(max({c}), 2) AS maximum"
        " FROM lineitem GROUP BY l_returnflag",
        _MEASURES,
    ),
    "class_counts": """
        SELECT l.l_returnflag, count(lineitem.l_returnflag) AS n
        FROM (VALUES ('A'), ('N'), ('R')) AS l(l_returnflag) LEFT JOIN lineitem USING (l_returnflag) GROUP BY 1
    """,
    "distinct_values": f"SELECT DISTINCT p_type FROM ({PARTS_SQL}) WHERE p_type IS NOT NULL",
    "feature_ranges": _each(
        "SELECT '{c}' AS feature, round_even(min({c}), 6) AS minimum, round_even(median({c}), 6) AS median,"
        " round_even(max({c}), 6) AS maximum FROM lineitem",
        _MEASURES,
    ),
    "rounded_medians": _each("SELECT '{c}' AS feature, round(median({c}), 1) AS median FROM lineitem", _MEASURES),
    "formatted_metrics": """
        SELECT l_returnflag,
               replace(format('{:.3f}', share), '.', ',') AS fixed,
               replace(format('{:.2f}', share * 100), '.', ',') || ' %' AS percent,
               replace(format('{:g}', top), '.', ',') AS top,
               replace(format('{:g}', tax), '.', ',') AS tax
        FROM (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') / count(*) AS share,
                     max(l_extendedprice) AS top, max(l_tax) AS tax FROM lineitem GROUP BY 1)
    """,
    "clean_table": f"""
        SELECT p_brand, p_size, p_retailprice, p_type, p_partkey FROM ({PARTS_SQL})
        WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL
    """,
    "null_counts": _each(
        f'SELECT \'{{c}}\' AS "column", count(*) FILTER ({{c}} IS NULL) AS n_missing FROM ({PARTS_SQL})',
        ("p_partkey", "p_brand", "p_retailprice", "p_size", "p_type"),
    ),
    "rows_with_nulls": f"SELECT * FROM ({PARTS_SQL}) WHERE p_size IS NULL OR p_type IS NULL",
    "missing_crosstab": f"""
        SELECT CASE WHEN grouping(m) = 1 THEN 'All' ELSE m END AS measure_missing,
               CASE WHEN grouping(t) = 1 THEN 'All' ELSE t END AS category_missing, count(*) AS n
        FROM (SELECT CAST(p_size IS NULL OR p_retailprice IS NULL AS VARCHAR) AS m,
                     CAST(p_type IS NULL AS VARCHAR) AS t FROM ({PARTS_SQL}))
        GROUP BY CUBE (m, t)
    """,
}
