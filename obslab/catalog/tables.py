"""The test tables seen as labelled observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslab.spec import DatasetSpec

# Fixed values of the test tables.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

ORDERS = DatasetSpec(
    label="o_orderstatus",
    numeric=("o_totalprice",),
    categorical=("o_orderpriority",),
    context=("o_custkey",),
    key=("o_orderkey",),
    labels=("F", "O", "P"),
    categories={"o_orderpriority": (*(p.lower() for p in PRIORITIES), "unknown")},
)
LINES = DatasetSpec(
    label="l_returnflag",
    numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    categorical=("l_linestatus",),
    key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    labels=("A", "N", "R"),
    categories={"l_linestatus": ("f", "o", "unknown")},
)
# Few discrete features: many identical combinations, most with contradicting labels.
LINES_SMALL = DatasetSpec(
    label="l_returnflag",
    numeric=("l_quantity", "l_discount", "l_tax"),
    categorical=("l_linestatus",),
    key=LINES.key,
    labels=LINES.labels,
    categories=LINES.categories,
)
PARTS = DatasetSpec(
    label="p_brand",
    numeric=("p_size", "p_retailprice"),
    categorical=("p_type",),
    key=("p_partkey",),
    labels=tuple(f"Brand#{i}" for i in range(1, 26)),
)
EVENTS = DatasetSpec(
    label="grade",
    numeric=("value",),
    categorical=("event_type",),
    key=("event_id",),
    labels=("high", "low", "mid"),
    categories={"event_type": (*EVENT_TYPES, "unknown")},
)
DOCS = DatasetSpec(
    label="quality",
    numeric=("n_chars",),
    categorical=("lang",),
    context=("source",),
    key=("doc_id",),
    labels=("0", "1"),
    categories={"lang": ("de", "en", "es", "fr", "unknown")},
    confirmed="validated_quality",
)
EMBEDDING_SIZE = 64
EMBEDDINGS = DatasetSpec(
    label="label",
    numeric=tuple(f"e{i}" for i in range(EMBEDDING_SIZE)),
    key=("vec_id",),
    labels=tuple(str(i) for i in range(10)),
)
# Training sets built from orders: the price in steps of 100 gives repeated combinations. There are so many prices only: the more
# orders, the more combinations carry every label and contradict themselves, until no row is left. ``finer`` steps, so many to
# 100 as there are ``STEP_ROWS`` orders, keep the copies of a combination as many as they are in the first ``STEP_ROWS``.
STEP_ROWS = 150_000
STEPS = DatasetSpec(
    label="status",
    numeric=("price_step",),
    categorical=("priority",),
    key=("o_orderkey",),
    labels=("F", "O", "P"),
    categories={"priority": (*(p.lower() for p in PRIORITIES), "unknown")},
    confirmed="validated_status",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` with missing sizes and types, which the stored table does not have."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_retailprice",
        F.nullif(F.col("p_size") % 7, F.lit(0)).cast("double").alias("p_size"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("p_type"),
    )


PARTS_SQL = """
  SELECT p_partkey, p_brand, p_retailprice,
         CAST(nullif(p_size % 7, 0) AS DOUBLE) AS p_size,
         CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS p_type
  FROM part
"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw(table(spark, sf_dir, "events"))


def as_raw(events: DataFrame) -> DataFrame:
    """Events as they might arrive: numbers as text, some of them unusable."""
    value = F.col("value").cast("string")
    case = F.col("event_id") % 12
    return events.select(
        "event_id",
        F.when(case == 0, "").when(case == 1, "text").when(case == 2, "NaN").when(case == 3, "-inf")
        .when(case == 4, "0").when(case == 5, F.concat(F.lit("-"), value)).when(case == 6, "18d")
        .when(case == 7, F.concat(F.lit("\t "), value, F.lit(" \n"))).when(case == 8, "1_000.5")
        .when(case != 9, value).alias("value"),
        F.when(case == 10, F.concat(F.lit(" "), F.upper("event_type"), F.lit("\t")))
        .when(F.col("user_id") % 9 == 0, " NA ").when(F.col("user_id") % 9 == 1, "")
        .when(F.col("user_id") % 9 == 2, "other").when(F.col("user_id") % 9 != 3, F.col("event_type"))
        .alias("event_type"),
        F.when(F.col("value") >= 20, "high").when(F.col("value") >= 5, "mid").when(F.col("value") >= 0.5, "low")
        .otherwise("none").alias("grade"),
    )


RAW_EVENTS_SQL = r"""
  SELECT event_id,
         CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'text' WHEN 2 THEN 'NaN' WHEN 3 THEN '-inf'
              WHEN 4 THEN '0' WHEN 5 THEN '-' || CAST(value AS VARCHAR) WHEN 6 THEN '18d'
              WHEN 7 THEN chr(9) || ' ' || CAST(value AS VARCHAR) || ' ' || chr(10)
              WHEN 8 THEN '1_000.5' WHEN 9 THEN NULL ELSE CAST(value AS VARCHAR) END AS value,
         CASE WHEN event_id % 12 = 10 THEN ' ' || upper(event_type) || chr(9)
              WHEN user_id % 9 = 0 THEN ' NA ' WHEN user_id % 9 = 1 THEN '' WHEN user_id % 9 = 2 THEN 'other'
              WHEN user_id % 9 = 3 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN value >= 20 THEN 'high' WHEN value >= 5 THEN 'mid' WHEN value >= 0.5 THEN 'low' ELSE 'none' END AS grade
  FROM events
"""


def step_reference(spark: SparkSession, sf_dir: str, finer: bool = False) -> DataFrame:
    """Older orders as the reference table."""
    return _steps(spark, sf_dir, finer).where(F.col("day") < "1999-01-01").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), "price_step", "priority"
    )


def step_log(spark: SparkSession, sf_dir: str, finer: bool = False) -> DataFrame:
    """Newer orders as the observation log; low-priority ones are not confirmed."""
    confirmed = F.when(F.col("priority") == "5-LOW", F.lit(" ")).otherwise(
        F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("\t"))
    )
    return _steps(spark, sf_dir, finer).where(F.col("day") >= "1999-01-01").select(
        "o_orderkey", confirmed.alias("validated_status"),
        F.concat(F.col("price_step").cast("decimal(38,1)").cast("string"), F.lit("0")).alias("price_step"), "priority",
    )


def _steps(spark: SparkSession, sf_dir: str, finer: bool) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    parts = -(-orders.count() // STEP_ROWS) if finer else 1
    return orders.select(
        "o_orderkey", "o_orderstatus",
        (F.floor(F.col("o_totalprice") / (100 / max(1, parts))) + 1).cast("double").alias("price_step"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
    )


# Rows of both sources after normalisation, as ``prepare_dataset`` sees them.
STEP_ROWS_SQL = """
  SELECT o_orderkey, o_orderstatus AS status,
         CAST(floor(o_totalprice / 100) + 1 AS DOUBLE) AS price_step,
         lower(o_orderpriority) AS priority,
         CASE WHEN CAST(o_orderdate AS DATE) < DATE '1999-01-01' THEN 0 ELSE 1 END AS source_rank
  FROM orders
  WHERE CAST(o_orderdate AS DATE) < DATE '1999-01-01' OR o_orderpriority <> '5-LOW'
"""
STEP_GROUPS_SQL = f"""
  SELECT price_step, priority, count(*) AS copies, min(status) <> max(status) AS conflict,
         arg_min(status, source_rank * 1000000000000 + o_orderkey) AS status,
         arg_min(o_orderkey, source_rank * 1000000000000 + o_orderkey) AS o_orderkey,
         min(source_rank) AS source_rank,
         CASE min(source_rank) WHEN 0 THEN 'reference' ELSE 'confirmed' END AS source
  FROM ({STEP_ROWS_SQL}) GROUP BY price_step, priority
"""
FEATURE_TEXT_SQL = "CAST(price_step AS VARCHAR) || ',\"' || priority || '\"'"
STEP_SNAPSHOT_SQL = f"""
  SELECT o_orderkey, price_step, priority, status, source, copies,
         sha256('[' || {FEATURE_TEXT_SQL} || ']') AS feature_id,
         sha256('[' || {FEATURE_TEXT_SQL} || ',"' || status || '"]') AS record_id
  FROM ({STEP_GROUPS_SQL}) WHERE NOT conflict
"""


def fingerprint_sql(ids: str) -> str:
    """SQL expression over a column of ids: count and two sums of hash slices, hashed."""
    part = lambda at: f"coalesce(sum(CAST(('0x' || substr(md5({ids}), {at}, 15)) AS BIGINT)), 0)"
    return f"sha256(count({ids}) || ':' || {part(1)} || ':' || {part(16)})"


def embeddings_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMBEDDING_SIZE)],
    )


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document statistics as observations, without labels of their own."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality")
