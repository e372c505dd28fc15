"""The streaming jobs, each run over a whole table until nothing new is left."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from obslab.catalog.models import FOREST
from obslab.catalog.quality import SQL as QUALITY_SQL
from obslab.catalog.tables import EVENTS, LINES, as_raw, table
from obslab.operators.models import fit
from obslab.session import shared_dir
from obslab.streaming import jobs


def _stream(spark, sf_dir, name):
    return jobs.read_stream(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


def stream_ingest(spark, sf_dir):
    out = shared_dir(spark, "ingest")
    raw = as_raw(_stream(spark, sf_dir, "events"))
    jobs.ingest(raw, EVENTS, "serve", out, f"{out}-state").awaitTermination()
    good = spark.read.parquet(f"{out}/good").select("event_id", "event_type", F.lit("").alias("errors"))
    broken = spark.read.parquet(f"{out}/quarantine")
    return good.unionByName(broken.select("event_id", "event_type", F.array_join("errors", ",").alias("errors")))


def stream_score(spark, sf_dir):
    out = shared_dir(spark, "scored")
    model = fit(table(spark, sf_dir, "lineitem").select(*LINES.key, LINES.label, *LINES.features), LINES, FOREST)
    stream = _stream(spark, sf_dir, "lineitem").select(*LINES.key, *LINES.features)
    # The spec of stored rows: line status in capital letters, zero discounts refused.
    jobs.score_stream(stream, _serving(model), out, f"{out}-state").awaitTermination()
    known = F.col("predicted_l_returnflag").isin(*LINES.labels)
    scored = spark.read.parquet(f"{out}/scored").select(
        *LINES.key, F.lit("scored").alias("status"), F.lit("").alias("errors"), "model_version", known.alias("label_is_known"))
    refused = spark.read.parquet(f"{out}/refused").select(
        *LINES.key, F.lit("refused").alias("status"), F.array_join("errors", ",").alias("errors"),
        F.lit(None).cast("string").alias("model_version"), F.lit(False).alias("label_is_known"))
    return scored.unionByName(refused)


def _serving(model):
    return replace(model, spec=replace(model.spec, categories={"l_linestatus": ("F", "O", "unknown")}), version="v1")


def stream_dedupe(spark, sf_dir):
    """Every event arrives twice, the newest files first, in several batches; one copy is kept."""
    out, arriving = shared_dir(spark, "saved"), shared_dir(spark, "arriving")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"
    )
    schema = events.schema
    quarters = events.withColumn("part", F.pmod(F.unix_timestamp("ts"), F.lit(4))).persist()
    for part in (3, 2, 1, 0, 2):
        own = quarters.where(F.col("part") == part).drop("part")
        own.orderBy(F.desc("ts")).coalesce(1).write.mode("append").parquet(arriving)
        stream = jobs.read_stream(spark, arriving, schema, files_per_trigger=1)
        jobs.save_once(stream.unionAll(stream), "event_id", "ts", out, f"{out}-state").awaitTermination()
    quarters.unpersist()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


def stream_label_counts(spark, sf_dir):
    out = shared_dir(spark, "label-counts")
    log = as_raw(_stream(spark, sf_dir, "events")).withColumn(
        EVENTS.confirmed, F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("grade"))
    )
    jobs.running_label_counts(log, EVENTS, out, f"{out}-state").awaitTermination()
    return jobs.latest_counts(spark, out)


# Zero measures are refused, in the order of the spec; line status is always one of those allowed.
_REFUSED = ", ".join(f"CASE WHEN {c} <= 0 THEN '{c}:not_positive' END" for c in LINES.numeric)

QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_score": stream_score,
    "stream_dedupe": stream_dedupe,
    "stream_label_counts": stream_label_counts,
}

SQL = {
    "stream_ingest": f"SELECT event_id, event_type, errors FROM ({QUALITY_SQL['normalise_serve']})",
    "stream_score": f"""
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN errors = '' THEN 'scored' ELSE 'refused' END AS status, errors,
               CASE WHEN errors = '' THEN 'v1' END AS model_version, errors = '' AS label_is_known
        FROM (SELECT *, concat_ws(',', {_REFUSED}) AS errors FROM lineitem)
    """,
    "stream_dedupe": "SELECT event_id, user_id, event_type FROM events",
    "stream_label_counts": """
        SELECT CASE WHEN value >= 20 THEN 'high' WHEN value >= 5 THEN 'mid' ELSE 'low' END AS grade, count(*) AS n
        FROM events WHERE event_id % 3 <> 0 AND value >= 0.5 GROUP BY 1
    """,
}
