"""Streaming ingest, scoring, idempotent saving and running counts.

All jobs use the available-now trigger by default: they process what has
arrived since their checkpoint and stop, so they can be scheduled or left
running with another trigger. Output folders and checkpoints belong on shared
storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from obslab.operators.cleaning import ERRORS, normalise, only_confirmed
from obslab.operators.models import FittedModel, score
from obslab.session import is_folder, path_exists
from obslab.spec import DatasetSpec

AVAILABLE_NOW = {"availableNow": True}
SAVED_BUCKETS = 64


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files arriving in a folder, or one stored file, as a stream.

    ``files_per_trigger`` bounds one micro-batch, not the data: available-now
    runs as many batches as there are files.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def ingest(stream: DataFrame, spec: DatasetSpec, mode: str, out: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Validated rows and quarantined rows to two folders.

    Each micro-batch overwrites its own partition, so a batch repeated after a
    failure leaves one copy.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            good = F.size(ERRORS) == 0
            rows.where(good).drop(ERRORS).write.mode("overwrite").parquet(f"{out}/good/batch={number}")
            rows.where(~good).write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        finally:
            rows.unpersist()

    checked = normalise(stream, spec, mode)
    return _start(checked.writeStream.foreachBatch(write), checkpoint, trigger)


def score_stream(stream: DataFrame, model: FittedModel, out: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Scored rows and refused rows, with their codes, to two folders.

    Each micro-batch overwrites its own partition, so a batch repeated after a
    failure leaves one copy.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for part, kept in zip(("scored", "refused"), score(rows, model)):
                kept.write.mode("overwrite").parquet(f"{out}/{part}/batch={number}")
        finally:
            rows.unpersist()

    return _start(stream.writeStream.foreachBatch(write), checkpoint, trigger)


def save_once(stream: DataFrame, key: str, time: str, out: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Keeps one row per key, whatever the order of arrival: of a batch the earliest, of several batches the first's.

    What is saved is the state: a batch is compared with the keys that earlier
    batches saved. Both are partitioned by a hash of the key, so a batch reads
    the key column of the partitions that it touches. Each micro-batch
    overwrites its own folder, so a repeated one leaves one copy.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        every = F.struct(*batch.columns)
        earliest = batch.groupBy(F.col(key).alias("_key")).agg(F.min_by(every, F.col(time)).alias("_row")).select("_row.*")
        new = earliest.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(SAVED_BUCKETS)).cast("int"))
        if path_exists(spark, f"{out}/batch=*"):
            saved = spark.read.schema(T.StructType([*new.schema.fields]).add("batch", "integer")).parquet(out).where(F.col("batch") < number)
            same = (new["bucket"] == saved["bucket"]) & new[key].eqNullSafe(saved[key])
            new = new.join(saved.select("bucket", key), same, "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={number}")

    return _start(stream.writeStream.foreachBatch(write), checkpoint, trigger)


def running_label_counts(stream: DataFrame, spec: DatasetSpec, out: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Confirmed rows per label so far; the state is one counter per label."""
    counts = only_confirmed(stream, spec).where(F.col(spec.label).isin(*spec.labels)).groupBy(spec.label).agg(
        F.count(F.lit(1)).alias("n")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(counts.writeStream.outputMode("complete").foreachBatch(write), checkpoint, trigger)


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts of the newest micro-batch."""
    table = spark.read.parquet(out)
    newest = table.agg(F.max("batch").alias("batch"))
    return table.join(F.broadcast(newest), "batch").drop("batch")


def _start(writer, checkpoint: str, trigger) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE_NOW)).start()
