"""The observation log: strict reading with quarantine, gated appending."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslab.functions.text import blank_to_null
from obslab.session import empty_files, path_exists, shared_dir
from obslab.spec import DatasetSpec

CORRUPT = "corrupt_record"
# Either a closed quoted value with doubled inner quotes, or a value without any quote.
_VALUE = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
_WELL_QUOTED = rf"^{_VALUE}(?:,{_VALUE})*+$"
# The first line of a record whose last value goes on in the next line, and a last line that closes such a value.
_OPENS = rf'^(?:{_VALUE},)*+"(?:[^"]++|"")*+$'
_CLOSES = rf'^(?:[^"]++|"")*+"(?:,{_VALUE})*+\r?$'
_PLACE = ["file_path", "block", "_id"]


def log_columns(spec: DatasetSpec) -> list[str]:
    """Fixed column order of the log; the confirmed label stands apart from the prediction."""
    return [
        "timestamp_utc",
        *spec.context,
        *spec.features,
        f"predicted_{spec.label}",
        *(f"probability_{name.lower()}" for name in spec.class_order),
        spec.confirmed,
    ]


def read_log(spark: SparkSession, path: str, spec: DatasetSpec) -> tuple[DataFrame, DataFrame]:
    """Read a CSV log as text columns; returns ``(rows, quarantine)``.

    A log that does not exist has no rows. One that exists must start with a
    header naming every feature and the confirmed label, without repeats, and
    all its files must start with the same header; a file without any line is
    refused as well. Records whose number of values or quoting is wrong go to
    the quarantine with file, number of the (first) line and raw text. Records
    with quoted line breaks are read whole, also where files are split inside
    them, see ``_spanning``; their line breaks stay as they are.
    """
    required = {*spec.features, spec.confirmed}
    if not path_exists(spark, path):
        empty = T.StructType([T.StructField(c, T.StringType()) for c in log_columns(spec)])
        broken = T.StructType([T.StructField(c, T.StringType()) for c in ("file_path", CORRUPT)]).add("line", T.LongType())
        return spark.createDataFrame([], empty), spark.createDataFrame([], broken)
    read = spark.read.text(path, lineSep="\n").select(
        # A byte order mark may precede the header.
        F.regexp_replace("value", r"^\x{FEFF}", "").alias("raw"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"),
    )
    lines = _unended(read)
    # The first line of every file, and whether any line leaves a quoted value open; one short row a file.
    firsts = lines.groupBy("file_path").agg(
        F.min_by(CORRUPT, F.struct("block", "_id")).alias("first"), F.max(F.col(CORRUPT).rlike(_OPENS)).alias("opens"))
    shown = firsts.groupBy("first").agg(F.min("file_path").alias("file_path"), F.max("opens").alias("opens"))
    shown = shown.withColumn("opens", F.max("opens").over(Window.partitionBy())).orderBy("file_path").limit(2).collect()
    header = next(csv.reader([shown[0]["first"]])) if shown else []
    missing = sorted(required - set(header))
    if missing:
        raise ValueError(f"{path}: line 1: required columns are missing: {missing}")
    if len(header) != len(set(header)):
        raise ValueError(f"{path}: line 1: column names are repeated")
    if len(shown) > 1:
        raise ValueError(f"{shown[1]['file_path']}: line 1: the header differs from the other files")
    empty = empty_files(spark, path)
    if empty:
        raise ValueError(f"{empty[0]}: line 1: the file is empty")
    is_header = F.col(CORRUPT) == F.lit(shown[0]["first"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "escape": "\""}
    parsed = F.from_csv(F.col(CORRUPT), _ddl(header), options).alias("r")
    intact = F.col("r._broken").isNull() & F.col(CORRUPT).rlike(_WELL_QUOTED)
    spanning = None
    if shown[0]["opens"]:
        folder = shared_dir(spark, "log-records")
        whole = _spanning(read, len(header), lambda df: df.withColumn("r", parsed).where(intact).drop("r"))
        whole.write.parquet(folder)
        spanning = spark.read.parquet(folder)
        inside = spanning.select("file_path", F.explode(F.sequence("open", "close")).alias("line"))
        lines = _unended(_numbered(read, _blocks(read)).join(inside, ["file_path", "line"], "left_anti").select(read.columns))
    # Only the first line of a file is its header: the same text further down is a record.
    again = lines.where(is_header).groupBy("file_path", CORRUPT).agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    again = again.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("n")))).drop("n")
    records = lines.where(~is_header).unionByName(again, allowMissingColumns=True)
    if spanning is not None:
        records = records.unionByName(spanning.select("file_path", CORRUPT), allowMissingColumns=True)
    records = records.select(*_PLACE, CORRUPT, parsed)
    broken = _numbered(records.where(~intact).drop("r"), _blocks(read)).select("file_path", CORRUPT, "line")
    return records.where(intact).select("r.*").drop("_broken"), broken


def _unended(read: DataFrame) -> DataFrame:
    """Lines with text, without the carriage return of a Windows line end."""
    return read.select("file_path", "block", "_id", F.regexp_replace("raw", r"\r$", "").alias(CORRUPT)).where(F.length(CORRUPT) > 0)


def _odd(raw: Column) -> Column:
    return F.pmod(F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit(""))), F.lit(2)) == 1


def _blocks(read: DataFrame) -> DataFrame:
    """One row for each split of a file: its first id, and the lines and the lines with an odd number of quotes before it.

    Ids are consecutive inside a split, so this small prefix sum over the splits numbers every line.
    """
    counted = read.groupBy("file_path", "block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(_odd(F.col("raw")).cast("bigint")).alias("_odd"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file_path", "block", "_first", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_odd")])


def _numbered(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``line``, the number in the file from 1."""
    joined = df.join(blocks, ["file_path", "block"], "left")
    return joined.withColumn("line", F.col("_id") - F.col("_first") + F.col("_n_before") + 1)


def _spanning(read: DataFrame, values: int, well_formed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(file_path, open, close, record) of the records over several lines, by a prefix scan over quote parity.

    Only lines with an odd number of quotes open or close a value. Two that follow each other are a record if the first
    leaves a value open, the second closes one, and all their lines together are well formed. In a sound file these are the
    first and second, the third and fourth, as one reader would find them; a stray quote shifts that order, and then a pair
    in between counts if it overlaps no other, so that what follows a broken record is not lost with it.
    """
    blocks = _blocks(read)
    rank = F.row_number().over(Window.partitionBy("file_path", "block").orderBy("_id")) + F.col("_odd_before")
    odd = _numbered(read.where(_odd(F.col("raw"))), blocks).withColumn("rank", rank)
    bare = lambda text: F.regexp_replace(text, r'"(?:[^"]++|"")*+"', "")
    commas = lambda text: F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    # Whole quoted values are taken away; what stands before the open one, or after the closed one, has the other commas.
    before = F.regexp_replace(bare(F.col("raw")), r'(?s)".*$', "")
    after = bare(F.regexp_replace("raw", r'^(?:[^"]++|"")*+"', ""))
    first = odd.where(F.col("raw").rlike(_OPENS)).select(
        "file_path", "rank", F.col("line").alias("open"), commas(before).alias("_commas"))
    second = odd.where(F.col("raw").rlike(_CLOSES)).select(
        "file_path", (F.col("rank") - 1).alias("rank"), F.col("line").alias("close"), commas(after).alias("_more"))
    pairs = first.join(second, ["file_path", "rank"]).where(F.col("_commas") + F.col("_more") + 1 == values)
    inside = pairs.select("file_path", "open", "close", "rank", F.explode(F.sequence("open", "close")).alias("line"))
    parts = _numbered(read, blocks).select("file_path", "line", "raw").join(inside, ["file_path", "line"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x.raw)
    texts = parts.groupBy("file_path", "open", "close", "rank").agg(
        F.regexp_replace(F.array_join(ordered, "\n"), r"\r$", "").alias(CORRUPT))
    found = well_formed(texts)
    due, other = found.where("rank % 2 = 1"), found.where("rank % 2 = 0")
    for own, theirs in (("open", "close"), ("close", "open")):
        other = other.join(due.select("file_path", F.col(theirs).alias(own)), ["file_path", own], "left_anti")
    return due.unionByName(other).drop("rank")


def _ddl(header: list[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in [*header, "_broken"])


def require_intact(quarantine: DataFrame) -> None:
    """Strict mode: any unreadable record stops the job, naming one location."""
    broken = quarantine.take(1)
    if broken:
        raise ValueError(f"{broken[0]['file_path']}: line {broken[0]['line']}: record cannot be read: {broken[0][CORRUPT]!r}")


def refused_labels(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows whose confirmed label is neither absent nor exactly an allowed label.

    Writing is stricter than reading: nothing is trimmed or re-spelled here.
    """
    given = F.coalesce(F.col(spec.confirmed), F.lit(""))
    return df.filter((given != "") & ~given.isin(*spec.labels))


def log_rows(scored: DataFrame, spec: DatasetSpec, at: Column | None = None) -> DataFrame:
    """Scored observations in log layout; absent confirmations become null."""
    stamp = F.current_timestamp() if at is None else at
    probability = F.col("probabilities")
    return scored.select(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp_utc"),
        *spec.context,
        *spec.features,
        F.col(f"predicted_{spec.label}"),
        *(probability[name].alias(f"probability_{name.lower()}") for name in spec.class_order),
        blank_to_null(F.col(spec.confirmed)).alias(spec.confirmed),
    )


def append_log(scored: DataFrame, spec: DatasetSpec, path: str, at: Column | None = None) -> str:
    """Append to the Parquet log, or write nothing when a confirmed label is refused.

    The rule is checked while writing, so scoring runs once; a refused row fails
    the job before its output is committed.
    """
    refusal = f"{spec.confirmed} must be empty or one of {list(spec.labels)}"
    given = F.coalesce(F.col(spec.confirmed), F.lit(""))
    checked = F.when((given == "") | given.isin(*spec.labels), F.col(spec.confirmed)).otherwise(F.raise_error(F.lit(refusal)))
    try:
        log_rows(scored.withColumn(spec.confirmed, checked), spec, at).write.mode("append").parquet(path)
    except PySparkException as error:
        if refusal in str(error):
            raise ValueError(refusal) from None
        raise
    return path
