"""Byte fingerprints of stored files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task holds as one value; larger files are read line by line.
WHOLE_BYTES = 32 << 20
#: More than any file has: what makes a file one split, and a split one partition.
_NO_LIMIT = 1 << 43


def file_fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file below ``path``.

    A small file is one value. A larger one, of any length, is read from its
    beginning to its end by one task that holds a batch of its lines at a time:
    SHA-256 is a chain, so its steps cannot be shared by tasks. Files that are
    compressed by their name are read as one value whatever their size, hence up
    to 2 GB, because line readers would unpack them.
    """
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": True}
    files = spark.read.format("binaryFile").options(**options).load(path)
    # A rule on the metadata alone: files are chosen while they are listed, and no byte of the others is read.
    name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
    by_lines = (size > WHOLE_BYTES) & ~reduce(or_, (F.lower(name).endswith(e) for e in _packed(spark)), F.lit(False))
    whole = files.where(~by_lines).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    # Each file is one partition only under settings of its own.
    alone = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    alone.conf.set("spark.sql.files.maxPartitionBytes", _NO_LIMIT)
    alone.conf.set("spark.sql.files.openCostInBytes", _NO_LIMIT)
    lines = alone.read.options(**options, lineSep="\n").text(path)
    lines = lines.where(by_lines).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes"),
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"),
    )
    found = whole.unionByName(lines.mapInArrow(_chain(), "path string, n_bytes bigint, sha256 string"))
    return found.select(F.regexp_replace("path", r"^.*/", "").alias("file"), "path", "n_bytes", "sha256")


def _packed(spark: SparkSession) -> list[str]:
    """Endings of the names that line readers take for compressed files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return sorted({jvm.org.apache.hadoop.util.ReflectionUtils.newInstance(c, conf).getDefaultExtension().lower() for c in codecs})


def _chain():
    """(path, n_bytes, sha256) of files whose lines come in order, each with a line feed at its end."""
    mark = b"\xef\xbb\xbf"

    def digests(batches):
        import hashlib
        from urllib.parse import unquote

        import numpy as np
        import pyarrow as pa

        def told():
            # Readers leave out a byte order mark, and the last line may end without a line feed: the length tells.
            path, length = here
            absent = length - read
            if absent >= 2:
                done, absent = marked, absent - len(mark)
            else:
                done = plain
            if absent not in (0, -1):
                raise ValueError(f"{path}: {read} bytes were read of {length}")
            if absent == 0:
                done.update(b"\n")
            kinds = (pa.string(), pa.int64(), pa.string())
            values = (unquote(path), length, done.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["path", "n_bytes", "sha256"])

        here, read = None, 0
        for batch in batches:
            names, sizes, lines = batch.columns
            at = 0
            while at < batch.num_rows:
                file = names[at].as_py(), sizes[at].as_py()
                if file != here:
                    if here:
                        yield told()
                    here, read, plain, marked = file, 0, hashlib.sha256(), hashlib.sha256(mark)
                end = batch.num_rows
                if names[end - 1].as_py() != file[0]:
                    end = next(i for i in range(at, end) if names[i].as_py() != file[0])
                part = lines.slice(at, end - at).cast(pa.binary())
                limits = np.frombuffer(part.buffers()[1], np.int32)
                first, last = int(limits[part.offset]), int(limits[part.offset + len(part)])
                # All but the last line feed, which may not be the file's.
                piece = part.buffers()[2][first : last - 1]
                for digest in (plain, marked):
                    if read:
                        digest.update(b"\n")
                    digest.update(piece)
                read += last - first
                at = end
        if here:
            yield told()

    return digests


def fingerprint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or changed between two fingerprint tables."""
    old = before.select("path", F.col("sha256").alias("sha256_before"))
    new = after.select("path", F.col("sha256").alias("sha256_after"))
    joined = old.join(new, "path", "full_outer").filter(~F.col("sha256_before").eqNullSafe(F.col("sha256_after")))
    change = (
        F.when(F.col("sha256_before").isNull(), "added")
        .when(F.col("sha256_after").isNull(), "removed")
        .otherwise("changed")
    )
    return joined.select("path", change.alias("change"))
