"""Column helpers and shared-folder tables used by several operators."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obslab.session import shared_dir

#: ASCII white space, the separators of words in every contract.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order, with repeats."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that a lambda over it does not evaluate it again for each element."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hash of each run of ``size`` words; a shorter text is one run, a text without words has none."""

    def runs(w: Column) -> Column:
        parts = [lambda i, k=k: F.get(w, i + F.lit(k)) for k in range(size)]
        many = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(p(i) for p in parts)))
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= size, many).when(F.size(w) > 0, one).otherwise(none)

    return let(words, runs)


def remainder(key: str, divisor: int) -> Column:
    """``crc32(key as text) mod divisor``; a null key counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % divisor, F.lit(0))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write the rows below the shared folder and read them back: lineage is cut and any executor may be lost."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark application, as ``--py-files`` would."""
    context, package = spark.sparkContext, pathlib.Path(__file__).resolve().parents[1]
    if getattr(context, "_obslab_shipped", False):
        return
    archive = pathlib.Path(tempfile.mkdtemp(prefix="obslab-py-")) / "obslab.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._obslab_shipped = True
