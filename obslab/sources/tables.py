"""Loading reference tables and writing study results."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obslab.functions.text import parse_stripped, strip
from obslab.session import path_exists
from obslab.spec import DatasetSpec


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Schema gate: reads no data, names every missing column."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def measures_schema(spec: DatasetSpec) -> T.StructType:
    """Explicit schema of a table: measures are doubles, the other roles text."""
    types = {c: T.DoubleType() for c in spec.numeric}
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in spec.role_columns])


def load_table(spark: SparkSession, path: str, spec: DatasetSpec, fmt: str = "parquet", as_text: bool = False) -> DataFrame:
    """Read a reference table and check that every role has its column.

    In CSV files ``NA`` and empty cells are missing values, and columns are
    matched by header name whatever their order. A measure that is no number
    stops the job; with ``as_text`` measures stay text, so that normalising
    them sets unreadable rows aside with a reason.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"reference table not found: {path}")
    if fmt == "csv":
        reader = spark.read.option("header", True).option("nullValue", "NA").option("emptyValue", None)
        raw = require_columns(reader.csv(path), spec.role_columns)
        typed = set() if as_text else set(spec.numeric)
        return raw.select(*((_number if c in typed else _text)(c).alias(c) for c in raw.columns))
    return require_columns(spark.read.format(fmt).load(path), spec.role_columns)


def _text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    number = parse_stripped(strip(_text(name)))
    refusal = F.raise_error(F.concat(F.lit(f"{name}: not a number: "), F.col(name)))
    return F.when(_text(name).isNull() | number.isNotNull(), number).otherwise(refusal.cast("double"))


def with_row_locator(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Unique row key for Parquet tables that have none: file name and row number.

    The locator is a property of the stored file, so it is the same on every
    read and after an executor is lost.
    """
    where = F.col("_metadata")
    return df.select("*", F.concat_ws("#", where["file_path"], where["row_index"]).alias(name))


def write_semicolon_csv(df: DataFrame, path: str, columns: Iterable[str]) -> None:
    """Result table as ``;``-separated text; columns outside ``columns`` are left out."""
    df.select(*columns).write.mode("errorifexists").option("sep", ";").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Metrics and metadata documents as JSON lines; NaN and infinities are refused at any depth, while writing."""
    refusal = "non-finite numbers cannot be stored as JSON"
    checked = df
    for field in df.schema.fields:
        broken = _not_finite(F.col(f"`{field.name}`"), field.dataType)
        if broken is not None:
            stop = F.raise_error(F.lit(f"{refusal}: ['{field.name}']")).cast(field.dataType)
            checked = checked.withColumn(field.name, F.when(F.coalesce(broken, F.lit(False)), stop).otherwise(F.col(f"`{field.name}`")))
    try:
        checked.write.mode("errorifexists").json(path)
    except PySparkException as error:
        if refusal in str(error):
            raise ValueError(str(error).partition(refusal)[1] + str(error).partition(refusal)[2].split("\n")[0]) from None
        raise


def _not_finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether a NaN or an infinity is anywhere inside; null if the type has no place for one."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if isinstance(kind, T.StructType):
        parts = [_not_finite(value.getField(f.name), f.dataType) for f in kind.fields]
        parts = [F.coalesce(p, F.lit(False)) for p in parts if p is not None]
        return reduce(or_, parts) if parts else None
    if isinstance(kind, T.ArrayType):
        inner = _not_finite(F.lit(None).cast(kind.elementType), kind.elementType) is not None
        return F.exists(value, lambda x: F.coalesce(_not_finite(x, kind.elementType), F.lit(False))) if inner else None
    if isinstance(kind, T.MapType):
        return _not_finite(F.map_values(value), T.ArrayType(kind.valueType))
    return None
