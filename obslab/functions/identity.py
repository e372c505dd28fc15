"""Canonical record text and its hashes.

The canonical text of a record is a compact JSON array of its feature values,
so equal numbers written differently ("18", "18.00") get one identity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.spec import DatasetSpec


def canonical_number(value: Column) -> Column:
    """Shortest decimal text of a double, without exponent from 1e-4 up to 1e16."""
    number = value.cast("double")
    plain = number.cast("string")
    size = F.abs(number)
    digits = plain.try_cast("decimal(38,22)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ".0")
    wide = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(wide, trimmed).otherwise(plain)


def canonical_text(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def feature_id(spec: DatasetSpec) -> Column:
    return F.sha2(_array(_feature_parts(spec)), 256)


def record_id(spec: DatasetSpec, label: Column | None = None) -> Column:
    label = F.col(spec.label) if label is None else label
    return F.sha2(_array([*_feature_parts(spec), canonical_text(label)]), 256)


def _feature_parts(spec: DatasetSpec) -> list[Column]:
    return [
        *(canonical_number(F.col(c)) for c in spec.numeric),
        *(canonical_text(F.col(c)) for c in spec.categorical),
    ]


def _array(parts: Sequence[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(p, F.lit("null")) for p in parts)), F.lit("]"))


def order_hash(seed: int | str, *keys: Column) -> Column:
    """Reproducible pseudo-random sort key: depends on the seed and the row key only.

    Keys are joined by colons. Colons and backslashes inside a key are escaped and a null has a mark of its own, so
    different keys never give the same text.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(_key_part(k) for k in keys)))


def _key_part(key: Column) -> Column:
    text = key.cast("string")
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    return F.coalesce(escaped, F.lit("\\0"))


def _hash_number(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, *keys: str, ids: str = "record_id", name: str = "fingerprint") -> DataFrame:
    """Order-independent fingerprint of a multiset of ids.

    Sums of hash slices combine on the map side, so nothing is sorted or
    collected however many ids there are.
    """
    return df.groupBy(*keys).agg(*fingerprint_parts(F.col(ids))).select(
        *keys, "n_ids", fingerprint_text().alias(name)
    )


def fingerprint_parts(ids: Column, where: Column | None = None) -> list[Column]:
    chosen = ids if where is None else F.when(where, ids)
    zero = F.lit(0).cast("decimal(38,0)")
    return [
        F.count(chosen).alias("n_ids"),
        F.coalesce(F.sum(_hash_number(chosen, 1)), zero).alias("ids_low"),
        F.coalesce(F.sum(_hash_number(chosen, 16)), zero).alias("ids_high"),
    ]


def fingerprint_text() -> Column:
    parts = [F.col(c).cast("string") for c in ("n_ids", "ids_low", "ids_high")]
    return F.sha2(F.concat_ws(":", *parts), 256)
