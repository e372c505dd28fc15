"""Equi-joins whose left side may repeat one key for a large part of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
# Keys that hold at least this share of the rows are spread; there can be at most 1/SHARE of them.
SHARE = 0.002
_KEY, _SALT = "_join_key", "_salt"


def hot_keys(df: DataFrame, on: Sequence[str], share: float = SHARE) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows.

    A frequent-items sketch finds them in one pass without a shuffle of the
    rows; an inexact sketch costs speed only, never a result row.
    """
    most = int(1 / share)
    sketch = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.call_function("approx_top_k", _hash(on), F.lit(most), F.lit(most * 20)).alias("top"),
    ).first()
    return sorted(item["item"] for item in sketch["top"] if item["count"] >= max(share * sketch["n"], 1000))


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread: Sequence[str] | None = None,
    hot: list[int] | None = None,
) -> DataFrame:
    """``left`` joined to ``right`` (inner, left, left_semi or left_anti) on equal keys.

    Rows of the ``hot`` left keys (hashes, as ``hot_keys`` finds them) are spread
    over salts by the hash of their ``spread`` columns (a unique row key), and
    only the matching right rows are repeated once per salt. Without hot keys
    this is the plain join, whose skew adaptive execution splits.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    if not hot:
        return left.join(right, list(on), how)
    is_hot = _hash(on).isin(*hot)
    salt = F.pmod(F.xxhash64(*(spread or left.columns)), F.lit(SALTS))
    salted = left.withColumn(_SALT, F.when(is_hot, salt).otherwise(F.lit(0)))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn(_SALT, F.explode(every)).withColumn(_SALT, F.col(_SALT).cast("bigint"))
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)


def _hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*on)
