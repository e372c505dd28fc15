"""Exact ranks without putting a whole group into one task.

Rows are ordered by a uniformly distributed hash. Its leading hex digits are
buckets of about equal size, so a count per bucket tells which bucket holds a
wanted rank, and only that bucket has to be looked at more closely.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASH = "order_hash"
# Hex digits per level: 4096 buckets, and 4096 sub-buckets inside a chosen one.
WIDTH = 3
# Rows of one bucket that a single task may sort.
SMALL = 1_000_000
HASH_DIGITS = 32


def bucket_counts(rows: DataFrame, group: str) -> dict[str, dict[str, int]]:
    """Rows per group and bucket: at most 4096 counts for each allowed group."""
    return _counts(rows, group, WIDTH)


def _counts(rows: DataFrame, group: str, width: int) -> dict[str, dict[str, int]]:
    table = rows.groupBy(group, F.substring(HASH, 1, width).alias("bucket")).agg(F.count(F.lit(1)).alias("k"))
    counts: dict[str, dict[str, int]] = {}
    for name, bucket, k in table.collect():
        counts.setdefault(name, {})[bucket] = k
    return counts


def select_ranks(
    rows: DataFrame, group: str, counts: dict[str, dict[str, int]], wanted: Mapping[str, Sequence[int]]
) -> dict[str, list[str]]:
    """The hash at each wanted rank (1-based) of every group; rank 0 gives the empty string.

    ``rows(group, order_hash)`` must be unique per hash: a hash that goes on beyond its rank is an error. Each pass after the
    first count looks only at buckets that hold a wanted rank, 1/4096 of the
    rows per digit triple, until a bucket fits one task easily. What reaches the
    driver is bounded by groups x ranks x 4096 counts, never by the rows.
    """
    targets = [
        _locate(counts[name], name, cut, rank)
        for name, ranks in wanted.items() for cut, rank in enumerate(ranks) if rank > 0
    ]
    width = WIDTH
    while any(t.size > SMALL for t in targets):
        width += WIDTH
        if width > HASH_DIGITS:
            raise ValueError("row keys repeat too often: a unique row key is needed")
        finer = _counts(_held(rows, group, targets), group, width)
        targets = [
            _locate({b: k for b, k in finer[t.group].items() if b.startswith(t.bucket)}, t.group, t.cut, t.rank)
            for t in targets
        ]
    found = {name: [""] * len(ranks) for name, ranks in wanted.items()}
    if targets:
        # The row after a rank tells whether the hash there parts off more rows than wanted.
        picks = [F.lit(_tag(t.group, f"{t.bucket}:{t.rank + k}")) for t in targets for k in (0, 1)]
        bucket = F.substring(HASH, 1, width)
        place = F.row_number().over(Window.partitionBy(group, bucket).orderBy(HASH))
        ranked = _held(rows, group, targets).select(
            F.concat_ws("\0", F.col(group), F.concat_ws(":", bucket, place)).alias("pick"), HASH
        )
        at = dict(ranked.where(F.col("pick").isin(*picks)).collect())
        for t in targets:
            found[t.group][t.cut] = at[_tag(t.group, f"{t.bucket}:{t.rank}")]
            if at.get(_tag(t.group, f"{t.bucket}:{t.rank + 1}")) == found[t.group][t.cut]:
                raise ValueError("row keys repeat: rows that share a key cannot be split to the quota")
    return found


@dataclass(frozen=True)
class _Target:
    """A wanted rank: the bucket that holds it and the rank inside that bucket."""

    group: str
    cut: int
    bucket: str
    rank: int
    size: int


def _locate(buckets: Mapping[str, int], group: str, cut: int, rank: int) -> _Target:
    for bucket in sorted(buckets):
        if rank <= buckets[bucket]:
            return _Target(group, cut, bucket, rank, buckets[bucket])
        rank -= buckets[bucket]
    raise ValueError(f"{group!r} has fewer rows than the wanted rank")


def _tag(group: str, text: str) -> str:
    return f"{group}\0{text}"


def _held(rows: DataFrame, group: str, targets: Sequence[_Target]) -> DataFrame:
    tags = sorted({_tag(t.group, t.bucket) for t in targets})
    width = len(targets[0].bucket)
    return rows.where(F.concat_ws("\0", F.col(group), F.substring(HASH, 1, width)).isin(*tags))


def positions(rows: DataFrame, name: str = "position", width: int = 4) -> DataFrame:
    """Zero-based position of every row in hash order.

    A window per bucket ranks its rows and the counts of earlier buckets are
    added; the only global window runs over the 16**width bucket counts.
    """
    bucketed = rows.withColumn("bucket", F.substring(HASH, 1, width))
    counts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(HASH))
    return (
        bucketed.withColumn("place", place)
        .join(F.broadcast(offsets), "bucket")
        .withColumn(name, F.col("offset") + F.col("place") - 1)
        .drop("bucket", "place", "offset")
    )
