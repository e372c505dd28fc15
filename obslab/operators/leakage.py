"""Leakage audits and comparisons of row sets, snapshots and protocols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.operators.skew import salted_join

#: Key buckets whose digests tell where two protocols differ.
DIGEST_BUCKETS = 4096
_BUCKET = "_digest_bucket"


def exclude_holdout(
    rows: DataFrame, holdout: DataFrame, on: Sequence[str], spread: Sequence[str] | None = None,
    hot: list[int] | None = None,
) -> DataFrame:
    """Training rows whose features do not occur in the hold-out, whatever their source or label."""
    return salted_join(rows, holdout.select(*on).distinct(), on, "left_anti", spread, hot)


def split_overlap(df: DataFrame, left: Column, right: Column, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Feature combinations and row keys shared by two parts of a table.

    Both sides are counted per combination in one map-side combined pass, so a
    combination of any size becomes two numbers; missing values equal each other.
    """
    is_left, is_right = F.coalesce(left, F.lit(False)), F.coalesce(right, F.lit(False))
    sides = lambda keys: df.groupBy(*keys).agg(F.count_if(is_left).alias("l"), F.count_if(is_right).alias("r"))
    common = (F.col("l") > 0) & (F.col("r") > 0)
    total = lambda side: F.coalesce(F.sum(F.when(common, F.col(side))), F.lit(0))
    tuples = sides(features).agg(
        F.count_if(common).alias("shared_feature_combinations"),
        total("l").alias("left_rows_with_match"),
        total("r").alias("right_rows_with_match"),
    )
    rows = sides(key).agg(F.count_if(common).alias("shared_rows"))
    return _long(tuples).unionByName(_long(rows))


def protocol_overlap(df: DataFrame, features: Sequence[str], folds: int, fold: str = "fold") -> DataFrame:
    """Shared feature combinations across every boundary of a protocol.

    ``fold`` is 0 on held-out rows and 1 to ``folds`` on training rows. Rows are
    counted per combination and fold once; hold-out and all folds are then
    compared from those few counters.
    """
    parts = range(folds + 1)
    counts = df.groupBy(*features).agg(*[F.count_if(F.col(fold) == i).alias(f"n{i}") for i in parts])
    training = sum((F.col(f"n{i}") for i in parts[1:]), F.lit(0))
    pairs = {"holdout": (training, F.col("n0"))}
    pairs.update({f"fold_{i}": (training - F.col(f"n{i}"), F.col(f"n{i}")) for i in parts[1:]})
    sides = F.array(*[
        F.struct(F.lit(name).alias("boundary"), left.alias("l"), right.alias("r")) for name, (left, right) in pairs.items()
    ])
    common = (F.col("l") > 0) & (F.col("r") > 0)
    total = lambda side: F.coalesce(F.sum(F.when(common, F.col(side))), F.lit(0))
    return counts.select(F.inline(sides)).groupBy("boundary").agg(
        F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"),
        F.count_if(common).alias("shared_feature_combinations"),
        total("l").alias("left_rows_with_match"),
        total("r").alias("right_rows_with_match"),
    )


def _long(df: DataFrame) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("n")) for c in df.columns
    ])))


def _sides(id_name: str, **sets: DataFrame) -> DataFrame:
    """How often every id occurs in each of the named sets, one shuffle for all sets."""
    tagged = None
    for name in sets:
        rows = sets[name].select(F.col(id_name).alias("id"), *[
            F.lit(1 if other == name else 0).cast("bigint").alias(other) for other in sets
        ])
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy("id").agg(*[F.sum(name).alias(name) for name in sets])


def snapshot_diff(a: DataFrame, b: DataFrame, id_name: str = "record_id") -> DataFrame:
    """Two snapshots are comparable only when their reference ids are the same multiset."""
    counts = _sides(id_name, a=a, b=b)
    return counts.agg(
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("ids_in_both"),
        F.count_if(F.col("b") == 0).alias("ids_only_in_a"),
        F.count_if(F.col("a") == 0).alias("ids_only_in_b"),
        (F.count_if(F.col("a") != F.col("b")) == 0).alias("same_ids"),
    )


def manifest_diff(
    current: DataFrame, previous: DataFrame, candidate: DataFrame | None = None, id_name: str = "record_id"
) -> DataFrame:
    """New and removed confirmations; a candidate is stale once it holds an id no longer confirmed."""
    candidate = current.limit(0) if candidate is None else candidate
    sets = _sides(id_name, current=current, previous=previous, candidate=candidate)
    is_in = lambda name: F.col(name) > 0
    new, removed = is_in("current") & ~is_in("previous"), is_in("previous") & ~is_in("current")
    return sets.agg(
        F.count_if(new).alias("new_confirmed"),
        F.count_if(removed).alias("removed_confirmed"),
        (F.count_if(new | removed) > 0).alias("can_train"),
        (F.count_if(is_in("candidate") & ~is_in("current")) == 0).alias("candidate_holds"),
    )


def protocol_diff(
    saved: DataFrame, recomputed: DataFrame, key: Sequence[str], columns: Sequence[str], buckets: int = DIGEST_BUCKETS
) -> DataFrame:
    """Rows whose split or fold differs between a saved and a recomputed protocol.

    One pass counts the rows of each key bucket and side and adds up two 64-bit
    hashes of each; only rows of buckets whose digests differ are joined, so equal
    protocols move one row per bucket and side. Two differing buckets would have
    to agree in both sums to be missed. Rows without a whole key match no other
    and are always reported.
    """
    side = lambda df, name: df.select(*key, *[F.col(c).cast("string").alias(f"{name}_{c}") for c in columns], _bucket(key, buckets).alias(_BUCKET))
    left, right = side(saved, "saved"), side(recomputed, "recomputed")
    parted = F.broadcast(differing_buckets(saved, recomputed, key, columns, buckets))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"saved_{c}").eqNullSafe(F.col(f"recomputed_{c}"))
    inside = lambda df: df.join(parted, _BUCKET, "left_semi").drop(_BUCKET)
    return inside(left).join(inside(right), list(key), "full_outer").where(differs)


def differing_buckets(saved: DataFrame, recomputed: DataFrame, key: Sequence[str], columns: Sequence[str], buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """The key buckets, at most ``buckets`` and one for rows without a whole key, whose rows may differ."""
    def digests(df: DataFrame, sign: int) -> DataFrame:
        texts = [F.col(c).cast("string") for c in (*key, *columns)]
        # A null leaves no trace in the hash, so its place is hashed too.
        parts = [p for t in texts for p in (t.isNull(), t)]
        sums = [(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)") * sign).alias(f"h{seed}") for seed in (1, 2)]
        return df.select(_bucket(key, buckets).alias(_BUCKET), F.lit(sign).cast("bigint").alias("n"), *sums)

    both = digests(saved, 1).unionByName(digests(recomputed, -1))
    balance = both.groupBy(_BUCKET).agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")])
    return balance.where((F.col(_BUCKET) < 0) | (F.col("n") != 0) | (F.col("h1") != 0) | (F.col("h2") != 0)).select(_BUCKET)


def _bucket(key: Sequence[str], buckets: int) -> Column:
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    return F.when(whole, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets))).otherwise(-1).cast("int")
