"""Mix sources to target weights by a low-discrepancy schedule over blocks of equal size.

Slot n takes the source whose interval of the cumulative weights holds frac((n + 1/2) * golden ratio): in any stretch of
the schedule every source comes in nearly its share. Each source's documents are shuffled by hash and cut into blocks of
equal word counts; its r-th slot takes block r of that stream, which starts again, three times at most, when it runs out.

Null sources are a source of their own, null text has no words, a document without words is never taken. Repeated rows are
documents of their own. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslab.llm.common import text_of, words_of

GOLDEN = (math.sqrt(5) - 1) / 2
MOST_PASSES = 3
#: Mean number of rows that one window holds.
WINDOW_ROWS = 1024


@dataclass(frozen=True)
class Share:
    """What the mix wants of one source."""

    source: str | None
    size: int
    target: float


def target_sizes(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = MOST_PASSES) -> dict[str | None, float]:
    """Share all sizes by weight; a target above ``most`` times its size stops there, its excess is shared out again."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in free)
        wanted = {s: left * weights[s] / weight for s in free}
        over = [s for s in free if wanted[s] > most * sizes[s]]
        if not over:
            return fixed | wanted
        fixed |= {s: float(most * sizes[s]) for s in over}


def rotating_weights(sources: list[str | None], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Sources by code point, null last, weigh 1, 2, 3 and again."""
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(order)}


def source_sizes(sized: DataFrame) -> dict[str | None, int]:
    """Words of each source. Sources are few by nature: a label of where a document is from."""
    return {r["source"]: int(r["words"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()}


def block_size(shares: list[Share]) -> int:
    """Words of a block: 1/1024 of the least target, 4096 at most, and not so few that slots pass 2^31."""
    least = min((s.target for s in shares if s.target >= 1), default=1.0)
    return max(1, min(4096, int(least // 1024)), math.ceil(sum(s.target for s in shares) / 2**31))


def schedule(spark, shares: list[Share], block: int) -> DataFrame:
    """Rows (slot, source_no, turn): the source of every slot and how many slots it had before."""
    total = sum(s.target for s in shares)
    bounds, at = [], 0.0
    for s in shares:
        at += s.target
        bounds.append(at / total)
    # The targets' sum is a whole number but for rounding, which must not add a slot.
    slots = spark.range(math.ceil(round(total, 6) / block)).withColumnRenamed("id", "slot")
    point = (F.col("slot") + F.lit(0.5)) * F.lit(GOLDEN)
    ends = F.array(*(F.lit(b) for b in bounds[:-1])) if len(bounds) > 1 else F.array().cast("array<double>")
    dealt = slots.withColumn("_u", point - F.floor(point)).withColumn(
        "source_no", F.size(F.filter(ends, lambda b: b <= F.col("_u")))
    ).withColumn("_part", F.floor(F.col("slot") / WINDOW_ROWS))
    counts = dealt.groupBy("source_no", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_no", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("source_no", "_part").orderBy("slot"))
    ranked = dealt.withColumn("_rank", inside).join(starts, ["source_no", "_part"])
    return ranked.select("slot", "source_no", (F.col("_start") + F.col("_rank") - 1).alias("turn"))


def placed(sized: DataFrame) -> DataFrame:
    """Adds ``begins``: words of the source that come before the document in its shuffled order.

    The order is that of a hash of doc_id. Its leading digits cut a source into parts of about WINDOW_ROWS rows: sums of
    parts are added up first, then the rows inside each part, so no window sees a whole source.
    """
    parts = max(1, sized.count() // WINDOW_ROWS)
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    part = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint") * F.lit(parts) / F.lit(2**32))
    rows = sized.withColumn("_order", order).withColumn("_part", part)
    sums = rows.groupBy("source_no", "_part").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_no", "_part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source_no", "_part").orderBy("_order", "size", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_no", "_part"])
    return joined.withColumn("begins", F.col("_start") + F.col("_inside")).drop("_order", "_part", "_start", "_inside")


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """One row for each piece of a document in a block: (row_no, source_no, turn, first, words).

    ``first`` is the piece's first word inside the document. A document comes once for each pass over its source that its
    target reaches into; a document without words has one row with a null turn.
    """
    passes = F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    turns = F.when((F.col("size") > 0) & (passes > 0), F.sequence(F.lit(0), F.least(passes, F.lit(MOST_PASSES)) - 1))
    again = rows.withColumn("_pass", F.explode_outer(turns))
    at = F.col("_pass") * F.col("source_size") + F.col("begins")
    cut = again.withColumn("_at", at).withColumn(
        "turn", F.explode_outer(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block)))
    )
    low = F.greatest(F.col("_at"), F.col("turn") * block)
    high = F.least(F.col("_at") + F.col("size"), (F.col("turn") + 1) * block, F.round("target").cast("bigint"))
    return cut.withColumn("first", low - F.col("_at")).withColumn("words", F.greatest(high - low, F.lit(0))).drop("_at", "_pass", "begins")


def mix(sized: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None) -> DataFrame:
    """The mixture itself: one row for each piece taken, (slot, turn, first, words) beside the document's columns.

    ``sized`` has row_no (unique), doc_id, source and size and is read several times, so it should be a stored table.
    Pieces with a null slot are documents, or parts of them, that the mix leaves out.
    """
    spark, sizes = sized.sparkSession, source_sizes(sized)
    wanted = target_sizes(sizes, weights or rotating_weights(list(sizes)))
    shares = [Share(s, sizes[s], wanted[s]) for s in rotating_weights(list(sizes))]
    if sum(s.target for s in shares) <= 0:
        return sized.selectExpr(
            "*", "0 as source_no", "0L as source_size", "0D as target", "null::bigint as turn", "null::bigint as first",
            "null::bigint as words", "null::bigint as slot")
    block = block or block_size(shares)
    table = spark.createDataFrame([(i, s.source, s.size, s.target) for i, s in enumerate(shares)], "source_no int, _s string, source_size bigint, target double")
    rows = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["_s"])).drop("_s")
    return blocks(placed(rows), block).join(schedule(spark, shares, block), ["source_no", "turn"], "left")


def sized_documents(df: DataFrame, *more: Column) -> DataFrame:
    """(row_no, doc_id, source, size, more): what the mix needs of the documents. Row numbers last once it is stored."""
    size = F.size(words_of(text_of())).cast("bigint").alias("size")
    return df.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "source", size, *more)


def taken_words(mixed: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, repeats counted."""
    words: Column = F.when(F.col("slot").isNotNull(), F.col("words"))
    return mixed.groupBy("row_no", "doc_id", "source", "size", "source_size", "target").agg(
        F.coalesce(F.sum(words), F.lit(0)).cast("bigint").alias("taken")
    )
