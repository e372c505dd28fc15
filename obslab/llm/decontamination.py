"""Benchmark passages inside documents: a prefix-filtered join of windows, all native expressions.

Words are runs of ``0-9``, ``a-z`` and every character beyond ASCII, after A-Z became a-z. A window is ``window`` consecutive
words of an item; an item with fewer words, but at least one, is one window. A window occurs in a document where all its words
stand one after the other.

Every window is a set of shingles (runs of up to ``SHINGLE`` words) at their places. One pass over the documents keeps the
places at which a shingle of any item stands; texts do not travel. How often the documents hold a shingle orders them by
rarity. All shingles of a window must be met, so its necessary prefix is the rarest one alone, and a window with a shingle that
no document holds is out. Places join that one shingle; a candidate must have room for the whole window around it (positional
and length bounds); and then every shingle of the window must stand at its place. Shingles are told apart by hashes of 64 bits:
a word that differs lies in several shingles of a longer window, each of which would have to collide.

Defined results: null and empty texts have no words, no hits and no items (the hash of the empty string); repeated documents
get a row each, repeated items count once; a null item id counts as the empty string; without items every document is clean.
Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslab.llm.common import let, stored

#: What lies between words, once A-Z is a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words of one shingle; shorter windows are one shingle of all their words.
SHINGLE = 5
#: Bytes of shingles or windows that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Two hashes of the whole row tell documents apart; rows with both equal have the same result.
ROW = ["_row_1", "_row_2"]


def words_of(text: Column) -> Column:
    """Words in order; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAP), "")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row hashes, text) of every document."""
    parts = [part for c in (key, text) for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    hashes = (F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts))
    return docs.select(F.col(f"`{key}`").alias("key"), *(h.alias(n) for h, n in zip(hashes, ROW)), F.col(f"`{text}`").alias("text"))


def item_windows(items: DataFrame, item_key: str, text: str, window: int) -> DataFrame:
    """Distinct (item, words) of all windows."""
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0))), lambda i: F.slice(w, i + 1, window))
    item = F.coalesce(F.col(f"`{item_key}`").cast("string"), F.lit(""))
    worded = items.select(item.alias("item"), words_of(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    return worded.select("item", F.explode(let(F.col("words"), cut)).alias("words")).distinct()


def _shingles(words: Column, size: int) -> Column:
    """(at, token) of every run of ``size`` words; fewer words have none."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.struct(
        i.alias("at"), F.xxhash64(F.lit(size), *(F.get(w, i + k) for k in range(size))).alias("token")))
    return F.when(F.size(words) >= size, let(words, runs)).otherwise(F.array().cast("array<struct<at:int,token:bigint>>"))


def _all_shingles(words: Column, sizes: list[int]) -> Column:
    return F.flatten(F.array(*(_shingles(words, n) for n in sizes))) if len(sizes) > 1 else _shingles(words, sizes[0])


def _small(table: DataFrame, bytes_: Column, limit: int) -> bool:
    """Whether the rows take at most ``limit`` bytes together, 64 for each row included."""
    return (table.agg(F.sum(bytes_ + 64)).first()[0] or 0) <= limit


def _met(keyed: DataFrame, tokens: DataFrame, sizes: list[int], limit: int) -> DataFrame:
    """(row hashes, n, at, token) of every place in a document of ``n`` words where a shingle of an item stands."""
    worded = keyed.select(*ROW, words_of(F.col("text")).alias("words"))
    placed = worded.select(*ROW, F.size("words").alias("n"), F.explode(_all_shingles(F.col("words"), sizes)).alias("s"))
    placed = placed.select(*ROW, "n", "s.at", "s.token")
    return stored(placed.join(F.broadcast(tokens) if _small(tokens, F.lit(8), limit) else tokens, "token", "left_semi"), "places")


def occurrences(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW,
    limit: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the join finds, as three tables that share the row hashes and the windows' numbers.

    The documents (key, row hashes, n_words); the occurrences (row hashes, start and length in words, window), each once for
    each different document; the windows of the items (item, window, words).
    """
    listed = stored(item_windows(items, item_key, text, window), "windows")
    windows = stored(listed.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())
    keyed = _keyed(docs, key, text)
    counted = keyed.select("key", *ROW, F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    own = F.size("words")
    runs = F.when(own >= SHINGLE, _shingles(F.col("words"), SHINGLE))
    for n in range(1, SHINGLE):
        runs = runs.when(own == n, _shingles(F.col("words"), n))
    shingles = windows.select("window", own.alias("length"), F.explode(runs).alias("s")).select("window", "length", F.col("s.at").alias("offset"), "s.token")
    shingles = stored(shingles, "window-shingles")
    met = _met(keyed, shingles.select("token").distinct(), sizes or [SHINGLE], limit)
    counts = met.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("s")
    prefixes = shingles.join(counts, "token", "left").groupBy("window", "length").agg(rarest, F.count(F.lit(1)).alias("needed"))
    prefixes = stored(prefixes.where("s.n > 0").select("window", "length", "needed", "s.token", "s.offset"), "prefixes")
    start = F.col("at") - F.col("offset")
    room = (start >= 0) & (start + F.col("length") <= F.col("n"))
    small = _small(prefixes, F.lit(40), limit)
    candidates = met.join(F.broadcast(prefixes) if small else prefixes, "token").where(room)
    candidates = candidates.select(*ROW, start.alias("start"), "window", "length", "needed").distinct()
    parts = shingles.select("window", "offset", "token")
    wanted = candidates.join(F.broadcast(parts) if _small(parts, F.lit(24), limit) else parts, "window")
    wanted = wanted.select(*ROW, "start", "window", "length", "needed", (F.col("start") + F.col("offset")).alias("at"), "token")
    held = wanted.join(met.select(*ROW, "at", "token").distinct(), [*ROW, "at", "token"])
    whole = held.groupBy(*ROW, "start", "window", "length", "needed").agg(F.count(F.lit(1)).alias("found")).where("found = needed")
    found = stored(whole.select(*ROW, "start", "length", "window"), "occurrences")
    return counted, found, listed.join(windows, "words").select("item", "window", "words")


def spans(found: DataFrame) -> DataFrame:
    """(row hashes, start, end) in words: the union of the occurrences as runs that do not touch."""
    inside = Window.partitionBy(*ROW).orderBy("start", "end")
    ranges = found.select(*ROW, "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reached = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = ranges.withColumn("opens", (reached.isNull() | (F.col("start") > reached)).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*ROW, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def report(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each document: its words, those inside an occurrence, the items that occur and whether any does."""
    counted, found, windows = occurrences(docs, items, key, item_key, text, window, limit)
    hit = spans(found).groupBy(*ROW).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    pairs = found.select(*ROW, "window").distinct().join(windows, "window").select(*ROW, "item").distinct()
    listed = pairs.groupBy(*ROW).agg(F.array_sort(F.collect_list("item")).alias("items"))
    told = counted.join(hit.join(listed, ROW), ROW, "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return told.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
