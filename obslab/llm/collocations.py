"""Frequent phrases whose words stick together, counted exactly in direct-address tiles.

A-Z become a-z, texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words. Everything is per
language; a null language is ``und``. A phrase can only be frequent if all its parts are, so phrases grow word by word:

1. words are counted, the frequent ones numbered by falling frequency, and every document becomes a row of numbers;
2. each pair of a frequent phrase and the frequent word after it is a cell of a matrix that is cut into tiles of 1024 x 1024.
   Tiles in the corner of the most frequent numbers are dense arrays, counted by ``bincount``; all others are counted by sorting
   their cells (sorted coordinate lists). Tiles meet by a shuffle and are added up, one at a time;
3. the frequent cells are the phrases of one word more; numbered by falling frequency again, they are the rows of the next
   matrix, up to the longest phrase.

Numbers are looked up in sorted files that workers map, so nothing is broadcast or held whole. Counts of parts meet in joins;
scores are exact: products are decimals of 38 digits, the division is that of whole numbers.

Defined results: null and empty texts have no words; repeated documents count as often as they stand there; ties of score and
count go by the phrase's UTF-8 bytes; an empty table, or one without frequent phrases, has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obslab.llm.common import stored
from obslab.llm.sorted_tables import SortedTable, write_sorted
from obslab.llm.word_batches import slices

LEAST, MOST_WORDS, TOP = 30, 4, 2000
#: A longer phrase with this share (in hundredths) of a candidate's count makes the candidate redundant.
COVERED = 80
SCALE = 2_000_000
#: Numbers along a tile's side, as a power of two, and dense tiles along each axis of a language.
TILE_BITS, DENSE_TILES = 10, 2
#: Dense tiles that a task holds, 4 MB each, before it hands them on.
HELD_TILES = 24
#: Words of encoded texts that a task works on at once.
POSITIONS = 1 << 20
#: Cells of other tiles for each bucket of the shuffle, about; and cells that a task gathers before it adds them up.
BUCKET_CELLS, GATHERED = 1 << 22, 1 << 21
#: Rows (a name and a number) of languages that may be broadcast.
BROADCAST_LANGUAGES = 100_000
#: Counting tasks whose tiles are added up by one task, level by level.
FAN = 256
_SEED = xxhash.xxh64_intdigest(b"2", 42)

# Bytes: 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words_of_batch(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order, the number of the text and of the piece (both rising) that each is from."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    # A break after every text keeps the last word of one and the first of the next apart.
    kind = np.insert(_KIND[data], ends[1:], 2)
    data = np.insert(_LOWER[data], ends[1:], 0)
    inside = kind == 0
    edges = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.r_[0, np.cumsum(stops - starts)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    pieces = np.cumsum(kind == 2)[starts] if len(starts) else starts
    rows = np.searchsorted(ends[1:] + np.arange(len(texts)), starts, "right")
    return words, rows, pieces


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(language, row numbers, texts) of the languages of a batch (lang, text)."""
    for part in slices(batch, 1):
        named = part.column(0).dictionary_encode()
        codes = named.indices.to_numpy()
        for code, lang in enumerate(named.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            yield lang, rows, part.column(1).take(pa.array(rows))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, _, texts in _languages(batch):
            named = words_of_batch(texts)[0].dictionary_encode()
            counts = np.bincount(named.indices.to_numpy(), minlength=len(named.dictionary)).astype(np.int64)
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), named.dictionary.cast(pa.string()), pa.array(counts)], ["lang", "word", "n"])


def _hashes(lang: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Spark's ``xxhash64(lang, word)`` and ``xxhash64('2', lang, word)``."""
    digest, tag = xxhash.xxh64_intdigest, lang.encode()
    seeds = digest(tag, 42), digest(tag, _SEED)
    coded = [w.encode() for w in words]
    return tuple(np.fromiter((digest(w, seed) for w in coded), np.uint64, len(coded)).view(np.int64) for seed in seeds)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """Adds ``id`` from 0 by (lang, order) over the whole table, and ``start``, the least id of the language.

    The rows are sorted by ranges; only the number of rows of each range meets on the driver.
    """
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange("lang", *order).sortWithinPartitions("lang", *order)
    kept = stored(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_place", place), "numbered")
    counts = sorted(kept.groupBy("_part").agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, first, n in counts:
        offsets.append((part, total - first))
        total += n
    table = spark.createDataFrame(offsets, "_part int, _offset bigint")
    named = kept.join(F.broadcast(table), "_part").withColumn("id", F.col("_place") + F.col("_offset")).drop("_part", "_place", "_offset")
    starts = named.groupBy("lang").agg(F.min("id").alias("start"))
    return stored(named.join(_few(starts), "lang"), "numbered")


def _few(languages: DataFrame) -> DataFrame:
    """One row for each language: broadcast, unless there are too many."""
    return F.broadcast(languages) if languages.count() <= BROADCAST_LANGUAGES else languages


def _encoder(vocabulary: SortedTable):
    """Documents (lang, text) as (start, ids): the numbers of frequent words, -1 once for whatever lies between them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows, texts in _languages(batch):
                words, of, pieces = words_of_batch(texts)
                named = words.dictionary_encode()
                one, two = _hashes(lang, named.dictionary.to_pylist())
                found, (_, ids, starts) = vocabulary.find(one, two)
                if not found.any():
                    continue
                ids = np.where(found, ids, -1)[named.indices.to_numpy()]
                cuts = np.flatnonzero(np.diff(pieces)) + 1
                ids, of = np.insert(ids, cuts, -1), np.insert(of, cuts, of[cuts - 1])
                # -1 ends every text; one stands for several.
                last = np.flatnonzero(np.diff(np.r_[of, len(rows)])) + 1
                ids, of = np.insert(ids, last, -1), np.insert(of, last, of[last - 1])
                kept = (ids != -1) | np.r_[True, ids[:-1] != -1]
                ids, of = ids[kept].astype("<i8"), of[kept]
                texts_, lengths = np.unique(of, return_counts=True)
                offsets = np.r_[0, np.cumsum(lengths * 8)].astype(np.int64)
                blobs = pa.Array.from_buffers(pa.large_binary(), len(texts_), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                start = int(starts[found][0])
                yield pa.RecordBatch.from_arrays([pa.array([start] * len(texts_), pa.int64()), blobs.cast(pa.binary())], ["start", "ids"])

    return encode


class _Cells:
    """Counts of the cells that one task meets: dense tiles as arrays, others as sorted lists by bucket."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets, self.dense, self.seen = width, buckets, {}, 0

    def add(self, left, right, left_start, right_start) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        side = DENSE_TILES << TILE_BITS
        row, column = left - left_start, right - right_start
        corner = (row < side) & (column < side)
        row, column = row[corner], column[corner]
        mask = (1 << TILE_BITS) - 1
        firsts = (left[corner] - (row & mask)) * self.width + right[corner] - (column & mask)
        inside = ((row & mask) << TILE_BITS) | (column & mask)
        tiles, which = np.unique(firsts, return_inverse=True)
        for t, first in enumerate(tiles.tolist()):
            if first not in self.dense and len(self.dense) >= HELD_TILES:
                yield from self.flush()
            array = self.dense.setdefault(first, np.zeros(1 << 2 * TILE_BITS, np.uint32))
            array += np.bincount(inside[which == t], minlength=len(array)).astype(np.uint32)
        self.seen += int(corner.sum())
        if self.seen >= 1 << 31:  # before a count could pass 32 bits
            yield from self.flush()
        cells, counts = np.unique(left[~corner] * self.width + right[~corner], return_counts=True)
        rows, columns = (cells // self.width) >> TILE_BITS, (cells % self.width) >> TILE_BITS
        mixed = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (columns.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        bucket = ((mixed >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, firsts = np.unique(bucket[order], return_index=True)
        for name, own in zip(names.tolist(), np.split(order, firsts[1:]) if len(names) else []):
            yield name, cells[own], counts[own]

    def flush(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Dense tiles have negative buckets, which tell their first cell."""
        for first, array in self.dense.items():
            at = np.flatnonzero(array)
            yield -1 - first, first + (at >> TILE_BITS) * self.width + (at & ((1 << TILE_BITS) - 1)), array[at]
        self.dense, self.seen = {}, 0


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, that width first."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


_CELLS = "bucket bigint, part bigint, cells binary, counts binary"


def _cell_rows(found: Iterator[tuple[int, np.ndarray, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
    for bucket, cells, counts in found:
        if len(cells):
            columns = [bucket], [part], [_narrow(np.diff(cells, prepend=0))], [_narrow(counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "part", "cells", "counts"])


def _counter(tables: list[SortedTable], width: int, buckets: int):
    """Cells (phrase, next word) of encoded documents; the tables name phrases of 2, 3, ... words."""

    ahead = len(tables) + 1

    def met(words, starts, ends, at):
        """Cells of the phrases that begin at ``POSITIONS`` words from ``at`` on, and the least numbers of their languages."""
        words = words[at : at + POSITIONS + ahead]
        start = starts[np.searchsorted(ends, np.arange(at, at + len(words)), "right")]
        phrase, phrase_start = words, start
        for k, table in enumerate(tables, 1):
            there = (phrase[:-1] >= 0) & (words[k:] >= 0)
            code, back = np.unique(phrase[:-1][there] * width + words[k:][there], return_inverse=True)
            found, (ids, firsts) = table.find(code)
            phrase, phrase_start = np.full(len(there), -1, np.int64), np.zeros(len(there), np.int64)
            phrase[there], phrase_start[there] = np.where(found, ids, -1)[back], firsts[back]
        # Both the phrase and the one that starts a word later must be frequent.
        both = np.flatnonzero((phrase[:-1] >= 0) & (phrase[1:] >= 0))
        return phrase[both], words[both + ahead], phrase_start[both], start[both + ahead]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, part = _Cells(width, buckets), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            blobs = batch.column(1)
            ends = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)
            words = np.frombuffer(blobs.buffers()[2], "<i8", (ends[-1] - ends[0]) // 8, ends[0])
            ends = (ends[1:] - ends[0]) // 8
            for at in range(0, len(words), POSITIONS):
                yield from _cell_rows(cells.add(*met(words, batch.column(0).to_numpy(), ends, at)), part)
        yield from _cell_rows(cells.flush(), part)

    return count


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    firsts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    return cells[firsts], np.add.reduceat(counts, firsts) if len(cells) else counts


class _Tile:
    """The sum of one bucket: a dense array for a negative number, else lists that are added up as they pile up."""

    def __init__(self, bucket: int, width: int):
        self.bucket, self.width = bucket, width
        self.first = -1 - bucket
        self.array = np.zeros(1 << 2 * TILE_BITS, np.int64) if bucket < 0 else None
        self.lists, self.size = [], 0

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        if self.array is not None:
            row, column = np.divmod(cells - self.first, self.width)
            self.array[(row << TILE_BITS) | column] += counts
            return
        self.lists.append((cells, counts))
        self.size += len(cells)
        if self.size > max(GATHERED, 2 * len(self.lists[0][0])) and len(self.lists) > 1:
            self.lists = [self.total()]
            self.size = len(self.lists[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.array is not None:
            at = np.flatnonzero(self.array)
            return self.first + (at >> TILE_BITS) * self.width + (at & ((1 << TILE_BITS) - 1)), self.array[at]
        return _summed(*(np.concatenate(parts) for parts in zip(*self.lists)))


def _tiles(batches: Iterator[pa.RecordBatch], width: int, group: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(bucket, part, cells, counts) of rows that come sorted by bucket and part // group."""
    now, tile = None, None
    for batch in batches:
        for bucket, part, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (bucket, part // group) != now:
                if tile is not None:
                    yield (*now, *tile.total())
                now, tile = (bucket, part // group), _Tile(bucket, width)
            tile.add(np.cumsum(_wide(cells)), _wide(counts))
    if tile is not None:
        yield (*now, *tile.total())


def _total(rows: DataFrame, parts: int, width: int, least: int, fan: int) -> DataFrame:
    """(left, right, n) of the cells met ``least`` times or more."""

    def between(batches):
        for bucket, part, cells, counts in _tiles(batches, width, fan):
            yield from _cell_rows([(bucket, cells, counts)], part)

    def final(batches):
        for _, _, cells, counts in _tiles(batches, width, 1 << 62):
            often = counts >= least
            left, right = np.divmod(cells[often], width)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (left, right, counts[often])], ["left", "right", "n"])

    while parts > fan:
        group = F.expr(f"part div {fan}")
        rows = rows.repartition("bucket", group).sortWithinPartitions("bucket", group).mapInArrow(between, _CELLS)
        parts = -(-parts // fan)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(final, "left bigint, right bigint, n bigint")


def phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most_words: int = MOST_WORDS, fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of 1 to ``most_words`` words met ``least`` times, and (lang, n) of all words."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    counted = rows.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = numbered(counted.where(F.col("n") >= least), F.desc("n"), "word")
    width, frequent = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = [words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")]
    if not width:
        return known[0], totals
    hashed = words.select(F.xxhash64("lang", "word").alias("key"), F.xxhash64(F.lit("2"), "lang", "word").alias("check"), "id", "start")
    vocabulary = write_sorted(hashed, "key", ["check", "id", "start"])
    encoded = stored(rows.mapInArrow(_encoder(vocabulary), "start bigint, ids binary"), "encoded")
    parts = encoded.rdd.getNumPartitions()
    encoded = encoded.withColumn("part", F.spark_partition_id().cast("bigint"))
    last, tables = words.select("lang", "id", F.col("word").alias("phrase")), []
    names = last
    for size in range(2, most_words + 1):
        if last.agg(F.max("id")).first()[0] * width >= 1 << 62:
            raise ValueError("the frequent phrases have more cells than 64 bits can number")
        buckets = 1 + frequent // BUCKET_CELLS
        cells = stored(_total(encoded.mapInArrow(_counter(tables, width, buckets), _CELLS), parts, width, least, fan), "cells")
        named = cells.join(last.withColumnRenamed("id", "left"), "left").join(
            names.select(F.col("id").alias("right"), F.col("phrase").alias("word")), "right")
        named = named.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "n", (F.col("left") * width + F.col("right")).alias("cell"))
        grown = numbered(named, F.desc("n"), "phrase")
        known.append(grown.select("lang", "phrase", F.lit(size).alias("size"), "n"))
        if size == most_words or not grown.head(1):
            break
        tables.append(write_sorted(grown.select("cell", "id", "start"), "cell", ["id", "start"]))
        last = grown.select("lang", "id", "phrase")
    found = known[0]
    for more in known[1:]:
        found = found.unionByName(more)
    return found, totals


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most_words: int = MOST_WORDS, top: int | None = TOP, fan: int = FAN,
) -> DataFrame:
    """Candidates that no longer phrase covers, by falling score; ``top`` for each language, or all."""
    found, totals = phrases(docs, lang, text, least, most_words, fan)
    candidates = found.where("size > 1")
    words = F.split("phrase", " ")
    cut = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    # The least score of all cuts, the first of those that tie.
    cuts = candidates.select("lang", "phrase", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), cut(F.lit(1), k).alias("left"), cut(k + 1, F.col("size") - k).alias("right")))).alias("cut"))
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "cut.*")
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # For each shorter phrase the largest count of a longer one that holds it.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: cut(i, n))))
    inner = candidates.where("size > 2").select("lang", "n", F.explode(F.array_distinct(spans)).alias("phrase"))
    cover = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    covered = F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(COVERED).cast("decimal(20,0)") * F.col("a")
    left = best.join(cover, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")).cast("bigint")
    ranked = left.select("lang", "phrase", "a", "best", place.alias("rank"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(_few(totals), "lang").select(
        "lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("bigint").alias("score"))
