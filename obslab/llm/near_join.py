"""Jaccard self-join of documents on word shingles by chosen paths, with classes of near copies.

After T. Christiani, R. Pagh and J. Sivertsen, Scalable and robust set similarity join. A node is a distinct set of
five-word shingles (texts with the same set are one node), embedded as 64 min-hashes. In each run every node follows, from
the root, the paths that sampled shared (place, min-hash) tokens name: 1 / threshold of them on average, so a pair at the
threshold is expected to share one. Buckets of at most ``limit`` nodes are compared by brute force. From larger ones, nodes
close to the bucket's pivot are compared at once (they are all alike: no path would part them), nodes not so close split
further; by the triangle inequality every pair of likeness over the threshold stays together in one of the two parts.
A bucket of which both parts would be nearly all is compared at once. Runs repeat until the target recall.

Buckets compare short sketches and drop all nodes without a likely partner. Only the rest gets its shingles, and pairs are
verified exactly, in blocks of a bounded number of nodes. A pair that meets in several buckets counts in the first only. No
pair leaves a task: a block gives each node's number of links, and one edge to its component's least node in the block.

Null texts are alone in their class; texts without a word are alike only if equal; texts of fewer than five words have one
shingle, the whole. Repeated rows share their class. Links count distinct other texts. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.llm.common import stored, text_of
from obslab.llm.components import components
from obslab.llm.word_batches import hash_words, words_of_batch

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Min-hashes of a node, nodes of a bucket that are compared at once, nodes of a block, and the deepest path.
PLACES, LIMIT, BLOCK, DEPTH = 64, 1024, 1024, 8
#: Least sketch likeness of a pair that is verified: four standard errors below the threshold.
LIKELY = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / PLACES)
#: Sketch likeness to a pivot: from CLOSE on nodes are compared at once, below FAR they split further. Two nodes' likeness
#: to the pivot differs by the places in which they differ themselves at most: a fifth at the threshold, and FAR - CLOSE
#: leaves two standard errors of that.
CLOSE, FAR = 0.25, 0.56
#: A node's chance of sharing a bucket with a partner at the threshold: 1 - exp(-1) on the first level; deeper ones sample
#: twice as many tokens and keep eight of ten such pairs at any depth.
SHARED = (1 - math.exp(-1)) * 0.797
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input moves every bit of the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


SEEDS = mixed(np.arange(1, PLACES + 1, dtype=np.uint64) * MULTIPLIER)
FLIPS, FACTORS = (SEEDS >> np.uint64(32)).astype(np.uint32), (SEEDS | np.uint64(1)).astype(np.uint32)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    found = words_of_batch(texts)
    words = hash_words(found.distinct)[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        runs = words.copy()
        for k in range(1, SHINGLE):
            runs[:-k] = runs[:-k] * MULTIPLIER + words[k:]
            runs[-k:] = 0
        out, a = [], 0
        for b in found.ends.tolist():
            if b - a >= SHINGLE:
                out.append(np.unique(mixed(runs[a : b - SHINGLE + 1])))
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    whole = whole * MULTIPLIER + w
                out.append(mixed(whole))
            else:
                out.append(np.zeros(0, np.uint64))
            a = b
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 20) // PLACES)
    parts = [((low[None, a : a + step] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1) for a in range(0, len(low), step)]
    return np.minimum.reduce(parts)


def sketch_rows(kind: pa.DataType, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text_key, set_key, sketch, brief) of (key, text_key, text); equal texts of a batch are sketched once."""
    names = [key, "text_key", "set_key", "sketch", "brief"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                named = part.column(2).dictionary_encode()
                sets = []
                for shingles in shingle_sets(named.dictionary):
                    if len(shingles):
                        hashes = min_hashes(shingles)
                        brief = (hashes * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                        sets.append((hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), hashes.astype("<u4").tobytes(), brief.tobytes()))
                    else:
                        sets.append((None, None, None))
                rows = [sets[i] if i is not None else (None, None, None) for i in named.indices.to_pylist()]
                columns = [pa.array(c, pa.binary()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), part.column(1).cast(pa.binary()), *columns], names=names)

    return run


def sketched(df: DataFrame, key: str, text: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    field = df.schema[key]
    texts = df.select(key, F.unhex(F.sha2(F.col(text), 256)).alias("text_key"), text)
    return texts.mapInArrow(
        sketch_rows(to_arrow_type(field.dataType), key), f"`{key}` {field.dataType.simpleString()}, text_key binary, set_key binary, sketch binary, brief binary"
    )


def fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a binary column whose values are all ``width`` items long."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def first_paths(runs: int, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(path, node) of the first level of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = mixed(fixed(batch.column(1), "<u4", PLACES).astype(np.uint64) + SEEDS)
                for seed in mixed(np.arange(1, runs + 1, dtype=np.uint64)):
                    yield chosen(mixed(tokens + seed), batch.column(0), rate)

    return run


def chosen(paths: np.ndarray, nodes: pa.Array, rate: float) -> pa.RecordBatch:
    rows, places = np.nonzero(paths < np.uint64(min(1.0, rate / PLACES) * (2**64 - 1)))
    return pa.RecordBatch.from_arrays([pa.array(mixed(paths[rows, places]).view(np.int64)), nodes.take(pa.array(rows))], names=["path", "set_key"])


def pivot_likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, set_key, sketch, like): how like each row's sketch is to its bucket's pivot."""
    for batch in batches:
        if batch.num_rows:
            own, pivot = fixed(batch.column("sketch"), "<u4", PLACES), fixed(batch.column("pivot"), "<u4", PLACES)
            like = pa.array((own == pivot).mean(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("path", "set_key", "sketch")] + [like], names=["path", "set_key", "sketch", "like"])


def next_paths(rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(path, set_key): the longer paths that each row of (path, set_key, sketch) takes from its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                base = batch.column("path").to_numpy().view(np.uint64)
                tokens = mixed(fixed(batch.column("sketch"), "<u4", PLACES).astype(np.uint64) + SEEDS)
                yield chosen(mixed(tokens + base[:, None] * MULTIPLIER), batch.column("set_key"), rate)

    return run


def split_buckets(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paths of buckets to part, and of those that are compared whole.

    A bucket is whole if half of it is close to the pivot and its pairs are no more than those of its close nodes and of the
    nodes that would go further: where most are as close as not, both parts are nearly the bucket, and each level repeats it.
    A bucket whose nodes are all close is whole.
    """
    close, further = F.sum((F.col("like") >= CLOSE).cast("double")), F.sum((F.col("like") < FAR).cast("double"))
    counted = split.groupBy("path").agg(F.count(F.lit(1)).cast("double").alias("n"), close.alias("close"), further.alias("further"))
    pairs = F.col("n") * F.col("n") <= F.col("close") * F.col("close") + F.col("further") * F.col("further")
    told = stored(counted.select("path", ((2 * F.col("close") >= F.col("n")) & pairs).alias("whole")), "kinds")
    return told.where(~F.col("whole")).select("path"), told.where("whole").select("path")


def leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """(leaf, set_key): the buckets to compare, those of one node left out. Every level is a written table."""
    rate = 1 / THRESHOLD
    paths = nodes.select("set_key", "sketch").mapInArrow(first_paths(runs, rate), "path bigint, set_key binary")
    found: list[DataFrame] = []
    for depth in range(DEPTH):
        # The pivot is the bucket's least node. Its sketch comes with the bucket's size, so that a row meets its bucket once.
        sizes = stored(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("_pivot")).where("n > 1"), "sizes")
        large = sizes.where(F.col("n") > LIMIT)
        if depth == DEPTH - 1 or large.isEmpty():
            found.append(stored(paths.join(sizes.select("path"), "path"), "paths"))
            break
        pivots = large.join(nodes.select(F.col("set_key").alias("_pivot"), F.col("sketch").alias("pivot")), "_pivot").select("path", "pivot")
        told = sizes.where(F.col("n") <= LIMIT).select("path", F.lit(None).cast("binary").alias("pivot")).union(pivots)
        level = stored(paths.join(told, "path"), "paths")
        found.append(level.where(F.col("pivot").isNull()).select("path", "set_key"))
        known = level.where(F.col("pivot").isNotNull()).join(nodes.select("set_key", "sketch"), "set_key")
        split = stored(known.mapInArrow(pivot_likeness, "path bigint, set_key binary, sketch binary, like double"), "split")
        parted, whole = split_buckets(split)
        # What stays has a path of its own.
        stays = split.where(F.col("like") >= CLOSE).select("path", "set_key").union(
            split.where(F.col("like") < CLOSE).join(whole, "path", "left_semi").select("path", "set_key"))
        found.append(stays.select(F.xxhash64(F.lit("close"), "path").alias("path"), "set_key"))
        further = split.where(F.col("like") < FAR).join(parted, "path", "left_semi").select("path", "set_key", "sketch")
        paths = further.mapInArrow(next_paths(2 * rate), "path bigint, set_key binary")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("path", "leaf").distinct()


def cells(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the comparisons: (leaf, i, j, block, set_key, brief, n_texts, leaves).

    A bucket of up to BLOCK nodes is one cell; a larger one is cut into blocks, and each pair of blocks is a cell. ``leaves``
    lists all buckets of the node.
    """
    sizes = buckets.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = buckets.join(sizes, "leaf").withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = shared.groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("leaf", "_blocks"))).alias("_all"))
    rows = own.join(nodes.select("set_key", "brief", "n_texts"), "set_key").select(
        "set_key", "brief", "n_texts", F.col("_all.leaf").alias("leaves"), F.explode("_all").alias("_one")
    )
    block = F.pmod(F.xxhash64("set_key"), F.col("_one._blocks")).cast("int")
    rows = rows.select("set_key", "brief", "n_texts", "leaves", F.col("_one.leaf").alias("leaf"), "_one._blocks", block.alias("block"))
    others = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return others.select(
        "leaf", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "set_key", "brief", "n_texts", "leaves"
    )


def by_cell(df: DataFrame) -> DataFrame:
    return df.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole cells and the bounds of each, from rows sorted by cell."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None and held.num_rows else table
        starts = cell_starts(table)
        if len(starts) > 1:
            yield table, list(zip(starts[:-1].tolist(), starts[1:].tolist()))
        held = table.slice(int(starts[-1])) if len(starts) else table
    if held is not None and held.num_rows:
        yield held.combine_chunks(), [(0, held.num_rows)]


def cell_starts(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("leaf", "i", "j"):
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def likely_pairs(leaf: int, a: np.ndarray, b: np.ndarray, briefs: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are likely alike and meet in no earlier bucket."""
    likely = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), 64):
        own = a[at : at + 64]
        likely[at : at + 64] = (briefs[own][:, None, :] == briefs[b][None, :, :]).mean(axis=2) >= LIKELY
    if a is b:
        likely = np.triu(likely, 1)
    if likely.any():
        earlier = [x[x < leaf] for x in lists]
        values, codes = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(values):
            member = np.zeros((len(lists), len(values)), np.float32)
            member[np.repeat(np.arange(len(lists)), [len(x) for x in earlier]), codes] = 1
            likely &= member[a] @ member[b].T == 0
    return likely


def cell_sides(table: pa.Table, lo: int, hi: int) -> tuple[int, np.ndarray, np.ndarray]:
    leaf, i, j = (table.column(c)[lo].as_py() for c in ("leaf", "i", "j"))
    if i == j:
        every = np.arange(hi - lo)
        return leaf, every, every
    block = table.column("block").to_numpy()[lo:hi]
    return leaf, np.flatnonzero(block == i), np.flatnonzero(block == j)


def cell_pairs(table: pa.Table, bounds: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, rows a, rows b, likely pairs) of each cell that has any."""
    briefs = fixed(table.column("brief"), np.uint8, PLACES)
    lists = table.column("leaves").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for lo, hi in bounds:
        if hi - lo > 1:
            leaf, a, b = cell_sides(table, lo, hi)
            own = [values[ends[k] : ends[k + 1]] for k in range(lo, hi)]
            likely = likely_pairs(leaf, a, b, briefs[lo:hi], own)
            if likely.any():
                yield lo, hi, a, b, likely


def likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of cells that have a likely partner in them."""
    for table, bounds in grouped(batches):
        kept = []
        for lo, _, a, b, likely in cell_pairs(table, bounds):
            kept.append(lo + np.union1d(a[likely.any(axis=1)], b[likely.any(axis=0)]))
        if kept:
            yield from table.take(pa.array(np.concatenate(kept))).combine_chunks().to_batches()


def likeness(a: np.ndarray, b: np.ndarray, likely: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard likeness of the likely pairs; 0 elsewhere."""
    sizes = np.array([len(s) for s in sets], np.int64)
    common = np.zeros(likely.shape)
    if likely.sum() <= 16:
        for x, y in zip(*np.nonzero(likely)):
            common[x, y] = len(np.intersect1d(sets[a[x]], sets[b[y]], assume_unique=True))
    else:
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        rows = np.repeat(np.arange(len(sets)), sizes)
        often = np.bincount(codes) > 1
        place = np.cumsum(often) - 1
        keep = often[codes]
        rows, codes = rows[keep], place[codes[keep]]
        order = np.argsort(codes, kind="stable")
        rows, codes = rows[order], codes[order]
        for at in range(0, int(often.sum()), 4096):
            lo, hi = np.searchsorted(codes, [at, at + 4096])
            held = np.zeros((len(sets), 4096), np.float32)
            held[rows[lo:hi], codes[lo:hi] - at] = 1
            common += held[a] @ held[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - common
    return np.where(likely, common / np.maximum(union, 1), 0)


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, links) of each node with a link in a cell: the least node linked with it there, and its number of links."""
    for table, bounds in grouped(batches):
        nodes, weights, out = table.column("set_key").to_pylist(), table.column("n_texts").to_numpy(), []
        shingles = table.column("shingles")
        for lo, hi, a, b, likely in cell_pairs(table, bounds):
            sets = [np.frombuffer(shingles[k].as_py(), "<u8") for k in range(lo, hi)]
            linked = likeness(a, b, likely, sets) >= THRESHOLD
            full = np.zeros((hi - lo, hi - lo), bool)
            full[np.ix_(a, b)] = linked
            full |= full.T
            links = full @ weights[lo:hi]
            order = sorted(range(hi - lo), key=lambda k: nodes[lo + k])
            root = np.full(hi - lo, -1)
            for first in order:
                if root[first] < 0 and links[first]:
                    root[first], edge = first, np.zeros(hi - lo, bool)
                    edge[first] = True
                    while edge.any():
                        edge = full[edge].any(axis=0) & (root < 0)
                        root[edge] = first
            out += [(nodes[lo + k], nodes[lo + root[k]], int(links[k])) for k in np.flatnonzero(links)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "links"])


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("set_key").cast(pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"])


def links(df: DataFrame, nodes: DataFrame, runs: int, text: str) -> DataFrame:
    """(a, b, links) of all cells: the verified join, stored."""
    compared = by_cell(cells(leaves(nodes, runs), nodes))
    likely = stored(compared.mapInArrow(likely_rows, compared.schema), "likely")
    wanted = likely.select("set_key").distinct().join(nodes.select("set_key", "text_key"), "set_key")
    texts = df.select(F.unhex(F.sha2(F.col(text), 256)).alias("text_key"), F.col(text).alias("text"))
    found = texts.join(wanted.hint("shuffle_hash"), "text_key").select("set_key", "text").dropDuplicates(["set_key"])
    sets = found.mapInArrow(shingle_rows, "set_key binary, shingles binary")
    return stored(by_cell(likely.join(sets, "set_key")).mapInArrow(verified, "a binary, b binary, links bigint"), "links")


def near_join(df: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links) of every row: the least key of its class, and how many other texts are linked to its own."""
    runs = math.ceil(math.log(1 - recall) / math.log(1 - SHARED))
    rows = stored(sketched(df, key, text), "sketches")
    texts = rows.where(F.col("set_key").isNotNull()).groupBy("set_key", "text_key").agg(F.first("sketch").alias("sketch"), F.first("brief").alias("brief"))
    nodes = stored(
        texts.groupBy("set_key").agg(
            F.first("sketch").alias("sketch"), F.first("brief").alias("brief"), F.count(F.lit(1)).alias("n_texts"), F.min("text_key").alias("text_key")
        ),
        "nodes",
    )
    found = links(df, nodes, runs, text)
    counted = found.groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("_links"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "set_key")
    alike = nodes.where("n_texts > 1").select("set_key", (F.col("n_texts") - 1).alias("_alike"))
    told = counted.join(alike, "set_key", "full").join(roots, "set_key", "left")
    told = told.select("set_key", "root", (F.coalesce("_links", F.lit(0)) + F.coalesce("_alike", F.lit(0))).alias("n_links"))
    every = rows.select(key, "text_key", "set_key").join(told, "set_key", "left")
    group = F.coalesce("root", "set_key", "text_key")
    every = every.select(F.col(key), group.alias("_group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = every.groupBy("_group").agg(F.min(key).alias("class_id"))
    own = F.when(F.col("_group").isNull(), F.col(key)).otherwise(F.col("class_id"))
    return every.join(least, "_group", "left").select(key, own.alias("class_id"), "n_links")
