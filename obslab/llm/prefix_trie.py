"""The prefix trie of conversations: which of them share their first turns, and what sharing saves.

``rebuilt`` makes the conversations: the first h turns of conversation c-c%5 (the remainder keeps c's sign), then c's own turns
after its first h, h = crc32(c in decimal) % 9. Turns are ordered by turn number, null first; equal numbers by role, then text.
A conversation is held whole, as a text is; groups of conversations never are.

``trie`` works on different conversations only. They are cut into range shards by their turns, and every shard builds a ternary
search tree over its own dictionary of turns: a node holds one turn, its lesser and greater siblings, and the turns that follow
it. The shard's paths are inserted median first, which balances the siblings. A stack walks the tree in order, and folding that
order backwards gives members, leaves and savings of every subtree. Only nodes on a shard's first or last path can lie in other
shards too; these stay open. ``FAN`` neighbouring shards at a time merge their open nodes, which closes all that are not on the
edge of the whole group, until one group is left.

Defined results: null roles and texts are empty; rows without conv_id belong to no conversation and are left out; repeated rows
are turns like others; a table without conversations has no nodes, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.llm.common import stored

#: Turns of the paths of one shard: what a task holds.
SHARD_TURNS = 1 << 17
#: Neighbouring shards whose open nodes meet in one task.
FAN = 64
#: Conversation ids in one piece of the text that is hashed.
PIECE = 1 << 16
#: Open nodes whose conv_id may be broadcast to their children, 64 bytes each; more are joined by a shuffle.
BROADCAST_NODES = 1 << 19
MODULUS, HEADS = 5, 9
#: A path: of each turn, two hashes of role and text and the bytes of the text.
_PATH = "array<struct<a:bigint,b:bigint,bytes:bigint>>"
_NODE = (
    "shard bigint, open boolean, leftmost boolean, rightmost boolean, node_key binary, parent_key binary, conv_id bigint, depth bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, bytes bigint, ends_sha256 string"
)
_FIELDS = [field.split()[0] for field in _NODE.split(", ")]
_ARROW = pa.schema([
    (name, {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[field.split()[1]])
    for name, field in zip(_FIELDS, _NODE.split(", "))
])
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turns(table: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    plain = table.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    hashed = F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.octet_length("text").cast("bigint").alias("bytes"))
    return plain.withColumn("hashed", hashed)


def _path(sorted_: Column) -> Column:
    return F.transform(sorted_, lambda t: t["hashed"])


def ordered(table: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation as it stands in the table.

    Texts do not travel. Only conversations in which two different texts have one turn number and role are read again with
    their texts, to order those.
    """
    turns = _turns(table)
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "hashed"))).alias("list"))
    tie = lambda i: (
        F.get("list", i)["turn"].eqNullSafe(F.get("list", i + 1)["turn"]) & (F.get("list", i)["role"] == F.get("list", i + 1)["role"])
        & (F.get("list", i)["hashed"] != F.get("list", i + 1)["hashed"]))
    places = F.when(F.size("list") > 1, F.sequence(F.lit(0), F.size("list") - 2)).otherwise(F.array().cast("array<int>"))
    known = stored(listed.select("conv_id", _path(F.col("list")).alias("path"), F.exists(places, tie).alias("tied")), "conversations")
    tied = known.where("tied").select("conv_id")
    if not tied.head(1):
        return known.drop("tied")
    texts = turns.join(tied, "conv_id", "left_semi").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "hashed"))).alias("list"))
    again = texts.select("conv_id", _path(F.col("list")).alias("path"))
    return stored(known.where("not tied").drop("tied").unionByName(again), "conversations")


def rebuilt(table: DataFrame) -> DataFrame:
    """(conv_id, path) of every rebuilt conversation."""
    own = ordered(table)
    first = F.col("conv_id") % MODULUS == 0
    heads = own.where(first).select(F.col("conv_id").alias("base"), F.slice("path", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rest = own.where(~first).withColumn("base", F.col("conv_id") - F.col("conv_id") % MODULUS).join(heads, "base", "left")
    begun = F.slice(F.coalesce("head", F.array().cast(_PATH)), F.lit(1), h)
    after = F.slice("path", h + 1, F.greatest(F.size("path") - h, F.lit(0)))
    return own.where(first).unionByName(rest.select("conv_id", F.concat(begun, after).alias("path")))


def _ends(conversations: DataFrame) -> DataFrame:
    """(key_1, key_2, ends_sha256): the hash of the ascending ids of equal conversations.

    Ids are sorted by ranges, so that a large group is spread over tasks; its pieces of text then stream through one hash.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            one, two, ids, part = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((np.diff(one) != 0) | (np.diff(two) != 0)) + 1
            starts = np.unique(np.r_[0, cuts, np.arange(0, len(ids), PIECE)]) if len(ids) else []
            rows = [(int(one[s]), int(two[s]), int(part[s]), no + k, ",".join(map(str, ids[s:e].tolist())))
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
            no += len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["key_1", "key_2", "part", "no", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["key_1", "key_2", "ends_sha256"])

        now, digest = None, None
        for batch in batches:
            done = []
            for one, two, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                if (one, two) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (one, two), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield result(done)
        if now is not None:
            yield result([(*now, digest.hexdigest())])

    order = ["key_1", "key_2", "conv_id"]
    ids = conversations.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = ids.withColumn("part", F.spark_partition_id().cast("bigint")).mapInArrow(pieces, "key_1 bigint, key_2 bigint, part bigint, no bigint, ids string")
    together = cut.repartition("key_1", "key_2").sortWithinPartitions("key_1", "key_2", "part", "no")
    return together.mapInArrow(hashed, "key_1 bigint, key_2 bigint, ends_sha256 string")


class TernaryTree:
    """Turns as nodes in lists; node 0 is the root, which holds no turn."""

    def __init__(self):
        self.turn, self.low, self.high, self.down, self.parent = [-1], [-1], [-1], [-1], [-1]
        self.first, self.members, self.end = [None], [0], [None]

    def _child(self, node: int, turn: int) -> int:
        """The child of ``node`` that holds ``turn``, made where it is missing."""
        links, at, now = self.down, node, self.down[node]
        while now != -1:
            held = self.turn[now]
            if turn == held:
                return now
            links, at = (self.low, now) if turn < held else (self.high, now)
            now = links[at]
        new = len(self.turn)
        links[at] = new
        for values, value in (
            (self.turn, turn), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, node), (self.first, None), (self.members, 0), (self.end, None),
        ):
            values.append(value)
        return new

    def insert(self, path: list[int], first: int, members: int, end: str) -> list[int]:
        """Nodes along the path, root first."""
        along = [0]
        for turn in path:
            along.append(self._child(along[-1], turn))
        for node in along:
            self.members[node] += members
            if self.first[node] is None or first < self.first[node]:
                self.first[node] = first
        self.end[along[-1]] = end
        return along

    def walk(self) -> list[int]:
        """All nodes, parents before what follows them, siblings in the order of their turns."""
        order, stack = [], [(0, True)]
        while stack:
            node, visit = stack.pop()
            if node == -1:
                continue
            if visit and node:
                stack += [(self.high[node], True), (node, False), (self.low[node], True)]
            else:
                order.append(node)
                stack.append((self.down[node], True))
        return order


def median_first(n: int) -> Iterator[int]:
    """0 to n-1, the middle of every range before its halves."""
    ranges = [(0, n)]
    for low, high in ranges:
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(low, middle), (middle + 1, high)]


def _key(parent: bytes, turn: tuple[int, int]) -> bytes:
    return hashlib.blake2b(parent + turn[0].to_bytes(8, "big", signed=True) + turn[1].to_bytes(8, "big", signed=True), digest_size=16).digest()


def _shard_nodes(table: pa.Table) -> list[list]:
    """Columns of the nodes of one shard, whose paths are sorted: closed nodes are done, open ones may go on elsewhere."""
    lists = table.column("path").combine_chunks()
    flat = lists.flatten()
    a, b, size = (flat.field(i).to_numpy() for i in range(3))
    ends = np.cumsum(lists.value_lengths().to_numpy())
    starts = ends - lists.value_lengths().to_numpy()
    # The shard's own dictionary; its order is the order of the paths.
    by = np.lexsort((b, a))
    new = np.r_[False, (np.diff(a[by]) != 0) | (np.diff(b[by]) != 0)][: len(by)]
    ids = np.empty(len(by), np.int64)
    ids[by] = np.cumsum(new)
    words = dict(zip(ids[by].tolist(), by.tolist()))
    ids = ids.tolist()
    convs, counts, hashes = (table.column(c).to_pylist() for c in ("first", "n_convs", "ends_sha256"))
    tree, edges = TernaryTree(), {}
    last = table.num_rows - 1
    for i in median_first(table.num_rows):
        along = tree.insert(ids[starts[i] : ends[i]], convs[i], counts[i], hashes[i])
        if i in (0, last):
            edges[i] = along
    leftmost, rightmost = set(edges[0]), set(edges[last])
    keys = {0: b""}
    for along in edges.values():
        for node in along[1:]:
            at = words[tree.turn[node]]
            keys[node] = _key(keys[tree.parent[node]], (int(a[at]), int(b[at])))
    n = len(tree.turn)
    children, leaves, saved, depth = [0] * n, [0] * n, [0] * n, [0] * n
    order = tree.walk()
    for node in order[1:]:
        depth[node] = depth[tree.parent[node]] + 1
    weight = [0] + [int(size[words[t]]) for t in tree.turn[1:]]
    for node in reversed(order):
        if node in keys:
            continue
        up = tree.parent[node]
        leaves[node] = leaves[node] or 1
        saved[node] += (tree.members[node] - 1) * weight[node]
        children[up] += 1
        leaves[up] += leaves[node]
        saved[up] += saved[node]
    shard = table.column("shard")[0].as_py()
    up_key = [keys.get(p) if p != -1 else None for p in tree.parent]
    return [
        [shard] * n, [node in keys for node in range(n)], [node in leftmost for node in range(n)], [node in rightmost for node in range(n)],
        [keys.get(node) for node in range(n)], up_key, tree.first, depth,
        [None if p == -1 or k is not None else tree.first[p] for p, k in zip(tree.parent, up_key)],
        tree.members, children, leaves, saved, weight, [e or _NO_ENDS for e in tree.end],
    ]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        columns = _shard_nodes(pa.Table.from_batches(held))
        whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)


def merge_open(rows: list[dict], final: bool) -> list[dict]:
    """Open nodes of neighbouring shards as one: all are closed but those on the edge of the whole, at the end those too."""
    first, last = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        left, right = r["leftmost"] and r["shard"] == first, r["rightmost"] and r["shard"] == last
        node = nodes.get(r["node_key"])
        if node is None:
            nodes[r["node_key"]] = {**r, "shard": first, "leftmost": left, "rightmost": right}
            continue
        node["conv_id"] = min(node["conv_id"], r["conv_id"])
        for c in ("n_convs", "n_children", "n_leaves", "saved"):
            node[c] += r[c]
        node["leftmost"] |= left
        node["rightmost"] |= right
        if r["ends_sha256"] != _NO_ENDS:
            node["ends_sha256"] = r["ends_sha256"]
    for node in sorted(nodes.values(), key=lambda r: -r["depth"]):
        node["open"] = not final and (node["leftmost"] or node["rightmost"])
        if node["open"]:
            continue
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        node["saved"] += (node["n_convs"] - 1) * node["bytes"]
        up = nodes.get(node["parent_key"]) if node["depth"] else None
        if up is not None:
            up["n_children"] += 1
            up["n_leaves"] += node["n_leaves"]
            up["saved"] += node["saved"]
    return list(nodes.values())


def _merged(open_nodes: DataFrame, fan: int, final: bool) -> DataFrame:
    def group(frame: pd.DataFrame) -> pd.DataFrame:
        rows = merge_open(frame.drop(columns="_group").astype(object).where(frame.drop(columns="_group").notna(), None).to_dict("records"), final)
        for r in rows:
            r["shard"] //= fan
        return pd.DataFrame(rows, columns=_FIELDS).astype({"parent_conv_id": "Int64"})

    grouped = open_nodes.withColumn("_group", F.expr(f"shard div {fan}")).groupBy("_group")
    return stored(grouped.applyInPandas(group, _NODE), "open-nodes")


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN, broadcast: int = BROADCAST_NODES) -> DataFrame:
    """One row for each node of the conversations (conv_id, path)."""
    kept = stored(conversations.select("conv_id", F.xxhash64("path").alias("key_1"), F.xxhash64(F.lit(1), "path").alias("key_2"), "path"), "paths")
    different = kept.groupBy("path").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n_convs"), F.min("key_1").alias("key_1"), F.min("key_2").alias("key_2"))
    paths = stored(different.join(_ends(kept), ["key_1", "key_2"]).select("path", "first", "n_convs", "ends_sha256"), "paths")
    shards = 1 + (paths.agg(F.sum(F.size("path") + 1)).first()[0] or 0) // shard_turns
    cut = paths.repartitionByRange(shards, "path").sortWithinPartitions("path").withColumn("shard", F.spark_partition_id().cast("bigint"))
    nodes = stored(cut.mapInArrow(_build, _NODE), "nodes")
    closed, open_nodes = [nodes.where("not open")], nodes.where("open")
    last = open_nodes.agg(F.max("shard")).first()[0] or 0
    while True:
        final = last < fan
        merged = _merged(open_nodes, fan, final)
        closed.append(merged.where("not open"))
        if final:
            break
        open_nodes, last = merged.where("open"), last // fan
    seams = closed[1]
    for part in closed[2:]:
        seams = seams.unionByName(part)
    names = seams.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent"))
    names = F.broadcast(names) if names.count() <= broadcast else names
    every = closed[0].unionByName(seams)
    within = every.where("parent_key IS NULL").withColumn("parent", F.col("parent_conv_id"))
    across = every.where("parent_key IS NOT NULL").join(names, "parent_key", "left")
    return within.unionByName(across).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
