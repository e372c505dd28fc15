import hashlib
import random
import zlib

import pytest

from obslab.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Every prefix of every rebuilt conversation, by itself."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, convs in members.items():
        gain = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += gain
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(n=300, seed=2):
    """Conversations that share turns at random, copies of whole ones, a long one and short ones."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        depth = rng.choice([1, 2, 3, 4, 8, 12])
        rows += [(c, t, ("user", "assistant")[t % 2], f"text {min(rng.randrange(6), rng.randrange(6))} é" * (1 + t % 3)) for t in range(depth)]
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(0, 400, 5) for t in range(9)]
    rows += [(5000, t, "user", "again") for t in range(500)] + [(5005, t, "user", "again") for t in range(400)]
    return rows


ODD = [
    (None, 1, "user", "nobody's"), (7001, None, None, None), (7001, 0, "user", ""), (7001, 0, "user", "b"), (7001, 0, "user", "a"), (7001, 0, "user", "a"),
    (7001, 0, "assistant", "z"), (-7, 1, "user", "below zero"), (-5, 1, "user", "below zero"), (-5, 2, "user", "x" * 100_000), (7002, 3, "ab", "c"), (7003, 3, "a", "bc"),
    (7004, 1, "user", "short"), (2**62, 1, "user", "short"),
]


def collected(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("shard_turns,fan,broadcast", [(prefix_trie.SHARD_TURNS, prefix_trie.FAN, 1 << 19), (300, 64, 0), (60, 2, 1 << 19)])
def test_equals_brute_force(shipped, shard_turns, fan, broadcast):
    rows = table() + ODD
    frame = shipped.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie.trie(prefix_trie.rebuilt(frame), shard_turns, fan, broadcast)
    assert collected(got) == brute(rows)


def test_turnless_conversations_belong_to_the_root(shipped):
    convs = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:4]
    rows = [(c, t, "user", "only") for c in convs for t in range(2)]
    got = collected(prefix_trie.trie(prefix_trie.rebuilt(shipped.createDataFrame(rows, SCHEMA))))
    assert got == brute(rows) and len(got) == 1 and got[0][:6] == (min(convs), 0, None, 4, 0, 1)


def test_ids_of_one_large_group_stream_through_one_hash(shipped, monkeypatch):
    rows = [(5 * c, 0, "user", "same") for c in range(3000)]
    frame = shipped.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ids = ",".join(str(5 * c) for c in range(3000))
    got = collected(prefix_trie.trie(prefix_trie.rebuilt(frame)))
    assert (0, 1, 0, 3000, 0, 1, 4 * 2999, hashlib.sha256(ids.encode()).hexdigest()) in got and len(got) == 2


def test_median_first_balances_siblings():
    assert sorted(prefix_trie.median_first(10)) == list(range(10)) and next(prefix_trie.median_first(9)) == 4
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.median_first(1023):
        tree.insert([i], i, 1, "")
    depth, level = 0, [tree.down[0]]
    while level := [m for n in level for m in (tree.low[n], tree.high[n]) if m != -1]:
        depth += 1
    assert depth == 9 and [tree.turn[n] for n in tree.walk()][1:] == list(range(1023))


def test_empty_and_clashing(shipped):
    assert prefix_trie.trie(prefix_trie.rebuilt(shipped.createDataFrame([], SCHEMA))).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt(shipped.createDataFrame([(None, 1, "user", "x")], SCHEMA))).count() == 0
    rows = table(30)
    named = shipped.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as path", "'x' as hashed", "2 as base", "3 as list", "4 as shard", "5 as depth", "6 as head", "7 as tied")
    assert collected(prefix_trie.trie(prefix_trie.rebuilt(named))) == brute(rows)
