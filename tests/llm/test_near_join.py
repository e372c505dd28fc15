import random
from itertools import combinations

import pytest
from llm_rows import words_of

from obslab.llm import near_join as nj
from obslab.llm.components import components


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else None)


def plain(source):
    """(key, class, links) of every row, by comparing all pairs of texts."""
    texts = list({t for _, t, *_ in source if t is not None})
    sets = {t: shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    links = dict.fromkeys(texts, 0)
    for a, b in combinations(texts, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
            links[a] += 1
            links[b] += 1
    least = {}
    for i, t, *_ in source:
        if t is not None and i is not None:
            least[find(t)] = min(i, least.get(find(t), i))
    return sorted((i or 0, i or 0 if t is None else least.get(find(t), 0), links.get(t, 0)) for i, t, *_ in source)


def got(df):
    return sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in nj.near_join(df).collect())


def copies(n_groups, sizes, seed=2):
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.randint(80, 200))]
        for _ in range(sizes[g % len(sizes)]):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), "en", "s", 0))
    return rows


def test_equals_all_pairs(make):
    source = copies(40, (1, 2, 3, 9))
    assert got(make(*source).repartition(3)) == plain(source)


def test_large_buckets_and_blocks(make, monkeypatch):
    monkeypatch.setattr(nj, "LIMIT", 8)
    monkeypatch.setattr(nj, "BLOCK", 6)
    passage = " ".join(f"p{i}" for i in range(60))
    source = copies(3, (45, 2, 1))
    source += [(1000 + i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(100)), "en", "s", 0) for i in range(30)]
    assert got(make(*source).repartition(3)) == plain(source)


def test_a_path_row_meets_its_bucket_once(make, monkeypatch):
    """Inner joins on paths give each row of a level once, however large the group of near copies is."""
    monkeypatch.setattr(nj, "LIMIT", 8)
    table, made, levels = make(*copies(3, (45, 2, 1))), [], []
    join, stored = type(table).join, nj.stored

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "path" and how in (None, "inner"):
            made.append(out.count())
        return out

    def told(df, purpose):
        out = stored(df, purpose)
        if purpose == "paths":
            levels.append(out.count())
        return out

    monkeypatch.setattr(type(table), "join", counted)
    monkeypatch.setattr(nj, "stored", told)
    nj.near_join(table).count()
    assert levels and sum(made) == sum(levels)


def test_a_shared_passage_is_compared_whole(make, monkeypatch):
    """Texts about as like as CLOSE stay together at once: split, nearly all would stay and nearly all go further, level by level."""
    monkeypatch.setattr(nj, "LIMIT", 8)
    passage, levels, stored = " ".join(f"p{i}" for i in range(100)), [], nj.stored
    source = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(100)), "en", "s", 0) for i in range(40)]
    source += [(100 + i, f"{source[i][1]} end", "en", "s", 0) for i in (0, 7, 30)]

    def told(df, purpose):
        out = stored(df, purpose)
        if purpose == "paths":
            levels.append(out.count())
        return out

    monkeypatch.setattr(nj, "stored", told)
    assert got(make(*source).repartition(3)) == plain(source)
    assert levels[0] and not sum(levels[1:])


def test_far_nodes_of_a_bucket_go_further(shipped):
    rows = [("outlier", x) for x in [0.05] * 9 + [1.0]] + [("two groups", x) for x in [0.1] * 5 + [0.8] * 5]
    rows += [("near copies", x) for x in [0.8] * 9 + [0.9]] + [("passage", x) for x in [0.2] * 4 + [0.4] * 6]
    parted, whole = nj.split_buckets(shipped.createDataFrame(rows, "path string, like double"))
    assert sorted(r.path for r in parted.collect()) == ["outlier", "two groups"]
    assert sorted(r.path for r in whole.collect()) == ["near copies", "passage"]


def test_odd_texts(odd, odd_rows):
    assert got(odd) == plain(odd_rows)


def test_same_shingles_are_linked(make):
    source = [(7, "a b c d e f g", "", "", 0), (5, "a  b c\nd e f g ", "", "", 0), (3, "A b c d e f g", "", "", 0), (9, "a b", "", "", 0), (8, "a b", "", "", 0)]
    assert got(make(*source)) == [(3, 3, 0), (5, 5, 1), (7, 5, 1), (8, 8, 0), (9, 8, 0)]


def test_empty_table_and_clashing_columns(none, clashing, odd_rows):
    assert nj.near_join(none).collect() == []
    assert got(clashing.drop("class_id", "n_links")) == plain(odd_rows)


def test_components_of_chains_and_stars(shipped):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, 301), (301, 300)]
    rows = components(shipped.createDataFrame(edges, "a bigint, b bigint")).collect()
    found = {r.node: r.root for r in rows}
    assert len(rows) == len(found)
    assert all(found[i] == 0 for i in range(31)) and all(found[100 + i] == 100 for i in range(40)) and found[301] == found[300] == 300


def test_stars_need_no_round(shipped, monkeypatch):
    import obslab.llm.components as module

    written, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, purpose: written.append(purpose) or stored(df, purpose))
    rows = components(shipped.createDataFrame([(1, k) for k in range(1, 6)] + [(9, 7), (8, 7), (7, 8)], "a bigint, b bigint")).collect()
    assert sorted(rows) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 7)]
    assert len(written) == 1


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_runs_reach_the_recall(share):
    """Pairs of sets at the threshold meet in a first-level bucket of some run about as often as computed."""
    import numpy as np
    import pyarrow as pa

    rng, met, pairs = np.random.default_rng(5), 0, 400
    run = nj.first_paths(3, 1 / nj.THRESHOLD)
    for _ in range(pairs):
        common = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        left = rng.integers(0, 2**63, (2, (1000 - len(common)) // 2), dtype=np.uint64)
        sketches = [nj.min_hashes(np.r_[common, x]).astype("<u4").tobytes() for x in left]
        batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"b"]), pa.array(sketches)], names=["set_key", "sketch"])
        paths = [set(), set()]
        for out in run(iter([batch])):
            for p, k in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                paths[k == b"b"].add(p)
        met += bool(paths[0] & paths[1])
    assert met / pairs > 1 - (1 - nj.SHARED) ** 3 - 0.02
