import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from obslab.llm import packing


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, source, window=1024):
    """Every id in one piece, sequences gapless and short enough; returns padding over tokens."""
    by_sequence, by_key = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_key[r.doc_id].append(r)
    want = defaultdict(list)
    for i, text, *_ in source:
        want[i].append(ids_of(text))
    for key, own in by_key.items():
        total = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own)
        pieces = []
        for ids in want[key]:
            for start, length, crc, n in {t for t in total if t[3] == len(ids)}:
                if zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc:
                    pieces.append(length)
        assert sum(r.length for r in own) == sum(map(len, want[key]))
        assert len(pieces) >= len({t for t in total})
    padding = tokens = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        tokens += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert set(by_key) == set(want)
    return padding / max(1, tokens)


def test_round_trip(odd, odd_rows):
    check(packing.pack(odd).collect(), odd_rows)


def test_little_padding_over_many_blocks(make):
    from llm_rows import plain_rows

    source = plain_rows(400, 5)
    table = make(*source).coalesce(1)
    for block in (1 << 18, 5000):
        assert check(packing.pack(table, costs=packing.Costs(block=block)).collect(), source) < 0.03


def test_order_is_kept(make):
    from llm_rows import plain_rows

    rows = packing.pack(make(*plain_rows(50)).coalesce(1)).collect()
    placed = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    assert [(r.doc_id, r.start) for r in placed] == sorted((r.doc_id, r.start) for r in rows)


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_of_least_cost(seed):
    rng = np.random.default_rng(seed)
    n, window = int(rng.integers(1, 60)), 32
    positions = np.unique(np.r_[0, np.cumsum(rng.integers(1, 20, n))]).tolist()
    penalties = rng.integers(0, 9, len(positions)).astype(float).tolist()
    short = {j: [i for i in range(j) if positions[j] - positions[i] in (4, 8, 16)] for j in range(len(positions))}

    def step(i, j):
        gap = positions[j] - positions[i]
        return None if gap > window else penalties[j] + 3 + (0 if i in short[j] else window - gap)

    best = [0.0] + [float("inf")] * (len(positions) - 1)
    for j in range(1, len(positions)):
        best[j] = min(best[i] + s for i in range(j) if (s := step(i, j)) is not None)
    cuts = packing.best_cuts(positions, penalties, short, window, 3)
    assert cuts[0] == 0 and cuts[-1] == len(positions) - 1
    assert sum(step(i, j) for i, j in zip(cuts, cuts[1:])) == best[-1]


def test_empty_table_and_clashing_columns(none, clashing, odd_rows):
    assert packing.pack(none).collect() == []
    check(packing.pack(clashing).collect(), odd_rows)


def test_very_long_runs(make):
    rows = [(i, t, "", "", 0) for i, t in enumerate([" " * 1_000_000, "\n" * 1_000_000, "word" * 250_000, "a " + " " * 500_000 + "b"])]
    check(packing.pack(make(*rows)).collect(), rows)
