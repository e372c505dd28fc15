"""Order-preserving packing: dynamic programming over window cuts.

The documents of a partition, in the table's order, are one stream of tokens. Windows of at most ``window`` tokens cut it
at the ends of documents (free), at ends of sentences or at other tokens (each at a penalty), so that padding plus
penalties is least. The best cost up to a cut is a sliding-window minimum over earlier cuts, kept in a monotone queue. A
window whose length is a power of two needs no padding.

Nothing is shuffled: a partition packs itself, block by block, and hands its last open window on to the next block. Only a
partition's last window can be left with much padding. Null text is empty, an empty document is one end token, repeated
rows are documents of their own, an empty table gives no sequences.
"""

from __future__ import annotations

import pathlib
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

END_ID = 0
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？", "\n", '."', '!"', '?"', ".)", ".'")
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Sequence numbers of a partition start at its number times this.
PARTITION = 1 << 34
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class Costs:
    """In tokens of padding: a cut after a sentence, a cut elsewhere, a sequence; and how far apart other cuts may lie."""

    sentence: float = 6
    elsewhere: float = 20
    sequence: float = 12
    step: int = 64
    block: int = 1 << 18


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level vocabulary of the .json file, read from the ranks file beside it, and which ids end a sentence."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    found = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    ends = np.zeros(len(ranks) + 1, bool)
    ends[[i for piece, i in ranks.items() if piece.decode("utf-8", "replace").rstrip(" ").endswith(SENTENCE_ENDS)]] = True
    return found, ends


@lru_cache(maxsize=2)
def whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(pathlib.Path(path).with_suffix(".json")))


def ids_of(found, path: str, text: str) -> np.ndarray:
    """Ids of the whole text. The ranks' pattern gives up on a run of about a million blanks; the .json tokenizer does not."""
    try:
        return found.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(whole_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


def best_cuts(positions: list[int], penalties: list[float], short: dict[int, list[int]], window: int, sequence: float) -> list[int]:
    """Indices of the cuts of least cost, the first and the last position included.

    ``short`` gives for a cut the earlier cuts that lie a power of two before it.
    """
    n = len(positions)
    cost, come = [0.0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        at = positions[j]
        while positions[queue[0]] < at - window:
            queue.popleft()
        i = queue[0]
        best = cost[i] + positions[i] + window - at
        for k in short.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        cost[j] = best = best + penalties[j] + sequence
        come[j] = i
        key = best + at
        while queue and cost[queue[-1]] + positions[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [n - 1], n - 1
    while j:
        j = come[j]
        out.append(j)
    return out[::-1]


def window_ends(tokens: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, window: int, costs: Costs) -> np.ndarray:
    """Ends of the windows over ``tokens``, ascending."""
    n = len(tokens)
    penalty = np.full(n + 1, np.inf)
    step = min(costs.step, window)
    penalty[step::step] = costs.elsewhere
    penalty[1:][ends[tokens]] = costs.sentence
    penalty[doc_ends] = 0
    penalty[0] = penalty[n] = 0
    positions = np.flatnonzero(np.isfinite(penalty))
    index = np.full(n + 1, -1, np.int32)
    index[positions] = np.arange(len(positions))
    short: dict[int, list[int]] = {}
    power = 1 << 5
    while power < window:
        to = np.flatnonzero(positions >= power)
        came = index[positions[to] - power]
        for j, i in zip(to[came >= 0].tolist(), came[came >= 0].tolist()):
            short.setdefault(j, []).append(i)
        power *= 2
    cuts = best_cuts(positions.tolist(), penalty[positions].tolist(), short, window, costs.sequence)
    return positions[cuts[1:]]


class Packer:
    """Documents of one partition on their way into windows."""

    def __init__(self, ends: np.ndarray, window: int, costs: Costs, first: int):
        self.ends, self.window, self.costs, self.sequence = ends, window, costs, first
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []  # (row, tokens of the document, tokens of it packed before)
        self.size = 0

    def add(self, row: int, tokens: np.ndarray) -> None:
        self.tokens.append(tokens)
        self.docs.append((row, len(tokens), 0))
        self.size += len(tokens)

    def flush(self, last: bool) -> tuple[np.ndarray, ...] | None:
        """Rows, starts, lengths, checksums, document sizes, sequences and offsets of the finished windows' pieces."""
        if not self.size:
            return None
        tokens = np.concatenate(self.tokens)
        rows, totals, done = (np.array(x, np.int64) for x in zip(*self.docs))
        ends = np.cumsum(totals - done)
        windows = window_ends(tokens, ends, self.ends, self.window, self.costs)
        stop = len(tokens) if last else int(windows[-2]) if len(windows) > 1 else 0
        windows = windows[windows <= stop]
        cuts = np.union1d(windows, ends[ends <= stop])
        starts = np.r_[0, cuts[:-1]] if len(cuts) else cuts
        doc = np.searchsorted(ends, starts, "right")
        number = np.searchsorted(windows, starts, "right")
        raw = memoryview(np.ascontiguousarray(tokens, "<u4")).cast("B")
        sums = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), cuts.tolist())), np.int64, len(cuts))
        begun = np.r_[0, ends[:-1]] - done
        pieces = (rows[doc], starts - begun[doc], cuts - starts, sums, totals[doc], number + self.sequence, starts - np.r_[0, windows][number])
        self.sequence += len(windows)
        kept = int(np.searchsorted(ends, stop, "right"))
        self.tokens, self.size = [tokens[stop:]], len(tokens) - stop
        self.docs = [(int(rows[i]), int(totals[i]), int(max(done[i], stop - begun[i]))) for i in range(kept, len(rows))]
        return pieces


def pack_rows(path: str, key: str, kind: pa.DataType, window: int, costs: Costs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [key, *(c.split()[0] for c in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ends = encoder(path)
        packer, keys, base = Packer(ends, window, costs, TaskContext.get().partitionId() * PARTITION), [], 0

        def rows(pieces: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            own = pa.array([keys[r - base] for r in pieces[0].tolist()], kind)
            return pa.RecordBatch.from_arrays([own, *map(pa.array, pieces[1:])], names=names)

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(own)
                ids = ids_of(found, path, text.as_py() or "")
                packer.add(base + len(keys) - 1, np.append(ids, np.uint32(END_ID)))
                if packer.size >= costs.block:
                    yield rows(packer.flush(last=False))
                    low = packer.docs[0][0] if packer.docs else base + len(keys)
                    keys, base = keys[low - base :], low
        if packer.size:
            yield rows(packer.flush(last=True))

    return run


def pack(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", window: int = 1024, costs: Costs = Costs()) -> DataFrame:
    """One row for each piece of a document in a sequence: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = df.schema[key]
    path = path or public_tokenizers.path(f"{VOCABULARY}.tiktoken")
    rows = pack_rows(path, key, to_arrow_type(field.dataType), window, costs)
    return df.select(key, text).mapInArrow(rows, f"`{key}` {field.dataType.simpleString()}, {PIECES}")
