"""Interpolated modified Kneser-Ney model of order 2 or 3: counted by Spark, kept as sorted arrays, mapped by the scoring tasks.

1. Word counts: each task adds up its batches' words; rows meet by range of the word's hash. A range is stored as a sorted
   hash array with its counts; a word's number is its place in the arrays' concatenation.
2. Bigram counts: keys ``context number << 32 | word number`` are added up in each batch, meet by range of contexts and are
   stored as runs of ascending words, one run for each context. What they say of the second words (in how many contexts a
   word was seen) meets by range of words and is stored too.
   Of order 3, trigrams are counted instead: they meet by a hash of their two context words, which parts the pairs of a hot
   word, and are stored likewise below the sorted contexts. What they say of their last two words (after how many first
   words a pair was seen) meets by range of contexts and takes the place of the bigrams' counts.
3. Scoring maps the arrays and looks all words of a batch up at once.

Contexts with one trigram lie beside its word, the others' words in runs. A context's two numbers are mixed, one to one, so
that equal steps of a range hold about as many and the rest of the number takes 32 bits. Counts above a byte and the sums of
long runs are kept apart; those of short runs are added up when asked. Cells of the shuffles are packed.

Nothing but the ranges' sizes and a few sums (one row for each range) passes the driver. The number of ranges follows the
number of training rows. Texts are lower-cased A-Z, cut into words ``[^\\x20\\x09-\\x0D]+`` and end with an end token; a
begin mark is a context only (order 3 has two of them before a text). Null text is empty: just the end token. Without any training row every probability is 1 over
the vocabulary with its unknown word, that is 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.llm.shared_arrays import map_arrays, write_arrays
from obslab.llm.word_batches import hash_words, slices, words_of_batch
from obslab.session import shared_dir

#: Training rows for which one range of words is made; the number of ranges is a power of two, 16 at least.
RANGE_ROWS = 4096
#: No word holds white space, so the end token's hash is no word's but by chance.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
PARTS = "shard int, kind int, a binary, b binary, c binary, d binary"
VOCABULARY, BIGRAMS, FOLLOWS, TRIGRAMS = 0, 1, 2, 3
#: Bytes of text whose trigrams are added up at once.
COUNTED_BYTES = 16 << 20
COUNT_LIMIT = np.iinfo(np.uint8).max
#: Words of a context whose sums are added up when asked; longer runs have theirs stored.
SHORT_RUN = 16
#: An odd number: multiplying by it is one to one on the last bits.
MIXER = 0x9E3779B97F4A7C15
#: Contexts in one step of a range, about.
STEP = 8
MANIFEST = "kind int, shard int, n bigint, m bigint, total bigint, long bigint, ones bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


@dataclass
class Model:
    """Where the arrays are, their sizes by range, and the sums that discounts come from."""

    path: str
    bits: int
    words: list[int] = field(default_factory=list)  # distinct words of each range
    bigrams: list[tuple[int, int, int]] = field(default_factory=list)  # keys, overflowing counts and long runs of each range
    tokens: int = 0
    counts: list[list[int]] = field(default_factory=lambda: [[0] * 4 for _ in range(3)])  # n1..n4 of bigrams, words' contexts, trigrams
    order: int = 2
    trigrams: list[tuple[int, ...]] = field(default_factory=list)  # keys, overflowing counts, contexts, long runs and lone keys of each range

    @property
    def starts(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.words, dtype=np.int64)] if self.words else np.zeros(2, np.int64)

    @property
    def vocabulary(self) -> int:
        return int(sum(self.words))

    def file(self, kind: int, shard: int) -> str:
        return f"{self.path}/{('vocabulary', 'bigrams', 'follows', 'trigrams')[kind]}-{shard:06d}.bin"


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2, 3 and more, kept positive where a corpus is too small for them."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k) for k, x in zip((0.95, 1.95, 2.95), d))])


def combine(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """The values' byte planes, compressed; of ascending values the differences."""
    values = np.diff(values, prepend=values.dtype.type(0)) if ascending else np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def joined(cells: pd.Series, kind: str, ascending: bool = False) -> np.ndarray:
    """The packed cells' values, one cell after the other."""
    out = [np.zeros(0, kind)]
    for c in cells:
        size = int.from_bytes(c[:8], "little")
        if size:
            planes = np.frombuffer(pa.decompress(c[8:], decompressed_size=size, codec="zstd"), np.uint8)
            values = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
            out.append(np.cumsum(values, dtype=kind) if ascending else values)
    return np.concatenate(out)


def parts(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), *[pa.binary()] * 4])]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "kind", "a", "b", "c", "d"])


def count_words(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of_batch(batch.column(0), lower=True)
            hashes = np.r_[hash_words(found.distinct), END]
            counts = np.r_[np.bincount(found.codes, minlength=len(found.distinct)), batch.num_rows]
            seen = counts > 0
            hashes, counts = combine(hashes[seen], counts[seen])
            cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = [
                (s, VOCABULARY, packed(hashes[a:b], True), packed(counts[a:b].astype("<u4")), None, None)
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a
            ]
            if rows:
                yield parts(rows)

    return run


def store_words(model: Model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        hashes, counts = combine(joined(rows["a"], "<u8", True), joined(rows["b"], "<u4").astype(np.int64))
        write_arrays(model.file(VOCABULARY, shard), [hashes.astype("<u8"), counts.astype("<i8")])
        return manifest(VOCABULARY, shard, len(hashes), 0, int(counts.sum()))

    return run


def manifest(kind: int, shard: int, n: int, m: int, total: int, counts: tuple[int, ...] = (0, 0, 0, 0), long: int = 0, ones: int = 0) -> pd.DataFrame:
    return pd.DataFrame([(kind, shard, n, m, total, long, ones, *counts)], columns=[c.split()[0] for c in MANIFEST.split(", ")])


@lru_cache(maxsize=2)
def vocabulary_arrays(path: str, bits: int, sizes: tuple[int, ...]) -> list[list[np.ndarray]]:
    model = Model(path, bits)
    return [map_arrays(model.file(VOCABULARY, s), [("<u8", n), ("<i8", n)]) if n else [np.zeros(0, "<u8"), np.zeros(0, "<i8")] for s, n in enumerate(sizes)]


def number_words(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (the vocabulary's size for an unknown word) and counts of words by hash."""
    arrays, starts = vocabulary_arrays(model.path, model.bits, tuple(model.words)), model.starts
    order = np.argsort(hashes)
    ordered = hashes[order]
    numbers, counts = np.full(len(hashes), model.vocabulary, np.int64), np.zeros(len(hashes), np.int64)
    cuts = np.searchsorted(ordered >> np.uint64(64 - model.bits), np.arange(len(arrays) + 1, dtype=np.uint64))
    for (known, seen), start, a, b in zip(arrays, starts, cuts[:-1], cuts[1:]):
        if b > a and len(known):
            at = np.minimum(np.searchsorted(known, ordered[a:b]), len(known) - 1)
            hit = known[at] == ordered[a:b]
            numbers[order[a:b][hit]] = start + at[hit]
            counts[order[a:b][hit]] = seen[at[hit]]
    return numbers, counts


def token_stream(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' tokens, ends included: numbers, the numbers before them, counts; and where each text's tokens start."""
    found = words_of_batch(texts, lower=True)
    numbers, counts = number_words(model, np.r_[hash_words(found.distinct), END])
    n = len(found.ends)
    ends = found.ends + np.arange(n)  # place of each end token
    codes = np.full(len(found.codes) + n, len(found.distinct), np.int64)
    words = np.ones(len(codes), bool)
    words[ends] = False
    codes[words] = found.codes
    tokens, seen = numbers[codes], counts[codes]
    starts = np.r_[0, ends[:-1] + 1]
    before = np.r_[0, tokens[:-1]]
    before[starts] = model.vocabulary + 1
    return tokens, before, seen, starts


def context_width(model: Model) -> int:
    """Context numbers of one range: words, the unknown word's number and the begin mark's."""
    return -(-(model.vocabulary + 2) // (1 << model.bits))


def count_bigrams(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = context_width(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, before, _, _ = token_stream(model, batch.column(0))
            keys, counts = combine(before.astype(np.uint64) << np.uint64(32) | tokens.astype(np.uint64))
            yield parts(bigram_rows(model, keys, counts, width))

    return run


def runs_of(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal contexts starts, and its length."""
    first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]])
    return first, np.diff(np.r_[first, len(contexts)]).astype("<u4")


def bigram_rows(model: Model, keys: np.ndarray, counts: np.ndarray, width: int) -> list[tuple]:
    """Ascending bigram keys and their counts, by range of contexts."""
    contexts = (keys >> np.uint64(32)).astype("<u4")
    cuts = np.searchsorted(contexts, np.arange((1 << model.bits) + 1) * width)
    rows = []
    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b > a:
            own = contexts[a:b]
            first, runs = runs_of(own)
            rows.append((s, BIGRAMS, packed((keys[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")), packed(counts[a:b].astype("<u4")), packed(own[first], True), packed(runs)))
    return rows


def pair_contexts(model: Model, before: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two words before each token as one number; two begin marks precede a text."""
    second = np.r_[0, before[:-1]]
    second[starts] = model.vocabulary + 1
    return second.astype(np.uint64) << np.uint64(32) | before.astype(np.uint64)


def half_width(model: Model) -> int:
    """Bits of one word's number in a mixed context; both words' have at least as many as there are ranges."""
    return max((model.vocabulary + 1).bit_length(), model.bits // 2 + 1)


def mixed_contexts(model: Model, contexts: np.ndarray) -> np.ndarray:
    """The contexts' two numbers beside each other, mixed one to one; the first bits name the range."""
    half = np.uint64(half_width(model))
    mask = np.uint64((1 << 2 * int(half)) - 1)
    x = ((contexts >> np.uint64(32)) << half | contexts & np.uint64(0xFFFFFFFF)) * np.uint64(MIXER) & mask
    return (x ^ x >> half) * np.uint64(MIXER) & mask


def second_words(model: Model, mixed: np.ndarray) -> np.ndarray:
    """The second word's number of each mixed context."""
    half = half_width(model)
    inverse, mask = np.uint64(pow(MIXER, -1, 1 << 64)), np.uint64((1 << 2 * half) - 1)
    x = mixed * inverse & mask
    return (x ^ x >> np.uint64(half)) * inverse & np.uint64((1 << half) - 1)


def trigram_shards(model: Model, mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(2 * half_width(model) - model.bits)).astype(np.int32)


def step_bits(model: Model, n: int) -> tuple[int, int]:
    """Bits of a step's number in a range of ``n`` contexts, and the bits after it: 32 at most."""
    rest = 2 * half_width(model) - model.bits
    steps = min(rest, max(rest - 32, (n // STEP).bit_length()))
    return steps, rest - steps


def stepped(model: Model, mixed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The step of each mixed context of a range with ``n`` contexts, and the rest of its number."""
    steps, low = step_bits(model, n)
    own = mixed & np.uint64((1 << steps + low) - 1)
    return (own >> np.uint64(low)).astype(np.int64), (own & np.uint64((1 << low) - 1)).astype("<u4")


def step_arrays(model: Model, mixed: np.ndarray) -> list[np.ndarray]:
    """Where each step of ascending mixed contexts starts, and the rest of their numbers."""
    steps, rest = stepped(model, mixed, len(mixed))
    return [np.searchsorted(steps, np.arange((1 << step_bits(model, len(mixed))[0]) + 1)).astype("<u4"), rest]


def places(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is in its own ascending part [low, high) of ``values``, and whether it is there."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    end, open_ = high.copy(), np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = values[middle] < wanted[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    found = low < end
    found[found] = values[low[found]] == wanted[found]
    return low, found


def find_contexts(model: Model, starts: np.ndarray, rest: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, wanted = stepped(model, mixed, len(rest))
    return places(rest, wanted, starts[steps], starts[steps + 1])


def combine_trigrams(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word), ascending, and their summed counts."""
    order = np.lexsort((words, contexts))
    contexts, words = contexts[order], words[order]
    first = np.flatnonzero(np.r_[True, (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])])
    sums = np.diff(np.r_[first, len(contexts)]) if counts is None else np.add.reduceat(counts[order], first)
    return contexts[first], words[first], sums


def count_trigrams(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, COUNTED_BYTES)):
            tokens, before, _, starts = token_stream(model, batch.column(0))
            contexts, words, counts = combine_trigrams(mixed_contexts(model, pair_contexts(model, before, starts)), tokens.astype("<u4"))
            cuts = np.searchsorted(trigram_shards(model, contexts), np.arange((1 << model.bits) + 1))
            rows = []
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if b > a:
                    first, runs = runs_of(contexts[a:b])
                    rows.append((s, TRIGRAMS, packed(words[a:b]), packed(counts[a:b].astype("<u4")), packed(contexts[a:b][first], True), packed(runs)))
            yield parts(rows)

    return run


def store_trigrams(model: Model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Stores a range of contexts; returns after how many first words each pair was seen, by range, and a row for the manifest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        contexts, words, counts = combine_trigrams(
            np.repeat(joined(rows["c"], "<u8", True), joined(rows["d"], "<u4")), joined(rows["a"], "<u4"), joined(rows["b"], "<u4").astype(np.int64))
        first, runs = runs_of(contexts)
        lone = np.repeat(runs == 1, runs)
        order = np.r_[np.flatnonzero(lone), np.flatnonzero(~lone)]
        over, large, small = small_counts(counts[order])
        ones, many = contexts[first[runs == 1]], contexts[first[runs > 1]]
        sums, starts, long = run_sums(counts[~lone], runs[runs > 1])
        write_arrays(model.file(TRIGRAMS, shard), [
            *sums, over, large, *long, starts, *step_arrays(model, ones), *step_arrays(model, many), words[order].astype("<u4"), small])
        pairs, firsts = combine(second_words(model, contexts) << np.uint64(32) | words.astype(np.uint64))
        out = bigram_rows(model, pairs, firsts, context_width(model))
        told = np.array([shard, len(counts), len(over), len(first), len(sums[0]), len(ones), *counts_of_counts(counts)], "<i8")
        out.append((shard, TRIGRAMS, told.tobytes(), None, None, None))
        return pd.DataFrame(out, columns=["shard", "kind", "a", "b", "c", "d"])

    return run


def small_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of the counts above a byte, and all counts up to it."""
    over = np.flatnonzero(counts >= COUNT_LIMIT)
    return over.astype("<i8"), counts[over].astype("<i8"), np.minimum(counts, COUNT_LIMIT).astype("<u1")


def counts_at(over: np.ndarray, large: np.ndarray, small: np.ndarray, at: np.ndarray) -> np.ndarray:
    counts = small[at].astype(np.int64)
    top = np.flatnonzero(counts == COUNT_LIMIT)
    counts[top] = large[np.searchsorted(over, at[top])]
    return counts


def run_sums(counts: np.ndarray, runs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Totals of the long runs, where every run starts, and of the long ones: number, and how many counts are 1 and 2."""
    starts = np.r_[0, np.cumsum(runs, dtype=np.int64)]
    long = np.flatnonzero(runs > SHORT_RUN)
    own = np.repeat(np.arange(len(runs)), runs)
    kinds = [np.bincount(own[counts == k], minlength=len(runs))[long].astype("<u4") for k in (1, 2)]
    return [np.bincount(own, weights=counts, minlength=len(runs))[long].astype("<f8")], starts.astype("<u4"), [long.astype("<u4"), *kinds]


def counts_of_counts(counts: np.ndarray) -> tuple[int, ...]:
    return tuple(int((counts == k).sum()) for k in (1, 2, 3, 4))


def store_bigrams(model: Model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Stores a range of contexts; returns the range's second words by their own range, and a row for the manifest; passes the trigram ranges' sums on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, width = int(rows["shard"].iloc[0]), context_width(model)
        passed, rows = rows[rows["kind"] == TRIGRAMS], rows[rows["kind"] == BIGRAMS]
        if not len(rows):
            return passed
        contexts = np.repeat(joined(rows["c"], "<u4", True), joined(rows["d"], "<u4")).astype(np.uint64)
        words = joined(rows["a"], "<u4").astype(np.uint64)
        keys, counts = combine(contexts << np.uint64(32) | words, joined(rows["b"], "<u4").astype(np.int64))
        runs = np.bincount((keys >> np.uint64(32)).astype(np.int64) - shard * width, minlength=width)
        over, large, small = small_counts(counts)
        totals, starts, long = run_sums(counts, runs)
        write_arrays(model.file(BIGRAMS, shard), [*totals, over, large, *long, starts, (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), small])
        seconds, contexts_of = combine((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
        cuts = np.searchsorted(seconds, model.starts)
        out = [
            (s, FOLLOWS, packed(seconds[a:b].astype("<u4"), True), packed(contexts_of[a:b].astype("<u4")), None, None)
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a
        ]
        sums = np.array([shard, len(keys), len(over), len(totals[0]), *counts_of_counts(counts)], "<i8")
        out.append((shard, BIGRAMS, sums.tobytes(), None, None, None))
        return pd.concat([pd.DataFrame(out, columns=["shard", "kind", "a", "b", "c", "d"]), passed])

    return run


def store_follows(model: Model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Stores in how many contexts each word of a range was seen; passes the other ranges' sums on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, out = int(rows["shard"].iloc[0]), []
        for a in rows["a"][rows["kind"] == BIGRAMS]:
            s = np.frombuffer(a, "<i8").tolist()
            out.append(manifest(BIGRAMS, s[0], s[1], s[2], 0, tuple(s[4:]), s[3]))
        for a in rows["a"][rows["kind"] == TRIGRAMS]:
            s = np.frombuffer(a, "<i8").tolist()
            out.append(manifest(TRIGRAMS, s[0], s[1], s[2], s[3], tuple(s[6:]), s[4], s[5]))
        own = rows[rows["kind"] == FOLLOWS]
        if len(own):
            start, n = int(model.starts[shard]), model.words[shard]
            counts = np.bincount(joined(own["a"], "<u4", True).astype(np.int64) - start, weights=joined(own["b"], "<u4"), minlength=n)
            write_arrays(model.file(FOLLOWS, shard), [counts.astype("<u4")])
            out.append(manifest(FOLLOWS, shard, n, 0, int(counts.sum()), counts_of_counts(counts)))
        return pd.concat(out)

    return run


def train(texts: DataFrame, column: str = "text", order: int = 2) -> Model:
    """Count ``column`` of all rows and store the model below the shared folder; ``order`` is 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    texts = texts.select(column)
    n = texts.count()
    bits = max(4, (max(1, n) // RANGE_ROWS).bit_length())
    model = Model(shared_dir(texts.sparkSession, "kneser-ney"), bits, [0] * (1 << bits), [(0, 0, 0)] * (1 << bits), order=order, trigrams=[(0,) * 5] * (1 << bits))
    if not n:
        return model
    words = texts.mapInArrow(count_words(bits), PARTS).groupBy("shard").applyInPandas(store_words(model), MANIFEST)
    for r in words.collect():
        model.words[r.shard] = r.n
        model.tokens += r.total
    if model.vocabulary >= 2**32 - 2:
        raise ValueError("word numbers must fit 32 bits")
    counted = texts.mapInArrow(count_bigrams(model), PARTS)
    if order == 3:
        counted = texts.mapInArrow(count_trigrams(model), PARTS).groupBy("shard").applyInPandas(store_trigrams(model), PARTS)
    bigrams = counted.groupBy("shard").applyInPandas(store_bigrams(model), PARTS)
    for r in bigrams.groupBy("shard").applyInPandas(store_follows(model), MANIFEST).collect():
        sums = model.counts[{BIGRAMS: 0, FOLLOWS: 1, TRIGRAMS: 2}[r.kind]]
        for k, x in enumerate((r.n1, r.n2, r.n3, r.n4)):
            sums[k] += x
        if r.kind == BIGRAMS:
            model.bigrams[r.shard] = (r.n, r.m, r.long)
        if r.kind == TRIGRAMS:
            model.trigrams[r.shard] = (r.n, r.m, r.total, r.long, r.ones)
    return model


@lru_cache(maxsize=2)
def bigram_arrays(path: str, bits: int, sizes: tuple[tuple[int, int, int], ...], width: int) -> list[list[np.ndarray] | None]:
    model = Model(path, bits)
    return [
        map_arrays(model.file(BIGRAMS, s), [("<f8", k), ("<i8", m), ("<i8", m), ("<u4", k), ("<u4", k), ("<u4", k), ("<u4", width + 1), ("<u4", n), ("<u1", n)]) if n else None
        for s, (n, m, k) in enumerate(sizes)
    ]


@lru_cache(maxsize=2)
def trigram_arrays(path: str, bits: int, sizes: tuple[tuple[int, ...], ...], words: tuple[int, ...]) -> list[list[np.ndarray] | None]:
    model, out = Model(path, bits, list(words)), []
    for s, (n, m, contexts, k, ones) in enumerate(sizes):
        many = contexts - ones
        steps = [(1 << step_bits(model, x)[0]) + 1 for x in (ones, many)]
        shapes = [("<f8", k), ("<i8", m), ("<i8", m), *[("<u4", x) for x in (k, k, k, many + 1, steps[0], ones, steps[1], many, n)], ("<u1", n)]
        out.append(map_arrays(model.file(TRIGRAMS, s), shapes) if n else None)
    return out


@lru_cache(maxsize=2)
def follow_arrays(path: str, bits: int, sizes: tuple[int, ...]) -> list[np.ndarray]:
    model = Model(path, bits)
    return [map_arrays(model.file(FOLLOWS, s), [("<u4", n)])[0] if n else np.zeros(0, "<u4") for s, n in enumerate(sizes)]


def unigram_probability(model: Model, numbers: np.ndarray) -> np.ndarray:
    """Share of the contexts that a word follows, discounted, plus its part of what that leaves for all words."""
    total = sum(n for n, _, _ in model.bigrams)
    unknown = 1 / (model.vocabulary + 1)
    if not total:
        return np.full(len(numbers), unknown)
    d, n = discounts(model.counts[1]), model.counts[1]
    left = (d[1] * n[0] + d[2] * n[1] + d[3] * (model.vocabulary - n[0] - n[1])) / total
    follows, seen = follow_arrays(model.path, model.bits, tuple(model.words)), np.zeros(len(numbers), np.int64)
    cuts = np.searchsorted(numbers, model.starts)
    for own, start, a, b in zip(follows, model.starts, cuts[:-1], cuts[1:]):
        seen[a:b] = own[numbers[a:b] - start]
    return (seen - d[np.minimum(seen, 3)]) / total + left * unknown


def probabilities(model: Model, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Probability of each token after the one before it."""
    distinct, place = np.unique(tokens, return_inverse=True)
    single = unigram_probability(model, distinct)[place]
    keys, back = np.unique(before.astype(np.uint64) << np.uint64(32) | tokens.astype(np.uint64), return_inverse=True)
    contexts, width, d = (keys >> np.uint64(32)).astype(np.int64), context_width(model), discounts(model.counts[0])
    found, left = np.zeros(len(keys)), np.ones(len(keys))
    cuts = np.searchsorted(contexts, np.arange((1 << model.bits) + 1) * width)
    for s, arrays in enumerate(bigram_arrays(model.path, model.bits, tuple(model.bigrams), width)):
        a, b = cuts[s], cuts[s + 1]
        if b == a or arrays is None:
            continue
        found[a:b], left[a:b] = shares(arrays, (keys[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), contexts[a:b] - s * width, d)
    return found[back] + left[back] * single


def sums_of(arrays: list[np.ndarray], own: np.ndarray, before: int) -> np.ndarray:
    """Of each run: its counts' total, and how many of them are 1, 2 and more; the first run's counts have ``before`` others before them."""
    totals, over, large, long, n1, n2, starts, _, small = arrays
    low = starts[own].astype(np.int64)
    runs, sums = starts[own + 1].astype(np.int64) - low, np.zeros((len(own), 4))
    stored = np.flatnonzero(runs > SHORT_RUN)
    at = np.searchsorted(long, own[stored])
    sums[stored] = np.stack([totals[at], n1[at], n2[at], runs[stored] - n1[at].astype(np.int64) - n2[at]], axis=1)
    short = np.flatnonzero((runs > 0) & (runs <= SHORT_RUN))
    first = np.r_[0, np.cumsum(runs[short])]
    counts = counts_at(over, large, small, np.repeat(low[short] + before - first[:-1], runs[short]) + np.arange(first[-1]))
    if len(short):
        sums[short] = np.stack([np.add.reduceat(x, first[:-1]) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1, dtype=float)
    return sums


def shares(arrays: list[np.ndarray], words: np.ndarray, own: np.ndarray, d: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of words in their contexts' runs: the discounted share of the context's count, and what the context leaves for the lower order."""
    _, over, large, _, _, _, starts, known, small = arrays
    at, hit = places(known, words, starts[own].astype(np.int64) + before, starts[own + 1].astype(np.int64) + before)
    count = np.zeros(len(own), np.int64)
    count[hit] = counts_at(over, large, small, at[hit])
    distinct, place = np.unique(own, return_inverse=True)
    total, n1, n2, n3 = sums_of(arrays, distinct, before)[place].T
    seen = total > 0
    total = np.where(seen, total, 1)
    return np.where(seen, (count - d[np.minimum(count, 3)]) / total, 0), np.where(seen, (d[1] * n1 + d[2] * n2 + d[3] * n3) / total, 1)


def trigram_probabilities(model: Model, tokens: np.ndarray, contexts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probability of each token after the two before it, ``lower`` being that after one."""
    mixed, d = mixed_contexts(model, contexts), discounts(model.counts[2])
    order = np.lexsort((tokens, mixed))
    cuts = np.searchsorted(trigram_shards(model, mixed[order]), np.arange((1 << model.bits) + 1))
    out, sizes = lower.copy(), tuple(model.trigrams)
    for s, arrays in enumerate(trigram_arrays(model.path, model.bits, sizes, tuple(model.words))):
        chosen = order[cuts[s] : cuts[s + 1]]
        if arrays is None or not len(chosen):
            continue
        *sums, starts, steps, rest, steps_many, rest_many, known, small = arrays
        over, large, ones = sums[1], sums[2], len(rest)
        at, hit = find_contexts(model, steps, rest, mixed[chosen])
        rows, at = chosen[hit], at[hit]
        total = counts_at(over, large, small, at)
        kept = d[np.minimum(total, 3)]
        out[rows] = np.where(known[at] == tokens[rows], (total - kept) / total, 0) + kept / total * lower[rows]
        rest_of = chosen[~hit]
        at, hit = find_contexts(model, steps_many, rest_many, mixed[rest_of])
        rows = rest_of[hit]
        found, left = shares([*sums, starts, known, small], tokens[rows].astype("<u4"), at[hit], d, ones)
        out[rows] = found + left * lower[rows]
    return out


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: (key, n_tokens, n_known, train_tokens, base_score, score); scores are sums of log10."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)
    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.log10(model.tokens + 1 * (model.vocabulary + 1))
        for batch in (part for whole in batches for part in slices(whole, 1)):
            tokens, before, seen, starts = token_stream(model, batch.column(1))
            p = probabilities(model, tokens, before)
            if model.order == 3:
                p = trigram_probabilities(model, tokens, pair_contexts(model, before, starts), p)
            p = np.log10(p)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(arrow), pa.array(np.diff(np.r_[starts, len(tokens)])), pa.array(np.add.reduceat((seen > 0).astype(np.int64), starts)),
                pa.array(np.full(len(starts), model.tokens)), pa.array(np.add.reduceat(np.log10(seen + 1.0) - scale, starts)), pa.array(np.add.reduceat(p, starts)),
            ], names=names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train_and_score(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Scores of all rows by a model of those that are not held out; repeated rows are scored each."""
    return score(df, train(df.where(~held_out), text, order), key, text)
