"""Token counts: pieces are counted once for each distinct pre-token and joined to the documents' pre-token frequencies.

1. Documents are cut into pre-tokens by the vocabulary's own pattern, in the JVM; the special string cuts them before
   that, as in the tokenizer, and counts as one token. Each Arrow batch of documents is a block. It gives one row for each
   distinct pre-token: the block's documents that have it, and how often. A hot pre-token has one row a block.
2. Rows meet by pre-token (those with many documents spread further by block), sorted by it: each distinct pre-token is
   tokenised once there, and its piece count multiplies the frequencies.
3. Sums for each task and block, then for each block, give the documents' counts. No ids are kept anywhere.

Null text counts as empty: no bytes, no tokens. Repeated rows are counted each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obslab.llm.common import text_of

VOCABULARY = "byte_bpe_50k.json"
#: The vocabulary's pattern; (?U) gives \s its Unicode meaning in the JVM.
PATTERN = f"(?U){public_tokenizers.PATTERN}"
SPECIAL = "<|endoftext|>"
#: Documents of a block at most: their numbers fit 16 bits.
BLOCK_DOCS = 1 << 14
#: A pre-token's row is hot from so many documents on; hot rows are dealt by block as well.
HOT_DOCS, SALTS = 512, 64
#: Entries that a task adds up before it hands sums on.
HELD = 1 << 22
ROWS = "block bigint, pretoken string, entries binary, members binary"


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def piece_counts(path: str, pretokens: list[str]) -> np.ndarray:
    many = tokenizer(path).encode_batch_fast(pretokens, add_special_tokens=False)
    return np.fromiter((len(x.ids) for x in many), np.int64, len(pretokens))


def pretokens_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, n_special, pretokens)."""
    parts = F.split(text_of(text), re.escape(SPECIAL))
    found = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(PATTERN), F.lit(0))))
    return df.select(
        F.col(key), F.octet_length(text_of(text)).cast("bigint").alias("n_bytes"),
        (F.size(parts) - 1).cast("bigint").alias("n_special"), found.alias("pretokens"),
    )


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def to_entries(codes: np.ndarray, docs: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(document << 16 | frequency) ordered by code, and the number of entries of each code."""
    pairs = np.sort(codes.astype(np.int64) << 16 | docs)
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    counts, pairs = np.diff(np.r_[first, len(pairs)]), pairs[first]
    full = counts // 0xFFFF  # a frequency beyond 16 bits takes several entries
    more = 1 + full
    left = np.repeat(counts, more)
    last = np.cumsum(more) - 1
    amounts = np.full(len(left), 0xFFFF, np.int64)
    amounts[last] = left[last] - full * 0xFFFF
    entries = ((np.repeat(pairs, more) & 0xFFFF) << 16 | amounts).astype("<u4")
    return entries, np.bincount(np.repeat(pairs, more) >> 16, minlength=n_codes)


def block_rows(docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of each block of at most ``docs`` documents: its distinct pre-tokens, and one with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, docs):
                batch = whole.slice(at, docs)
                lists = batch.column("pretokens")
                lists = pa.concat_arrays([lists])
                sizes = np.diff(lists.offsets.to_numpy())
                named = lists.flatten().dictionary_encode()
                entries, each = to_entries(
                    named.indices.to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), len(named.dictionary)
                )
                ends = np.r_[0, np.cumsum(each * 4)].astype("<i4")
                payload = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(entries.tobytes())])
                block = task << 32 | number
                number += 1
                n = len(each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), named.dictionary.cast(pa.string()), payload, pa.nulls(n, pa.binary())],
                    names=["block", "pretoken", "entries", "members"],
                )
                members = packed(batch.select([c for c in batch.schema.names if c != "pretokens"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([members], pa.binary())],
                    names=["block", "pretoken", "entries", "members"],
                )

    return run


def sums(blocks: np.ndarray, docs: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    """One row for each block: its documents' numbers and token sums."""
    order = np.lexsort((docs, blocks))
    blocks, docs, tokens = blocks[order], docs[order], tokens[order]
    first = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (docs[1:] != docs[:-1])])
    total = np.add.reduceat(tokens, first)
    blocks, pairs = blocks[first], np.empty((len(first), 2), "<u4")
    pairs[:, 0], pairs[:, 1] = docs[first], np.minimum(total, 0xFFFFFFFF)
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
    cells = [pairs[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(blocks)])]
    n = len(cells)
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks[starts]), pa.nulls(n, pa.string()), pa.array(cells, pa.binary()), pa.nulls(n, pa.binary())],
        names=["block", "pretoken", "entries", "members"],
    )


def multiply(path: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by pre-token in, sums by block out; the blocks' document rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            member = np.asarray(batch.column("pretoken").is_null())
            if member.any():
                yield batch.filter(pa.array(member))
                batch = batch.filter(pa.array(~member))
            if not batch.num_rows:
                continue
            named = batch.column("pretoken").dictionary_encode()
            pieces = piece_counts(path, named.dictionary.to_pylist())[named.indices.to_numpy()]
            values = pa.concat_arrays([batch.column("entries")])
            offsets = np.frombuffer(values.buffers()[1], "<i4")[values.offset : values.offset + len(values) + 1]
            entries = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4").astype(np.int64)
            each = np.diff(offsets) // 4
            held.append((np.repeat(batch.column("block").to_numpy(), each), entries >> 16, (entries & 0xFFFF) * np.repeat(pieces, each)))
            size += len(entries)
            if size >= most:
                yield sums(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield sums(*map(np.concatenate, zip(*held)))

    return run


def token_counts(
    df: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 1024, block_docs: int = BLOCK_DOCS,
    hot_docs: int = HOT_DOCS, held: int = HELD,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``df``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = pretokens_of(df, key, text).mapInArrow(block_rows(block_docs), ROWS)
    salt = F.when(F.col("pretoken").isNull(), F.col("block")).when(
        F.octet_length("entries") >= 4 * hot_docs, F.pmod("block", F.lit(SALTS))
    )
    met = rows.repartition("pretoken", salt).sortWithinPartitions("pretoken").mapInArrow(multiply(path, held), ROWS)
    kind = df.schema[key].dataType.simpleString()
    name = key

    def documents(parts: pd.DataFrame) -> pd.DataFrame:
        members = pa.ipc.open_stream(next(m for m in parts["members"] if m is not None)).read_all()
        total = np.zeros(members.num_rows, np.int64)
        for e in parts["entries"]:
            if e is not None:
                pairs = np.frombuffer(e, "<u4").reshape(-1, 2)
                np.add.at(total, pairs[:, 0], pairs[:, 1])
        out = members.to_pandas(types_mapper=pd.ArrowDtype)
        tokens = total + members.column("n_special").to_numpy()
        return pd.DataFrame({name: out[name], "n_bytes": members.column("n_bytes").to_numpy(), "n_tokens": tokens, "over_limit": tokens > limit})

    return met.groupBy("block").applyInPandas(documents, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
