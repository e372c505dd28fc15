"""Words of an Arrow batch of texts, cut and named by Arrow's own kernels, and hashes of the distinct ones."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


class Words(NamedTuple):
    """Words of a batch in order: their codes, the distinct words, and where each text's words end."""

    codes: np.ndarray
    distinct: pa.Array
    ends: np.ndarray

    def rows(self) -> np.ndarray:
        """Number of the text that each word is from."""
        return np.repeat(np.arange(len(self.ends)), np.diff(np.r_[0, self.ends]))


def words_of_batch(texts: pa.Array, lower: bool = False) -> Words:
    """Words between ASCII white space (null: none); ``lower`` turns A-Z only."""
    texts = pc.fill_null(texts, "")
    # Lowered before the cast: Arrow lowers the wrong bytes of a slice that was cast.
    texts = (pc.ascii_lower(texts) if lower else texts).cast(pa.large_string())
    cut = pc.ascii_split_whitespace(texts)
    named = cut.flatten().dictionary_encode()
    codes, distinct = named.indices.to_numpy(), named.dictionary
    ends = cut.offsets.to_numpy()[1:].astype(np.int64) - cut.offsets.to_numpy()[0]
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:  # beside leading or trailing white space
        kept = codes != empty
        ends = np.r_[0, np.cumsum(kept)][ends]
        codes = codes[kept]
    return Words(codes, distinct, ends)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts take at most ``most`` bytes together, or of one row: they bound a task's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().cumsum()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, most + (sizes[start - 1] if start else 0), "right")))
        yield batch.slice(start, end - start)
        start = end


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each word's UTF-8 bytes."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode()) for w in distinct.to_pylist()), np.uint64, len(distinct))
