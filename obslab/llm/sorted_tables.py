"""Tables of sorted keys that workers look up in mapped files of the shared folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.llm.shared_arrays import map_arrays, write_arrays
from obslab.session import shared_dir

#: Keys of one file, which a task holds while it writes them.
FILE_KEYS = 1 << 21


class SortedTable(NamedTuple):
    """Files in the order of their keys: (path, number of keys, first key), and the names of the columns beside the key."""

    files: tuple[tuple[str, int, int], ...]
    columns: tuple[str, ...]
    #: The most rows that share a key.
    repeats: int

    def find(self, keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is there, and its values of the columns (0 where it is not).

        With ``check`` a row only counts if its first column has that value too: a second hash, for instance.
        """
        found = np.zeros(len(keys), bool)
        values = [np.zeros(len(keys), np.int64) for _ in self.columns]
        if not self.files or not len(keys):
            return found, values
        firsts = np.array([f[2] for f in self.files], np.int64)
        order = np.argsort(keys, kind="stable")
        # A key that starts a file may also end the one before it.
        lows, highs = (np.searchsorted(firsts, keys[order], side) - 1 for side in ("left", "right"))
        for file in np.unique(np.r_[lows[lows >= 0], highs[highs >= 0]]):
            at = order[(lows <= file) & (file <= highs)]
            held, *columns = _mapped(self.files[file][0], self.files[file][1], len(self.columns))
            place = np.searchsorted(held, keys[at])
            for _ in range(self.repeats):
                here = np.minimum(place, len(held) - 1)
                same = (place < len(held)) & (held[here] == keys[at])
                if check is not None:
                    same &= columns[0][here] == check[at]
                found[at[same]] = True
                for value, column in zip(values, columns):
                    value[at[same]] = column[here[same]]
                place = place + 1
        return found, values


@lru_cache(maxsize=256)
def _mapped(path: str, n: int, columns: int) -> list[np.ndarray]:
    return map_arrays(path, [("<i8", n)] * (1 + columns))


def write_sorted(rows: DataFrame, key: str, columns: Sequence[str], file_keys: int = FILE_KEYS) -> SortedTable:
    """Write the rows (longs without null) by ranges of the key; what reaches the driver is one line for each file."""
    spark = rows.sparkSession
    folder = shared_dir(spark, "sorted")
    n, repeats = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    ranges = rows.select(key, *columns).repartitionByRange(1 + (n or 0) // file_keys, key).sortWithinPartitions(key, *columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            part = table.column("_part")[0].as_py()
            arrays = [table.column(c).to_numpy().astype("<i8", copy=False) for c in (key, *columns)]
            write_arrays(f"{folder}/{part}", arrays)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, table.num_rows, int(arrays[0][0]))], ["part", "n", "first"])

    told = ranges.withColumn("_part", F.spark_partition_id().cast("bigint")).mapInArrow(write, "part bigint, n bigint, first bigint")
    files = tuple((f"{folder}/{r['part']}", r["n"], r["first"]) for r in sorted(told.collect(), key=lambda r: r["part"]))
    return SortedTable(files, tuple(columns), repeats or 0)
