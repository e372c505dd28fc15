"""Bottom-k sketches of word shingles: mergeable fingerprints that estimate likeness.

A fingerprint is the ascending list of the k smallest distinct 64-bit hashes of the runs of five words of a text (a
shorter text is one run; a text without words, or null, has an empty fingerprint). Equal texts have equal fingerprints,
and the fingerprint of a text put together from parts is the ``merge`` of the parts' (but for runs over the joints).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obslab.llm.common import let, shingle_hashes, text_of, words_of

K = 128
SHINGLE = 5
#: Rows that a cell holds on average, and cells at most (their heads are broadcast: 24 bytes each).
CELL_ROWS, MOST_CELLS = 4096, 1 << 20
#: Zones of about as many rows, whose keys are dealt to cells of equal width, and the error of their ranks.
ZONES, ZONE_ERROR = 128, 1 / 2048


def fingerprint(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(words_of(text), size))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of the union of both shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: 1 for two empty fingerprints, 0 if just one is empty."""
    both = let(merge(a, b, k), lambda m: F.size(F.array_intersect(F.array_intersect(m, a), b)) / F.size(m))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range used."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; null if a is empty."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_all(df: DataFrame, group: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each group: the k smallest distinct hashes of all its rows, combined before the shuffle."""
    hashes = df.select(*group, F.explode(column).alias("_h")).distinct()
    salted = Window.partitionBy(*group, F.pmod("_h", F.lit(64))).orderBy("_h")
    few = hashes.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= k)
    return few.groupBy(*group).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(column))


def as_text(a: Column) -> Column:
    """Hexadecimal digits of the hashes, 16 each."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def cell_number(k: Column, bounds: list[float], each: int) -> Column:
    """Number of the cell of key ``k``, never falling as ``k`` rises: its zone's number times ``each``, plus its place there."""
    ends = F.array(*map(F.lit, bounds))

    def place(zone: Column) -> Column:
        low, high = F.get(ends, zone), F.get(ends, zone + 1)
        share = F.coalesce((k - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
        return zone * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor(share * each)))

    zone = F.least(F.lit(max(0, len(bounds) - 2)), F.greatest(F.lit(0), F.size(F.filter(ends, lambda b: b <= k)) - 1))
    return F.when(k.isNotNull(), let(zone, place)).cast("bigint")


def in_cells(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Deal the rows to cells of consecutive keys, so that each row's successor is in its cell.

    Quantiles of the keys bound ZONES zones, and a zone is cut into cells of equal width, so that a few distant keys widen
    the cells of their own zone only. All is reckoned in doubles, which keep the order of any long keys; nulls come first, in
    a cell of their own. Each cell also gets a copy, marked ``_guest``, of the first row of the next cell that has any, the
    last that of the first. The successor of a cell is found by one narrow window over the numbers of the cells that have
    rows, MOST_CELLS at most.
    """
    n = df.count()
    cuts = min(ZONES, max(1, n // CELL_ROWS))
    quantiles = df.select(F.col(key).cast("double").alias("_k")).approxQuantile("_k", [i / cuts for i in range(cuts + 1)], ZONE_ERROR)
    bounds = sorted(set(quantiles)) or [0.0]
    each = min(MOST_CELLS // ZONES, max(1, -(-n // (CELL_ROWS * cuts))))
    celled = df.withColumn("_cell", F.coalesce(let(F.col(key).cast("double"), lambda k: cell_number(k, bounds, each)), F.lit(-1)))
    heads = celled.groupBy("_cell").agg(F.min(key).alias("_key"))
    previous = F.coalesce(F.lag("_cell").over(Window.orderBy("_cell")), F.max("_cell").over(Window.partitionBy()))
    heads = heads.select(F.col("_cell").alias("_from"), "_key", previous.alias("_to"))
    joined = celled.join(F.broadcast(heads), (F.col("_cell") == F.col("_from")) & F.col(key).eqNullSafe(F.col("_key")))
    first = joined.withColumn("_n", F.row_number().over(Window.partitionBy("_cell").orderBy(tie))).where("_n = 1")
    guests = first.withColumn("_cell", F.col("_to")).drop("_from", "_key", "_to", "_n")
    return celled.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))


def with_next(celled: DataFrame, key: str, tie: str, carried: list[str]) -> DataFrame:
    """Rows of ``in_cells`` with ``next_<column>``: the value in the next row, ascending (key, tie), nulls first.

    After the last row comes the first. Rows that are alike in key and tie follow each other in any order.
    """
    ordered = Window.partitionBy("_cell").orderBy("_guest", key, tie)
    leads = [F.lead(c).over(ordered).alias(f"next_{c}") for c in carried]
    return celled.select("*", *leads).where(~F.col("_guest")).drop("_cell", "_guest")


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the code points (rounded down) gives way to as many, or all, of the following text's first."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(df: DataFrame, k: int = K, text: str = "text") -> DataFrame:
    """All rows and columns, plus ``fingerprint``; repeated rows each have theirs, an empty table gives none."""
    return df.withColumn("fingerprint", fingerprint(text_of(text), k))


def edit_likeness(df: DataFrame, k: int = K) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and the likeness to that and to the next document's."""
    celled = in_cells(df.select("doc_id", text_of().alias("text")), "doc_id", "text")
    sketched = fingerprints(celled, k).withColumnRenamed("fingerprint", "sketch")
    pairs = with_next(sketched, "doc_id", "text", ["text", "sketch"])
    edited = pairs.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), edited_text(F.col("text"), F.col("next_text")).alias("edited"),
        "sketch", "next_sketch",
    )
    both = edited.withColumn("edited_sketch", fingerprint(F.col("edited"), k))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
