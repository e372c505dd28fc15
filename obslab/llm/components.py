"""Connected components of a table of edges, by alternating large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.llm.common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """Rows (u, v) with m: the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    return pairs.join(least, "u")


def stars(pairs: DataFrame) -> bool:
    """Whether each u has one v and no v is a u. Another round would change nothing then."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("_out")).union(pairs.select("v", F.lit(0)))
    counted = ends.groupBy("node").agg(F.sum("_out").alias("_out"), F.count(F.lit(1)).alias("_all"))
    return counted.where("_out > 1 or _out > 0 and _all > _out").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the component's least node.

    Each round is written to the shared folder. Rounds end when every node points at a root alone; their number grows with
    the logarithm of the longest chain.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while not stars(now):
        both = now.union(now.select("v", "u"))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = _least(large.where("u != v").distinct())
        small = down.select("u", F.col("m").alias("v")).union(down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(small.where("u != v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
