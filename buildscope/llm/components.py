"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label): label is the least node of the node's component; nodes without edges are absent.

    edges has columns a and b of any type with an order. Large-star and small-star steps in
    turn: each hangs neighbours on the least one, so the number of rounds grows with the
    logarithm of the longest chain. Every step groups with map-side minima and joins them
    back by node, so a node with very many neighbours is never gathered in one row.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    said = _tally(now)
    while said[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, now = now, stored(small, "edges")
        forget(before)
        if (new := _tally(now)) == said:
            break
        said = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
