"""Connected components of links between keys, as star contractions (Kiveris et al. 2014).

Every round is two aggregations and joins over the links; rounds are logarithmic in the longest chain. A hub with any
number of links is aggregated in parts before the shuffle, and its links are split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """(a, root) for every key of ``links`` (a, b) that is not the smallest key of its component."""
    def state(df: DataFrame) -> tuple:
        # the decimal sum cannot overflow
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = write_through(links.where("a <> b").select("a", "b").distinct(), "links")
    seen = None
    while (found := state(now)) != seen:
        seen = found
        now = write_through(_small_star(_large_star(now)), "links")
    return now.select("a", F.col("b").alias("root"))
