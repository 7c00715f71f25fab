"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.common import saved


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair and the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v): root is the least node that can be reached.

    Rounds of large and small stars: the links of a node are moved to its least partner until each
    component is one star. A component of n nodes takes about log(n) rounds, and a round never makes more
    links than it reads. Every round is a written table, so no lineage grows. The least partner is
    folded before the shuffle; the join back to a hub is one that adaptive execution splits.
    """
    pairs = saved(links.select("u", "v").where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = _with_least(down)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        pairs = saved(moved.where("u <> v").distinct(), "links")
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if state == seen:
            break
        seen = state
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
