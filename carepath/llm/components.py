"""Connected components of a table of links, by alternating large and small stars.

Every round is a grouping and an equi-join on node keys; hot nodes are combined before the
shuffle. The joins of a large table read stored sides, as the adaptive planner splits a hot node's
rows only where both sides come straight from a shuffle. Nothing is collected, and a round's
tables go when the next one is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import discard, stored

#: Links up to which a round is one job; hot nodes are no matter in so few rows.
FEW_LINKS = 1_000_000


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node that has a link and is not a root itself.

    `links` has columns u and v of one ordered type; loops and repeated links do no harm.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _sum(edges)
    while state[0]:
        side = stored if state[0] > FEW_LINKS else lambda df, name: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "nearest")
        large = side(both.where("v > u").join(nearest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = side(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least.hint("merge"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, stored(small.distinct(), "links")
        state, before = _sum(edges), state
        discard(old, nearest, large, least)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
