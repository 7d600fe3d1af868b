"""Connected components of a link table, by alternating star steps.

A large-star step hangs every larger neighbour of a node on the smallest
node it knows, a small-star step does so for the smaller ones; both keep
components. When nothing changes any more, every node hangs on the
smallest node of its component. Each step is a minimum per node (combined
before the shuffle) and a join of two written tables, so that a node with very many links
can be split over tasks; links and labels never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _hang(pairs: DataFrame, keep) -> DataFrame:
    """For (u, v): the smallest of u's v and u itself joined to the rows."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    return pairs.join(least, F.col("u") == F.col("w")).where(keep).select("u", "v", "m")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is
    its smallest node. Nodes without links are not listed."""
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    state = _state(now)
    while state[0]:
        both = written(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = written(_hang(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = _hang(large, F.lit(True))
        stars = small.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("s"))
        now = written(stars.select("s.*").where("u != v").distinct(), "stars")
        before, state = state, _state(now)
        if state == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
