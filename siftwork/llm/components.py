"""Connected components by alternating large-star and small-star steps, as joins and group minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import stored


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b); loops and repeats do no harm.

    Each round writes its edges to the shared folder. Rounds grow with the logarithm of the longest chain.
    Minima are combined before they are shuffled, and a node of many links meets them in a join that can be split.
    """
    edges = stored(_directed(links), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _directed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(_directed(small), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
