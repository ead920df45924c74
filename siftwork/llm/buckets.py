"""Exact comparison within large buckets, in tiles of bounded bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import stored


def one_of_equal(large: DataFrame) -> DataFrame:
    """The rows (bucket, node) of one bucket of those with the same members, as they have the same pairs."""
    sums = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")) for i in range(2)]
    marks = large.groupBy("bucket").agg(F.count("*").alias("m"), sums[0].alias("s"), sums[1].alias("t"))
    return large.join(marks.groupBy("m", "s", "t").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def stars(large: DataFrame, rank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bucket, pivot, the member of the largest rank (node, rank); and the pairs (a, b) of each other member with it."""
    pivots = large.join(rank, "node").groupBy("bucket").agg(F.max(F.struct("rank", "node"))["node"].alias("pivot"))
    pairs = large.join(pivots, "bucket").where("node <> pivot")
    return pivots, pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def tiles(large: DataFrame, pivots: DataFrame, groups: DataFrame, sizes: DataFrame, most: int, payload: DataFrame) -> DataFrame:
    """bucket, x, y, node, component, block and the columns of payload (node, ...): the rows of each tile (bucket, x, y).

    Members of large (bucket, node) that share the pivot's component (groups: node, component) are linked
    already; the rest meets all members. Both are dealt into blocks of about `most` of sizes (node, size), and a tile
    holds the blocks x and y of a bucket, so rows grow with the rest times the bucket.
    """
    named = groups.select(F.col("node").alias("pivot"), F.col("component").alias("hub"))
    hubs = pivots.join(named, "pivot", "left").select("bucket", F.coalesce("hub", "pivot").alias("hub"))
    placed = large.select("bucket", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sized = stored(placed.join(hubs, "bucket").join(sizes, "node").withColumn("main", F.col("component") == F.col("hub")).drop("hub"), "placed")
    total = [F.ceil(F.sum(F.when(which, F.col("size")).otherwise(0)) / most) for which in (F.col("main"), ~F.col("main"))]
    blocks = sized.groupBy("bucket").agg(total[0].alias("mains"), total[1].alias("rests"), (F.sum("size") <= most).alias("one")).where("rests > 0")
    # Blocks of the rest come first, then those of the pivot's component; a small bucket is one block.
    spread = F.xxhash64("node", "bucket")
    block = F.when(F.col("one"), F.lit(0)).when(F.col("main"), F.col("rests") + F.pmod(spread, "mains")).otherwise(F.pmod(spread, "rests"))
    last = F.when(F.col("one"), F.lit(0)).when(F.col("main"), F.col("rests") - 1).otherwise(F.col("rests") + F.col("mains") - 1)
    rows = sized.join(blocks, "bucket").withColumn("block", block.cast("long")).withColumn("last", last.cast("long")).join(payload, "node")
    kept = [c for c in payload.columns if c != "node"]
    met = rows.select("bucket", "node", "component", "block", *kept, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    return met.select("bucket", F.greatest("block", "other").alias("x"), F.least("block", "other").alias("y"), "node", "component", "block", *kept)
