"""Addresses against a table of networks: the narrowest one that holds each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.network import address_bits, network_bits, version


def narrowest(rows: DataFrame, networks: DataFrame, host: str, cidr: str, into: str) -> DataFrame:
    """Adds `into` to rows: the cidr text of the network with the longest prefix that holds the host; null if none does or it is no address.

    A network is a beginning of an address's bits, so each distinct address is cut to the lengths that occur among the
    networks, 162 at most, and meets them by equality: no range is compared, and nested networks cost nothing. Of texts for one
    network the least is shown; rows that are no network match nothing.
    """
    known = networks.select(network_bits(F.col(cidr)).alias("__net"), F.col(cidr).alias("__cidr")).where("__net IS NOT NULL")
    known = known.groupBy("__net").agg(F.min("__cidr").alias("__cidr"))
    lengths = [r[0] for r in known.select(F.substring("__net", 1, 2).alias("v"), (F.length("__net") - 2).alias("n")).distinct().select(F.struct("v", "n")).collect()]
    asked = rows.select(F.col(host).alias("__host")).distinct().withColumn("__bits", address_bits(F.col("__host"))).where("__bits IS NOT NULL")
    cuts = [F.when(version(F.col("__bits")) == x["v"], F.concat(F.lit(x["v"]), F.substring("__bits", 1, x["n"]))) for x in lengths]
    cut = asked.select("__host", F.explode(F.array_compact(F.array(*cuts).cast("array<string>"))).alias("__net"))
    best = cut.join(known, "__net").groupBy("__host").agg(F.max_by("__cidr", F.length("__net")).alias(into))
    return rows.join(best, rows[host] == best["__host"], "left").select(*[rows[c] for c in rows.columns], into)
