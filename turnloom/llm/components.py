"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import cut


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each end of a link; root is the smallest node reachable.

    Each round hangs the larger neighbours of every node under its smallest
    neighbour, then the smaller ones; about log2 of the number of nodes rounds.
    A round is joins and partial minima: no component is gathered in one task,
    and the driver sees a count and a checksum of the link table only.
    """
    cur = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    cur, before = cut(cur), None
    while (now := _mark(cur)) != before:
        if now[0] == 0:
            break
        before = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        cur = cut(small.where("u != v").distinct())
    tree = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return tree.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
