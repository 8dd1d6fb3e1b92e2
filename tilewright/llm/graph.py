"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import fresh


def _smallest(links: DataFrame) -> DataFrame:
    """(u, low): the smallest of each node and its neighbours. Written, so that the join with it can be split where a node
    holds much of the links."""
    return fresh(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low")


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links(u, v)`` the smallest node that it reaches.

    Rounds of large and small stars: each node links its larger neighbours, then its smaller ones, to the smallest node
    around it, until every component is a star about its root. The links never become more than they were; a round is
    written to the shared folder, and the driver sees one count and one checksum of it.
    """
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = fresh(now, "links"), None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(found)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = fresh(large.where("u <> v").distinct(), "links")
        low = _smallest(large)
        small = large.join(low, "u").select("v", "low").unionByName(low.select(F.col("u").alias("v"), "low"))
        now = fresh(small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "links")
