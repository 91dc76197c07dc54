"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v.

    Large: each node hooks its larger neighbours to the least of its neighbourhood; small: it hooks its smaller
    neighbours and itself to the least of them. Both are a minimum by key and a join, so a hub is split like any hot key.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hooked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hooked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hooked.where("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``edges`` (columns a, b of any ordered type); root is the least node reachable.

    Each round is written to the shared folder; the driver sees a count and a checksum only.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        now = staged(_star(_star(now, True), False), "stars")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
