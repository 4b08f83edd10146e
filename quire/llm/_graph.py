"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of the links (a, b), the smallest node it reaches.

    Alternates two kinds of contraction: every node hands its larger neighbours, and then its
    smaller ones, to its smallest. Both are a minimum by node, combined before the shuffle,
    and a join back, so a node with many links needs no task of its own. The links, rewritten
    each round, become stars after a number of rounds that grows with the logarithm of a
    component's size.
    """
    # A linked node that equals itself carries no news.
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", few_files=True)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, written(small, "edges", few_files=True)
        dropped(old)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
