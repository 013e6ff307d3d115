"""Connected components of a link table, by alternating star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import discard, stage


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has a link in (a, b).

    Large and small star steps: every node links its larger neighbours, then its smaller ones, to
    the smallest node it knows. The number of steps grows with the square of the logarithm of the
    nodes. Only sums go to the driver. Hot nodes are only counted against in joins on the node,
    which Spark splits, and in minima, which are taken before the shuffle.
    """
    edges = stage(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        # Links of a node to itself carry nothing; the others point from the larger to the smaller.
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, stage(
            moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "links",
        )
        discard(before)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    # Stars are left: each node points to the smallest one.
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
