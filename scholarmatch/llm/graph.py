"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmatch.sources.tables import settle


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Links every node's larger (or smaller) neighbours to its smallest one, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))  # reduced map-side, a hot node too
    joined = both.join(least, "a")
    if larger:
        found = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = joined.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return found.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of the links (a, b) with the smallest node of its component.

    Each round writes its links to the shared folder; their number never grows, and the rounds grow with the
    logarithm of the nodes. A hot node only ever meets its minimum, one row.
    """
    edges = settle(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    seen = None
    while True:
        edges = settle(_stars(_stars(edges, True), False), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
