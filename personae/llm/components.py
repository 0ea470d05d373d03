"""Connected components of a table of links, in a number of rounds that grows with its log.

Alternating large-star and small-star: every node hands its larger neighbours to its smallest
one, then itself and its smaller neighbours, until each component is a star. Rounds are written
to the shared folder, so a lost executor costs at most one of them. Links that come later are
brought to the roots known so far, and only those that still join two roots take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from personae.operators.scale import materialize


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node.

    ``known`` is the result for earlier links, whose nodes are in the result as well.
    """
    if known is not None:
        links = _at_root(_at_root(links, "a", known), "b", known)
    star, now = _stored(links)
    if known is not None and not now[0]:
        return known
    seen = None
    while now[0] and now != seen:
        seen = now
        both = star.union(star.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m"))
        large = large.select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star, now = _stored(small.union(least.select("a", F.col("m").alias("b"))))
    root = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = root.union(star.select("b", "b").distinct())
    if known is not None:
        root = materialize(root, "roots")
        moved = root.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        old = known.join(moved, "root", "left").select(
            "node", F.coalesce("_to", "root").alias("root")
        )
        root = old.union(root.join(known, "node", "left_anti"))
    return materialize(root, "roots")


def _at_root(links: DataFrame, end: str, known: DataFrame) -> DataFrame:
    to = known.select(F.col("node").alias(end), F.col("root").alias("_root"))
    return links.join(to, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")


def _stored(links: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct links from larger to smaller nodes, with their number and a sum of hashes."""
    ordered = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    seen = Observation("links")
    hashes = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ordered = ordered.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("hashes"))
    stored = materialize(ordered, "links")
    return stored, (seen.get["n"], seen.get["hashes"])
