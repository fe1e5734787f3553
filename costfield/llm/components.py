"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costfield.shared import materialise, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    moved = both.join(least, "u")
    out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (u, v) with the smallest node it can reach.

    Returns (node, component) for nodes that are not their own label; the others are their component's smallest node or
    have no edge. Loops, repeated and reversed edges are allowed; a null end makes no edge; no edges give no rows. Each
    step halves the distance to the smallest node at least, so the steps number about the log of the longest chain; every
    step is one aggregation with partial sums and one join on the edges, and is written to the shared folder.
    """
    now = materialise(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, before = state, now
        now = materialise(_stars(_stars(now, True), False), "stars")
        release(before)
