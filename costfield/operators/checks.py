"""Checks and comparisons of routes, lines and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costfield.shared import materialise, release


def route_set(expected: DataFrame, routes: DataFrame) -> DataFrame:
    """(problem, from_id, to_id): pairs (from_id, to_id) that are missing, unexpected, reversed or there more than once."""
    have = routes.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    turned = expected.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    unexpected = have.join(expected, ["from_id", "to_id"], "left_anti")
    found = {
        "missing": expected.join(have, ["from_id", "to_id"], "left_anti"),
        "duplicate": have.filter("n > 1"),
        "reversed": unexpected.join(turned, ["from_id", "to_id"], "left_semi"),
        "unexpected": unexpected.join(turned, ["from_id", "to_id"], "left_anti"),
    }
    out = None
    for problem, rows in found.items():
        rows = rows.select(F.lit(problem).alias("problem"), "from_id", "to_id")
        out = rows if out is None else out.union(rows)
    return out


def detours(routes: DataFrame, placed: DataFrame, cell_km: float) -> DataFrame:
    """(from_id, to_id, factor): length_km over the straight line between the ends' cells (site, r, c)."""
    end = lambda k: placed.select(F.col("site").alias(f"{k}_id"), F.col("r").alias(f"{k}_r"), F.col("c").alias(f"{k}_c"))
    both = routes.join(end("from"), "from_id").join(end("to"), "to_id")
    straight = F.hypot(F.col("from_r") - F.col("to_r"), F.col("from_c") - F.col("to_c")) * cell_km
    return both.filter(straight > 0).select("from_id", "to_id", (F.col("length_km") / straight).alias("factor"))


def detour_summary(factors: DataFrame, beyond: float) -> DataFrame:
    """One row (routes, least, median, most, beyond): the spread of detour factors, and how many exceed ``beyond``."""
    return factors.agg(F.count("*").alias("routes"), F.min("factor").alias("least"), F.percentile("factor", 0.5).alias("median"), F.max("factor").alias("most"), F.count_if(F.col("factor") > beyond).alias("beyond"))


def route_faults(routes: DataFrame, km: list[str], slack: float = 0.5) -> DataFrame:
    """(problem, from_id, to_id): routes (from_id, to_id, cost, length_km and the columns ``km``) whose cost isn't above zero, or of whose parts one is below zero or longer than the route by more than ``slack``."""
    bad_cost = F.col("cost").isNull() | F.isnan("cost") | (F.col("cost") <= 0) | (F.col("cost") == float("inf"))
    length = F.coalesce("length_km", F.lit(0.0))
    listed = [F.when(bad_cost, F.lit("cost"))] + [F.when((F.col(k) < 0) | (F.col(k) > length + slack), F.lit(k)) for k in km]
    return routes.select(F.explode(F.array_compact(F.array(*listed))).alias("problem"), "from_id", "to_id")


def compare_routes(expected: DataFrame, actual: DataFrame, tolerance: float) -> DataFrame:
    """One row: of two sets of routes (from_id, to_id, cost), how many pairs both have, miss, have beyond what is expected, or have with a cost not above zero; the relative errors of the others, and whether all ``passed``."""
    both = expected.select("from_id", "to_id", F.col("cost").alias("x"), F.lit(True).alias("e")).join(actual.select("from_id", "to_id", F.col("cost").alias("y"), F.lit(True).alias("a")), ["from_id", "to_id"], "full")
    there = F.col("e").isNotNull() & F.col("a").isNotNull()
    good = lambda k: F.coalesce((F.col(k) > 0) & (F.col(k) < float("inf")) & ~F.isnan(k), F.lit(False))
    valid = there & good("x") & good("y")
    error = F.when(valid, F.abs(F.col("x") - F.col("y")) / F.col("x"))
    counts = both.agg(F.count_if(there).alias("compared"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(there & ~valid).alias("invalid"), F.count_if(error > tolerance).alias("beyond"), F.max(error).alias("largest"), F.avg(error).alias("mean"))
    return counts.withColumn("passed", F.col("missing") + F.col("unexpected") + F.col("invalid") + F.col("beyond") == 0)


def too_short(routes: DataFrame, placed: DataFrame, cell_km: float, tolerance_km: float) -> DataFrame:
    """Routes that are shorter than the straight line by more than the tolerance."""
    factor = detours(routes, placed, cell_km)
    return routes.join(factor, ["from_id", "to_id"]).filter(F.col("length_km") + tolerance_km < F.col("length_km") / F.col("factor")).drop("factor")


def compare_grids(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cells in both, cells that only one can enter, and the largest and mean relative difference."""
    both = a.select("r", "c", F.col("cost").alias("x")).join(b.select("r", "c", F.col("cost").alias("y")), ["r", "c"], "full")
    apart = F.abs(F.col("x") - F.col("y")) / F.abs("y")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("compared"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("mismatched"), F.max(apart).alias("largest"), F.avg(apart).alias("mean"))


def tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (edges, nodes, parts, cycles, is_tree) of the graph of (from_id, to_id) edges on (site) nodes.

    Parts are counted from the edges themselves: every round each node takes the least label among its own and its neighbours', and the label
    of that label, until none changes. A graph of ``parts`` parts has edges - nodes + parts independent cycles; a loop or a repeated edge is one.
    """
    ends = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    ends = materialise(ends.union(ends.select("b", "a")).filter("a <> b").distinct(), "ends")
    held = materialise(nodes.select("site", F.col("site").alias("label")), "labels")
    label = held
    while True:
        beside = ends.join(label, F.col("a") == F.col("site")).groupBy(F.col("b").alias("site")).agg(F.min("label").alias("least"))
        now = label.join(beside, "site", "left").select("site", "label", F.least("label", "least").alias("new"))
        upper = now.select(F.col("site").alias("new"), F.col("new").alias("newer"))
        moved = materialise(now.join(upper, "new", "left").select("site", "label", F.least("new", "newer").alias("new")), "labels")
        done = moved.filter("new <> label").isEmpty()
        release(held)
        held, label = moved, moved.select("site", F.col("new").alias("label"))
        if done:
            break
    counts = edges.agg(F.count("*").alias("edges")).join(nodes.agg(F.count("*").alias("nodes")), how="cross").join(label.select("label").distinct().agg(F.count("*").alias("parts")), how="cross")
    cycles = (F.col("edges") - F.col("nodes") + F.col("parts")).alias("cycles")
    return counts.select("edges", "nodes", "parts", cycles, ((F.col("parts") == 1) & (F.col("edges") == F.col("nodes") - 1)).alias("is_tree"))


def points_along(lines: DataFrame, step: float) -> DataFrame:
    """(feature, k, x, y): max(2, floor(length / step) + 1) points at even distances along each segment (feature, x1, y1, x2, y2)."""
    n = F.greatest(F.lit(2), F.floor(F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / step, 9)).cast("int") + 1)
    each = lines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda k: F.col(f"{k}1") + (F.col(f"{k}2") - F.col(f"{k}1")) * F.col("k") / (F.col("n") - 1)
    return each.select("feature", "k", at("x").alias("x"), at("y").alias("y"))


def offsets(points: DataFrame, segments: DataFrame, within: dict[str, float] | None = None) -> DataFrame:
    """(feature, mean, median, p90, most): distances of a feature's points (feature, other, k, x, y) from the segments of ``other``.

    For each of ``within`` (name: distance), a column of that name has the share of the points within the distance.
    """
    shares = [F.avg((F.col("d") <= most).cast("double")).alias(name) for name, most in (within or {}).items()]
    near = points.join(segments, "other")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    along = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.nullif(square, F.lit(0.0)))))
    apart = F.hypot(F.col("x") - F.col("x1") - along * dx, F.col("y") - F.col("y1") - along * dy)
    each = near.groupBy("feature", "k").agg(F.min(apart).alias("d"))
    return each.groupBy("feature").agg(F.avg("d").alias("mean"), F.percentile("d", 0.5).alias("median"), F.percentile("d", 0.9).alias("p90"), F.max("d").alias("most"), *shares)
