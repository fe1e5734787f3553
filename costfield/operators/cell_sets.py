"""Sets of cells as runs (r, first, last) of columns, and their algebra by sweeping over the runs' ends.

A set may have keys (say, a layer), and then each key's runs are a set. Union, intersection and difference look at the ends of runs alone, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HOLDS = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "difference": lambda a, b: (a > 0) & (b == 0),
    "either": lambda a, b: (a > 0) != (b > 0),
}


def runs_of(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The runs of cells (r, c); repeated cells count once."""
    ones = cells.select(*keys, "r", F.col("c").alias("first"), F.col("c").alias("last"))
    return combine(ones, ones.limit(0), "union", keys)


def combine(a: DataFrame, b: DataFrame, how: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The runs of the union, intersection, difference (a without b) or either (in one of them only) of two sets of runs.

    Runs of an input may overlap and repeat; those of the result are apart, and as long as they can be.
    """
    holds = _HOLDS[how]
    ends = None
    for runs, one, other in ((a, "a", "b"), (b, "b", "a")):
        each = F.explode(F.array(F.struct(F.col("first").cast("long").alias("x"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).cast("long").alias("x"), F.lit(-1).alias("d")))).alias("e")
        part = runs.select(*keys, "r", each).select(*keys, "r", "e.x", F.col("e.d").alias(one), F.lit(0).alias(other)).select(*keys, "r", "x", "a", "b")
        ends = part if ends is None else ends.union(part)
    ends = ends.groupBy(*keys, "r", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> 0 or b <> 0")
    row = Window.partitionBy(*keys, "r").orderBy("x")
    so_far = row.rowsBetween(Window.unboundedPreceding, 0)
    state = ends.select(*keys, "r", "x", holds(F.sum("a").over(so_far), F.sum("b").over(so_far)).alias("in"))
    # Only where the answer changes does a run begin or end; begins and ends take turns.
    turns = state.withColumn("was", F.coalesce(F.lag("in").over(row), F.lit(False))).filter("`in` <> was").select(*keys, "r", "x", "in")
    paired = turns.withColumn("end", F.lead("x").over(row)).filter("`in`")
    return paired.select(*keys, "r", F.col("x").cast("int").alias("first"), (F.col("end") - 1).cast("int").alias("last"))


def cells_of(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The cells (r, c) of runs that are apart."""
    return runs.select(*keys, "r", F.explode(F.sequence("first", "last")).alias("c"))


def surfaces(extent: DataFrame, land: DataFrame) -> DataFrame:
    """(surface, r, first, last): land within the extent, and the rest of the extent as sea."""
    dry = combine(extent, land, "intersection").select(F.lit("land").alias("surface"), "r", "first", "last")
    return dry.union(combine(extent, land, "difference").select(F.lit("sea").alias("surface"), "r", "first", "last"))


def area(runs: DataFrame, size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(km2) of the sets, from cells of ``size`` metres."""
    return runs.groupBy(*keys).agg((F.sum(F.col("last") - F.col("first") + 1) * (size**2 / 1e6)).alias("km2"))
