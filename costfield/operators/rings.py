"""The boundaries of cell sets as rings of corners, traced across partitions.

Every side of a cell beyond which the set ends is a directed edge, the set on its right hand; which edge follows is told by the eight cells around. Straight
stretches become one segment, and pointer doubling over the segments names each ring by its least segment and counts each segment's place
in it: the rounds are the logarithm of the longest ring, and no ring has to fit a task. Cells that touch at a corner alone are apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costfield.operators.cell_sets import runs_of
from costfield.shared import materialise, release

# A side: the cell across it; the cells ahead (right in the set's row or column) and ahead across; and the start corner. Sides are numbered clockwise from the top.
_SIDES = [
    # across, ahead, ahead across, behind, behind across, start (row, column)
    ((-1, 0), (0, 1), (-1, 1), (0, -1), (-1, -1), (0, 0)),
    ((0, 1), (1, 0), (1, 1), (-1, 0), (-1, 1), (0, 1)),
    ((1, 0), (0, -1), (1, -1), (0, 1), (1, 1), (1, 1)),
    ((0, -1), (-1, 0), (-1, -1), (1, 0), (1, -1), (1, 0)),
]


def _key(r: Column, c: Column, side: Column) -> Column:
    """One number for a side of a cell; rows and columns lie within 2**28 of 0."""
    return F.shiftleft(r.cast("long") + (1 << 28), 32) + (c.cast("long") + (1 << 28)) * 4 + side


def _edges(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, r, c, side, starts, ends, follower): the boundary's edges; whether a straight stretch begins or ends there, and the edge that follows."""
    bit = lambda a, b: 1 << ((a + 1) * 3 + b + 1)
    around = F.array(*(F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b"), F.lit(bit(a, b)).alias("bit")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    sent = cells.select(*keys, "r", "c", F.explode(around).alias("o")).select(*keys, (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), F.col("o.bit").alias("bit"))
    held = sent.groupBy(*keys, "r", "c").agg(F.bit_or("bit").alias("m")).filter(F.col("m").bitwiseAND(F.lit(bit(0, 0))) != 0)
    has = lambda at: F.col("m").bitwiseAND(F.lit(bit(*at))) != 0
    sides = []
    for k, (across, ahead, diagonal, behind, behind_across, _) in enumerate(_SIDES):
        right = _key(F.col("r"), F.col("c"), F.lit((k + 1) % 4))
        straight = _key(F.col("r") + ahead[0], F.col("c") + ahead[1], F.lit(k))
        left = _key(F.col("r") + diagonal[0], F.col("c") + diagonal[1], F.lit((k + 3) % 4))
        goes_on = has(ahead) & ~has(diagonal)
        follower = F.when(~has(ahead), right).when(~has(diagonal), straight).otherwise(left)
        sides.append(F.when(~has(across), F.struct(F.lit(k).alias("side"), (~(has(behind) & ~has(behind_across))).alias("starts"), (~goes_on).alias("ends"), follower.alias("follower"))))
    return held.select(*keys, "r", "c", F.explode(F.array_compact(F.array(*sides))).alias("e")).select(*keys, "r", "c", "e.*")


def segments(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, x, y, follower): the straight stretches of the boundaries of the sets of cells (keys, r, c), each with its first corner (column x, row y) and the next."""
    edges = _edges(cells.select(*keys, "r", "c").distinct(), keys).filter("starts or ends")
    level = F.col("side") % 2 == 0
    line, along = F.when(level, F.col("r")).otherwise(F.col("c")), F.when(level, F.col("c")).otherwise(F.col("r"))
    forward = F.when(F.col("side").isin(0, 1), along).otherwise(-along)
    stretch = Window.partitionBy(*keys, "side", "line").orderBy("forward")
    paired = edges.withColumn("line", line).withColumn("forward", forward).withColumn("follower", F.when(F.col("ends"), F.col("follower")).otherwise(F.lead("follower").over(stretch)))
    corner = [F.create_map(*(F.lit(v) for k, s in enumerate(_SIDES) for v in (k, s[5][i])))[F.col("side")] for i in (0, 1)]
    return paired.filter("starts").select(*keys, _key(F.col("r"), F.col("c"), F.col("side")).alias("id"), (F.col("c") + corner[1]).alias("x"), (F.col("r") + corner[0]).alias("y"), "follower")


def boundary_rings(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ring, k, x, y): the corners of each ring in order, in cell units (x: columns, y: rows), clockwise on the map for shells and the other way round for holes.

    ``ring`` is a number that only tells rings of a set apart. Null cells and repeated ones count for nothing.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    base = materialise(segments(cells.filter("r is not null and c is not null"), keys), "segments")
    pointers = base.select(*keys, "id", F.col("follower").alias("to"), F.col("id").alias("least"))
    held: DataFrame | None = None
    while True:
        joined = pointers.alias("a").join(pointers.alias("b").hint("merge"), (F.col("a.to") == F.col("b.id")) & same("a", "b"))
        found = materialise(joined.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("id"), F.col("b.to").alias("to"), F.least("a.least", "b.least").alias("least"), (F.col("b.least") < F.col("a.least")).alias("moved")), "rings")
        done = found.filter("moved").isEmpty()
        if held is not None:
            release(held)
        held, pointers = found, found.drop("moved")
        if done:
            break
    named = base.alias("a").join(pointers.alias("b").hint("merge"), (F.col("a.id") == F.col("b.id")) & same("a", "b"))
    ahead = named.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("id"), F.col("b.least").alias("ring"), "x", "y", F.when(F.col("a.follower") != F.col("b.least"), F.col("a.follower")).alias("to"), F.lit(1).cast("long").alias("left"))
    ahead = materialise(ahead, "places")
    release(held)
    while not ahead.filter("to is not null").isEmpty():
        joined = ahead.alias("a").join(ahead.alias("b").hint("merge"), (F.col("a.to") == F.col("b.id")) & same("a", "b"), "left")
        moved = materialise(joined.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("id"), F.col("a.ring").alias("ring"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.to").alias("to"), (F.col("a.left") + F.coalesce("b.left", F.lit(0))).alias("left")), "places")
        release(ahead)
        ahead = moved
    release(base)
    size = F.max("left").over(Window.partitionBy(*keys, "ring"))
    return ahead.select(*keys, "ring", (size - F.col("left")).alias("k"), "x", "y")


def ring_areas(rings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ring, corners, area): the area inside each ring in cells, above zero for shells, below for holes."""
    ring = Window.partitionBy(*keys, "ring")
    order = ring.orderBy("k")
    whole = ring.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(v).over(order), F.first(v).over(whole)) for v in ("x", "y"))
    cross = rings.select(*keys, "ring", (F.col("x") * ny - nx * F.col("y")).alias("cross"))
    return cross.groupBy(*keys, "ring").agg(F.count("*").alias("corners"), (F.sum("cross") / 2).alias("area"))


def without_small_holes(rings: DataFrame, least: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rings, but for holes of an area below ``least`` cells."""
    same = [*keys, "ring"]
    small = ring_areas(rings, keys).filter((F.col("area") < 0) & (-F.col("area") < least)).select(*same)
    return rings.join(small.hint("merge"), same, "left_anti")


def _set(keys: tuple[str, ...]) -> Column:
    """One value for the keys, nulls too, to join by."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def _named(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.withColumn("set", _set(keys)).drop(*keys)


def shells_of(rings: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ring, area, shell): each ring's area as ``ring_areas`` has it, and the shell that it lies in; a shell lies in itself.

    A row's run of cells begins at one ring and ends at another of the same piece; by such steps every hole is joined with its shell. Labels spread over the
    rings, which are few beside the cells.
    """
    ahead = Window.partitionBy(*keys, "ring").orderBy("k")
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = [F.coalesce(F.lead(v).over(ahead), F.first(v).over(whole)).alias(f"n{v}") for v in ("x", "y")]
    sides = rings.select(*keys, "ring", "x", "y", *following).filter("x = nx")
    edge = sides.select(*keys, "ring", "x", (F.col("ny") > F.col("y")).alias("right"), F.explode(F.sequence(F.least("y", "ny"), F.greatest("y", "ny") - 1)).alias("r"))
    left = edge.filter("not `right`").select(*keys, F.col("r").cast("int").alias("r"), F.col("x").cast("int").alias("first"), F.col("ring").alias("a"))
    right = edge.filter("`right`").select(*keys, F.col("r").cast("int").alias("r"), (F.col("x") - 1).cast("int").alias("last"), F.col("ring").alias("b"))
    runs = runs_of(cells.filter("r is not null and c is not null").select(*keys, "r", "c"), keys)
    pairs = _named(runs, keys).join(_named(left, keys), ["set", "r", "first"]).join(_named(right, keys), ["set", "r", "last"]).select("set", "a", "b").filter("a <> b").distinct()
    both = materialise(pairs.union(pairs.select("set", F.col("b"), F.col("a"))), "joints")
    areas = ring_areas(rings, keys).withColumn("set", _set(keys))
    held = materialise(areas.select("set", "ring", F.col("ring").alias("label")), "labels")
    while True:
        least = both.join(held.select("set", F.col("ring").alias("a"), "label"), ["set", "a"]).groupBy("set", F.col("b").alias("ring")).agg(F.min("label").alias("least"))
        moved = held.join(least, ["set", "ring"], "left").select("set", "ring", F.least("label", F.coalesce("least", "label")).alias("label"), (F.col("least") < F.col("label")).alias("moved"))
        following_labels = materialise(moved, "labels")
        done = following_labels.filter("moved").isEmpty()
        release(held)
        held = following_labels.drop("moved")
        held._costfield_path = following_labels._costfield_path
        if done:
            break
    labelled = areas.join(held, ["set", "ring"])
    shell = labelled.filter("area > 0").select("set", "label", F.col("ring").alias("shell"))
    out = materialise(labelled.join(shell, ["set", "label"]).select(*keys, "ring", "area", "shell"), "shells")
    release(both, held)
    return out


def polygons(rings: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, polygons): each set's shells with their holes, as GeoJSON nests them: polygons, their rings (the shell first), closed rings of (x, y)."""
    placed = shells_of(rings, cells, keys).withColumn("set", _set(keys))
    corners = rings.withColumn("set", _set(keys)).groupBy("set", "ring").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    point = lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))
    closed = F.concat(F.transform("p", point), F.array(point(F.get("p", F.lit(0)))))
    each = placed.join(corners.select("set", "ring", closed.alias("line")), ["set", "ring"])
    shells = each.groupBy("set", *keys, "shell").agg(F.array_sort(F.collect_list(F.struct((F.col("ring") != F.col("shell")).alias("hole"), "ring", "line"))).alias("rs"))
    return shells.groupBy("set", *keys).agg(F.array_sort(F.collect_list(F.struct("shell", F.transform("rs", lambda r: r["line"]).alias("rs")))).alias("ps")).select(*keys, F.transform("ps", lambda p: p["rs"]).alias("polygons"))
