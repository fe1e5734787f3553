"""A grid as a map shows it: warped to Web Mercator by the inverse projection, and a pyramid of tiles.

Display cells lie on one lattice over the world, (i, j) south and east of the projection's origin, so grids side by side fit. Each display cell looks up the cell
of the grid that its centre falls in, which is one join; each level of the pyramid is a grouping of the one below. Tiles without a cell aren't there.
"""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costfield.functions.projection import conformal, latitude, to_utm32

# Fixed value: the sphere of the map projection, in metres.
RADIUS = 6378137.0
#: Display cells of a tile's side.
TILE = 256


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.log(F.tan(F.radians(lat) / 2 + pi / 4)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - pi / 2)


def _reach(cells: DataFrame, grid: dict[str, float], size: float) -> tuple[int, int, int, int]:
    """The first and last row and column of the lattice that any of the cells' corners falls in."""
    low, high, left, right = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    # The extremes of a rectangle's image lie on its border, so its border is what is projected.
    spark = cells.sparkSession
    along = spark.range(left, right + 2).select(F.col("id").alias("c")).crossJoin(spark.createDataFrame([(low,), (high + 1,)], "r int")).select("r", "c")
    across = spark.range(low, high + 2).select(F.col("id").alias("r")).crossJoin(spark.createDataFrame([(left,), (right + 1,)], "c int")).select("r", "c")
    border = along.union(across).select((grid["x0"] + F.col("c") * grid["size"]).alias("x"), (grid["y0"] - F.col("r") * grid["size"]).alias("y"))
    tangent, lon = conformal(F.col("x"), F.col("y"))
    x, y = to_mercator(F.col("lon"), latitude(F.col("tangent")))
    placed = border.select(tangent.alias("tangent"), lon.alias("lon")).select(x.alias("x"), y.alias("y"))
    floor = lambda v: F.floor(v / size)
    return tuple(placed.agg(F.min(floor(-F.col("y"))) - 1, F.max(floor(-F.col("y"))) + 1, F.min(floor(F.col("x"))) - 1, F.max(floor(F.col("x"))) + 1).first())


def warped(cells: DataFrame, grid: dict[str, float], size: float, value: str = "cost") -> DataFrame:
    """(i, j, value): each display cell of ``size`` metres of the projection whose centre lies in a cell (r, c) of the UTM grid (x0, y0, size) with a value."""
    held = cells.filter(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("value"))
    if held.isEmpty():
        return held.select(F.col("r").cast("long").alias("i"), F.col("c").cast("long").alias("j"), "value")
    top, bottom, left, right = _reach(held, grid, size)
    width = right - left + 1
    lattice = cells.sparkSession.range((bottom - top + 1) * width).select((F.floor(F.col("id") / width) + top).alias("i"), (F.col("id") % width + left).alias("j"))
    lon, lat = from_mercator((F.col("j") + 0.5) * size, -(F.col("i") + 0.5) * size)
    x, y = to_utm32(F.col("lon"), F.col("lat"))
    placed = lattice.select("i", "j", lon.alias("lon"), lat.alias("lat")).select("i", "j", x.alias("x"), y.alias("y"))
    row, column = F.floor((grid["y0"] - F.col("y")) / grid["size"]).cast("int"), F.floor((F.col("x") - grid["x0"]) / grid["size"]).cast("int")
    return placed.select("i", "j", row.alias("r"), column.alias("c")).join(held.withColumnsRenamed({"r": "r_", "c": "c_"}), (F.col("r") == F.col("r_")) & (F.col("c") == F.col("c_"))).select("i", "j", "value")


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """(level, i, j, value, n): display cells (i, j, value), and for each further level the means of 2 by 2 cells of the one below, by how many first cells they stand for."""
    now = cells.select("i", "j", F.col("value").cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    out = []
    for level in range(levels + 1):
        if level:
            mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
            now = now.groupBy(F.floor(F.col("i") / 2).alias("i"), F.floor(F.col("j") / 2).alias("j")).agg(mean.alias("value"), F.sum("n").alias("n"))
        out.append(now.select(F.lit(level).alias("level"), "i", "j", "value", "n"))
    return reduce(DataFrame.union, out)


def tiles(cells: DataFrame, side: int = TILE) -> DataFrame:
    """(level, tile_r, tile_c, cells, pixels): each tile's cells and their places and values in it, row by row."""
    at = (F.pmod(F.col("i"), F.lit(side)) * side + F.pmod(F.col("j"), F.lit(side))).cast("int")
    held = cells.groupBy("level", F.floor(F.col("i") / side).alias("tile_r"), F.floor(F.col("j") / side).alias("tile_c"))
    return held.agg(F.count("*").alias("cells"), F.array_sort(F.collect_list(F.struct(at.alias("at"), "value"))).alias("pixels"))  # a tile holds side squared at most


def ramp(value: Column, low: Column, high: Column, colours: tuple[str, str, str]) -> Column:
    """The colour (#rrggbb) of a value between ``low`` and ``high``, both ends clamped, over three stops."""
    share = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(high - low, F.lit(0.0))))).otherwise(0.5)
    parts = []
    for k in (1, 3, 5):
        a, b, c = (int(x[k : k + 2], 16) for x in colours)
        mixed = F.when(share <= 0.5, a + (b - a) * share * 2).otherwise(b + (c - b) * (share * 2 - 1))
        parts.append(F.lpad(F.hex(F.floor(mixed + 0.5)), 2, "0"))
    return F.lower(F.concat(F.lit("#"), *parts))
