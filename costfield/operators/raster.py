"""Rasters as tables of cells (r, c): rasterising, distances, focal sums, resampling."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapped(low_x: float, low_y: float, high_x: float, high_y: float, size: float) -> dict[str, float]:
    """The grid of whole cells that holds a box."""
    x0, y0, x1, y1 = (f(v / size) * size for f, v in ((_floor, low_x), (_floor, low_y), (_ceil, high_x), (_ceil, high_y)))
    return {"x0": x0, "y0": y1, "size": size, "width": round((x1 - x0) / size), "height": round((y1 - y0) / size)}


def _floor(v: float) -> int:
    return int(v // 1)


def _ceil(v: float) -> int:
    return -int(-v // 1)


def disk(radius: int, inner: int = 0) -> list[tuple[int, int]]:
    """Offsets of the cells whose centres are within ``radius`` cells, and ``inner`` at least."""
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if inner**2 <= a * a + b * b <= radius**2]


def spread(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells (r, c, d2) around the given ones, each with the least squared distance to one of them, in cells."""
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets))
    near = cells.select("r", "c", F.explode(around).alias("o"))
    return near.select((F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), (F.col("o.a") * F.col("o.a") + F.col("o.b") * F.col("o.b")).alias("d2")).groupBy("r", "c").agg(F.min("d2").alias("d2"))


def landfall(land: DataFrame, sea: DataFrame, connectivity: int = 8) -> DataFrame:
    """Land cells with a sea cell among their 8 (or 4) neighbours."""
    offsets = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not (a and b))]
    return land.join(spread(sea, offsets).select("r", "c"), ["r", "c"], "left_semi")


def focal_sum(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """The sum of ``value`` over the disk of ``radius`` cells around each cell (r, c); what is missing counts as zero.

    Each cell asks the rows of its disk, at its column, and a range window over a row's values answers; so cells need not
    be everywhere. Rows of the grid are cut into stretches, and what lies beside a stretch is sent to it too, so that
    a long row is no single task's.
    """
    stretch = max(256, 8 * radius)
    part = lambda c: F.floor(c / stretch)
    sides = F.array_distinct(F.array(part(F.col("c")), part(F.col("c") - radius), part(F.col("c") + radius)))
    held = cells.select("r", "c", F.coalesce(F.col(value), F.lit(0)).alias("v"), F.lit(None).cast("int").alias("a"), F.explode(sides).alias("part"))
    asked = cells.select("r", "c", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("a"))
    asked = asked.select((F.col("r") + F.col("a")).alias("r"), "c", F.lit(0).alias("v"), "a", part(F.col("c")).alias("part"))
    row = lambda w: F.sum("v").over(Window.partitionBy("r", "part").orderBy("c").rangeBetween(-w, w))
    wide = {a: isqrt(radius**2 - a * a) for a in range(radius + 1)}
    sums = held.union(asked).select("r", "c", "a", *(row(w).alias(f"w{w}") for w in sorted(set(wide.values())))).filter("a is not null")
    answer = F.coalesce(*(F.when(F.abs("a") == a, F.col(f"w{w}")) for a, w in wide.items()))
    return sums.groupBy((F.col("r") - F.col("a")).alias("r"), "c").agg(F.sum(answer).alias("focal"))


def polygon_runs(rings: DataFrame) -> DataFrame:
    """Runs (feature, r, first, last) of cells whose centre is inside a feature, from its rings' edges (feature, x1, y1, x2, y2) in cell units.

    Row r's centre line y = r + 0.5 crosses an edge where exactly one end is above it; between the odd and the
    following even crossing a row is inside, from the first centre at or right of a crossing to the last one left of the next.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = rings.filter("y1 <> y2").withColumn("from", F.ceil(lo - 0.5)).withColumn("to", F.ceil(hi - 0.5) - 1).filter("to >= from")
    crossed = rows.withColumn("r", F.explode(F.sequence("from", "to")))
    x = F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    at = Window.partitionBy("feature", "r").orderBy("x")
    pairs = crossed.select("feature", "r", x.alias("x")).withColumn("k", F.row_number().over(at)).withColumn("next", F.lead("x").over(at)).filter("k % 2 = 1")
    first, last = F.ceil(F.col("x") - 0.5), F.ceil(F.col("next") - 0.5) - 1
    inside = pairs.select("feature", "r", first.alias("first"), last.alias("last")).filter("last >= first")
    return inside.select("feature", *(F.col(k).cast("int").alias(k) for k in ("r", "first", "last")))


def rasterize_polygons(rings: DataFrame) -> DataFrame:
    """Cells (feature, r, c) whose centre is inside a feature, from the edges of its rings."""
    return polygon_runs(rings).select("feature", "r", F.explode(F.sequence("first", "last")).alias("c")).distinct()


def rasterize_lines(segments: DataFrame) -> DataFrame:
    """Cells (feature, r, c) that a segment (feature, x1, y1, x2, y2; in cell units) passes through.

    The segment is cut where it crosses a grid line; every piece lies in the cell of its middle.
    """
    crossings = lambda a, b: F.filter(
        F.transform(F.sequence(F.ceil(F.least(a, b)), F.greatest(F.ceil(F.least(a, b)), F.floor(F.greatest(a, b)))), lambda g: (g - F.col(a)) / (F.col(b) - F.col(a))),
        lambda t: (t > 0) & (t < 1),
    )
    none = F.array().cast("array<double>")
    cuts = F.concat(F.array(F.lit(0.0), F.lit(1.0)), *(F.when(F.col(a) != F.col(b), crossings(a, b)).otherwise(none) for a, b in (("x1", "x2"), ("y1", "y2"))))
    cut = segments.withColumn("t", F.array_sort(F.array_distinct(cuts)))
    middle = F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda k: (F.get("t", k) + F.get("t", k + 1)) / 2)).alias("m")
    pieces = cut.select("feature", "x1", "y1", "x2", "y2", middle)
    r, c = F.floor(F.col("y1") + F.col("m") * (F.col("y2") - F.col("y1"))), F.floor(F.col("x1") + F.col("m") * (F.col("x2") - F.col("x1")))
    return pieces.select("feature", r.cast("int").alias("r"), c.cast("int").alias("c")).distinct()


def resample(cells: DataFrame, value: str, ratio: float) -> DataFrame:
    """Coarser cells (r, c), ``ratio`` fine ones wide: the area-weighted mean of ``value``, its largest, and the area covered (in coarse cells)."""
    target = lambda k: F.explode(F.sequence(F.floor(F.col(k) / ratio), F.ceil((F.col(k) + 1) / ratio) - 1))
    over = cells.select("r", "c", value, target("r").alias("big_r")).select("*", target("c").alias("big_c"))
    part = lambda k: F.least(F.col(k) + 1, (F.col(f"big_{k}") + 1) * ratio) - F.greatest(F.col(k), F.col(f"big_{k}") * ratio)
    weighed = over.withColumn("area", part("r") * part("c")).filter("area > 1e-12")
    whole = weighed.groupBy(F.col("big_r").cast("int").alias("r"), F.col("big_c").cast("int").alias("c"))
    return whole.agg((F.sum(F.col(value) * F.col("area")) / F.sum("area")).alias("mean"), F.max(value).alias("most"), (F.sum("area") / ratio**2).alias("covered"))
