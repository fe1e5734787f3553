"""Quantile scales: scores by linear interpolation between the quantiles of all eligible values."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costfield.shared import materialise, release


def quantiles(values: DataFrame, value: str, shares: list[float]) -> list[float]:
    """The quantiles at ``shares`` of all values that are there, linear between neighbours; none of an empty table.

    Equal values are counted together; ranges of values are counted in parallel, and of the ranges that hold a wanted rank only the
    values at these ranks come to the driver: two for each share at most.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    held = materialise(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "values")
    parts, below, total = {}, {}, 0
    for part, n in sorted(map(tuple, held.groupBy("part").agg(F.sum("n")).collect())):
        parts[part], below[part] = n, total
        total += n
    if not total:
        return []
    places = [(total - 1) * share for share in shares]
    ranks = sorted({r for p in places for r in (floor(p), min(floor(p) + 1, total - 1))})
    wanted = {part: [r - below[part] for r in ranks if below[part] <= r < below[part] + n] for part, n in parts.items()}
    wanted = {part: within for part, within in wanted.items() if within}
    end = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    among = held.filter(F.col("part").isin(list(wanted))).withColumn("end", end)
    hit = F.lit(False)
    for part, within in wanted.items():
        hit = hit | ((F.col("part") == part) & F.exists(F.array(*map(F.lit, within)), lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n"))))
    found = sorted((below[part] + last - n, x) for part, x, n, last in among.filter(hit).select("part", "x", "n", "end").collect())
    release(held)
    at = lambda rank: [x for first, x in found if first <= rank][-1]
    return [at(floor(p)) + (p - floor(p)) * (at(min(floor(p) + 1, total - 1)) - at(floor(p))) for p in places]


def quantile_scale(values: DataFrame, value: str, low: float, high: float, count: int, single: float) -> DataFrame:
    """One row: ``xs``, the distinct quantiles 0, 1/count ... 1 of ``value``, and ``ys``, their scores.

    Scores rise evenly from ``low`` to ``high``; equal quantiles take the mean of theirs; a single one takes ``single``.
    """
    shares = [k / count for k in range(count + 1)]
    levels: dict[float, list[float]] = {}
    for x, share in zip(quantiles(values, value, shares), shares):
        levels.setdefault(x, []).append(float(low + (high - low) * share))
    xs = sorted(levels)
    ys = [float(single)] if len(xs) == 1 else [sum(levels[x]) / len(levels[x]) for x in xs]
    return values.sparkSession.createDataFrame([(xs, ys)], "xs array<double>, ys array<double>")


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Linear between the points, constant beyond them."""
    below = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1, y0, y1 = F.get(xs, below - 1), F.get(xs, below), F.get(ys, below - 1), F.get(ys, below)
    return F.when(below == 0, F.get(ys, F.lit(0))).when(below == F.size(xs), F.get(ys, F.size(ys) - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
