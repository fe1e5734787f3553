"""Exact Euclidean distances to the nearest cell of a set, at any range, in two passes.

The squared distance splits: d2 = (c - c')^2 + (r - r')^2, so for each column the nearest row comes first, then for each row the lowest of the parabolas that
stand on the columns. The first pass groups columns by ``STRIP``, the second rows; between them goes one array for each strip of rows and column that
holds a cell of the set. No cell is spread over its surroundings, so the cost doesn't depend on the range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIP = 64


def _envelope(columns: np.ndarray, heights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The least of (x - column)^2 + height over the columns (ascending), at each wanted x."""
    hull: list[int] = []
    starts: list[float] = []
    xs, hs = columns.tolist(), heights.tolist()
    for k, (x, h) in enumerate(zip(xs, hs, strict=True)):
        start = -np.inf
        while hull:
            j = hull[-1]
            start = ((h + x * x) - (hs[j] + xs[j] * xs[j])) / (2 * (x - xs[j]))
            if start > starts[-1]:
                break
            hull.pop()
            starts.pop()
            start = -np.inf
        hull.append(k)
        starts.append(start)
    at = np.array(hull)[np.searchsorted(np.array(starts), wanted, side="right") - 1]
    return (wanted - columns[at]) ** 2 + heights[at]


def distance_transform(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(r, c, d2): the squared distance, in cells, of each of ``cells`` (r, c) from the nearest of ``targets`` (r, c); 0 on one.

    Targets needn't be among the cells. Without targets there are no rows.
    """
    low, high = cells.agg(F.min("r"), F.max("r")).first()
    if low is None:
        return cells.select("r", "c", F.lit(None).cast("long").alias("d2")).limit(0)

    def by_column(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = np.arange(low, high + 1)
        for c, held in group.groupby("c"):
            there = np.sort(held["r"].to_numpy())
            after = np.searchsorted(there, rows)
            up = np.abs(rows - there[np.maximum(after - 1, 0)])
            down = np.abs(there[np.minimum(after, len(there) - 1)] - rows)
            nearest = np.minimum(up, down).astype(np.int64)
            first = low // STRIP
            for s in range(first, high // STRIP + 1):
                a, b = max(s * STRIP, low) - low, min((s + 1) * STRIP, high + 1) - low
                out.append((s, c, nearest[a:b] ** 2))
        return pd.DataFrame(out, columns=["strip", "c", "h"])

    def by_row(key: tuple, columns: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if columns.empty or asked.empty:
            return pd.DataFrame({"r": [], "c": [], "d2": []}).astype({"r": "int32", "c": "int32", "d2": "int64"})
        columns = columns.sort_values("c")
        at, heights = columns["c"].to_numpy().astype(np.int64), np.stack(columns["h"].to_numpy())
        base, out = max(int(key[0]) * STRIP, low), []
        for r, held in asked.groupby("r"):
            wanted = held["c"].to_numpy().astype(np.int64)
            out.append(pd.DataFrame({"r": np.int32(r), "c": held["c"].to_numpy(), "d2": _envelope(at, heights[:, r - base], wanted)}))
        return pd.concat(out)

    as_int = lambda df: df.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    columns = as_int(targets).distinct().groupBy(F.floor(F.col("c") / STRIP).alias("block")).applyInPandas(by_column, "strip int, c int, h array<long>")
    asked = as_int(cells).withColumn("strip", F.floor(F.col("r") / STRIP).cast("int"))
    return columns.groupBy("strip").cogroup(asked.groupBy("strip")).applyInPandas(by_row, "r int, c int, d2 long")
