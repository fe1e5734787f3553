"""Routes as vertices, walked back through tiles of accumulated cost.

From each wanted end a walk goes to the neighbour that the cell's cost came from, until it stands on the origin. A round moves every walk through
the one tile that its head is in, all tiles in parallel, and hands it to the tile beyond the rim; so rounds are as many as tiles on the longest route, and only
tiles that a head stands in are read. No cell off the routes is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costfield.functions.projection import conformal, latitude
from costfield.operators.paths import STEPS, TILE, banded, bands, boxed, place, spread, tiles
from costfield.shared import materialise, release


def _back(tile: int, ids: list[str]):
    width = tile + 2
    steps = [(a * width + b, a, b, length) for a, b, length in STEPS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                cost, acc = np.zeros(width * width), np.full(width * width, np.inf)
                cost[row.cost_at] = row.cost
                acc[row.acc_at] = row.acc
                cost, acc = cost.tolist(), acc.tolist()
                for target, at, done in zip(row.targets, row.heads.tolist(), row.steps.tolist(), strict=True):
                    cells, lengths = [], []
                    r, c = divmod(at, width)
                    while 1 <= r <= tile and 1 <= c <= tile and acc[at] < np.inf:
                        cells.append(at)
                        if acc[at] == 0:
                            lengths.append(0.0)
                            break
                        best = None
                        for step, a, b, length in steps:
                            there = at + step
                            if cost[there] > 0 and acc[there] < np.inf:
                                found = round(acc[there] + (cost[at] + cost[there]) / 2 * length, 9)
                                if best is None or found < best[0]:
                                    best = (found, a, b, length)
                        if best is None or best[0] > acc[at] + 1e-6:
                            raise ValueError(f"no neighbour explains the cost of site {row.site} at row {row.tr * tile + r - 1}, column {row.tc * tile + c - 1}")
                        lengths.append(best[3])
                        r, c = r + best[1], c + best[2]
                        at = r * width + c
                    arrived = not cells or lengths[-1] == 0
                    out.append((*(getattr(row, k) for k in ids), target, row.tr, row.tc, done, cells, lengths, None if arrived else row.tr * tile + r - 1, None if arrived else row.tc * tile + c - 1))
            yield pd.DataFrame(out, columns=[*ids, "target", "tr", "tc", "done", "at", "length", "next_r", "next_c"]).astype({"next_r": "Int32", "next_c": "Int32"})

    return run


def route_vertices(cells: DataFrame, acc: DataFrame, ends: DataFrame, tile: int = TILE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, site, target, k, r, c, length): the cells of a least-cost route from each site to its ends (keys, site, target, r, c).

    ``k`` counts from the site's cell, ``length`` is that of the step into the cell, in cells. Of several neighbours that a cost may come
    from, the first by row and column is taken. An end that ``acc`` (site, r, c, acc) doesn't reach has no vertices.
    """
    ids = ["site", *keys]
    of = lambda k: F.explode(F.array_distinct(F.array(*(F.floor((F.col(k) + d) / tile).cast("int") for d in (-1, 0, 1)))))
    reached = acc.join(ends.select(*ids).distinct(), ids, "left_semi").withColumn("tr", of("r")).withColumn("tc", of("c"))
    held = reached.groupBy(*ids, "tr", "tc").agg(F.collect_list(F.struct(place(tile).alias("at"), "acc")).alias("a"))
    held = materialise(held.select(*ids, "tr", "tc", F.col("a.at").alias("acc_at"), F.col("a.acc").alias("acc")), "reached")
    box = spread(held)[1] or (0, 0, 0, 0)
    grid = tiles(boxed(cells, box, tile), tile, keys, held).select(*keys, "tr", "tc", F.col("at").alias("cost_at"), "cost")
    fields = banded(held.join(grid.hint("merge"), [*keys, "tr", "tc"]), "fields")
    types = dict(ends.dtypes)
    kind = f"{', '.join(f'{k} {types[k]}' for k in ids)}, target {types['target']}, tr int, tc int, done long, at array<int>, length array<double>, next_r int, next_c int"
    heads = ends.select(*ids, "target", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(0).cast("long").alias("done"))
    rounds: list[DataFrame] = []
    while True:
        heads = heads.withColumn("tr", F.floor(F.col("r") / tile).cast("int")).withColumn("tc", F.floor(F.col("c") / tile).cast("int"))
        asked = heads.groupBy(*ids, "tr", "tc").agg(F.collect_list(F.struct("target", place(tile).alias("at"), "done")).alias("h"))
        asked = asked.select(*ids, "tr", "tc", F.col("h.target").alias("targets"), F.col("h.at").alias("heads"), F.col("h.done").alias("steps"))
        near = fields.filter(F.col("band").isin(bands(heads))).drop("band")
        rounds.append(materialise(asked.join(near.hint("merge"), [*ids, "tr", "tc"]).mapInPandas(_back(tile, ids), kind), "walked"))
        heads = rounds[-1].filter("next_r is not null").select(*ids, "target", F.col("next_r").alias("r"), F.col("next_c").alias("c"), (F.col("done") + F.size("at")).alias("done"))
        if heads.isEmpty():
            break
    every = reduce(DataFrame.union, rounds).select(*ids, "target", "tr", "tc", "done", F.posexplode(F.arrays_zip("at", "length")).alias("i", "v"))
    r, c = F.col("tr") * tile + F.floor(F.col("v.at") / (tile + 2)) - 1, F.col("tc") * tile + F.col("v.at") % (tile + 2) - 1
    back = every.select(*ids, "target", (F.col("done") + F.col("i")).alias("back"), r.cast("int").alias("r"), c.cast("int").alias("c"), F.col("v.length").alias("length"))
    last = F.max("back").over(Window.partitionBy(*ids, "target"))
    found = materialise(back.withColumn("k", last - F.col("back")).select(*ids, "target", "k", "r", "c", "length"), "vertices")
    release(held, fields, *rounds)
    return found


def route_sums(vertices: DataFrame, cells: DataFrame, classes: dict[str, int] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, site, target, length, sea, hops): a route's length in cells, and its part over sea; each step counts where it leads to.

    For each of ``classes`` (name: mask), a column of that name has the length of the steps into cells whose class_bits have any of its bits.
    """
    classes = classes or {}
    grid = cells.select("r", "c", "surface", F.col("class_bits").alias("bits") if classes else F.lit(0).cast("long").alias("bits"))
    each = vertices.join(grid.hint("merge"), ["r", "c"], "left")  # a grid of few bytes in its file may be large in memory: it is not sent to the driver
    part = lambda condition: F.sum(F.when(condition, F.col("length")).otherwise(0.0))
    sums = [part(F.col("bits").bitwiseAND(F.lit(mask)) != 0).alias(name) for name, mask in classes.items()]
    return each.groupBy(*keys, "site", "target").agg(F.sum("length").alias("length"), part(F.col("surface") == "sea").alias("sea"), F.max("k").alias("hops"), *sums)


def on_barriers(vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """(site, target, vertices, blocked): how many cells of each route have no cost in ``cells`` or aren't there; routes without any are left out."""
    valid = cells.filter("cost is not null and cost > 0").select("r", "c", F.lit(True).alias("valid"))
    counted = vertices.join(valid.hint("merge"), ["r", "c"], "left").groupBy("site", "target").agg(F.count("*").alias("vertices"), F.count_if(F.col("valid").isNull()).alias("blocked"))
    return counted.filter("blocked > 0")


def route_lines(vertices: DataFrame, grid: dict[str, float], places: int = 6) -> DataFrame:
    """(site, target, points): each route as an array of (x: longitude, y: latitude) through its cells' centres.

    ``grid`` (x0, y0, size) places the cells in UTM zone 32N, rows going south from y0.
    """
    x, y = grid["x0"] + (F.col("c") + 0.5) * grid["size"], grid["y0"] - (F.col("r") + 0.5) * grid["size"]
    tangent, lon = conformal(F.col("_x"), F.col("_y"))
    placed = vertices.select("site", "target", "k", x.alias("_x"), y.alias("_y")).select("site", "target", "k", tangent.alias("_t"), lon.alias("_lon"))
    point = F.struct("k", F.round("_lon", places).alias("x"), F.round(latitude(F.col("_t")), places).alias("y"))
    joined = placed.groupBy("site", "target").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return joined.select("site", "target", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
