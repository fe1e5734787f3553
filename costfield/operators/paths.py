"""Accumulated cost over the 8-connected grid, tile by tile.

A step costs the mean of its two cells' costs, times the square root of two if it is diagonal; cells without cost can't be
entered. The grid is cut into tiles of ``TILE`` by ``TILE`` cells, each one row with the arrays of its cells and of a rim one cell wide. In a
round, every tile of every site that got better costs at some cells runs a shortest-path search from these; what it
improves on its rim goes to the neighbouring tiles in the next round, until nothing improves. Only tiles that were searched in a round are
written in it. Tables of tiles lie in ``BANDS`` folders, and a round reads those alone that its tiles are in: what it reads and shuffles grows with the tiles searched,
not with the grid, and nothing of it is sent to the driver but the numbers of these folders. With targets, what can't lead to any of a site's targets at less than their present costs is not searched
any more, so a search ends about as far out as its dearest target. A task holds one tile at a time, whatever the size of the grid, and rounds are as many as tiles on the longest route.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costfield.shared import materialise, release

TILE = 128
#: So many rounds' tables are read side by side before they are put together, and so many of these again: a tile is rewritten by the logarithm of the rounds.
TABLES = 8
#: Folders that tables of tiles are dealt to.
BANDS = 64
STEPS = [(a, b, sqrt(2) if a and b else 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def tiles(cells: DataFrame, tile: int = TILE, keys: tuple[str, ...] = (), only: DataFrame | None = None) -> DataFrame:
    """(keys, tr, tc, at, cost): the cells (keys, r, c, cost) of each tile and of its rim, as one row of at most (tile + 2) squared; ``at`` is the place in that square. With ``only`` (keys, tr, tc), of these tiles alone."""
    valid = cells.filter("cost is not null and cost > 0").select(*keys, "r", "c", F.col("cost").cast("double").alias("cost"))
    of = lambda k: F.explode(F.array_distinct(F.array(*(F.floor((F.col(k) + d) / tile).cast("int") for d in (-1, 0, 1)))))
    placed = valid.withColumn("tr", of("r")).withColumn("tc", of("c"))
    if only is not None:
        placed = placed.join(only.select(*keys, "tr", "tc").distinct(), [*keys, "tr", "tc"], "left_semi")
    held = placed.groupBy(*keys, "tr", "tc").agg(F.collect_list(F.struct(place(tile).alias("at"), "cost")).alias("cells"))
    return held.select(*keys, "tr", "tc", F.col("cells.at").alias("at"), F.col("cells.cost").alias("cost"))


def banded(held: DataFrame, tag: str) -> DataFrame:
    """A table of tiles (tr, tc), each band of them in a folder of its own."""
    return materialise(held.withColumn("band", _band()).repartition("band"), tag)


def _band():
    return F.pmod(F.col("tr") * 31 + F.col("tc"), F.lit(BANDS)).cast("int")


def bands(points: DataFrame) -> list[int]:
    """The bands of the tiles (tr, tc) that points are in: at most ``BANDS`` numbers."""
    return sorted(x.band for x in points.select(_band().alias("band")).distinct().collect())


def spread(points: DataFrame) -> tuple[list[int], tuple[int, int, int, int] | None]:
    """The bands of the tiles (tr, tc) that points are in, and their box: first and last row and column of tiles. A row a band is collected at most."""
    rows = points.groupBy(_band().alias("band")).agg(*(f(k).alias(f"{f.__name__}_{k}") for k in ("tr", "tc") for f in (F.min, F.max))).collect()
    if not rows:
        return [], None
    return sorted(x.band for x in rows), (min(x.min_tr for x in rows), max(x.max_tr for x in rows), min(x.min_tc for x in rows), max(x.max_tc for x in rows))


def boxed(cells: DataFrame, box: tuple[int, int, int, int], tile: int) -> DataFrame:
    """The cells of the tiles in ``box`` and of their rims."""
    top, bottom, left, right = box
    return cells.filter(F.col("r").between(top * tile - 1, bottom * tile + tile) & F.col("c").between(left * tile - 1, right * tile + tile))


def _wider(box: tuple[int, int, int, int], held: tuple[int, int, int, int] | None) -> tuple[int, int, int, int]:
    """A box around ``box`` and ``held`` with a margin of half its size, a tile at least: so boxes are few until all is in them."""
    top, bottom, left, right = box if held is None else (min(box[0], held[0]), max(box[1], held[1]), min(box[2], held[2]), max(box[3], held[3]))
    high, wide = (bottom - top) // 2 + 1, (right - left) // 2 + 1
    return top - high, bottom + high, left - wide, right + wide


def place(tile: int):
    """The place of cell (r, c) in the square of tile (tr, tc) and its rim."""
    return ((F.col("r") - F.col("tr") * tile + 1) * (tile + 2) + F.col("c") - F.col("tc") * tile + 1).cast("int")


def _search(tile: int, ids: list[str]):
    width = tile + 2
    steps = [(a * width + b, length / 2) for a, b, length in STEPS]
    inside = np.zeros((width, width), bool)
    inside[1:-1, 1:-1] = True
    inside = inside.ravel().tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                cost = np.zeros(width * width)
                cost[row.at] = row.cost
                cost = cost.tolist()
                acc = [np.inf] * (width * width) if row.known is None else row.known.tolist()
                heap, rim, better = [], set(), False
                for k, d in zip(row.seed_at.tolist(), row.seed.tolist()):
                    if cost[k] > 0 and d < acc[k]:
                        acc[k] = d
                        heap.append((d, k))
                        better = True
                heapq.heapify(heap)
                pop, push = heapq.heappop, heapq.heappush
                while heap:
                    d, k = pop(heap)
                    if d > row.bound:
                        break
                    if d > acc[k]:
                        continue
                    own = cost[k]
                    for step, half in steps:
                        to = k + step
                        there = cost[to]
                        if there > 0 and (new := d + (own + there) * half) < acc[to]:
                            acc[to] = new
                            if inside[to]:
                                push(heap, (new, to))
                            else:
                                rim.add(to)
                if better:
                    sent = sorted(rim)
                    out.append((*(getattr(row, k) for k in ids), row.tr, row.tc, acc, sent, [acc[k] for k in sent]))
            yield pd.DataFrame(out, columns=[*ids, "tr", "tc", "acc", "rim_at", "rim"])

    return run


def _latest(rounds: list[DataFrame], ids: list[str]) -> DataFrame:
    """The newest row of each site's tile."""
    every = reduce(DataFrame.union, (x.select(*ids, "tr", "tc", "acc", F.lit(k).alias("round")) for k, x in enumerate(rounds)))
    return every.groupBy(*ids, "tr", "tc").agg(F.max_by("acc", "round").alias("known"))


def _in_tiles(points: DataFrame, tile: int) -> DataFrame:
    return points.withColumn("tr", F.floor(F.col("r") / tile).cast("int")).withColumn("tc", F.floor(F.col("c") / tile).cast("int"))


def _settled(found: DataFrame, targets: DataFrame, before: DataFrame | None) -> DataFrame:
    """``targets`` (ids, tr, tc, at) with the least cost so far (``acc``, infinite at first) after a round; a row each, so a small table."""
    keys = targets.columns
    now = found.join(targets.hint("merge"), keys[:-1]).select(*keys, F.get("acc", F.col("at")).alias("acc"))
    before = targets.withColumn("acc", F.lit(float("inf"))) if before is None else before
    return materialise(before.union(now).groupBy(*keys).agg(F.min("acc").alias("acc")), "settled")


def _bounds(settled: DataFrame, ids: list[str], slack: float) -> DataFrame:
    """(ids, bound): the present cost of each site's dearest target and a share ``slack`` of it; infinite while one isn't reached."""
    return settled.groupBy(*ids).agg((F.max("acc") * (1 + slack)).alias("bound"))


def _put_together(rounds: list[tuple[DataFrame, int]], ids: list[str]) -> list[tuple[DataFrame, int]]:
    """The rounds' tables, oldest first and each with how often it was put together, with the last ``TABLES`` of equal such number as one."""
    while len(rounds) >= TABLES and len({n for _, n in rounds[-TABLES:]}) == 1:
        old, n = [x for x, _ in rounds[-TABLES:]], rounds[-1][1]
        whole = banded(_latest(old, ids).select(*ids, "tr", "tc", F.col("known").alias("acc")), "searched")
        release(*old)
        rounds = [*rounds[:-TABLES], (whole, n + 1)]
    return rounds


def accumulate(cells: DataFrame, origins: DataFrame, tile: int = TILE, keys: tuple[str, ...] = (), targets: DataFrame | None = None, slack: float = 0.0) -> DataFrame:
    """(keys, site, r, c, acc): the least cost from each site's cell (keys, site, r, c) to every cell that can be reached.

    With ``keys``, say a scenario, ``cells`` hold a grid for each key, and all sites of all keys are searched for in the same rounds. An origin on a cell without cost reaches nothing. Sites that share a cell are each searched for.

    With ``targets`` (keys, site, r, c), a site's cells are given as far as the cost of its dearest target and a share ``slack`` of that more, to nine places: enough for costs of
    and routes to the targets, and for corridors of that tolerance. All that can be reached is given where a target can't be; a site without a target is not searched for.
    """
    ids, types = ["site", *keys], dict(origins.dtypes)
    grid = held_box = None
    kind = f"{', '.join(f'{k} {types[k]}' for k in ids)}, tr int, tc int, acc array<double>, rim_at array<int>, rim array<double>"
    if targets is not None:
        placed = _in_tiles(targets.select(*ids, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")), tile)
        targets = materialise(placed.select(*ids, "tr", "tc", place(tile).alias("at")).distinct(), "targets")
        origins = origins.join(targets.select(*ids).distinct().hint("merge"), ids, "left_semi")
    settled, unbound = None, F.lit(float("inf")).alias("bound")
    cores = cells.sparkSession.sparkContext.defaultParallelism
    seeds = materialise(_in_tiles(origins.select(*ids, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(0.0).alias("acc"), unbound), tile), "seeds")
    rounds: list[tuple[DataFrame, int]] = []
    if targets is None:
        grid = banded(tiles(cells, tile, keys), "tiles")
    else:
        box = spread(seeds.select("tr", "tc").union(targets.select("tr", "tc")))[1] or (0, 0, 0, 0)
    while (found_in := spread(seeds))[0] or not rounds:
        at = found_in[0]
        if targets is not None:
            # Tiles are made around the ends alone, and around more when a search comes to where there are none.
            box = found_in[1] if rounds and found_in[1] else box
            if held_box is None or box[0] < held_box[0] or box[1] > held_box[1] or box[2] < held_box[2] or box[3] > held_box[3]:
                held_box = _wider(box, held_box)
                if grid is not None:
                    release(grid)
                inside = F.col("tr").between(held_box[0], held_box[1]) & F.col("tc").between(held_box[2], held_box[3])
                grid = banded(tiles(boxed(cells, held_box, tile), tile, keys).filter(inside), "tiles")
        within = F.col("band").isin(at)
        asked = seeds.groupBy(*ids, "tr", "tc").agg(F.collect_list(F.struct(place(tile).alias("at"), "acc")).alias("s"), F.max("bound").alias("bound"))
        asked = asked.select(*ids, "tr", "tc", F.col("s.at").alias("seed_at"), F.col("s.acc").alias("seed"), "bound")
        # Tiles and targets meet by merge joins: a broadcast would send them to the driver in each round, and takes a whole page of memory for a few rows.
        if rounds:
            named = asked.select(*ids, "tr", "tc").hint("merge")
            known = [x.filter(within).join(named, [*ids, "tr", "tc"], "left_semi") for x, _ in rounds]
            asked = asked.join(_latest(known, ids).hint("merge"), [*ids, "tr", "tc"], "left")
        else:
            asked = asked.withColumn("known", F.lit(None).cast("array<double>"))
        held = asked.join(grid.filter(within).drop("band").hint("merge"), [*keys, "tr", "tc"]).repartition(cores, *ids, "tr", "tc")
        found = materialise(held.mapInPandas(_search(tile, ids), kind).withColumn("band", _band()), "searched")
        rounds = [*rounds, (found, 0)]
        sent = found.select(*ids, "tr", "tc", F.explode(F.arrays_zip("rim_at", "rim")).alias("s"))
        r, c = F.col("tr") * tile + F.floor(F.col("s.rim_at") / (tile + 2)) - 1, F.col("tc") * tile + F.col("s.rim_at") % (tile + 2) - 1
        sown, seeds = seeds, sent.select(*ids, r.cast("int").alias("r"), c.cast("int").alias("c"), F.col("s.rim").alias("acc")).groupBy(*ids, "r", "c").agg(F.min("acc").alias("acc"))
        if targets is not None:
            before, settled = settled, _settled(found, targets, settled)
            if before is not None:
                release(before)
            # A billionth more, so that sums in another order are no other cells.
            bounds = _bounds(settled, ids, slack).withColumn("bound", F.col("bound") * (1 + 1e-9))
            seeds = seeds.join(bounds.hint("merge"), ids).filter("acc <= bound")
        else:
            seeds = seeds.withColumn("bound", unbound)
        seeds = materialise(_in_tiles(seeds, tile), "seeds")
        release(sown)
        rounds = _put_together(rounds, ids)
    each = _latest([x for x, _ in rounds], ids).select(*ids, "tr", "tc", F.posexplode("known").alias("at", "acc"))
    row, column = F.floor(F.col("at") / (tile + 2)) - 1, F.col("at") % (tile + 2) - 1
    each = each.select(*ids, (F.col("tr") * tile + row).cast("int").alias("r"), (F.col("tc") * tile + column).cast("int").alias("c"), "acc", row.alias("row"), column.alias("column"))
    within = F.col("row").between(0, tile - 1) & F.col("column").between(0, tile - 1)
    each = each.filter(within & (F.col("acc") < float("inf")))
    if targets is not None:
        each = each.join(_bounds(settled, ids, slack), ids).filter(F.round("acc", 9) <= F.round("bound", 9))
    reached = materialise(each.select(*ids, "r", "c", "acc"), "accumulated")
    release(grid, seeds, *(x for x, _ in rounds))
    if targets is not None:
        release(targets, settled)
    return reached
