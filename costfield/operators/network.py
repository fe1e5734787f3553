"""Sites, pairs, spanning networks and corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costfield.operators.raster import disk
from costfield.shared import materialise, release


def snap(sites: DataFrame, cells: DataFrame, limit: int) -> DataFrame:
    """(site, r, c, d2): the nearest cell with a cost within ``limit`` cells of each site (site, r, c); of several, the first by row and column.

    Sites without such a cell are left out; the caller compares counts.
    """
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disk(limit)))
    near = sites.select("site", F.explode(offsets).alias("o"), "r", "c").select("site", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), (F.col("o.a") * F.col("o.a") + F.col("o.b") * F.col("o.b")).alias("d2"))
    valid = cells.filter("cost is not null and cost > 0").select("r", "c")
    best = near.join(valid, ["r", "c"]).groupBy("site").agg(F.min(F.struct("d2", "r", "c")).alias("best"))
    return best.select("site", "best.r", "best.c", "best.d2")


def _nearest(sites: DataFrame, cells: DataFrame, grid: dict[str, float], limit: float) -> DataFrame:
    """(site, r, c, metres): the cell with a cost whose centre is nearest to each site's point (x, y), within ``limit`` metres; of several the first by row and column."""
    size, reach = grid["size"], int(limit // grid["size"]) + 1
    column, row = F.floor((F.col("x") - grid["x0"]) / size), F.floor((grid["y0"] - F.col("y")) / size)
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1))))
    near = sites.select("site", "x", "y", row.alias("r0"), column.alias("c0"), around.alias("o")).select("site", "x", "y", (F.col("r0") + F.col("o.a")).cast("int").alias("r"), (F.col("c0") + F.col("o.b")).cast("int").alias("c"))
    away = F.hypot(F.col("x") - (grid["x0"] + (F.col("c") + 0.5) * size), F.col("y") - (grid["y0"] - (F.col("r") + 0.5) * size))
    near = near.withColumn("metres", away).filter(F.col("metres") <= limit)
    valid = cells.filter("cost is not null and cost > 0").select("r", "c")
    best = near.join(valid, ["r", "c"]).groupBy("site").agg(F.min(F.struct(F.round("metres", 9).alias("d"), "r", "c", "metres")).alias("best"))
    return best.select("site", "best.r", "best.c", "best.metres")


def _outside(grid: dict[str, float]):
    x, y = F.col("x") - grid["x0"], grid["y0"] - F.col("y")
    return x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y) | (x < 0) | (y <= 0) | (x >= grid["width"] * grid["size"]) | (y > grid["height"] * grid["size"])


def site_problems(sites: DataFrame, cells: DataFrame, grid: dict[str, float], limit: float) -> DataFrame:
    """(site, problem): sites (site, x, y) that are outside the grid (x0, y0, size, width, height), too far from any cell with a cost, or on one cell with another."""
    inside = sites.filter(~_outside(grid))
    found = _nearest(inside, cells, grid, limit)
    shared = found.groupBy("r", "c").agg(F.count("*").alias("n")).filter("n > 1")
    said = lambda df, problem: df.select("site", F.lit(problem).alias("problem"))
    return said(sites.filter(_outside(grid)), "outside").union(said(inside.join(found, "site", "left_anti"), "too far")).union(said(found.join(shared, ["r", "c"]), "shared cell"))


def place_sites(sites: DataFrame, cells: DataFrame, grid: dict[str, float], limit: float, within: bool = False) -> DataFrame:
    """(site, r, c, metres) of all ``sites`` (site, x, y); an error names those with a problem. With ``within``, sites outside the grid are left out instead."""
    problems = site_problems(sites, cells, grid, limit)
    bad = sorted(map(tuple, (problems.filter("problem <> 'outside'") if within else problems).collect()), key=str)  # sites are few: each is a search
    if bad:
        raise ValueError(f"sites that can't be placed: {bad}")
    return _nearest(sites.filter(~_outside(grid)), cells, grid, limit)


def route_pairs(sites: DataFrame) -> DataFrame:
    """(from_id, to_id) of all sources with all storages, from (site, role)."""
    source = sites.filter("role = 'source'").select(F.col("site").alias("from_id"))
    return source.crossJoin(sites.filter("role = 'storage'").select(F.col("site").alias("to_id")))


def network_pairs(sites: DataFrame) -> DataFrame:
    """(from_id, to_id) of all sites, each pair once."""
    return sites.select(F.col("site").alias("from_id")).join(sites.select(F.col("site").alias("to_id")), F.col("from_id") < F.col("to_id"))


def targets(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """(site, r, c): the cells that each site's search has to reach for ``pairs`` (from_id, to_id) of the ``placed`` sites."""
    return pairs.join(placed.select(F.col("site").alias("to_id"), "r", "c"), "to_id").select(F.col("from_id").alias("site"), "r", "c")


def pair_costs(acc: DataFrame, pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """(from_id, to_id, status, cost): each pair's accumulated cost; unreachable pairs have none."""
    ends = pairs.join(placed.select(F.col("site").alias("to_id"), "r", "c"), "to_id")
    there = acc.withColumnRenamed("site", "from_id").join(ends.select("from_id", "r", "c").distinct().hint("merge"), ["from_id", "r", "c"])
    found = ends.join(there.hint("merge"), ["from_id", "r", "c"], "left")
    return found.select("from_id", "to_id", F.when(F.col("acc").isNull(), "unreachable").otherwise("routed").alias("status"), F.col("acc").alias("cost"))


def ranked(costs: DataFrame) -> DataFrame:
    """(from_id, to_id, cost, rank, best): the routed storages of each source by cost."""
    rank = F.row_number().over(Window.partitionBy("from_id").orderBy("cost", "to_id"))
    return costs.filter("status = 'routed'").select("from_id", "to_id", "cost", rank.alias("rank"), (rank == 1).alias("best"))


def spanning_network(costs: DataFrame) -> DataFrame:
    """The edges (from_id, to_id, cost) of the minimum spanning tree by (cost, from_id, to_id); of several parts, a tree each.

    Each round every component takes its least edge to another one (Boruvka), and joined components are relabelled.
    """
    edges = materialise(costs.filter("status = 'routed'").select("from_id", "to_id", "cost"), "edges")
    label = edges.select(F.col("from_id").alias("site")).union(edges.select(F.col("to_id").alias("site"))).distinct().withColumn("label", F.col("site"))
    tree = edges.limit(0)
    while True:
        ends = edges.join(label.select(F.col("site").alias("from_id"), F.col("label").alias("a")), "from_id").join(label.select(F.col("site").alias("to_id"), F.col("label").alias("b")), "to_id").filter("a <> b")
        both = ends.select("a", "b", "from_id", "to_id", "cost").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "from_id", "to_id", "cost"))
        taken = both.groupBy("a").agg(F.min(F.struct("cost", "from_id", "to_id", "b")).alias("e")).select("a", "e.*")
        taken = materialise(taken, "taken")
        if taken.isEmpty():
            return tree.distinct()
        tree = tree.union(taken.select("from_id", "to_id", "cost"))
        # The taken edges form trees of components; the smaller of a mutual pair is its root, and pointers double to it.
        up = taken.select("a", "b").join(taken.select(F.col("a").alias("b"), F.col("b").alias("back")), "b")
        up = materialise(up.select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up")), "up")
        while True:
            further = materialise(up.join(up.select(F.col("a").alias("up"), F.col("up").alias("upper")), "up").select("a", "up", "upper"), "up")
            done = further.filter("up <> upper").isEmpty()
            up = further.select("a", F.col("upper").alias("up"))
            if done:
                break
        label, last = materialise(label.join(up.withColumnRenamed("a", "label"), "label", "left").select("site", F.coalesce("up", "label").alias("label")), "labels"), label
        if hasattr(last, "_costfield_path"):
            release(last)


def corridors(acc: DataFrame, costs: DataFrame, tolerances: list[float]) -> DataFrame:
    """(from_id, to_id, r, c, band): cells whose best route through costs the pair's least by a tolerance more at most; ``band`` numbers the smallest such."""
    # A cell beyond the widest tolerance from either end alone is in no corridor: each side is cut down before the two meet.
    widest = F.round(F.col("cost") * (1 + max(tolerances)), 9)
    pair = costs.filter("status = 'routed'").select("from_id", "to_id", "cost")
    side = lambda end, name: acc.select(F.col("site").alias(end), "r", "c", F.col("acc").alias(name)).join(pair, end).filter(F.round(name, 9) <= widest)
    through = side("from_id", "a").join(side("to_id", "b").drop("cost").hint("merge"), ["from_id", "to_id", "r", "c"])
    excess = F.round(F.col("a") + F.col("b"), 9)
    band = F.coalesce(*(F.when(excess <= F.round(F.col("cost") * (1 + t), 9), k) for k, t in enumerate(sorted(tolerances))))
    return through.select("from_id", "to_id", "r", "c", band.alias("band")).filter("band is not null")


def corridor_areas(cells: DataFrame, tolerances: list[float], size: float) -> DataFrame:
    """(from_id, to_id, tolerance, km2) of each band with the narrower ones in it."""
    ts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(sorted(tolerances))))
    each = cells.select("from_id", "to_id", F.explode(F.filter(ts, lambda x: x["k"] >= F.col("band"))).alias("x"))
    return each.groupBy("from_id", "to_id", F.col("x.t").alias("tolerance")).agg(F.round(F.count("*") * size**2 / 1e6, 1).alias("km2"))
