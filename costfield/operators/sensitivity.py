"""How routes change from scenario to scenario. All scenarios' searches and walks share their rounds, with the scenario as a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costfield.operators import paths, routes
from costfield.operators.raster import disk
from costfield.shared import materialise

KEYS = ("scenario",)


def best_routes(surfaces: DataFrame, placed: DataFrame, sites: DataFrame, scenarios: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The cheapest storage of each source in each scenario, (scenario, from_id, to_id, cost), and the vertices of the routes there.

    ``surfaces`` is (scenario, r, c, cost), ``placed`` the sites' cells (site, r, c), ``sites`` their roles (site, role). Costs are rounded to nine places; of equal ones the first storage counts.
    ``scenarios`` (scenario) are looked for in ``surfaces`` if they aren't given.
    """
    scenarios = surfaces.select("scenario").distinct() if scenarios is None else scenarios
    placed = materialise(placed, "placed")
    sources = placed.join(sites.filter("role = 'source'").select("site"), "site").select("site", "r", "c")
    storages = placed.join(sites.filter("role = 'storage'").select("site"), "site").select(F.col("site").alias("to_id"), "r", "c")
    origins = materialise(sources.crossJoin(F.broadcast(scenarios)), "origins")
    targets = origins.select("scenario", "site").crossJoin(F.broadcast(storages.select("r", "c")))
    acc = paths.accumulate(surfaces, origins, keys=KEYS, targets=targets)
    costs = acc.join(F.broadcast(storages), ["r", "c"]).select("scenario", F.col("site").alias("from_id"), "to_id", "r", "c", F.round("acc", 9).alias("cost"))
    first = F.row_number().over(Window.partitionBy("scenario", "from_id").orderBy("cost", "to_id"))
    best = materialise(costs.withColumn("rank", first).filter("rank = 1").drop("rank"), "best")
    ends = best.select("scenario", F.col("from_id").alias("site"), F.col("to_id").alias("target"), "r", "c")
    return best.select("scenario", "from_id", "to_id", "cost"), routes.route_vertices(surfaces, acc, ends, keys=KEYS)


def shares_within(vertices: DataFrame, baseline: str, radius: int) -> DataFrame:
    """(scenario, site, share): the share of each route's vertices that lie within ``radius`` cells of the baseline's route from the same site."""
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disk(radius))))
    near = vertices.filter(F.col("scenario") == baseline).select("site", "r", "c", around.alias("o"))
    near = near.select("site", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), F.lit(1.0).alias("near")).distinct()
    return vertices.join(near, ["site", "r", "c"], "left").groupBy("scenario", "site").agg(F.avg(F.coalesce("near", F.lit(0.0))).alias("share"))


def outcomes(best: DataFrame, vertices: DataFrame, baseline: str, radius: int, cell_km: float) -> DataFrame:
    """(scenario, sources, best_changed, cost_change, length_change, share_within) against the baseline, over the sources that both route.

    ``best_changed`` counts sources whose cheapest storage is another; the changes are means of the ratio less one; a route of no length has no change.
    """
    lengths = vertices.groupBy("scenario", F.col("site").alias("from_id")).agg((F.sum("length") * cell_km).alias("km"))
    each = best.join(lengths, ["scenario", "from_id"]).join(shares_within(vertices, baseline, radius).withColumnRenamed("site", "from_id"), ["scenario", "from_id"])
    before = each.filter(F.col("scenario") == baseline).select("from_id", F.col("to_id").alias("to_0"), F.col("cost").alias("cost_0"), F.col("km").alias("km_0"))
    ratio = lambda a, b: F.avg(F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0.0)) - 1))
    return each.join(before, "from_id").groupBy("scenario").agg(F.count("*").alias("sources"), F.count_if(F.col("to_id") != F.col("to_0")).alias("best_changed"), ratio("cost", "cost_0").alias("cost_change"), ratio("km", "km_0").alias("length_change"), F.avg("share").alias("share_within"))
