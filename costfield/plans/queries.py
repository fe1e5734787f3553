"""One query for each operator, over the driver's tables. Doubles are rounded, so that summation orders don't matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costfield.functions import attributes, predicates, projection, scales
from costfield.operators import cell_sets, checks, cost, display, distance, lines, network, paths, raster, rings, routes, sensitivity
from costfield.plans import driver_tables as t
from costfield.shared import materialise
from costfield.sinks import pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query
def grid_assign(spark, d):
    """Row, column and centre of each customer's point on a grid of 250 m from (0, 10000)."""
    x, y = F.col("c_custkey") * 37.0 % 9000, F.col("c_custkey") * 53.0 % 7000
    r, c = F.floor((10000 - y) / 250), F.floor(x / 250)
    return t.table(spark, d, "customer").select("c_custkey", r.alias("r"), c.alias("c"), ((c + 0.5) * 250).alias("x"), (10000 - (r + 0.5) * 250).alias("y"))


def _lon_lat(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", (3.5 + F.col("c_custkey") * 7 % 1200 / 100).alias("lon"), (54.3 + F.col("c_custkey") * 11 % 390 / 100).alias("lat"))


@query
def project_utm32(spark, d):
    x, y = projection.to_utm32(F.col("lon"), F.col("lat"))
    return _lon_lat(spark, d).select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query
def project_wgs84(spark, d):
    x, y = projection.to_utm32(F.col("lon"), F.col("lat"))
    tangent, lon = projection.conformal(F.col("x"), F.col("y"))
    there = _lon_lat(spark, d).select("c_custkey", x.alias("x"), y.alias("y")).select("c_custkey", tangent.alias("tangent"), lon.alias("lon"))
    return there.select("c_custkey", F.round("lon", 8).alias("lon"), F.round(projection.latitude(F.col("tangent")), 8).alias("lat"))


@query
def rasterize_polygon_center(spark, d):
    return raster.rasterize_polygons(t.boxes(spark, d))


def _sets(spark, d):
    """Two sets of runs from the customers' triangles: an extent, and land that reaches beyond it."""
    owner = t.table(spark, d, "customer").select(F.col("c_custkey").alias("feature"), "c_mktsegment", "c_acctbal")
    runs = raster.polygon_runs(t.boxes(spark, d)).join(owner, "feature")
    return runs.filter("c_mktsegment <> 'BUILDING'").select("r", "first", "last"), runs.filter("c_acctbal < 5000").select("r", "first", "last")


@query
def dissolved_extent(spark, d):
    """The triangles of the extent as one set."""
    extent, _ = _sets(spark, d)
    return cell_sets.combine(extent, extent.limit(0), "union")


@query
def clipped_land(spark, d):
    """Land cut to the extent."""
    extent, land = _sets(spark, d)
    return cell_sets.combine(land, extent, "intersection")


@query
def foreign_land(spark, d):
    """Land beyond the extent."""
    extent, land = _sets(spark, d)
    return cell_sets.combine(land, extent, "difference")


@query
def surface_areas(spark, d):
    """Land and sea of the extent: runs and km2."""
    found = cell_sets.surfaces(*_sets(spark, d))
    return rounded(found.groupBy("surface").agg(F.count("*").alias("runs")).join(cell_sets.area(found, 100.0, ("surface",)), "surface"))


@query
def boundary_rings(spark, d):
    """Shells and holes of what lies in the extent or on land, but not in both: corners and area of each ring."""
    cells = cell_sets.cells_of(cell_sets.combine(*_sets(spark, d), "either"))
    found = rings.ring_areas(rings.boundary_rings(cells))
    return found.groupBy("corners", "area").agg(F.count("*").alias("rings"))


@query
def shells_with_holes(spark, d):
    """The pieces of what lies in the extent or on land, but not in both: their area inside the shell, and how many holes of which area."""
    cells = cell_sets.cells_of(cell_sets.combine(*_sets(spark, d), "either"))
    found = rings.shells_of(rings.boundary_rings(cells), cells)
    each = found.groupBy("shell").agg(F.max("area").alias("shell_area"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("area").alias("area"))
    return each.groupBy("shell_area", "holes", "area").agg(F.count("*").alias("n"))


@query
def simplified_lines(spark, d):
    """Each user's events as a line of values over time, simplified."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    vertices = t.table(spark, d, "events").select(F.col("user_id").alias("line"), F.row_number().over(order).cast("long").alias("k"), (F.row_number().over(order) * 10.0).alias("x"), F.col("value").alias("y"))
    return rounded(lines.simplified(vertices, 25.0).withColumnRenamed("line", "user_id"))


@query
def rasterize_line_touched(spark, d):
    return raster.rasterize_lines(t.lines(spark, d))


def _present(spark, d):
    return cost.present_layers(t.cells(spark, d), t.presence(spark, d), t.RULES)


@query
def class_bits(spark, d):
    return _present(spark, d).select("r", "c", "class_bits")


def _inputs(spark, d):
    return t.cells(spark, d), t.presence(spark, d), t.population(spark, d), t.RULES


@query
def class_stats(spark, d):
    return rounded(cost.class_statistics(*_inputs(spark, d)), 4)


@query
def base_cost(spark, d):
    return t.cells(spark, d).select("r", "c", cost.base_cost(t.RULES).alias("cost"))


@query
def barriers(spark, d):
    return _present(spark, d).filter(cost.is_barrier(t.RULES)).select("r", "c")


@query
def static_max_group(spark, d):
    return _present(spark, d).select("r", "c", cost.group_cost(t.RULES, "nature").alias("nature"), cost.group_cost(t.RULES, "people").alias("people"))


@query
def discount_fold(spark, d):
    """Base, groups, then additions and discounts in the layers' order."""
    return rounded(_present(spark, d).select("r", "c", cost.static_cost(t.RULES).alias("cost")))


@query
def near_building(spark, d):
    return rounded(cost.near_buildings(t.cells(spark, d), t.RULES).join(t.cells(spark, d).filter("surface = 'land'").select("r", "c"), ["r", "c"]))


@query
def parallel_band(spark, d):
    return cost.parallel_band(_present(spark, d), t.RULES)


@query
def building_distance(spark, d):
    """Every cell's distance from the nearest building in metres, rounded to whole ones, 65534 at most."""
    grid = t.cells(spark, d)
    far = distance.distance_transform(grid.select("r", "c"), grid.filter("building").select("r", "c"))
    return far.select("r", "c", F.least(F.lit(65534), F.rint(F.sqrt("d2") * 100).cast("int")).alias("metres"))


@query
def nearest_landfall(spark, d):
    """Every sea cell's squared distance, in cells, from the nearest land cell of a size that few have."""
    grid = t.cells(spark, d)
    return distance.distance_transform(grid.filter("surface = 'sea'").select("r", "c"), grid.filter("surface = 'land' and size = 3 and r % 5 = 0").select("r", "c"))


@query
def landfall(spark, d):
    grid = t.cells(spark, d)
    return raster.landfall(grid.filter("surface = 'land'").select("r", "c"), grid.filter("surface = 'sea'").select("r", "c"))


@query
def focal_sum(spark, d):
    grid = t.cells(spark, d).select("r", "c").join(t.population(spark, d), ["r", "c"], "left")
    return rounded(raster.focal_sum(grid, "people", 3))


@query
def quantile_scale_population(spark, d):
    return rounded(cost.population_cost(t.cells(spark, d), t.population(spark, d), t.RULES))


@query
def quantile_scale_risk(spark, d):
    return rounded(cost.risk_cost(t.cells(spark, d), t.population(spark, d), t.RULES))


@query
def resample_area(spark, d):
    """Cells of 2.5 by 2.5: mean and largest size, share of buildings as a byte, and the majority surface."""
    grid = t.cells(spark, d).withColumn("land", F.when(F.col("surface") == "land", 1.0).otherwise(0.0)).withColumn("built", F.col("building").cast("double"))
    size = raster.resample(grid, "size", 2.5).withColumnRenamed("mean", "mean_size").withColumnRenamed("most", "most_size")
    land = raster.resample(grid, "land", 2.5).select("r", "c", F.when(F.round("mean", 9) >= 0.5, "land").otherwise("sea").alias("surface"))
    built = raster.resample(grid, "built", 2.5).select("r", "c", F.rint(F.round(F.col("mean") * 255, 6)).cast("int").alias("built"))
    return rounded(size.join(land, ["r", "c"]).join(built, ["r", "c"]))


@query
def cost_surface_full(spark, d):
    return rounded(cost.cost_surface(*_inputs(spark, d), check=True))


@query
def cost_explain(spark, d):
    return rounded(cost.explain(*_inputs(spark, d)))


def _snapped(spark, d):
    return network.snap(t.sites(spark, d), t.simple_costs(spark, d), 3)


@query
def pack_chunks(spark, d):
    """The digest of each chunk of three planes of the grid, as they lie in a pack: class bits, distances from buildings, buildings."""
    grid = t.cells(spark, d)
    low, high = pack.bit_planes()
    held = _present(spark, d).select("r", "c", low, high, F.col("building").cast("int").alias("buildings")).join(building_distance(spark, d), ["r", "c"])
    planes = [pack.Plane("presence_lo", "u32"), pack.Plane("presence_hi", "u32"), pack.Plane("metres", "u16", 65535), pack.Plane("buildings", "u8")]
    return pack.encoded(held, planes, grid.agg(F.max("r") + 1).first()[0], 50, 16).select("plane", "chunk", "raw_sha256", "raw_bytes")


@query
def display_tiles(spark, d):
    """The tiles of a map of the simple costs, three levels of them: how many cells each has, their mean, and the colour of that."""
    grid = t.simple_costs(spark, d)
    placed = {"x0": 500000.0, "y0": 6200000.0 + 100.0 * (grid.agg(F.max("r")).first()[0] + 1), "size": 100.0}
    found = display.pyramid(display.warped(grid, placed, 150.0), 2)
    each = display.tiles(found, 16).select("level", "tile_r", "tile_c", "cells", F.explode("pixels").alias("p"))
    means = each.groupBy("level", "tile_r", "tile_c", "cells").agg(F.avg("p.value").alias("mean"))
    return rounded(means.withColumn("colour", display.ramp(F.round("mean", 9), F.lit(1.0), F.lit(5.0), ("#1a9850", "#ffffbf", "#d73027"))))


@query
def snap_sites(spark, d):
    return _snapped(spark, d)


@query
def route_pairs(spark, d):
    return network.route_pairs(t.sites(spark, d))


@query
def network_pairs(spark, d):
    return network.network_pairs(t.sites(spark, d))


@query
def accumulated_cost(spark, d):
    return rounded(paths.accumulate(t.simple_costs(spark, d), _snapped(spark, d)), 9)


@query
def costs_to_targets(spark, d):
    """Each source's costs as far as the dearest of the storages that are near it by number: what an early stop settles."""
    placed = _snapped(spark, d)
    pairs = network.route_pairs(t.sites(spark, d)).filter("abs(from_id - to_id) <= 2")
    return rounded(paths.accumulate(t.simple_costs(spark, d), placed, targets=network.targets(pairs, placed)), 9)


def _pair_costs(spark, d, pairs=network.route_pairs, slack=None):
    """What the pairs' searches settle, as far as their dearest targets, and the pairs' costs. With ``slack``, searches go from both ends, and that share further."""
    wanted, placed = pairs(t.sites(spark, d)), materialise(_snapped(spark, d), "placed")
    reached = wanted if slack is None else wanted.union(wanted.select("to_id", "from_id"))
    acc = paths.accumulate(t.simple_costs(spark, d), placed, targets=network.targets(reached, placed), slack=slack or 0.0)
    return acc, materialise(network.pair_costs(acc, wanted, placed), "pair_costs")


def _corridors(spark, d):
    return network.corridors(*_pair_costs(spark, d, slack=max(t.TOLERANCES) + 1e-9), t.TOLERANCES)


@query
def pair_costs(spark, d):
    return rounded(_pair_costs(spark, d)[1], 9)


@query
def best_storage_rank(spark, d):
    return rounded(network.ranked(rounded(_pair_costs(spark, d)[1], 9)), 9)


@query
def spanning_network(spark, d):
    return network.spanning_network(rounded(_pair_costs(spark, d, network.network_pairs)[1], 9))


def _vertices(spark, d):
    acc, costs = _pair_costs(spark, d)
    placed = _snapped(spark, d).select(F.col("site").alias("to_id"), "r", "c")
    ends = costs.filter("status = 'routed'").join(placed, "to_id").select(F.col("from_id").alias("site"), F.col("to_id").alias("target"), "r", "c")
    return routes.route_vertices(t.simple_costs(spark, d), acc, ends)


def _as_pairs(df):
    return df.withColumnsRenamed({"site": "from_id", "target": "to_id"})


@query
def route_vertices(spark, d):
    """The cells of a least-cost route for each routed pair, from source to storage."""
    return _as_pairs(_vertices(spark, d)).select("from_id", "to_id", "k", "r", "c")


@query
def vertices_on_barriers(spark, d):
    """Routes that pass cells which the layers' barriers block, though they were found on a grid without these."""
    grid = _present(spark, d).select("r", "c", cost.static_cost(t.RULES).alias("cost"))
    return _as_pairs(routes.on_barriers(_vertices(spark, d), grid))


@query
def route_lengths(spark, d):
    """Length and sea part (km, cells of 100 m) of a least-cost route for each routed pair."""
    found = _as_pairs(routes.route_sums(_vertices(spark, d), t.simple_costs(spark, d)))
    return found.select("from_id", "to_id", F.round(F.col("length") / 10, 4).alias("length_km"), F.round(F.col("sea") / 10, 4).alias("sea_km"), "hops")


@query
def route_class_km(spark, d):
    """Km of each routed pair's route over each of four classes: steps count where their farther cell has any of the class's bits."""
    grid = t.simple_costs(spark, d).join(_present(spark, d).select("r", "c", "class_bits").hint("merge"), ["r", "c"])
    found = _as_pairs(routes.route_sums(_vertices(spark, d), grid, t.ROUTE_CLASSES))
    return found.select("from_id", "to_id", *(F.round(F.col(k) / 10, 4).alias(k) for k in t.ROUTE_CLASSES))


@query
def tree_check(spark, d):
    """Whether the spanning network is a tree on the sites that have a cell."""
    return checks.tree(spanning_network(spark, d).select("from_id", "to_id"), _snapped(spark, d).select("site"))


@query
def order_graph_check(spark, d):
    """Parts and cycles of the graph of customers and the nations of their orders' suppliers."""
    line = t.table(spark, d, "lineitem").join(t.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    edges = line.filter("l_quantity > 45").join(orders, "l_orderkey").select(F.col("o_custkey").alias("from_id"), (-1 - F.col("s_nationkey")).cast("long").alias("to_id"))
    nodes = t.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("site")).union(t.table(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("site")))
    return checks.tree(edges.select(F.col("from_id").cast("long").alias("from_id"), "to_id"), nodes)


@query
def route_shorter_than_straight(spark, d):
    """Routes that are shorter than the straight line between their ends: none."""
    placed = _snapped(spark, d)
    return rounded(checks.too_short(route_lengths(spark, d).select("from_id", "to_id", "length_km"), placed, 0.1, 0.001))


@query
def sensitivity_summary(spark, d):
    """Each layer's score halved and doubled: how much the total static cost changes, and how many cells get another cost."""
    present = _present(spark, d)
    base = cost.static_cost(t.RULES)
    sums = [F.sum(base).alias("base")]
    for k, _ in enumerate(t.RULES.layers):
        for factor in (0.5, 2.0):
            layers = [cost.Layer(**{**x.__dict__, "weight": factor if i == k else x.weight}) for i, x in enumerate(t.RULES.layers)]
            other = cost.static_cost(cost.Rules(**{**t.RULES.__dict__, "layers": layers}))
            sums += [F.sum(other).alias(f"t{k}_{factor}"), F.count_if(other != base).alias(f"n{k}_{factor}")]
    one = present.agg(*sums)
    runs = F.array(*(F.struct(F.lit(x.name).alias("layer"), F.lit(f).alias("factor"), (F.col(f"`t{k}_{f}`") / F.col("base") - 1).alias("change"), F.col(f"`n{k}_{f}`").alias("cells")) for k, x in enumerate(t.RULES.layers) for f in (0.5, 2.0)))
    return rounded(one.select(F.explode(runs).alias("s")).select("s.*"))


def _scenarios(spark, d):
    _, *rest = _inputs(spark, d)
    surfaces = cost.scenario_surfaces(t.tie_free(spark, d), *rest, t.SCENARIOS, keep=("little",))
    return surfaces.select("scenario", "r", "c", (F.col("cost") + F.col("little")).alias("cost"))


def _scenario_routes(spark, d):
    surfaces = _scenarios(spark, d)
    valid = surfaces.filter("scenario = 'baseline'").select("r", "c", "cost")  # the same cells have a cost in every scenario
    return sensitivity.best_routes(surfaces, network.snap(t.sites(spark, d), valid, 3), t.sites(spark, d), spark.createDataFrame([(x.name,) for x in t.SCENARIOS], "scenario string"))


@query
def sensitivity_runs(spark, d):
    """The cheapest storage of each source under every scenario of the suite, all searched for in one job."""
    return rounded(_scenario_routes(spark, d)[0])


@query
def sensitivity_outcomes(spark, d):
    """What every scenario changes against the baseline: storages, costs, lengths, and how much of the routes stays within two cells."""
    return rounded(sensitivity.outcomes(*_scenario_routes(spark, d), "baseline", 2, 0.1))


@query
def corridor_cells(spark, d):
    return _corridors(spark, d)


@query
def corridor_area(spark, d):
    return network.corridor_areas(_corridors(spark, d), t.TOLERANCES, 100.0)


@query
def corridor_rings(spark, d):
    """The outlines of each pair's widest corridor without holes of less than two cells."""
    keys = ("from_id", "to_id")
    found = rings.without_small_holes(rings.boundary_rings(corridor_cells(spark, d), keys), 2, keys)
    return rings.ring_areas(found, keys).groupBy(*keys).agg(F.count_if(F.col("area") > 0).alias("shells"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("corners").alias("corners"), F.sum("area").alias("area"))


@query
def detour_factors(spark, d):
    """Route length over the straight line, for each routed pair that is apart."""
    placed = _snapped(spark, d)
    return rounded(checks.detours(route_lengths(spark, d), placed, 0.1))


@query
def detour_summary(spark, d):
    return rounded(checks.detour_summary(checks.detours(route_lengths(spark, d), _snapped(spark, d), 0.1), 1.2))


@query
def route_compare(spark, d):
    """The routes' costs against a set with other costs, that lacks some routes and has others."""
    costs = _pair_costs(spark, d)[1]
    key = F.col("from_id") + F.col("to_id")
    other = costs.filter(key % 13 != 0).withColumn("cost", F.when(F.col("to_id") % 7 == 3, 0.0).otherwise(F.col("cost") * (1 + key % 3 * 0.004)))
    return rounded(checks.compare_routes(costs.filter(key % 11 != 0), other, 0.005))


def _point_sites(spark, d):
    """Suppliers as points in metres, some of them outside the grid; its size; and cells of which few have a cost."""
    height = t.cells(spark, d).agg(F.max("r") + 1).first()[0]
    k = F.col("s_suppkey")
    points = t.table(spark, d, "supplier").select(k.cast("int").alias("site"), (k * 137.0 % 5400 - 150).alias("x"), (k * 211.0 % (height * 100 + 300) - 100).alias("y"))
    few = t.cells(spark, d).select("r", "c", F.when((F.col("size") % 4 == 0) & ~F.col("building"), 1.0).alias("cost"))
    return points, few, {"x0": 0.0, "y0": height * 100.0, "size": 100.0, "width": 50, "height": height}, 120.0


@query
def site_problems(spark, d):
    """Points that are outside the grid, too far from a cell with a cost, or on one cell with another."""
    return network.site_problems(*_point_sites(spark, d))


@query
def placed_sites(spark, d):
    """The nearest cell with a cost of each point without a problem of its own."""
    points, *rest = _point_sites(spark, d)
    alone = network.site_problems(points, *rest).filter("problem <> 'shared cell'")
    return rounded(network._nearest(points.join(alone, "site", "left_anti"), *rest))


@query
def merged_lines(spark, d):
    """Segments between the points of orders that aren't urgent, each to another order's, merged to lines: how many of how many parts, and their length."""
    orders = t.table(spark, d, "orders")
    far = orders.select("o_orderkey", "o_orderpriority", ((F.col("o_orderkey") * 7 + 3) % orders.count()).alias("to")).filter("o_orderpriority not like '1%'")
    point = lambda k: F.struct((k % 1000).cast("double").alias("x"), F.floor(k / 1000).cast("double").alias("y"))
    vertices = far.select(F.col("o_orderkey").alias("part"), F.posexplode(F.array(point(F.col("o_orderkey")), point(F.col("to")))).alias("k", "p")).select("part", "k", "p.x", "p.y")
    found = lines.lengths(lines.merged(vertices))
    return found.groupBy((F.col("vertices") - 1).alias("parts")).agg(F.count("*").alias("lines"), F.round(F.sum("length"), 4).alias("length"))


@query
def cost_grid_compare(spark, d):
    """The static costs against those with the discount first."""
    other = cost.Rules(**{**t.RULES.__dict__, "layers": sorted(t.RULES.layers, key=lambda x: (x.kind != "discount", x.name))})
    a = _present(spark, d).select("r", "c", cost.static_cost(t.RULES).alias("cost"))
    b = cost.present_layers(t.cells(spark, d), t.presence(spark, d), other).select("r", "c", cost.static_cost(other).alias("cost"))
    return rounded(checks.compare_grids(a, b))


@query
def route_set_check(spark, d):
    """Orders as routes from customers to nations: what is missing, repeated or reversed."""
    expected = t.table(spark, d, "customer").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") + F.col("c_nationkey") + 1).alias("to_id"))
    o = t.table(spark, d, "orders").join(t.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    far = F.col("c_custkey") + F.col("c_nationkey") + 1
    turned = F.col("o_orderpriority").startswith("1")
    routes = o.select(F.when(turned, far).otherwise(F.col("c_custkey")).alias("from_id"), F.when(turned, F.col("c_custkey")).otherwise(far).alias("to_id"))
    return checks.route_set(expected, routes)


@query
def scenario_multipliers(spark, d):
    """Total static cost under every layer weight of 0, 0.5, 1 and 1.5, one layer at a time."""
    present = _present(spark, d)
    total, sums = [], []
    for k, layer in enumerate(t.RULES.layers):
        for weight in (0.0, 0.5, 1.0, 1.5):
            layers = [cost.Layer(**{**x.__dict__, "weight": weight if i == k else x.weight}) for i, x in enumerate(t.RULES.layers)]
            value, name = cost.static_cost(cost.Rules(**{**t.RULES.__dict__, "layers": layers})), f"{k}_{int(2 * weight)}"
            sums += [F.count(value).alias(f"n{name}"), F.sum(value).alias(f"t{name}")]
            total.append(F.struct(F.lit(layer.name).alias("layer"), F.lit(weight).alias("weight"), F.col(f"n{name}").alias("cells"), F.col(f"t{name}").alias("total")))
    return rounded(present.agg(*sums).select(F.explode(F.array(*total)).alias("s")).select("s.*"), 3)


@query
def voltage_parse(spark, d):
    value = F.concat_ws(";", F.concat(F.col("p_size").cast("string"), F.lit(" kV")), F.concat(F.lit(" "), (F.col("p_size") * 700).cast("string")), F.when(F.col("p_size") % 3 == 0, "unknown"))
    return t.table(spark, d, "part").select("p_partkey", attributes.voltage_in_volts(value).alias("volts"))


@query
def tag_extract(spark, d):
    tags = F.regexp_replace(F.regexp_replace(F.regexp_replace("props", r"^\{|\}$", ""), r'": *"?', '"=>"'), r'"?(,|$)', '"$1')
    return t.table(spark, d, "events").select("event_id", attributes.tag_value(tags, "k").alias("k"))


@query
def tag_filters(spark, d):
    """Parts by a token among their values, by category in any case, and by patterns of their names."""
    values = F.concat_ws("; ", F.initcap("p_type"), F.when(F.col("p_size") % 2 == 0, F.concat(F.upper("p_brand"), F.lit(" , Gas"))))
    layer = predicates.category(F.concat(F.lit(" "), F.initcap("p_type")), {"general": ["standard", "medium"], "sale": ["Promo"]})
    found = t.table(spark, d, "part").select(layer.alias("layer"), predicates.has_token(values, "gas").alias("gas"), predicates.like_any(F.col("p_name"), ["red%", "%bolt"]).alias("named"), "p_retailprice")
    return found.groupBy("layer", "gas", "named").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query
def features_in_box(spark, d):
    """The customers' triangles whose extents meet a box."""
    extents = t.boxes(spark, d).groupBy("feature").agg(F.min(F.least("x1", "x2")).alias("a"), F.min(F.least("y1", "y2")).alias("b"), F.max(F.greatest("x1", "x2")).alias("e"), F.max(F.greatest("y1", "y2")).alias("f"))
    return extents.filter(predicates.meets_box(tuple(map(F.col, "abef")), (10.0, 12.0, 20.5, 18.25))).select("feature")


@query
def cost_colours(spark, d):
    """How many cells each colour has when the simple costs are stretched from their 2nd to their 98th percentile over three stops."""
    grid = t.simple_costs(spark, d).filter("cost is not null")
    low, high = scales.quantiles(grid, "cost", [0.02, 0.98])
    return grid.groupBy(display.ramp(F.round("cost", 6), F.lit(round(low, 6)), F.lit(round(high, 6)), ("#1a9850", "#ffffbf", "#d73027")).alias("colour")).agg(F.count("*").alias("n"))


@query
def zone_routing(spark, d):
    zone = F.element_at(F.array(*map(F.lit, ("S", "Ev", "Ei", "R", "N", "Ek", "X"))), (F.col("l_linenumber") - 1) % 7 + 1)
    found = t.table(spark, d, "lineitem").select(attributes.marine_layer(zone).alias("layer")).filter("layer is not null")
    return found.groupBy("layer").agg(F.count("*").alias("n"))


@query
def status_classify(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "Production").when(F.col("o_orderstatus") == "O", " Planned (approved)").otherwise("under Construction")
    found = t.table(spark, d, "orders").select(attributes.wind_farm_category(status).alias("category"), "o_totalprice")
    return found.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def id_exclude(spark, d):
    """Line items whose order is in no customer's list of excluded ids."""
    ids = F.concat(F.lit("way/"), (F.col("c_custkey") * 3).cast("string"), F.lit(","), (F.col("c_custkey") * 5).cast("string"))
    out = t.table(spark, d, "customer").select(F.explode(attributes.id_list(ids)).alias("id")).distinct()
    line = t.table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey").cast("string"))
    return line.join(out, "id", "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query
def dedup_first(spark, d):
    """The first event of each user and type by time and id."""
    first = F.min(F.struct("ts", "event_id", "value")).alias("f")
    return t.table(spark, d, "events").groupBy("user_id", "event_type").agg(first).select("user_id", "event_type", F.col("f.event_id").alias("event_id"), F.col("f.value").alias("value"))


@query
def points_along_line(spark, d):
    """Evenly spaced points on each order's line: one each half cell or less, the ends among them, and two at least."""
    return rounded(checks.points_along(t.lines(spark, d), 0.5))


@query
def line_offset_stats(spark, d):
    """How far each order's line runs from its customer's triangle."""
    points = checks.points_along(t.lines(spark, d), 0.5)
    owner = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("feature"), F.col("o_custkey").alias("other"))
    return rounded(checks.offsets(points.join(owner, "feature"), t.boxes(spark, d).withColumnRenamed("feature", "other"), {"within_1": 1.0, "within_5": 5.0}), 5)


@query
def quantile_scale_orders(spark, d):
    """Orders' prices on a scale of ten quantiles from 1 to 10."""
    orders = t.table(spark, d, "orders")
    scale = scales.quantile_scale(orders, "o_totalprice", 1, 10, 10, 1)
    return orders.crossJoin(F.broadcast(scale)).select("o_orderkey", F.round(scales.interpolate(F.col("o_totalprice"), F.col("xs"), F.col("ys")), 6).alias("score"))
