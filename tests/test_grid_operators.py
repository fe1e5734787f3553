"""Operators on small grids with known results."""

import heapq
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from costfield.functions import attributes, projection, scales
from costfield.operators import checks, cost, display, distance, network, paths, raster, routes
from costfield.sources import boundaries, config, sites
from costfield.sinks import writers


def grid(spark, rows, **columns):
    cells = [(r, c, *(columns[k][r][c] for k in columns)) for r in range(len(rows)) for c in range(len(rows[0]))]
    return spark.createDataFrame([(r, c, rows[r][c], *rest) for r, c, *rest in cells], ["r", "c", "v", *columns])


def test_formula_on_nine_cells(spark):
    """Base, a barrier, a highest-only group and a landfall cost; the landfall bit counts on land only."""
    cells = spark.createDataFrame([(r, c, "sea" if (r, c) == (2, 0) else "land", False) for r in range(3) for c in range(3)], "r int, c int, surface string, building boolean")
    presence = spark.createDataFrame([("forest", 1, 0), ("forest", 1, 1), ("nature", 1, 1), ("nature", 1, 2), ("barrier", 0, 1), ("landfall", 2, 2), ("landfall", 2, 0)], "layer string, r int, c int")
    rules = cost.Rules(layers=[cost.Layer("barrier", "barrier"), cost.Layer("forest", "group", 4, "green"), cost.Layer("nature", "group", 6, "green"), cost.Layer("landfall", "add", 3, surface="land")])
    cost.check_rules(rules)
    got = {(r, c): v for r, c, v in cost.present_layers(cells, presence, rules).select("r", "c", cost.static_cost(rules)).collect()}
    assert got[0, 1] is None
    assert (got[1, 0], got[1, 1], got[1, 2], got[2, 2], got[2, 0], got[0, 0]) == (5, 7, 7, 4, 2, 1)


@pytest.mark.parametrize(("order", "expected"), [(["discount", "add"], 8.0), (["add", "discount"], 7.0)])
def test_discounts_depend_on_the_order(spark, order, expected):
    layers = {"add": cost.Layer("beach", "add", 7), "discount": cost.Layer("cable", "discount", 1)}
    rules = cost.Rules(layers=[layers[k] for k in order])
    cells = spark.createDataFrame([(0, 0, "land", False)], "r int, c int, surface string, building boolean")
    presence = spark.createDataFrame([("beach", 0, 0), ("cable", 0, 0)], "layer string, r int, c int")
    assert cost.present_layers(cells, presence, rules).select(cost.static_cost(rules)).first()[0] == expected


def test_near_building_and_band(spark):
    cells = spark.createDataFrame([(0, c, "land", c == 0) for c in range(5)], "r int, c int, surface string, building boolean")
    near = {c: v for _, c, v in cost.near_buildings(cells, cost.Rules(layers=[], near=(6.0, 300.0))).filter("r = 0").collect()}
    assert near[1] == pytest.approx(4.0) and near[2] == pytest.approx(2.0) and 3 not in near
    rules = cost.Rules(layers=[cost.Layer("line", "add", 1)], band=("line", 50.0, 200.0, 0.8, 0.3))
    row = spark.createDataFrame([(0, c, "land", False) for c in range(6)], "r int, c int, surface string, building boolean")
    present = cost.present_layers(row, spark.createDataFrame([("line", 0, 2)], "layer string, r int, c int"), rules)
    band = {c for r, c in cost.parallel_band(present, rules).collect() if r == 0}
    assert {c for c in range(6) if c in band} == {0, 1, 3, 4}


def test_rules_are_checked():
    for layers in ([cost.Layer("a", "add", 1, bit=3)], [cost.Layer("a", "add", 11)], [cost.Layer("a", "group", 1, "g")], [cost.Layer("a", "add", 1, bit=2), cost.Layer("b", "add", 1, bit=2)]):
        with pytest.raises(ValueError, match="."):
            cost.check_rules(cost.Rules(layers=layers))


def test_landfall(spark):
    land = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "r int, c int")
    assert [tuple(x) for x in raster.landfall(land, spark.createDataFrame([(0, 3)], "r int, c int")).collect()] == [(0, 2)]
    one = spark.createDataFrame([(0, 0)], "r int, c int")
    diagonal = spark.createDataFrame([(1, 1)], "r int, c int")
    assert raster.landfall(one, diagonal).count() == 1 and raster.landfall(one, diagonal, 4).count() == 0


def test_focal_sum_over_stretches(spark):
    r = random.Random(1)
    cells = {(a, b): r.randint(0, 9) for a in range(3) for b in range(600) if r.random() < 0.9}
    got = {(a, b): v for a, b, v in raster.focal_sum(spark.createDataFrame([(*k, v) for k, v in cells.items()], "r int, c int, v int"), "v", 2).collect()}
    for (a, b) in cells:
        assert got[a, b] == sum(v for (x, y), v in cells.items() if abs(a - x) <= 2 and abs(b - y) <= 2 and (a - x) ** 2 + (b - y) ** 2 <= 4)


def test_population_risk_of_one_value_is_the_highest(spark):
    cells = spark.createDataFrame([(r, c, "land", False) for r in range(5) for c in range(5)], "r int, c int, surface string, building boolean")
    people = spark.createDataFrame([(2, 2, 60.0)], "r int, c int, people double")
    got = cost.risk_cost(cells, people, cost.Rules(layers=[], risk=(1000.0, 50.0, 5.0, 5))).collect()
    assert len(got) == 25 and {x.risk_cost for x in got} == {5.0}


def test_resample_integer_and_fractional(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 0.0)], "r int, c int, v double")
    assert [tuple(x) for x in raster.resample(cells, "v", 2).collect()] == [(0, 0, 0.5, 1.0, 1.0)]
    row = spark.createDataFrame([(0, c, float(c)) for c in range(5)], "r int, c int, v double")
    got = sorted(map(tuple, raster.resample(row, "v", 2.5).collect()))
    assert [round(x[2], 9) for x in got] == [0.8, 3.2]


def test_snapped_grid():
    assert raster.snapped(120, 100, 610, 700, 250) == {"x0": 0, "y0": 750, "size": 250, "width": 3, "height": 3}


def dijkstra(costs, start):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > best[r, c]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                to = (r + a, c + b)
                if (a or b) and costs.get(to):
                    new = d + (costs[r, c] + costs[to]) / 2 * math.hypot(a, b)
                    if new < best.get(to, math.inf):
                        best[to] = new
                        heapq.heappush(heap, (new, to))
    return best


@pytest.mark.parametrize("seed", [7, 8])
def test_accumulated_cost_over_tiles(spark, seed):
    r = random.Random(seed)
    costs = {(a, b): None if r.random() < 0.2 and (a, b) != (0, 0) else r.uniform(0.4, 12) for a in range(-3, 17) for b in range(22)}
    cells = spark.createDataFrame([(*k, v) for k, v in costs.items()], "r int, c int, cost double")
    got = {(a, b): v for _, a, b, v in paths.accumulate(cells, spark.createDataFrame([("x", 0, 0)], "site string, r int, c int"), tile=6).collect()}
    expected = dijkstra(costs, (0, 0))
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], rel=1e-9) for k in expected)


def test_a_search_stops_behind_its_targets(spark, monkeypatch):
    """Costs up to the dearest target, and a share more, are those of the whole search; tiles far beyond it are never searched."""
    r = random.Random(3)
    costs = {(a, b): r.uniform(1, 3) for a in range(12) for b in range(60) if r.random() < 0.9} | {(5, 5): 1.0, (5, 14): 1.0, (2, 9): 1.0, (5, 59): 1.0}
    cells = spark.createDataFrame([(*k, v) for k, v in costs.items()], "r int, c int, cost double")
    origins = spark.createDataFrame([(1, 5, 5), (2, 5, 5), (3, 5, 14), (4, 2, 9)], "site int, r int, c int")
    targets = spark.createDataFrame([(1, 5, 14), (1, 2, 9), (2, 5, 59), (3, 99, 99)], "site int, r int, c int")
    rounds, write = [], paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, tag: [x for x in [write(df, tag)] if tag != "searched" or not rounds.append(x.groupBy("site").agg(F.max("tc")).collect())][0])
    got = {}
    for x in paths.accumulate(cells, origins, tile=10, targets=targets, slack=0.1).collect():
        got.setdefault(x.site, {})[x.r, x.c] = x.acc
    furthest = max(tc for found in rounds for site, tc in found if site == 1)
    whole, other = dijkstra(costs, (5, 5)), dijkstra(costs, (5, 14))
    limit = {1: 1.1 * max(whole[5, 14], whole[2, 9]), 2: 1.1 * whole[5, 59], 3: math.inf}
    assert got.keys() == {1, 2, 3}
    for site, expected in ((1, whole), (2, whole), (3, other)):
        near = {k: v for k, v in expected.items() if v <= limit[site]}
        assert got[site].keys() == near.keys() and all(got[site][k] == pytest.approx(v) for k, v in near.items())
    assert len(got[1]) < len(whole) / 2 and furthest < 5


def test_routes_and_their_lengths(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, "land"), (0, 1, 1.0, "land"), (1, 0, 1.0, "land"), (1, 1, 1.0, "sea")], "r int, c int, cost double, surface string")
    acc = paths.accumulate(cells, spark.createDataFrame([(1, 0, 0)], "site int, r int, c int"))
    got = routes.route_sums(routes.route_vertices(cells, acc, spark.createDataFrame([(1, 2, 1, 1), (1, 3, 0, 0)], "site int, target int, r int, c int")), cells).collect()
    assert {x.target: (round(x.length, 3), round(x.sea, 3), x.hops) for x in got} == {2: (1.414, 1.414, 1), 3: (0.0, 0.0, 0)}


def test_snapping(spark):
    cells = spark.createDataFrame([(2, 3, 1.0)], "r int, c int, cost double")
    site = spark.createDataFrame([("s", 2, 2)], "site string, r int, c int")
    assert [tuple(x) for x in network.snap(site, cells, 1).collect()] == [("s", 2, 3, 1)]
    assert network.snap(spark.createDataFrame([("s", 2, 1)], "site string, r int, c int"), cells, 1).count() == 0


def test_spanning_network(spark):
    costs = spark.createDataFrame([("A", "B", "routed", 1.0), ("A", "C", "routed", 4.0), ("B", "C", "routed", 2.0), ("A", "D", "unreachable", None)], "from_id string, to_id string, status string, cost double")
    assert sorted((x.from_id, x.to_id) for x in network.spanning_network(costs).collect()) == [("A", "B"), ("B", "C")]
    r = random.Random(4)
    edges = [(i, j, "routed", float(r.randint(1, 5))) for i in range(12) for j in range(i + 1, 12)]
    parent, expected = list(range(12)), []
    for _, i, j in sorted((w, i, j) for i, j, _, w in edges):
        a, b = i, j
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        if a != b:
            parent[a] = b
            expected.append((i, j))
    got = network.spanning_network(spark.createDataFrame(edges, "from_id int, to_id int, status string, cost double"))
    assert sorted((x.from_id, x.to_id) for x in got.collect()) == sorted(expected)


def test_pairs(spark):
    nodes = spark.createDataFrame([(k, "node") for k in range(15)], "site int, role string")
    assert network.network_pairs(nodes).count() == 105


def test_route_set_and_comparison(spark):
    pairs = "from_id string, to_id string"
    expected = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], pairs)
    routes = spark.createDataFrame([("a", "x"), ("a", "x"), ("y", "a"), ("q", "x"), ("b", "x")], pairs)
    got = {tuple(x) for x in checks.route_set(expected, routes).collect()}
    assert got == {("missing", "a", "y"), ("missing", "b", "y"), ("duplicate", "a", "x"), ("reversed", "y", "a"), ("unexpected", "q", "x")}
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, None)], "r int, c int, cost double")
    b = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.02), (0, 2, 3.0)], "r int, c int, cost double")
    result = checks.compare_grids(a, b).first()
    assert (result.compared, result.mismatched) == (2, 1) and result.largest == pytest.approx(0.02 / 2.02)


def test_projection_round_trip(spark):
    r = random.Random(3)
    points = spark.createDataFrame([(r.uniform(3.5, 15.5), r.uniform(54.3, 58.2)) for _ in range(200)], "lon double, lat double")
    x, y = projection.to_utm32(F.col("lon"), F.col("lat"))
    tangent, lon = projection.conformal(F.col("x"), F.col("y"))
    back = points.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", tangent.alias("t"), lon.alias("lon2")).select("lon", "lat", "lon2", projection.latitude(F.col("t")).alias("lat2"))
    assert all(abs(p.lon - p.lon2) < 1e-9 and abs(p.lat - p.lat2) < 1e-9 for p in back.collect())
    at = spark.createDataFrame([(9.0, 0.0)], "lon double, lat double").select(*projection.to_utm32(F.col("lon"), F.col("lat"))).first()
    assert at[0] == pytest.approx(500000) and at[1] == pytest.approx(0, abs=1e-6)


def test_attributes(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]
    for text, volts in (("132000;400000", 400000), ("132 kV", 132000), ("400", 400), ("unknown", None), (None, None)):
        assert one(text, attributes.voltage_in_volts) == volts
    assert one('"power"=>"line","voltage"=>"400000","name"=>"A"', lambda c: attributes.tag_value(c, "voltage")) == "400000"
    assert [one(s, attributes.wind_farm_category) for s in ("Production/Approved", "Planned")] == ["barrier", "planned"]
    assert one("way/101,way/202", attributes.id_list) == ["101", "202"]
    for bad, f in (("lost", attributes.wind_farm_category), ("way/x", attributes.id_list), ("-1", attributes.optional_amount)):
        with pytest.raises(Exception, match="."):
            one(bad, f)


def test_quantile_scale_averages_equal_quantiles(spark):
    values = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,)], "v double")
    scale = scales.quantile_scale(values, "v", 0, 4, 4, 9).first()
    assert scale.xs == [1.0, 2.0, 5.0] and scale.ys == [1.0, 3.0, 4.0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,name,lon,lat,role,ton\na,A,9.5,56.1,source,3\nb,B,10,57,,\n", encoding="utf-8")
    assert [(x.id, x.role, x.ton) for x in sites.read_sites(spark, str(tmp_path / "a.csv"), ("ton",)).orderBy("id").collect()] == [("a", "source", 3.0), ("b", "node", None)]
    (tmp_path / "b.csv").write_text("navn;type;x;y\nNord;lager;9,92;57,05\nUd;kilde;99;57\n", encoding="utf-8")
    got = sites.read_sites_tolerantly(spark, str(tmp_path / "b.csv")).orderBy("row").collect()
    assert (got[0].role, got[0].lon, got[0].error) == ("storage", 9.92, None) and got[1].error
    (tmp_path / "c.poly").write_text("name\n1\n 0 0\n 4 0\n 4 4\n 0 4\nEND\n!2\n 1 1\n 2 1\n 2 2\n 1 2\nEND\nEND\n")
    areas = boundaries.ring_areas(boundaries.read_poly(spark, str(tmp_path / "c.poly"))).orderBy("ring").collect()
    assert [(x.hole, x.area) for x in areas if x.area] == [(False, 16.0), (True, 1.0)]
    (tmp_path / "base.yaml").write_text("costs: {a: 1, b: {x: 1, y: 2}}\nlist: {k: 1}\n")
    (tmp_path / "top.yaml").write_text("extends: base.yaml\nreplace_sections: [list]\ncosts: {b: {x: 5}}\nlist: {m: 2}\n")
    held = config.load(tmp_path / "top.yaml")
    assert held == {"costs": {"a": 1, "b": {"x": 5, "y": 2}}, "list": {"m": 2}}
    assert config.perturbed(held, ["a", "b.x", "z"], 4)[0]["costs"] == {"a": 4.0, "b": {"x": 15.0, "y": 2}}
    assert config.differences(held, config.perturbed(held, ["a"], 2)[0]) == [("costs.a", 1, 2.0)]
    surface = spark.createDataFrame([(0, 0, 1.5), (0, 1, None)], "r int, c int, cost double")
    assert writers.write_surface(surface, str(tmp_path / "out"), held)["traversable_cells"] == 1
    points = spark.createDataFrame([("a", [(1.0, 2.0), (3.0, 4.0)], 1)], "id string, _p array<struct<x:double,y:double>>, n int")
    assert writers.features(points, writers.line(F.col("_p"))).first()[0] == '{"type":"Feature","properties":{"id":"a","n":1},"geometry":{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}}'
    with pytest.raises(ValueError, match="nothing"):
        writers.write_features(points.limit(0), writers.line(F.col("_p")), str(tmp_path / "none"))


def test_bits_only_where_a_layer_holds(spark):
    """No bit on buildings, nor on the other surface; computed bits on cells that can be entered; deferred groups count their highest member."""
    cells = spark.createDataFrame([(0, 0, "land", False), (0, 1, "sea", False), (0, 2, "land", True), (0, 3, "land", False)], "r int, c int, surface string, building boolean")
    presence = spark.createDataFrame([("dune", 0, c) for c in range(4)] + [("crowd", 0, 3), ("misspelt", 0, 0)], "layer string, r int, c int")
    people = spark.createDataFrame([(0, 0, 5.0), (0, 3, 5.0)], "r int, c int, people double")
    layers = [cost.Layer("dune", "add", 1, surface="land", bit=1), cost.Layer("crowd", "group", 4, "people", bit=2), cost.Layer("cable", "add", 1, bit=4)]
    rules = cost.Rules(layers=layers, near=(6.0, 150.0), band=("cable", 100.0, 100.0, 0.5, 0.4), bits={"near": 8, "population": 16}, risk=(100.0, 0.0, 5.0, 4))
    got = {x.c: x for x in cost.cost_surface(cells, presence, people, rules).collect()}
    assert [got[c].class_bits for c in range(4)] == [1 | 16, 0, 0, 1 | 2 | 8 | 16]
    assert got[2].cost is None and got[1].cost == 2.0
    # Open land, dune and near building (at 100 of 150 m), then the highest of crowd, people and risk.
    assert got[3].cost == pytest.approx(1 + 1 + 6 * (1 - 100 / 150) + 5)
    assert got[0].cost == pytest.approx(1 + 1 + 5)
    assert {tuple(x) for x in cost.unknown_layers(presence, rules).collect()} == {("unknown", "misspelt"), ("missing", "cable")}
    for bad in (cost.Rules(layers=[], deferred={"a": ("risk",), "b": ("risk",)}), cost.Rules(layers=[], bits={"other": 1}), cost.Rules(layers=[], population=(3.0, 1.0, 4, 1.0))):
        with pytest.raises(ValueError, match="."):
            cost.check_rules(bad)


def test_tree_check_finds_cycles_and_parts(spark):
    nodes = spark.createDataFrame([(k,) for k in range(6)], "site int")
    of = lambda edges: tuple(checks.tree(spark.createDataFrame(edges, "from_id int, to_id int"), nodes).first())
    assert of([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]) == (5, 6, 1, 0, True)
    assert of([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5)]) == (5, 6, 2, 1, False)
    assert of([(0, 1), (1, 0), (2, 2)]) == (3, 6, 5, 2, False)


def test_quantiles_are_exact(spark):
    r = random.Random(6)
    values = [float(r.randint(0, 40)) if r.random() < 0.5 else r.random() * 40 for _ in range(999)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    expected = [float(x) for x in np.quantile(values, shares)]
    assert scales.quantiles(table, "v", shares) == pytest.approx(expected)
    assert scales.quantiles(table.limit(0), "v", shares) == []


def test_routes_have_kilometres_by_class(spark):
    cells = spark.createDataFrame([(0, c, 1.0, "land", 3 if c == 2 else 4 if c == 0 else 0) for c in range(4)], "r int, c int, cost double, surface string, class_bits long")
    acc = paths.accumulate(cells, spark.createDataFrame([(1, 0, 0)], "site int, r int, c int"), tile=2)
    got = routes.route_sums(routes.route_vertices(cells, acc, spark.createDataFrame([(1, 2, 0, 3)], "site int, target int, r int, c int")), cells, {"a": 1, "b": 6, "start": 4}).first()
    assert (got.length, got.a, got.b, got.start) == (3.0, 1.0, 1.0, 0.0)


def test_tags_with_escapes_and_units(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]
    name = lambda c: attributes.tag_value(c, "name")
    assert [one(v, name) for v in ('"name"=>"a \\"b\\" c","x"=>"1"', '"x"=>"1"', '"name"=>""', '"name"=>"cut', None)] == ['a "b" c', None, "", None, None]
    assert [one(v, attributes.voltage_in_volts) for v in ("10kv", "20 KV; 5", "1.5 kV,x", "12v", "kv", "")] == [10000, 20000, 1500, 12, None, None]
    assert config.perturbed({"costs": {"p": {"minimum": 4, "maximum": 5}}}, ["p.maximum"], 0.5)[0]["costs"]["p"] == {"minimum": 2.5, "maximum": 2.5}


def test_routes_over_many_tiles(spark):
    """Walked back tile by tile, each route's steps sum up to its cost, and ends on cells without cost have no route."""
    r = random.Random(11)
    costs = {(a, b): round(r.uniform(0.4, 12), 3) for a in range(17) for b in range(23) if r.random() < 0.85} | {(0, 0): 1.0, (16, 22): 1.0, (8, 4): 1.0}
    cells = spark.createDataFrame([(a, b, "sea" if b > 15 else "land", v) for (a, b), v in costs.items()], "r int, c int, surface string, cost double")
    acc = paths.accumulate(cells, spark.createDataFrame([(1, 0, 0), (2, 8, 4)], "site int, r int, c int"), tile=5)
    ends = [(1, 7, 16, 22), (2, 7, 16, 22), (1, 8, 8, 4), (2, 9, 8, 4), (1, 10, 99, 99)]
    found = routes.route_vertices(cells, acc, spark.createDataFrame(ends, "site int, target int, r int, c int"), tile=5)
    least = {(x.site, x.r, x.c): x.acc for x in acc.collect()}
    by_route = {}
    for x in found.orderBy("site", "target", "k").collect():
        by_route.setdefault((x.site, x.target), []).append((x.k, x.r, x.c, x.length))
    assert by_route.keys() == {(1, 7), (2, 7), (1, 8), (2, 9)}
    for (site, target), steps in by_route.items():
        assert [k for k, *_ in steps] == list(range(len(steps))) and steps[0][3] == 0
        total = sum((costs[a[1:3]] + costs[b[1:3]]) / 2 * b[3] for a, b in zip(steps, steps[1:], strict=False))
        assert all(b[3] == pytest.approx(math.hypot(b[1] - a[1], b[2] - a[2])) for a, b in zip(steps, steps[1:], strict=False))
        assert total == pytest.approx(least[site, *steps[-1][1:3]]) and (site, target, *steps[-1][1:3]) in ends
    blocked = cells.withColumn("cost", F.when((F.col("r") != 8) | (F.col("c") != 4), F.col("cost")))
    assert {(x.site, x.target, x.blocked) for x in routes.on_barriers(found, blocked).collect()} >= {(2, 9, 1), (2, 7, 1), (1, 8, 1)}
    points = routes.route_lines(found, {"x0": 500000.0, "y0": 6200800.0, "size": 100.0}).filter("site = 1 and target = 7").first().points
    assert len(points) == len(by_route[1, 7]) and points[0].x == pytest.approx(9.0008, abs=1e-4) and 55 < points[0].y < 56
    feature = writers.features(spark.createDataFrame([(1, points)], "id int, _points array<struct<x: double, y: double>>"), writers.line(F.col("_points"))).first().value
    assert f"[{points[0].x},{points[0].y}]" in feature and '"LineString"' in feature and "_points" not in feature


def test_holes_count_beside_one_outer_ring(spark, tmp_path):
    square = "{}\n 0 0\n 1 0\n 1 1\nEND\n"
    (tmp_path / "one.poly").write_text("a\n" + square.format("1") + square.format("!2") + "END\n")
    (tmp_path / "two.poly").write_text("b\n" + square.format("1") + square.format("!2") + square.format("3") + "END\n")
    kept = lambda name: sorted(r.hole for r in boundaries.boundary_rings(boundaries.read_poly(spark, str(tmp_path / name))).select("ring", "hole").distinct().collect())
    assert kept("one.poly") == [False, True] and kept("two.poly") == [False, False]
    (tmp_path / "none.poly").write_text("c\n" + square.format("!1") + "END\n")
    with pytest.raises(Exception, match="no boundary"):
        kept("none.poly")


def test_written_sites_are_read_again(spark, tmp_path):
    rows = [("a", 'The "old" well, north', "source", 9.5, 56.0, True), ("b", "Æ; ø", "storage", 10.25, 55.5, False)]
    writers.write_csv(spark.createDataFrame(rows, "id string, name string, role string, lon double, lat double, enabled boolean"), str(tmp_path / "sites"))
    for got in (sites.read_sites(spark, str(tmp_path / "sites")), sites.read_sites_tolerantly(spark, str(tmp_path / "sites"))):
        assert sorted(map(tuple, got.select("id", "name", "role", "lon", "lat").collect())) == [r[:5] for r in rows]


def test_surfaces_are_stale_after_changes(spark, tmp_path):
    source, out = tmp_path / "in.txt", str(tmp_path / "out")
    source.write_text("x")
    os.utime(source, (1, 1))
    writers.write_surface(spark.createDataFrame([(0, 0, 1.5)], "r int, c int, cost double"), out, {"a": 1})
    assert writers.stale(spark, [out], [str(source)], {"a": 1}) == []
    os.utime(source, (4e9, 4e9))
    assert writers.stale(spark, [out], [str(source)], {"a": 2}) == [f"{source} is newer than the surfaces", f"{out} was made with another configuration"]


CELLS = "r int, c int, surface string, building boolean"


def surface_inputs(spark):
    """Nine cells: a building at (0, 0), a barrier at (0, 1), sea in the last column; people everywhere on land."""
    cells = spark.createDataFrame([(r, c, "sea" if c == 2 else "land", (r, c) == (0, 0)) for r in range(3) for c in range(3)], CELLS)
    where = {"wall": [(0, 1)], "forest": [(0, 1), (1, 0), (1, 1)], "nature": [(1, 1), (1, 2)], "cable": [(0, 1), (2, 0), (2, 1)], "beach": [(0, 1), (2, 1)], "dune": [(2, 1), (2, 0)], "town": [(2, 2), (1, 1)]}
    presence = spark.createDataFrame([(k, *x) for k, v in where.items() for x in v], "layer string, r int, c int")
    people = spark.createDataFrame([(r, c, 5.0) for r in range(3) for c in range(2)], "r int, c int, people double")
    layers = [cost.Layer("wall", "barrier"), cost.Layer("forest", "group", 4, "green"), cost.Layer("nature", "group", 6, "green"), cost.Layer("cable", "discount", 3), cost.Layer("beach", "add", 2, key="sand"), cost.Layer("dune", "add", 5, key="sand"), cost.Layer("town", "group", 2.5, "living")]
    return cells, presence, people, cost.Rules(layers=layers, near=(0.5, 150.0), population=(1.0, 3.0, 2, 1.0), risk=(100.0, 1e6, 5.0, 2), deferred={"living": ("population", "risk")})


def test_statistics_tell_what_each_class_added(spark):
    cells, presence, people, rules = surface_inputs(spark)
    got = {x.label: (x.rule, x.score, x.cells, x.applied_cells, None if x.total is None else round(x.total, 6)) for x in cost.class_statistics(cells, presence, people, rules).collect()}
    near = 0.5 * (1 - 100 / 150) + 0.5 * (1 - math.sqrt(2) * 100 / 150)  # below and across; the barrier has none
    assert got.pop("near") == ("distance", None, 2, 2, round(near, 6))
    assert got == {
        "open_land": ("", 1.0, 5, 4, 5.0), "open_sea": ("", 2.0, 3, 3, 6.0), "wall": ("barrier", None, 1, 0, None), "building": ("barrier", None, 1, 0, None),
        "green": ("max(forest, nature)", None, 4, 3, 4.0 + 6 + 6),
        "cable": ("discount", 3.0, 3, 2, 0.0),  # both cells cost as little as open land
        "sand": ("", 5.0, 3, 2, 15.0),  # cells times score, on the barrier too
        "living": ("max(population, risk, town)", None, 6, 5, 2.5 + 2.5 + 1.0 * 3),
    }
    after = {(x.r, x.c): x.cost for x in cost.cost_surface(cells, presence, people, rules, check=True).collect()}
    assert after[0, 0] is None and after[0, 1] is None and after[2, 1] == 1 + 5 + 1 and after[2, 2] == 2 + 2.5
    steps = [(x.label, round(x.value, 6)) for x in cost.explain(cells, presence, people, rules).filter("r = 1 and c = 1").orderBy("step").collect()]
    assert steps == [("base", 1.0), ("green", 6.0), ("near", round(0.5 * (1 - math.sqrt(2) / 1.5), 6)), ("living", 2.5)]
    blocked = {(x.r, x.c): x.label for x in cost.explain(cells, presence, people, rules).filter("step = -1").collect()}
    assert blocked == {(0, 0): "building", (0, 1): "wall"}


def test_a_barrier_in_a_band_stays_one(spark):
    cells, presence, people, rules = surface_inputs(spark)
    rules.band = ("nature", 100.0, 200.0, 0.5, 0.25)
    got = {(x.r, x.c): x for x in cost.cost_surface(cells, presence, people, rules).collect()}
    assert got[0, 1].cost is None and got[0, 1].band_cost is None
    assert got[2, 2].band_cost == 1.0 and got[2, 0].band_cost == pytest.approx(0.5 * (1 + 5))


def test_treatments_of_a_scenario(spark):
    cells, presence, people, rules = surface_inputs(spark)
    other = cost.treated(rules, {"wall": ("cost", 3.0), "forest": ("barrier", 0.0), "dune": ("ignore", 0.0)}, {"living": "sum"})
    got = {(x.r, x.c): x.cost for x in cost.cost_surface(cells, presence, people, other).collect()}
    assert got[1, 0] is None and got[1, 1] is None and got[0, 1] is None  # the forest stands there too
    assert got[2, 1] == 1 + 2 + 1
    with pytest.raises(ValueError, match="unknown layers"):
        cost.treated(rules, {"walll": ("ignore", 0.0)})


def test_what_a_surface_needs(spark):
    cells, presence, people, rules = surface_inputs(spark)
    with pytest.raises(ValueError, match="town"):
        cost.cost_surface(cells, presence.filter("layer <> 'town'"), people, rules, check=True)
    with pytest.raises(ValueError, match="buildings"):
        cost.check_inputs(cells.withColumn("building", F.lit(False)), presence, people, rules)
    with pytest.raises(ValueError, match="inhabited"):
        cost.check_inputs(cells, presence, people.limit(0), rules)
    rules.layers[-1].optional = True
    cost.check_inputs(cells, presence.filter("layer <> 'town'"), people, rules)
    with pytest.raises(ValueError, match="differ"):
        cost.check_rules(cost.Rules(layers=[cost.Layer("a", "add", 1, key="k"), cost.Layer("b", "discount", 1, key="k")]))


@pytest.mark.parametrize("seed", range(3))
def test_distances_at_any_range(spark, monkeypatch, seed):
    monkeypatch.setattr(distance, "STRIP", 7)
    r = random.Random(seed)
    cells = [(a, b) for a in range(-9, 23) for b in range(-5, 31) if r.random() < 0.8]
    targets = r.sample(cells, 3 + 20 * seed) + [(40, 2), (40, 2), (-12, 60)]
    got = {(x.r, x.c): x.d2 for x in distance.distance_transform(spark.createDataFrame(cells, "r int, c int"), spark.createDataFrame(targets, "r int, c int")).collect()}
    assert got == {(a, b): min((a - x) ** 2 + (b - y) ** 2 for x, y in targets) for a, b in cells}
    none = spark.createDataFrame([], "r int, c int")
    assert distance.distance_transform(spark.createDataFrame(cells, "r int, c int"), none).isEmpty() and distance.distance_transform(none, none).isEmpty()


def test_sites_that_cannot_be_placed(spark):
    cells = spark.createDataFrame([(r, c, 1.0 if (r, c) in ((2, 3), (0, 0)) else None) for r in range(5) for c in range(5)], "r int, c int, cost double")
    area = {"x0": 0.0, "y0": 500.0, "size": 100.0, "width": 5, "height": 5}
    sites = lambda *rows: spark.createDataFrame(rows, "site int, x double, y double")
    got = network.place_sites(sites((1, 220.0, 250.0)), cells, area, 150.0).first()
    assert (got.r, got.c, round(got.metres, 6)) == (2, 3, 130.0)
    with pytest.raises(ValueError, match="too far"):
        network.place_sites(sites((1, 220.0, 250.0)), cells, area, 50.0)
    with pytest.raises(ValueError, match="outside"):
        network.place_sites(sites((1, 220.0, 250.0), (2, 501.0, 10.0), (3, None, 1.0)), cells, area, 150.0)
    assert network.place_sites(sites((1, 220.0, 250.0), (2, 501.0, 10.0)), cells, area, 150.0, within=True).count() == 1
    problems = network.site_problems(sites((1, 330.0, 250.0), (2, 350.0, 240.0), (3, 10.0, 490.0)), cells, area, 150.0)
    assert sorted(map(tuple, problems.collect())) == [(1, "shared cell"), (2, "shared cell")]


def test_faults_and_comparisons_of_routes(spark):
    kind = "from_id string, to_id string, cost double, length_km double, km_land double"
    routes_ = spark.createDataFrame([("a", "x", 5.0, 10.0, 10.4), ("a", "y", float("inf"), 10.0, 12.0), ("b", "x", None, 3.0, -1.0), ("b", "y", 0.0, None, 0.2)], kind)
    assert sorted(map(tuple, checks.route_faults(routes_, ["km_land"]).collect())) == [("cost", "a", "y"), ("cost", "b", "x"), ("cost", "b", "y"), ("km_land", "a", "y"), ("km_land", "b", "x")]
    of = lambda *rows: spark.createDataFrame(rows, "from_id string, to_id string, cost double")
    base = of(("a", "x", 100.0), ("a", "y", 200.0))
    assert checks.compare_routes(base, of(("a", "x", 100.1), ("a", "y", 199.8)), 0.005).first().passed
    assert not checks.compare_routes(base, of(("a", "x", 101.0), ("a", "y", 200.0)), 0.005).first().passed
    assert checks.compare_routes(base, of(("a", "x", -1.0), ("b", "y", 200.0)), 0.005).first()[:4] == (1, 1, 1, 1)
    points = spark.createDataFrame([(1, 2, 0, 0.5, 0.0), (1, 2, 1, 3.0, 0.0)], "feature int, other int, k int, x double, y double")
    spot = spark.createDataFrame([(2, 0.0, 0.0, 0.0, 0.0)], "other int, x1 double, y1 double, x2 double, y2 double")
    assert checks.offsets(points, spot, {"near": 1.0}).first()[1:] == (1.75, 1.75, pytest.approx(2.75), 3.0, 0.5)


def test_display_grid_and_pyramid(spark):
    """Every display cell shows the cell under its centre; means of levels stand for the first one; colours run over three stops."""
    cells = spark.createDataFrame([(r, c, None if (r, c) == (3, 3) else float(10 * r + c)) for r in range(12) for c in range(9)], "r int, c int, cost double")
    placed = {"x0": 500000.0, "y0": 6201200.0, "size": 100.0}
    shown = display.warped(cells, placed, 40.0).withColumnsRenamed({"i": "row", "j": "column"})
    lon, lat = display.from_mercator((F.col("column") + 0.5) * 40, -(F.col("row") + 0.5) * 40)
    x, y = projection.to_utm32(F.col("lon"), F.col("lat"))
    back = shown.withColumn("lon", lon).withColumn("lat", lat).withColumn("x", x).withColumn("y", y).collect()
    assert all(v.value == 10 * math.floor((6201200 - v.y) / 100) + math.floor((v.x - 500000) / 100) for v in back)
    assert {v.value for v in back} == {float(10 * r + c) for r in range(12) for c in range(9)} - {33.0}
    near = [v for v in back if v.value == 0.0]
    assert 15 <= len(near) <= 25  # a cell of 100 m is 178 m wide on the map here
    assert display.warped(cells.filter("cost < 0"), placed, 40.0).isEmpty()
    dots = spark.createDataFrame([(-3, 0, 1.0), (-4, 1, 3.0), (5, 5, 7.0)], "i long, j long, value double")
    levels = {(v.level, v.i, v.j): (v.value, v.n) for v in display.pyramid(dots, 3).collect()}
    assert levels[1, -2, 0] == (2.0, 2) and levels[1, 2, 2] == (7.0, 1) and levels[3, -1, 0] == (2.0, 2) and levels[3, 0, 0] == (7.0, 1)
    sheet = {(v.level, v.tile_r, v.tile_c): [tuple(p) for p in v.pixels] for v in display.tiles(display.pyramid(dots, 0), 4).collect()}
    assert sheet == {(0, -1, 0): [(1, 3.0), (4, 1.0)], (0, 1, 1): [(5, 7.0)]}
    colours = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (99.0,)], "v double").select(display.ramp(F.col("v"), F.lit(0.0), F.lit(10.0), ("#000000", "#ff8000", "#ffffff"))).collect()
    assert [x[0] for x in colours] == ["#000000", "#ff8000", "#ffffff", "#ffffff"]


def test_search_sends_no_tiles_to_the_driver(spark):
    # 12 tiles in a row: more rounds than are put together at once, and again; no round's plan holds a broadcast of tiles.
    cells = spark.range(12 * 4).selectExpr("cast(id as int) r", "0 c", "1.0 cost")
    plans, write = [], paths.materialise

    def noted(df, tag):
        if tag == "searched":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(paths, "materialise", noted)
        patch.setattr(paths, "TABLES", 3)
        acc = paths.accumulate(cells, spark.createDataFrame([(1, 0, 0), (2, 20, 0)], "site int, r int, c int"), tile=4).collect()
    assert {(x.site, x.r): x.acc for x in acc} == {(s, r): abs(r - at) for s, at in ((1, 0), (2, 20)) for r in range(48)}
    assert len(plans) >= 12 and not any("Broadcast" in x for x in plans)


def test_pairs_costs_and_searches_broadcast_nothing(spark):
    # With targets, rounds meet these and their bounds by merging; so do the reached cells and the pairs' ends.
    cells = spark.range(12 * 4).selectExpr("explode(array('x', 'y')) key", "cast(id as int) r", "0 c", "1.0 cost")
    origins = spark.createDataFrame([("x", 1, 0, 0), ("y", 1, 20, 0)], "key string, site int, r int, c int")
    targets = spark.createDataFrame([("x", 1, 15, 0), ("y", 1, 40, 0)], "key string, site int, r int, c int")
    plans, write = {}, paths.materialise

    def noted(df, tag):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(paths, "materialise", noted)
        acc = paths.accumulate(cells, origins, tile=4, keys=("key",), targets=targets)
        got = {(x.key, x.r): x.acc for x in acc.collect()}
    assert got == {("x", r): r for r in range(16)} | {("y", r): abs(r - 20) for r in range(41)}
    assert len(plans["searched"]) > 4 and not any("Broadcast" in x for tag in ("searched", "seeds", "settled") for x in plans[tag])
    placed = spark.createDataFrame([(1, 0, 0), (2, 15, 0)], "site int, r int, c int")
    costs = network.pair_costs(acc.filter("key = 'x'").drop("key"), spark.createDataFrame([(1, 2)], "from_id int, to_id int"), placed)
    assert costs.collect() == [(1, 2, "routed", 15.0)]
    cut = network.corridors(acc.filter("key = 'x'").drop("key"), costs, [0.1])
    line = routes.route_sums(acc.select("site", F.lit(2).alias("target"), F.col("r").alias("k"), "r", "c", F.lit(1.0).alias("length")), cells.selectExpr("r", "c", "'sea' surface"))
    for found, few in ((costs, 2), (cut, 2 * 2 + 2), (line, 0)):  # the placed sites and the pairs are few, and joined by one number
        assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") and found._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= few


def test_tiles_are_made_around_the_ends_alone(spark):
    # A long grid: the search for a near target makes few tiles of it, one around a wall makes more, and all tiles if nothing leads there.
    cells = spark.range(40 * 4).selectExpr("cast(id as int) r", "explode(array(0, 1)) c", "cast(1 as double) cost").filter("not (r = 82 and c = 0)")
    made, write = [], paths.materialise

    def noted(df, tag):
        out = write(df, tag)
        if tag == "tiles":
            made.append(out.count())
        return out

    def costs(target, blocked=()):
        held = cells.filter(~F.col("r").isin(*blocked)) if blocked else cells
        made.clear()
        wanted = spark.createDataFrame([(1, target, 0)], "site int, r int, c int")
        return {(x.r, x.c): x.acc for x in paths.accumulate(held, spark.createDataFrame([(1, 80, 0)], "site int, r int, c int"), tile=4, targets=wanted).collect()}

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(paths, "materialise", noted)
        assert costs(84)[84, 0] == 2 + 2 * math.sqrt(2) and len(made) == 1 and made[0] <= 8
        reached = costs(84, blocked=(90, 83))
        assert (84, 0) not in reached and reached[0, 0] == 80 and len(made) > 2 and made[-1] >= 20
