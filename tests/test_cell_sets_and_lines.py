"""Runs, rings and lines against brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from costfield.operators import cell_sets, lines, rings
from costfield.sinks import writers

SEED = range(3)


def cells_frame(spark, cells):
    return spark.createDataFrame(sorted(cells), "r int, c int") if cells else spark.createDataFrame([], "r int, c int")


def blob(seed, share=0.6, size=14):
    r = random.Random(seed)
    return {(a, b) for a in range(-3, size) for b in range(-5, size) if r.random() < share}


@pytest.mark.parametrize("seed", SEED)
def test_set_algebra_of_runs(spark, seed):
    a, b = blob(seed), blob(seed + 50, 0.4)
    left, right = cell_sets.runs_of(cells_frame(spark, a)), cell_sets.runs_of(cells_frame(spark, b))
    overlapping = left.union(left.selectExpr("r", "first", "first as last"))
    for how, want in (("union", a | b), ("intersection", a & b), ("difference", a - b), ("either", a ^ b)):
        runs = sorted(map(tuple, cell_sets.combine(overlapping, right, how).collect()))
        assert [(r, c) for r, x, y in runs for c in range(x, y + 1)] == sorted(want)
        assert all(x[0] != y[0] or x[2] + 1 < y[1] for x, y in zip(runs, runs[1:], strict=False))  # as long as can be
    assert {(x.surface, x.r, x.c) for x in cell_sets.cells_of(cell_sets.surfaces(left, right), ("surface",)).collect()} == {("land" if k in b else "sea", *k) for k in a}
    assert cell_sets.area(left, 100.0).first().km2 == pytest.approx(len(a) * 0.01)
    assert cell_sets.runs_of(cells_frame(spark, set())).isEmpty()


def traced(found):
    out = {}
    for x in found:
        out.setdefault((x.g, x.ring), {})[x.k] = (x.x, x.y)
    return {key: [held[k] for k in range(len(held))] for key, held in out.items()}


def shoelace(points):
    return sum(x * b - a * y for (x, y), (a, b) in zip(points, points[1:] + points[:1], strict=True)) / 2


@pytest.mark.parametrize("seed", SEED)
def test_rings_enclose_their_cells(spark, seed):
    sets = {"a": blob(seed), "b": blob(seed + 9, 0.85), None: {(0, 0), (1, 1), (1, 2)}}
    rows = [(g, *k) for g, held in sets.items() for k in held]
    frame = spark.createDataFrame(rows + rows[:5] + [("b", None, 1)], "g string, r int, c int").repartition(4)
    found = rings.boundary_rings(frame, ("g",))
    loops = traced(found.collect())
    for (_, _), points in loops.items():
        assert all((x == a) != (y == b) for (x, y), (a, b) in zip(points, points[1:] + points[:1], strict=True))
        turns = [p for p, (x, y), (a, b) in zip(points[1:] + points[:1], points, points[2:] + points[:2], strict=True) if x != a and y != b]
        assert len(turns) == len(points)  # every point is a corner
    for g, held in sets.items():
        own = [p for (k, _), p in loops.items() if k == g]
        assert sum(map(shoelace, own)) == len(held)
        for a, b in [(a, b) for a in range(-5, 16) for b in range(-7, 16)]:
            crossed = sum(x == u and min(y, v) < a + 0.5 < max(y, v) and x > b + 0.5 for p in own for (x, y), (u, v) in zip(p, p[1:] + p[:1], strict=True))
            assert crossed % 2 == ((a, b) in held)
    areas = {(x.g, x.ring): x.area for x in rings.ring_areas(found, ("g",)).collect()}
    assert areas == {key: shoelace(p) for key, p in loops.items()}
    assert len([a for (g, _), a in areas.items() if g is None]) == 2  # cells that touch at a corner are apart
    kept = {(x.g, x.ring) for x in rings.without_small_holes(found, 2, ("g",)).collect()}
    assert kept == {key for key, a in areas.items() if a > 0 or a <= -2}


def test_small_holes_go(spark):
    """A square of 10 km with holes of 0.25 and 16 km2 keeps the large one: 84 km2."""
    cells = {(a, b) for a in range(20) for b in range(20)} - {(2, 2)} - {(a, b) for a in range(8, 16) for b in range(8, 16)}
    found = rings.without_small_holes(rings.boundary_rings(cells_frame(spark, cells)), 1 / 0.25)
    areas = sorted(x.area * 0.25 for x in rings.ring_areas(found).collect())
    assert areas == [-16.0, 100.0] and sum(areas) == 84.0
    assert rings.boundary_rings(cells_frame(spark, set())).isEmpty()


def recursive(points, tolerance):
    (ax, ay), (bx, by) = points[0], points[-1]
    square = (bx - ax) ** 2 + (by - ay) ** 2
    far = (-1.0, 0)
    for k, (x, y) in enumerate(points[1:-1], 1):
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0.0
        d = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
        if d > far[0]:
            far = (d, k)
    if far[0] <= tolerance:
        return [points[0], points[-1]]
    return recursive(points[: far[1] + 1], tolerance)[:-1] + recursive(points[far[1] :], tolerance)


def test_simplification(spark):
    r = random.Random(3)
    walks = {1: [(0.0, 0.0)], 2: [(1.0, 1.0), (2.0, 5.0)], 3: [(0.0, 0.0), (9.0, 9.0), (0.0, 0.0)], 4: [(float(k), 0.0) for k in range(50)]}
    for key in (5, 6):
        at = [(0.0, 0.0)]
        for _ in range(3000):
            at.append((round(at[-1][0] + r.uniform(-1, 2), 3), round(at[-1][1] + r.uniform(-2, 2), 3)))
        walks[key] = at
    rows = [(key, k, *p) for key, points in walks.items() for k, p in enumerate(points)]
    got = {}
    for x in lines.simplified(spark.createDataFrame(rows, "line int, k long, x double, y double").repartition(3), 4.0).collect():
        got.setdefault(x.line, []).append((x.k, x.x, x.y))
    assert {key: [p[1:] for p in sorted(v)] for key, v in got.items()} == {key: recursive(p, 4.0) if len(p) > 1 else p for key, p in walks.items()}
    measured = {x.line: (x.vertices, x.length) for x in lines.lengths(spark.createDataFrame(rows, "line int, k long, x double, y double")).collect()}
    assert measured[4] == (50, 49.0) and measured[1] == (1, 0.0)


def test_parts_are_merged_to_lines(spark):
    """Chains in any direction, a closed one, a fork, a part that closes on itself, and parts alone."""
    r = random.Random(5)
    lines_of = [[(float(k), float(10 * n)) for k in range(size)] for n, size in enumerate((40, 7, 2))]
    ring = [(100 + 5 * math.cos(k), 5 * math.sin(k)) for k in range(12)]
    pieces = [list(points[a : a + 2]) for points in lines_of for a in range(len(points) - 1)]
    pieces += [[ring[k], ring[(k + 1) % 12]] for k in range(12)]
    fork = [[(200.0, 0.0), (201.0, 0.0)], [(201.0, 0.0), (202.0, 1.0)], [(201.0, 0.0), (202.0, -1.0)]]
    loop, alone = [[(300.0, 0.0), (301.0, 1.0), (302.0, 0.0), (300.0, 0.0)]], [[(400.0, 0.0), (401.0, 3.0), (402.0, 0.0)]]
    pieces = [p[::-1] if r.random() < 0.5 else p for p in pieces] + fork + loop + alone
    r.shuffle(pieces)
    rows = [(part, k, *p) for part, points in enumerate(pieces) for k, p in enumerate(points)]
    got = {}
    for x in lines.merged(spark.createDataFrame(rows, "part long, k long, x double, y double").repartition(3)).collect():
        got.setdefault(x.line, {})[x.k] = (x.x, x.y)
    found = [[held[k] for k in range(len(held))] for held in got.values()]
    same = lambda a, b: a in (b, b[::-1])
    for want in [*lines_of, *fork, *loop, *alone]:
        assert sum(same(points, list(want)) for points in found) == 1
    closed = [points for points in found if len(points) == 13]
    assert len(found) == len(lines_of) + len(fork) + 3 and len(closed) == 1
    assert closed[0][0] == closed[0][-1] and {frozenset(e) for e in zip(closed[0], closed[0][1:], strict=False)} == {frozenset((ring[k], ring[k - 1])) for k in range(12)}
    far = lines.farthest_ends(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 5.0, 5.0), (2, 0, 9.0, 0.0), (2, 1, 1.0, 1.0)], "line int, k int, x double, y double")).first()
    assert tuple(far) == (0.0, 0.0, 9.0, 0.0)


def test_holes_lie_in_their_shells(spark, tmp_path):
    """Nested pieces: a frame, an island in its hole, the island's own hole, and a piece beside."""
    frame = {(a, b) for a in range(12) for b in range(12)} - {(a, b) for a in range(2, 10) for b in range(2, 10)}
    island = {(a, b) for a in range(4, 8) for b in range(4, 8)} - {(5, 5), (6, 6)}
    sets = {"x": frame | island | {(0, 20)}, None: {(a, b + 40) for a, b in frame}}
    cells = spark.createDataFrame([(g, *k) for g, held in sets.items() for k in held], "g string, r int, c int")
    found = rings.boundary_rings(cells, ("g",))
    placed = rings.shells_of(found, cells, ("g",)).collect()
    inside = {}
    for x in placed:
        inside.setdefault((x.g, x.shell), []).append(x.area)
    assert sorted((g is None, sorted(v)) for (g, _), v in inside.items()) == [(False, [-64.0, 144.0]), (False, [-2.0, 16.0]), (False, [1.0]), (True, [-64.0, 144.0])]
    nested = {x.g: x.polygons for x in rings.polygons(found, cells, ("g",)).collect()}
    assert sorted(len(p) for p in nested["x"]) == [1, 2, 2] and [len(p) for p in nested[None]] == [2]
    for polygon in nested["x"] + nested[None]:
        assert all(line[0] == line[-1] for line in polygon)
        sizes = [shoelace([tuple(p) for p in line[:-1]]) for line in polygon]
        assert sizes[0] > 0 and all(s < 0 for s in sizes[1:])
    plain = rings.boundary_rings(cells.filter("g is null").select("r", "c"))
    assert sorted(x.area for x in rings.shells_of(plain, cells.filter("g is null").select("r", "c")).collect()) == [-64.0, 144.0]
    feature = writers.features(rings.polygons(found, cells, ("g",)).withColumnRenamed("polygons", "_polygons"), writers.areas(F.col("_polygons"))).collect()
    read = [json.loads(x.value) for x in feature]
    assert {f["geometry"]["type"] for f in read} == {"MultiPolygon"} and sum(len(f["geometry"]["coordinates"]) for f in read) == 4
    with pytest.raises(ValueError, match="nothing to write"):
        writers.write_csv(cells.limit(0), str(tmp_path / "none"))
    writers.write_csv(cells.groupBy("g").count(), str(tmp_path / "counts"))
    writers.write_layers(cells.selectExpr("coalesce(g, 'none') as layer", "r", "c"), str(tmp_path / "layers"))
    assert spark.read.csv(str(tmp_path / "counts"), header=True).count() == 2 and spark.read.parquet(str(tmp_path / "layers")).filter("layer = 'none'").count() == 80


def test_equal_distances_stay_equal(spark):
    # Both points lie 91.8 from the stretch, one on each side; ``hypot`` gave the second a last bit more, so that it was split there.
    points = spark.createDataFrame([(20.0, 159.92), (30.0, -56.61)], "x double, y double").selectExpr("*", "10D ax", "33D ay", "40D bx", "70.31D by")
    first, second = (r.d for r in points.orderBy("x").select(lines._apart().alias("d")).collect())
    assert first == second


def test_ends_of_ways_do_not_meet_in_one_task(spark):
    # Ids that stand at their end have the null of ``to`` in common: a round lets them pass beside its join.
    plans, write = [], lines.materialise

    def noted(df, tag):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, tag)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lines, "materialise", noted)
        links = spark.createDataFrame([(k, k + 1 if k < 9 else None) for k in range(10)] + [(20, None)], "id long, to long")
        got = {x.id: (x.left, x.end) for x in lines._followed(links).collect()}
    assert got == {k: (9 - k, 9) for k in range(10)} | {20: (0, 20)}
    assert len(plans) > 2 and all("isnull(to" in x and "Union" in x for x in plans[1:])
