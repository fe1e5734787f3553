"""SQL for the queries, written for themselves: closed forms and brute force where the queries use windows, sweeps or rounds."""

from __future__ import annotations

from math import pi

from costfield.plans.driver_tables import RULES

# Fixed values, written out apart from the library's: GRS80 in UTM zone 32N, and its series to the sixth order.
_E, _EASTING, _MERIDIAN, _RADIUS = 0.08181919104281579, 500000.0, 0.15707963267948966, 6364902.1661127405
TO_GRID = (0.0008377318247285514, 7.608527848149476e-07, 1.1976455209422675e-09, 2.4291706548410134e-12, 5.711757817902035e-15, 1.4911177751870803e-17)

_TABLES = """
cells AS (SELECT CAST(p_partkey // 50 AS INT) r, CAST(p_partkey % 50 AS INT) c, CASE WHEN p_size % 10 = 0 THEN 'sea' ELSE 'land' END surface, p_size % 7 = 0 building, p_size size,
  0.4 + p_size / 10.0::DOUBLE + p_retailprice / 100000.0::DOUBLE simple FROM part),
presence AS (SELECT DISTINCT lower(l_returnflag) || l_linenumber || '_' || CAST(floor(l_quantity / 10) AS INT) layer, CAST(l_partkey // 50 AS INT) r, CAST(l_partkey % 50 AS INT) c FROM lineitem),
population AS (SELECT CAST(l_partkey // 50 AS INT) r, CAST(l_partkey % 50 AS INT) c, sum(l_quantity) people FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
held AS (SELECT r, c, surface, building, {flags} FROM cells LEFT JOIN presence USING (r, c) GROUP BY r, c, surface, building),
static AS (SELECT *, building OR h_a1_0 barrier, CASE surface WHEN 'land' THEN 1.0::DOUBLE ELSE 2.0 END base,
  greatest(CASE WHEN h_n1_1 THEN 6.0 ELSE 0 END, CASE WHEN h_n2_1 THEN 4.0 ELSE 0 END, CASE WHEN h_r4_4 THEN 8.0 ELSE 0 END)::DOUBLE nature,
  greatest(CASE WHEN h_a3_4 THEN 5.0 ELSE 0 END, CASE WHEN h_r5_2 THEN 3.0 ELSE 0 END)::DOUBLE people_cost FROM held),
added AS (SELECT *, base + nature + people_cost + CASE WHEN h_r1_2 OR h_r3_1 THEN 7 ELSE 0 END v1 FROM static),
less AS (SELECT *, CASE WHEN h_r2_2 THEN greatest(1.0, v1 - 1) ELSE v1 END v2 FROM added),
folded AS (SELECT *, v2 + CASE WHEN h_n3_3 THEN 2 ELSE 0 END v3, v2 + CASE WHEN h_n3_3 THEN 2 ELSE 0 END + CASE WHEN h_a2_3 THEN 0.5 ELSE 0 END v4 FROM less)
""".format(flags=", ".join(f"coalesce(bool_or(layer = '{x.name}'), false) AND NOT building{' AND surface = ' + repr(x.surface) if x.surface != 'any' else ''} h_{x.name}" for x in RULES.layers))
_WITH = "WITH RECURSIVE " + _TABLES

_QUANTILES = """
{name}_levels AS (SELECT quantile_cont({value}, [{shares}]) xs, [{levels}] ys FROM {table}),
{name}_points AS (SELECT x, avg(y) y FROM (SELECT unnest(xs) x, unnest(ys) y FROM {name}_levels) GROUP BY x),
{name}_steps AS (SELECT x x0, CASE WHEN count(*) OVER () = 1 THEN {single} ELSE y END y0, lead(x) OVER (ORDER BY x) x1, lead(y) OVER (ORDER BY x) y1, row_number() OVER (ORDER BY x) k FROM {name}_points)"""


def _quantiles(name: str, table: str, value: str, low: float, high: float, count: int, single: float) -> str:
    shares = [k / count for k in range(count + 1)]
    return _QUANTILES.format(name=name, table=table, value=value, shares=", ".join(map(repr, shares)), levels=", ".join(repr(float(low + (high - low) * s)) for s in shares), single=float(single))


def _scaled(name: str, table: str, value: str) -> str:
    """The rows of ``table`` with their ``score``."""
    return f"(SELECT t.*, CASE WHEN x1 IS NULL OR {value} <= x0 THEN y0 ELSE y0 + (y1 - y0) * ({value} - x0) / (x1 - x0) END score FROM {table} t JOIN {name}_steps ON {value} >= x0 AND (x1 IS NULL OR {value} < x1))"


_PEOPLE = "who AS (SELECT r, c, people FROM cells JOIN population USING (r, c) WHERE surface = 'land' AND NOT building AND people > 0 AND people >= 1)," + _quantiles("pop", "who", "people", 1, 3, 4, 1)
_RISK = """around AS (SELECT a.r, a.c, sum(coalesce(p.people, 0)) focal FROM cells a JOIN cells b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4
  LEFT JOIN population p ON p.r = b.r AND p.c = b.c WHERE a.surface = 'land' GROUP BY a.r, a.c),
risky AS (SELECT * FROM around WHERE focal > 0),""" + _quantiles("risk", "risky", "focal", 0, 5, 4, 5)
_NEAR = """near AS (SELECT a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) d2 FROM cells a JOIN cells b ON b.building AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY a.r, a.c),
near_costs AS (SELECT r, c, 6 * (1 - sqrt(d2) * 100 / 300) near_cost FROM near WHERE d2 > 0 AND sqrt(d2) * 100 < 300)"""
_BAND = """band AS (SELECT a.r, a.c FROM held a JOIN held b ON b.h_n3_3 AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 WHERE NOT a.h_n3_3 GROUP BY a.r, a.c
  HAVING min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) FILTER (WHERE sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) * 100 >= 100) IS NOT NULL AND min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) BETWEEN 1 AND 4)"""

_SITES = """n AS (SELECT count(*) n FROM part),
sites AS (SELECT CAST(n_nationkey AS INT) site, CASE WHEN n_nationkey % 5 = 0 THEN 'source' ELSE 'storage' END role, CAST(((n_nationkey * 79 + n // 2) % n) // 50 AS INT) r, CAST(((n_nationkey * 79 + n // 2) % n) % 50 AS INT) c FROM nation, n),
open AS (SELECT r, c, surface, simple cost FROM cells WHERE NOT building),
snapped AS (SELECT site, r, c, CAST(d2 AS INT) d2 FROM (SELECT s.site, o.r, o.c, (s.r - o.r) * (s.r - o.r) + (s.c - o.c) * (s.c - o.c) d2 FROM sites s JOIN open o ON abs(s.r - o.r) <= 3 AND abs(s.c - o.c) <= 3)
  WHERE d2 <= 9 QUALIFY row_number() OVER (PARTITION BY site ORDER BY d2, r, c) = 1),
steps AS (SELECT a.r, a.c, b.r r2, b.c c2, (a.cost + b.cost) / 2 * CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END w FROM open a JOIN open b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)),
acc(site, r, c, acc) USING KEY (site, r, c) AS (SELECT site, r, c, 0.0::DOUBLE FROM snapped UNION
  SELECT site, r, c, acc FROM (SELECT a.site, s.r2 r, s.c2 c, min(a.acc + s.w) acc FROM acc a JOIN steps s ON a.r = s.r AND a.c = s.c GROUP BY ALL) n
  WHERE NOT EXISTS (FROM recurring.acc k WHERE k.site = n.site AND k.r = n.r AND k.c = n.c AND k.acc <= n.acc))"""
_PAIRS = """pairs AS (SELECT a.site from_id, b.site to_id FROM sites a, sites b WHERE a.role = 'source' AND b.role = 'storage'),
costs AS (SELECT from_id, to_id, CASE WHEN acc IS NULL THEN 'unreachable' ELSE 'routed' END status, acc cost FROM pairs JOIN snapped s ON s.site = to_id LEFT JOIN acc a ON a.site = from_id AND a.r = s.r AND a.c = s.c)"""
_ROUTES = """hop AS (SELECT a.site, a.r, a.c, f.r r0, f.c c0, CASE WHEN f.r <> a.r AND f.c <> a.c THEN sqrt(2) ELSE 1 END n, o.surface FROM acc a JOIN open o ON o.r = a.r AND o.c = a.c JOIN steps s ON s.r2 = a.r AND s.c2 = a.c JOIN acc f ON f.site = a.site AND f.r = s.r AND f.c = s.c WHERE a.acc > 0
  QUALIFY row_number() OVER (PARTITION BY a.site, a.r, a.c ORDER BY round(f.acc + s.w, 9), f.r, f.c) = 1),
ends AS (SELECT from_id, to_id, s.r, s.c FROM costs JOIN snapped s ON s.site = to_id WHERE status = 'routed'),
walk AS (SELECT from_id, to_id, r, c, 0::BIGINT back FROM ends UNION ALL SELECT w.from_id, w.to_id, h.r0, h.c0, back + 1 FROM walk w JOIN hop h ON h.site = w.from_id AND h.r = w.r AND h.c = w.c),
trodden AS (SELECT from_id, to_id, h.r, h.c, n, surface FROM walk w JOIN hop h ON h.site = w.from_id AND h.r = w.r AND h.c = w.c),
routes AS (SELECT e.from_id, e.to_id, round(coalesce(sum(n), 0) / 10, 4) length_km, round(coalesce(sum(n) FILTER (WHERE surface = 'sea'), 0) / 10, 4) sea_km, count(n) hops FROM ends e LEFT JOIN trodden t USING (from_id, to_id) GROUP BY ALL)"""
_CORRIDOR = """bands AS (SELECT p.from_id, p.to_id, a.r, a.c, CASE WHEN round(a.acc + b.acc, 9) <= round(p.cost * 1.01::DOUBLE, 9) THEN 0 WHEN round(a.acc + b.acc, 9) <= round(p.cost * 1.03::DOUBLE, 9) THEN 1 END band
  FROM costs p JOIN acc a ON a.site = p.from_id JOIN acc b ON b.site = p.to_id AND a.r = b.r AND a.c = b.c WHERE p.status = 'routed')"""
_BITS = " | ".join(f"CASE WHEN h_{x.name} THEN {x.bit}::BIGINT ELSE 0 END" for x in RULES.layers)
_PARTS = f"""{_WITH}, {_PEOPLE}, {_RISK}, {_NEAR}, {_BAND},
parts AS (SELECT f.r, f.c, f.surface, {_BITS} static_bits, CASE WHEN NOT barrier THEN v4 END static_cost, near_cost, b.r IS NOT NULL in_band, pop.score pop, risk.score risk, f.* EXCLUDE (r, c, surface)
  FROM folded f LEFT JOIN near_costs n USING (r, c) LEFT JOIN band b USING (r, c) LEFT JOIN {_scaled("pop", "who", "people")} pop USING (r, c) LEFT JOIN {_scaled("risk", "risky", "focal")} risk USING (r, c)),
nearby AS (SELECT *, static_cost + CASE WHEN surface = 'land' THEN coalesce(near_cost, 0) ELSE 0 END near_building_cost FROM parts)"""
_FULL = f"""{_PARTS}
SELECT r, c, surface, static_bits | CASE WHEN static_cost IS NULL THEN 0 ELSE CASE WHEN surface = 'land' AND near_cost IS NOT NULL THEN 34359738368 ELSE 0 END | CASE WHEN in_band THEN 68719476736 ELSE 0 END | CASE WHEN pop IS NOT NULL THEN 137438953472 ELSE 0 END | CASE WHEN risk IS NOT NULL THEN 274877906944 ELSE 0 END END class_bits, round(static_cost, 6) static_cost, round(near_building_cost, 6) near_building_cost, round(CASE WHEN in_band AND NOT barrier THEN greatest(0.4, near_building_cost * 0.8) ELSE near_building_cost END, 6) band_cost,
  round(CASE WHEN in_band AND NOT barrier THEN greatest(0.4, near_building_cost * 0.8) ELSE near_building_cost END + greatest(coalesce(pop, 0), coalesce(risk, 0), CASE WHEN h_a4_4 THEN 2 ELSE 0 END), 6) AS cost FROM nearby"""

#: The steps of the surface with the cost before and after each, and where it holds, written out.
_STEPS = f"""{_PARTS},
banded AS (SELECT *, CASE WHEN in_band AND NOT barrier THEN greatest(0.4, near_building_cost * 0.8) ELSE near_building_cost END banded, greatest(coalesce(pop, 0), coalesce(risk, 0), CASE WHEN h_a4_4 THEN 2 ELSE 0 END) people FROM nearby),
steps AS (""" + " UNION ALL ".join(f"SELECT r, c, surface, building, barrier, {k} step, '{label}' AS label, {holds} holds, {before}::DOUBLE x0, {after}::DOUBLE x1 FROM banded" for k, (label, holds, before, after) in enumerate([
    ("base", "true", "0", "base"), ("nature", "h_n1_1 OR h_n2_1 OR h_r4_4", "base", "base + nature"), ("people", "h_a3_4 OR h_r5_2", "base + nature", "base + nature + people_cost"),
    ("r1_2", "h_r1_2 OR h_r3_1", "base + nature + people_cost", "v1"), ("r2_2", "h_r2_2", "v1", "v2"), ("n3_3", "h_n3_3", "v2", "v3"), ("a2_3", "h_a2_3", "v3", "v4"),
    ("near", "surface = 'land' AND near_cost IS NOT NULL", "v4", "near_building_cost"), ("band", "in_band", "near_building_cost", "banded"), ("living", "pop IS NOT NULL OR risk IS NOT NULL OR h_a4_4", "banded", "banded + people")])) + ")"

_POINTS = """lines AS (SELECT o_orderkey feature, o_custkey other, o_orderkey % 47 + 0.13::DOUBLE x1, (o_orderkey // 47) % 37 + 0.29::DOUBLE y1, o_orderkey % 47 + 0.13::DOUBLE + o_custkey % 7 - 2.5::DOUBLE x2, (o_orderkey // 47) % 37 + 0.29::DOUBLE + o_custkey % 5 - 1.75::DOUBLE y2 FROM orders),
numbered AS (SELECT *, greatest(2, CAST(floor(round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 0.5, 9)) AS INT) + 1) n FROM lines),
points AS (SELECT feature, other, CAST(k AS INT) k, x1 + (x2 - x1) * k / (n - 1) x, y1 + (y2 - y1) * k / (n - 1) y FROM numbered, unnest(range(n)) u(k))"""
_BOXES = """corners AS (SELECT c_custkey feature, c_custkey % 47 bx, (c_custkey // 47) % 37 b_y FROM customer),
edges AS (SELECT feature, bx + 0.13::DOUBLE x1, b_y + 0.21::DOUBLE y1, bx + 3.37::DOUBLE x2, b_y + 0.89::DOUBLE y2 FROM corners UNION ALL SELECT feature, bx + 3.37::DOUBLE, b_y + 0.89::DOUBLE, bx + 1.41::DOUBLE, b_y + 3.77::DOUBLE FROM corners UNION ALL SELECT feature, bx + 1.41::DOUBLE, b_y + 3.77::DOUBLE, bx + 0.13::DOUBLE, b_y + 0.21::DOUBLE FROM corners)"""
#: Suppliers as points in metres on a grid of 100 m, and the nearest cells with a cost.
_POINT_SITES = """spots AS (SELECT CAST(s_suppkey AS INT) site, s_suppkey * 137.0::DOUBLE % 5400 - 150 x, s_suppkey * 211.0::DOUBLE % (h * 100 + 300) - 100 y, h FROM supplier, (SELECT max(r) + 1 h FROM cells)),
put AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(d, 9), r, c) k FROM (SELECT site, r, c, sqrt((x - (c + 0.5) * 100) ** 2 + ((h * 100 - y) - (r + 0.5) * 100) ** 2) d FROM spots JOIN cells ON abs(c * 100 + 50 - x) < 200 AND abs(r * 100 + 50 - (h * 100 - y)) < 200 WHERE size % 4 = 0 AND NOT building AND x >= 0 AND y >= 0 AND x < 5000 AND y < h * 100) WHERE d <= 120)"""
#: Cells of the triangles by their centres, and gaps and islands.
_SETS = f"""WITH {_BOXES}, inside AS (SELECT feature, CAST(r AS INT) r, CAST(c AS INT) c FROM (SELECT feature, b_y + i r, bx + j c FROM corners, range(-1, 6) a(i), range(-1, 6) b(j)) p JOIN edges e USING (feature)
WHERE (y1 > r + 0.5) <> (y2 > r + 0.5) AND x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) < c + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1),
extent AS (SELECT DISTINCT r, c FROM inside JOIN customer ON c_custkey = feature WHERE c_mktsegment <> 'BUILDING'), land AS (SELECT DISTINCT r, c FROM inside JOIN customer ON c_custkey = feature WHERE c_acctbal < 5000)"""
_ISLANDS = "SELECT r, CAST(min(c) AS INT) AS first, CAST(max(c) AS INT) AS last FROM (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) i FROM held) GROUP BY r, i"
#: The unit edges of the sets ``cs`` (g, r, c), the set on their right, each linked to the one that follows; labels run round the rings.
_TRACED = """unit AS (SELECT c.g, c.r::BIGINT r, c.c::BIGINT c, s FROM cs c, range(4) u(s) WHERE NOT EXISTS (FROM cs n WHERE n.g = c.g AND n.r = c.r + [-1, 0, 1, 0][s + 1] AND n.c = c.c + [0, 1, 0, -1][s + 1])),
looked AS (SELECT u.*, EXISTS (FROM cs n WHERE n.g = u.g AND n.r = u.r + [0, 1, 0, -1][s + 1] AND n.c = u.c + [1, 0, -1, 0][s + 1]) ahead, EXISTS (FROM cs n WHERE n.g = u.g AND n.r = u.r + [-1, 1, 1, -1][s + 1] AND n.c = u.c + [1, 1, -1, -1][s + 1]) diagonal FROM unit u),
linked AS (SELECT g, (r + 10000) * 1000000 + (c + 10000) * 4 + s id, c + [0, 1, 1, 0][s + 1] x, r + [0, 0, 1, 1][s + 1] y, ahead AND NOT diagonal straight,
  CASE WHEN NOT ahead THEN (r + 10000) * 1000000 + (c + 10000) * 4 + (s + 1) % 4 WHEN NOT diagonal THEN (r + [0, 1, 0, -1][s + 1] + 10000) * 1000000 + (c + [1, 0, -1, 0][s + 1] + 10000) * 4 + s ELSE (r + [-1, 1, 1, -1][s + 1] + 10000) * 1000000 + (c + [1, 1, -1, -1][s + 1] + 10000) * 4 + (s + 3) % 4 END nxt FROM looked),
label(g, id, l) USING KEY (g, id) AS (SELECT g, id, id FROM linked UNION SELECT g, id, l FROM (SELECT e.g, e.nxt id, k.l FROM label k JOIN linked e ON e.g = k.g AND e.id = k.id) m WHERE NOT EXISTS (FROM recurring.label o WHERE o.g = m.g AND o.id = m.id AND o.l <= m.l)),
traced AS (SELECT a.g, k.l, count(*) FILTER (WHERE NOT a.straight) corners, sum(a.x * b.y - b.x * a.y) / 2.0::DOUBLE area FROM linked a JOIN linked b ON b.g = a.g AND b.id = a.nxt JOIN label k ON k.g = a.g AND k.id = a.id GROUP BY a.g, k.l)"""
_LON, _LAT = "(3.5 + c_custkey * 7 % 1200 / 100.0::DOUBLE)", "(54.3 + c_custkey * 11 % 390 / 100.0::DOUBLE)"

ORACLE_SQL: dict[str, str] = {
    "grid_assign": "SELECT c_custkey, CAST(floor((10000 - y) / 250) AS BIGINT) r, CAST(floor(x / 250) AS BIGINT) c, (floor(x / 250) + 0.5) * 250 x, 10000 - (floor((10000 - y) / 250) + 0.5) * 250 y FROM (SELECT c_custkey, c_custkey * 37.0::DOUBLE % 9000 x, c_custkey * 53.0::DOUBLE % 7000 y FROM customer)",
    "project_utm32": f"""WITH a AS (SELECT c_custkey, sin({_LAT} * {pi!r} / 180) s, {_LON} * {pi!r} / 180 - {_MERIDIAN!r} e FROM customer), b AS (SELECT c_custkey, e, sinh(atanh(s) - {_E!r} * atanh({_E!r} * s)) t FROM a),
d AS (SELECT c_custkey, atan2(t, cos(e)) p, atanh(sin(e) / sqrt(1 + t * t)) q FROM b)
SELECT c_custkey, round({_EASTING!r} + {_RADIUS!r} * (q + {" + ".join(f"{a!r} * cos({2 * j} * p) * sinh({2 * j} * q)" for j, a in enumerate(TO_GRID, 1))}), 3) x, round({_RADIUS!r} * (p + {" + ".join(f"{a!r} * sin({2 * j} * p) * cosh({2 * j} * q)" for j, a in enumerate(TO_GRID, 1))}), 3) y FROM d""",
    "project_wgs84": f"SELECT c_custkey, round({_LON}, 8) lon, round({_LAT}, 8) lat FROM customer",
    "rasterize_polygon_center": f"""WITH {_BOXES} SELECT feature, CAST(r AS INT) r, CAST(c AS INT) c FROM (SELECT feature, b_y + i r, bx + j c FROM corners, range(-1, 6) a(i), range(-1, 6) b(j)) p JOIN edges e USING (feature)
WHERE (y1 > r + 0.5) <> (y2 > r + 0.5) AND x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) < c + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1""",
    "dissolved_extent": f"{_SETS}, held AS (SELECT * FROM extent) {_ISLANDS}",
    "clipped_land": f"{_SETS}, held AS (SELECT * FROM land JOIN extent USING (r, c)) {_ISLANDS}",
    "foreign_land": f"{_SETS}, held AS (SELECT * FROM land ANTI JOIN extent USING (r, c)) {_ISLANDS}",
    "surface_areas": f"{_SETS}, marked AS (SELECT r, c, CASE WHEN (r, c) IN (FROM land) THEN 'land' ELSE 'sea' END surface FROM extent), lagged AS (SELECT *, lag(c) OVER (PARTITION BY surface, r ORDER BY c) IS NOT DISTINCT FROM c - 1 goes_on FROM marked) SELECT surface, count(*) FILTER (WHERE NOT goes_on) runs, round(count(*) * 0.01::DOUBLE, 6) km2 FROM lagged GROUP BY surface",
    "boundary_rings": f"{_SETS.replace('WITH', 'WITH RECURSIVE', 1)}, cs AS (SELECT 0 g, r, c FROM land ANTI JOIN extent USING (r, c) UNION ALL SELECT 0, r, c FROM extent ANTI JOIN land USING (r, c)), {_TRACED} SELECT corners, area, count(*) rings FROM traced GROUP BY corners, area",
    "shells_with_holes": f"{_SETS.replace('WITH', 'WITH RECURSIVE', 1)}, cs AS (SELECT 0 g, r, c FROM land ANTI JOIN extent USING (r, c) UNION ALL SELECT 0, r, c FROM extent ANTI JOIN land USING (r, c)), {_TRACED}, piece(r, c, l) USING KEY (r, c) AS (SELECT r, c, r * 100000 + c FROM cs UNION SELECT r, c, l FROM (SELECT n.r, n.c, min(p.l) l FROM piece p JOIN cs n ON abs(n.r - p.r) + abs(n.c - p.c) = 1 GROUP BY n.r, n.c) m WHERE NOT EXISTS (FROM recurring.piece o WHERE o.r = m.r AND o.c = m.c AND o.l <= m.l)), owned AS (SELECT t.area, p.l FROM traced t JOIN linked k ON k.id = t.l JOIN piece p ON p.r = t.l // 1000000 - 10000 AND p.c = t.l % 1000000 // 4 - 10000), each AS (SELECT max(area) shell_area, count(*) FILTER (WHERE area < 0) holes, sum(area) area FROM owned GROUP BY l) SELECT shell_area, holes, area, count(*) n FROM each GROUP BY ALL",
    "simplified_lines": """WITH RECURSIVE v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k, 10.0::DOUBLE * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) x, value y FROM events),
spans AS (SELECT user_id, min(k) a, max(k) b FROM v GROUP BY user_id UNION ALL SELECT user_id, unnest([a, s]), unnest([s, b]) FROM (
  SELECT i.user_id, i.a, i.b, arg_min(m.k, {'d': -(CASE WHEN t IS NULL THEN 0 ELSE sqrt((m.x - p.x - t * (q.x - p.x)) ** 2 + (m.y - p.y - t * (q.y - p.y)) ** 2) END), 'k': m.k}) s, max(sqrt((m.x - p.x - t * (q.x - p.x)) ** 2 + (m.y - p.y - t * (q.y - p.y)) ** 2)) far
  FROM spans i JOIN v p ON p.user_id = i.user_id AND p.k = i.a JOIN v q ON q.user_id = i.user_id AND q.k = i.b JOIN v m ON m.user_id = i.user_id AND m.k > i.a AND m.k < i.b,
  LATERAL (SELECT greatest(0, least(1, ((m.x - p.x) * (q.x - p.x) + (m.y - p.y) * (q.y - p.y)) / ((q.x - p.x) ** 2 + (q.y - p.y) ** 2))) t) GROUP BY i.user_id, i.a, i.b HAVING far > 25))
SELECT DISTINCT v.user_id, k, round(x, 6) x, round(y, 6) y FROM v JOIN spans s ON s.user_id = v.user_id AND (k = a OR k = b)""",
    "rasterize_line_touched": f"""WITH {_POINTS}, boxed AS (SELECT feature, x1, y1, x2 - x1 dx, y2 - y1 dy, CAST(floor(least(x1, x2)) AS INT) a, CAST(floor(greatest(x1, x2)) AS INT) b, CAST(floor(least(y1, y2)) AS INT) e, CAST(floor(greatest(y1, y2)) AS INT) f FROM lines),
near AS (SELECT feature, x1, y1, dx, dy, CAST(c AS INT) c, CAST(r AS INT) r FROM boxed, unnest(range(a, b + 1)) u(c), unnest(range(e, f + 1)) v(r)),
spans AS (SELECT feature, r, c, CASE WHEN dx = 0 THEN 0 ELSE least((c - x1) / dx, (c + 1 - x1) / dx) END tx0, CASE WHEN dx = 0 THEN 1 ELSE greatest((c - x1) / dx, (c + 1 - x1) / dx) END tx1, CASE WHEN dy = 0 THEN 0 ELSE least((r - y1) / dy, (r + 1 - y1) / dy) END ty0, CASE WHEN dy = 0 THEN 1 ELSE greatest((r - y1) / dy, (r + 1 - y1) / dy) END ty1 FROM near)
SELECT feature, r, c FROM spans WHERE least(tx1, ty1, 1) > greatest(tx0, ty0, 0)""",
    "class_bits": f"{_WITH} SELECT r, c, {_BITS} class_bits FROM held",
    "class_stats": f"""{_STEPS}, each AS (SELECT step + 2 step, label, CASE label WHEN 'nature' THEN 'max(n1_1, n2_1, r4_4)' WHEN 'people' THEN 'max(a3_4, r5_2)' WHEN 'r2_2' THEN 'discount' WHEN 'near' THEN 'distance' WHEN 'band' THEN 'factor 0.8' WHEN 'living' THEN 'max(population, risk, a4_4)' ELSE '' END AS rule,
  CASE label WHEN 'r1_2' THEN 7 WHEN 'r2_2' THEN 1 WHEN 'n3_3' THEN 2 WHEN 'a2_3' THEN 0.5 END::DOUBLE score, count(*) FILTER (WHERE holds AND (label NOT IN ('near', 'band') OR NOT barrier)) cells, count(*) FILTER (WHERE holds AND NOT barrier) applied_cells, coalesce(sum(x1 - x0) FILTER (WHERE holds AND NOT barrier), 0) total FROM steps WHERE step > 0 GROUP BY step, label)
SELECT 0 step, 'open_land' AS label, '' AS rule, 1.0::DOUBLE score, count(*) FILTER (WHERE NOT building) cells, count(*) FILTER (WHERE NOT barrier) applied_cells, count(*) FILTER (WHERE NOT building)::DOUBLE total FROM static WHERE surface = 'land'
UNION ALL SELECT 1, 'open_sea', '', 2.0, count(*) FILTER (WHERE NOT building), count(*) FILTER (WHERE NOT barrier), 2.0 * count(*) FILTER (WHERE NOT building) FROM static WHERE surface = 'sea'
UNION ALL SELECT 2, 'a1_0', 'barrier', NULL, count(*), 0, NULL FROM static WHERE h_a1_0
UNION ALL SELECT step, label, rule, score, cells, applied_cells, round(CASE WHEN label IN ('r1_2', 'n3_3', 'a2_3') THEN cells * score ELSE total END, 4) FROM each
UNION ALL SELECT 12, 'building', 'barrier', NULL, count(*), 0, NULL FROM static WHERE building""",
    "base_cost": f"{_WITH} SELECT r, c, CASE surface WHEN 'land' THEN 1.0::DOUBLE ELSE 2.0 END AS cost FROM cells",
    "barriers": f"{_WITH} SELECT r, c FROM static WHERE barrier",
    "static_max_group": f"{_WITH} SELECT r, c, nature, people_cost people FROM static",
    "discount_fold": f"{_WITH} SELECT r, c, round(CASE WHEN NOT barrier THEN v4 END, 6) AS cost FROM folded",
    "near_building": f"{_WITH}, {_NEAR} SELECT r, c, round(near_cost, 6) near_cost FROM near_costs JOIN cells USING (r, c) WHERE surface = 'land'",
    "parallel_band": f"{_WITH}, {_BAND} SELECT r, c FROM band",
    "building_distance": f"{_WITH} SELECT a.r, a.c, CAST(least(65534, round_even(sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) * 100, 0)) AS INT) metres FROM cells a, cells b WHERE b.building GROUP BY a.r, a.c",
    "nearest_landfall": f"{_WITH} SELECT a.r, a.c, CAST(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2) AS BIGINT) d2 FROM cells a, cells b WHERE a.surface = 'sea' AND b.surface = 'land' AND b.size = 3 AND b.r % 5 = 0 GROUP BY a.r, a.c",
    "landfall": f"{_WITH} SELECT DISTINCT a.r, a.c FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.surface = 'sea' WHERE a.surface = 'land'",
    "focal_sum": f"{_WITH} SELECT a.r, a.c, round(sum(coalesce(p.people, 0)), 6) focal FROM cells a JOIN cells b ON abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9 LEFT JOIN population p ON p.r = b.r AND p.c = b.c GROUP BY a.r, a.c",
    "quantile_scale_population": f"{_WITH}, {_PEOPLE} SELECT r, c, round(score, 6) population_cost FROM {_scaled('pop', 'who', 'people')}",
    "quantile_scale_risk": f"{_WITH}, {_RISK} SELECT r, c, round(focal, 6) focal, round(score, 6) risk_cost FROM {_scaled('risk', 'risky', 'focal')}",
    "resample_area": f"""{_WITH}, big AS (SELECT DISTINCT CAST(i AS INT) r, CAST(j AS INT) c FROM cells, range(0, 400) a(i), range(0, 20) b(j) WHERE i < (r + 1) / 2.5::DOUBLE AND i + 1 > r / 2.5::DOUBLE AND j < (cells.c + 1) / 2.5::DOUBLE AND j + 1 > cells.c / 2.5::DOUBLE),
shares AS (SELECT b.r, b.c, s.size, s.surface, s.building, (least(s.r + 1, (b.r + 1) * 2.5::DOUBLE) - greatest(s.r, b.r * 2.5::DOUBLE)) * (least(s.c + 1, (b.c + 1) * 2.5::DOUBLE) - greatest(s.c, b.c * 2.5::DOUBLE)) w FROM big b JOIN cells s ON s.r < (b.r + 1) * 2.5::DOUBLE AND s.r + 1 > b.r * 2.5::DOUBLE AND s.c < (b.c + 1) * 2.5::DOUBLE AND s.c + 1 > b.c * 2.5::DOUBLE)
SELECT r, c, round(sum(size * w) / sum(w), 6) mean_size, max(size) most_size, round(sum(w) / 6.25, 6) covered, CASE WHEN round(sum(CASE surface WHEN 'land' THEN w ELSE 0 END) / sum(w), 9) >= 0.5 THEN 'land' ELSE 'sea' END surface, CAST(round_even(round(sum(CASE WHEN building THEN w ELSE 0 END) / sum(w) * 255, 6), 0) AS INT) built FROM shares GROUP BY r, c""",
    "cost_surface_full": _FULL,
    "cost_explain": f"{_STEPS} SELECT r, c, step, label, round(x1 - x0, 6) AS value, round(x1, 6) AS cost FROM steps WHERE holds AND NOT barrier UNION ALL SELECT r, c, -1, CASE WHEN building THEN 'building' ELSE 'a1_0' END, NULL, NULL FROM static WHERE barrier",
    "pack_chunks": f"""{_WITH}, far AS (SELECT a.r, a.c, CAST(least(65534, round_even(sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) * 100, 0)) AS BIGINT) metres FROM cells a, cells b WHERE b.building GROUP BY a.r, a.c),
marked AS (SELECT r, c, building, {_BITS} bits FROM held), lattice AS (SELECT CAST(i AS INT) r, CAST(j AS INT) c FROM range((SELECT max(r) + 1 FROM cells)) a(i), range(50) b(j)),
value AS (SELECT r, c, coalesce(bits & 4294967295, 0)::BIGINT lo, coalesce((bits >> 32) & 4294967295, 0)::BIGINT hi, coalesce(metres, 65535)::BIGINT metres, CASE WHEN building THEN 1 ELSE 0 END built FROM lattice LEFT JOIN marked USING (r, c) LEFT JOIN far USING (r, c)),
four AS (SELECT 'presence_lo' plane, r, c, lo v, 4 size FROM value UNION ALL SELECT 'presence_hi', r, c, hi, 4 FROM value UNION ALL SELECT 'metres', r, c, metres, 2 FROM value UNION ALL SELECT 'buildings', r, c, built, 1 FROM value),
bytes AS (SELECT plane, r, c, size, printf('%02x', v & 255) || CASE WHEN size > 1 THEN printf('%02x', (v >> 8) & 255) ELSE '' END || CASE WHEN size > 2 THEN printf('%02x', (v >> 16) & 255) || printf('%02x', (v >> 24) & 255) ELSE '' END h FROM four)
SELECT plane, CAST(r // 16 AS INT) chunk, sha256(unhex(string_agg(h, '' ORDER BY r, c))) raw_sha256, CAST(sum(size) AS BIGINT) raw_bytes FROM bytes GROUP BY plane, r // 16""",
    "display_tiles": f"""{_WITH}, h AS (SELECT max(r) + 1 h FROM cells), low AS (SELECT floor(-6378137.0::DOUBLE * ln(tan(radians(56 + h * 0.001) / 2 + {pi!r} / 4)) / 150)::BIGINT a, floor(-6378137.0::DOUBLE * ln(tan(radians(55.9) / 2 + {pi!r} / 4)) / 150)::BIGINT b, floor(6378137.0::DOUBLE * radians(8.95) / 150)::BIGINT e, floor(6378137.0::DOUBLE * radians(9.15) / 150)::BIGINT f FROM h),
lattice AS (SELECT i, j, degrees((j + 0.5) * 150.0::DOUBLE / 6378137.0::DOUBLE) lon, degrees(2 * atan(exp(-(i + 0.5) * 150.0::DOUBLE / 6378137.0::DOUBLE)) - {pi!r} / 2) lat FROM low, unnest(range(a, b)) u(i), unnest(range(e, f)) v(j)),
turned AS (SELECT i, j, sin(radians(lat)) s, radians(lon) - {_MERIDIAN!r} e FROM lattice), tangent AS (SELECT i, j, e, sinh(atanh(s) - {_E!r} * atanh({_E!r} * s)) t FROM turned), plane AS (SELECT i, j, atan2(t, cos(e)) p, atanh(sin(e) / sqrt(1 + t * t)) q FROM tangent),
metres AS (SELECT i, j, {_EASTING!r} + {_RADIUS!r} * (q + {" + ".join(f"{a!r} * cos({2 * j} * p) * sinh({2 * j} * q)" for j, a in enumerate(TO_GRID, 1))}) x, {_RADIUS!r} * (p + {" + ".join(f"{a!r} * sin({2 * j} * p) * cosh({2 * j} * q)" for j, a in enumerate(TO_GRID, 1))}) y FROM plane),
level0 AS (SELECT i, j, simple v, 1 n FROM metres, h JOIN cells ON cells.r = floor((6200000.0 + 100 * h - y) / 100) AND cells.c = floor((x - 500000.0) / 100) WHERE NOT building),
level1 AS (SELECT i // 2 - CASE WHEN i < 0 AND i % 2 <> 0 THEN 1 ELSE 0 END i, j // 2 j, sum(v * n) / sum(n) v, sum(n) n FROM level0 GROUP BY ALL), level2 AS (SELECT i // 2 - CASE WHEN i < 0 AND i % 2 <> 0 THEN 1 ELSE 0 END i, j // 2 j, sum(v * n) / sum(n) v, sum(n) n FROM level1 GROUP BY ALL),
put AS (SELECT 0 AS level, i, j, v FROM level0 UNION ALL SELECT 1, i, j, v FROM level1 UNION ALL SELECT 2, i, j, v FROM level2),
means AS (SELECT level, CAST(floor(i / 16.0::DOUBLE) AS BIGINT) tile_r, CAST(floor(j / 16.0::DOUBLE) AS BIGINT) tile_c, count(*) AS cells, avg(v) mean FROM put GROUP BY ALL), shares AS (SELECT *, greatest(0, least(1, (round(mean, 9) - 1) / 4)) s FROM means)
SELECT level, tile_r, tile_c, cells, round(mean, 6) mean, CASE WHEN s <= 0.5 THEN printf('#%02x%02x%02x', floor(26 + 229 * s * 2 + 0.5)::INT, floor(152 + 103 * s * 2 + 0.5)::INT, floor(80 + 111 * s * 2 + 0.5)::INT) ELSE printf('#%02x%02x%02x', floor(255 - 40 * (s * 2 - 1) + 0.5)::INT, floor(255 - 207 * (s * 2 - 1) + 0.5)::INT, floor(191 - 152 * (s * 2 - 1) + 0.5)::INT) END colour FROM shares""",
    "snap_sites": f"{_WITH}, {_SITES} SELECT site, r, c, d2 FROM snapped",
    "route_pairs": f"{_WITH}, {_SITES}, {_PAIRS} SELECT from_id, to_id FROM pairs",
    "network_pairs": "SELECT CAST(a.n_nationkey AS INT) from_id, CAST(b.n_nationkey AS INT) to_id FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "accumulated_cost": f"{_WITH}, {_SITES} SELECT site, r, c, round(acc, 9) acc FROM acc",
    "costs_to_targets": f"""{_WITH}, {_SITES}, {_PAIRS}, bounds AS (SELECT from_id, CASE WHEN count(*) = count(cost) THEN max(cost) END most FROM costs WHERE abs(from_id - to_id) <= 2 GROUP BY from_id)
SELECT site, r, c, round(acc, 9) acc FROM acc JOIN bounds ON from_id = site WHERE most IS NULL OR round(acc, 9) <= round(most, 9)""",
    "pair_costs": f"{_WITH}, {_SITES}, {_PAIRS} SELECT from_id, to_id, status, round(cost, 9) AS cost FROM costs",
    "best_storage_rank": f"{_WITH}, {_SITES}, {_PAIRS} SELECT from_id, to_id, round(cost, 9) AS cost, CAST(row_number() OVER w AS INT) AS rank, row_number() OVER w = 1 AS best FROM costs WHERE status = 'routed' WINDOW w AS (PARTITION BY from_id ORDER BY round(cost, 9), to_id)",
    "spanning_network": f"""{_WITH}, {_SITES}, ranked AS (SELECT a.site from_id, b.site to_id, round(acc, 9) AS cost, row_number() OVER (ORDER BY round(acc, 9), a.site, b.site) k FROM sites a JOIN sites b ON a.site < b.site JOIN snapped s ON s.site = b.site JOIN acc ON acc.site = a.site AND acc.r = s.r AND acc.c = s.c),
both_ways AS (SELECT from_id a, to_id b, k FROM ranked UNION ALL SELECT to_id, from_id, k FROM ranked),
minimax(a, b, k) USING KEY (a, b) AS (SELECT a, b, k FROM both_ways UNION SELECT a, b, k FROM (SELECT m.a, e.b, min(greatest(m.k, e.k)) k FROM minimax m JOIN both_ways e ON m.b = e.a WHERE m.a <> e.b GROUP BY ALL) n WHERE NOT EXISTS (FROM recurring.minimax x WHERE x.a = n.a AND x.b = n.b AND x.k <= n.k))
SELECT from_id, to_id, cost FROM ranked JOIN minimax m ON m.a = from_id AND m.b = to_id WHERE ranked.k = m.k""",
    "route_lengths": f"{_WITH}, {_SITES}, {_PAIRS}, {_ROUTES} SELECT * FROM routes",
    "route_vertices": f"{_WITH}, {_SITES}, {_PAIRS}, {_ROUTES} SELECT from_id, to_id, max(back) OVER (PARTITION BY from_id, to_id) - back k, r, c FROM walk",
    "vertices_on_barriers": f"{_WITH}, {_SITES}, {_PAIRS}, {_ROUTES} SELECT from_id, to_id, count(*) vertices, count(*) FILTER (WHERE barrier) blocked FROM walk JOIN static USING (r, c) GROUP BY from_id, to_id HAVING blocked > 0",
    "detour_factors": f"{_WITH}, {_SITES}, {_PAIRS}, {_ROUTES} SELECT from_id, to_id, round(length_km / (sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) * 0.1::DOUBLE), 6) factor FROM routes JOIN snapped a ON a.site = from_id JOIN snapped b ON b.site = to_id WHERE a.r <> b.r OR a.c <> b.c",
    "route_class_km": f"{_WITH}, {_SITES}, {_PAIRS}, {_ROUTES}, bits AS (SELECT r, c, {_BITS} b FROM held) SELECT e.from_id, e.to_id, {', '.join(f'round(coalesce(sum(n) FILTER (WHERE b & {mask}::BIGINT <> 0), 0) / 10, 4) {name}' for name, mask in (('km_nature', 6), ('km_group', 56), ('km_added', 25769803840), ('km_discount', 128)))} FROM ends e LEFT JOIN trodden t USING (from_id, to_id) LEFT JOIN bits b ON b.r = t.r AND b.c = t.c GROUP BY ALL",
    "route_shorter_than_straight": f"{_WITH}, {_SITES}, {_PAIRS}, {_ROUTES} SELECT from_id, to_id, length_km FROM routes JOIN snapped a ON a.site = from_id JOIN snapped b ON b.site = to_id WHERE (a.r <> b.r OR a.c <> b.c) AND length_km + 0.001 < sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) * 0.1",
    "corridor_cells": f"{_WITH}, {_SITES}, {_PAIRS}, {_CORRIDOR} SELECT from_id, to_id, r, c, band FROM bands WHERE band IS NOT NULL",
    "corridor_area": f"{_WITH}, {_SITES}, {_PAIRS}, {_CORRIDOR} SELECT from_id, to_id, t AS tolerance, round(count(*) * 10000.0::DOUBLE / 1e6, 1) km2 FROM bands JOIN (VALUES (0, 0.01::DOUBLE), (1, 0.03::DOUBLE)) v(k, t) ON k >= band GROUP BY ALL",
    "corridor_rings": f"{_WITH}, {_SITES}, {_PAIRS}, {_CORRIDOR}, cs AS (SELECT from_id * 1000 + to_id g, r, c FROM bands WHERE band IS NOT NULL), {_TRACED} SELECT CAST(g // 1000 AS INT) from_id, CAST(g % 1000 AS INT) to_id, count(*) FILTER (WHERE area > 0) shells, count(*) FILTER (WHERE area < 0) holes, CAST(sum(corners) AS BIGINT) corners, sum(area) area FROM traced WHERE area > 0 OR area <= -2 GROUP BY g",
    "detour_summary": f"{_WITH}, {_SITES}, {_PAIRS}, {_ROUTES}, f AS (SELECT length_km / (sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) * 0.1::DOUBLE) f FROM routes JOIN snapped a ON a.site = from_id JOIN snapped b ON b.site = to_id WHERE a.r <> b.r OR a.c <> b.c) SELECT count(*) routes, round(min(f), 6) least, round(median(f), 6) median, round(max(f), 6) most, count(*) FILTER (WHERE f > 1.2) beyond FROM f",
    "route_compare": f"{_WITH}, {_SITES}, {_PAIRS}, e AS (SELECT from_id, to_id, cost x FROM costs WHERE (from_id + to_id) % 11 <> 0), a AS (SELECT from_id, to_id, CASE WHEN to_id % 7 = 3 THEN 0 ELSE cost * (1 + (from_id + to_id) % 3 * 0.004::DOUBLE) END y FROM costs WHERE (from_id + to_id) % 13 <> 0), j AS (SELECT x, y, abs(x - y) / x error FROM e FULL JOIN a USING (from_id, to_id)) SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) compared, count(*) FILTER (WHERE y IS NULL) missing, count(*) FILTER (WHERE x IS NULL) unexpected, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND (x <= 0 OR y <= 0)) AS invalid, count(*) FILTER (WHERE x > 0 AND y > 0 AND error > 0.005) beyond, round(max(error) FILTER (WHERE x > 0 AND y > 0), 6) largest, round(avg(error) FILTER (WHERE x > 0 AND y > 0), 6) mean, false passed FROM j",
    "site_problems": f"{_WITH}, {_POINT_SITES}, per AS (SELECT site, r, c, count(*) OVER (PARTITION BY r, c) n FROM put WHERE k = 1) SELECT site, 'outside' problem FROM spots WHERE x < 0 OR y < 0 OR x >= 5000 OR y >= h * 100 UNION ALL SELECT site, 'too far' FROM spots WHERE NOT (x < 0 OR y < 0 OR x >= 5000 OR y >= h * 100) AND site NOT IN (SELECT site FROM put) UNION ALL SELECT site, 'shared cell' FROM per WHERE n > 1",
    "placed_sites": f"{_WITH}, {_POINT_SITES} SELECT site, r, c, round(d, 6) metres FROM put WHERE k = 1",
    "merged_lines": """WITH RECURSIVE e AS (SELECT o_orderkey part, o_orderkey % 1000 x1, o_orderkey // 1000 y1, t % 1000 x2, t // 1000 y2 FROM (SELECT *, (o_orderkey * 7 + 3) % (SELECT count(*) FROM orders) t FROM orders) WHERE o_orderpriority NOT LIKE '1%'),
n AS (SELECT part, x1 x, y1 y FROM e UNION ALL SELECT part, x2, y2 FROM e), d AS (SELECT x, y, min(part) a, max(part) b FROM n GROUP BY x, y HAVING count(*) = 2 AND min(part) <> max(part)),
both_ways AS (SELECT a, b FROM d UNION SELECT b, a FROM d), label(part, l) USING KEY (part) AS (SELECT part, part FROM e UNION SELECT part, l FROM (SELECT w.b part, min(k.l) l FROM label k JOIN both_ways w ON w.a = k.part GROUP BY w.b) m WHERE NOT EXISTS (FROM recurring.label o WHERE o.part = m.part AND o.l <= m.l)),
sums AS (SELECT l, count(*) parts, sum(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)) len FROM e JOIN label USING (part) GROUP BY l)
SELECT parts, count(*) AS lines, round(sum(len), 4) AS length FROM sums GROUP BY parts""",
    "cost_grid_compare": f"""{_WITH}, other AS (SELECT r, c, CASE WHEN NOT barrier THEN v4 END x, CASE WHEN NOT barrier THEN CASE WHEN h_r2_2 THEN greatest(1.0, base + nature + people_cost - 1) ELSE base + nature + people_cost END + CASE WHEN h_r1_2 OR h_r3_1 THEN 7 ELSE 0 END + CASE WHEN h_n3_3 THEN 2 ELSE 0 END + CASE WHEN h_a2_3 THEN 0.5 ELSE 0 END END y FROM folded)
SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) compared, count(*) FILTER (WHERE (x IS NULL) <> (y IS NULL)) mismatched, round(max(abs(x - y) / abs(y)), 6) largest, round(avg(abs(x - y) / abs(y)), 6) mean FROM other""",
    "route_set_check": """WITH e AS (SELECT c_custkey a, c_custkey + c_nationkey + 1 b FROM customer), x AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN c_custkey + c_nationkey + 1 ELSE c_custkey END a, CASE WHEN o_orderpriority LIKE '1%' THEN c_custkey ELSE c_custkey + c_nationkey + 1 END b FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT a, b, count(*) n FROM x GROUP BY ALL), u AS (SELECT a, b FROM h ANTI JOIN e USING (a, b))
SELECT 'missing' problem, a from_id, b to_id FROM e ANTI JOIN h USING (a, b) UNION ALL SELECT 'duplicate', a, b FROM h WHERE n > 1 UNION ALL SELECT CASE WHEN EXISTS (FROM e WHERE e.a = u.b AND e.b = u.a) THEN 'reversed' ELSE 'unexpected' END, a, b FROM u""",
    "voltage_parse": "SELECT p_partkey, greatest(p_size * 1000, p_size * 700)::DOUBLE volts FROM part",
    "tag_extract": "SELECT event_id, json_extract_string(props, '$.k') k FROM events",
    "tag_filters": "SELECT CASE p_type WHEN 'STANDARD' THEN 'general' WHEN 'MEDIUM' THEN 'general' WHEN 'PROMO' THEN 'sale' END layer, p_size % 2 = 0 gas, p_name LIKE 'red%' OR p_name LIKE '%bolt' named, count(*) n, round(sum(p_retailprice), 2) price FROM part GROUP BY ALL",
    "features_in_box": f"WITH {_BOXES} SELECT feature FROM edges GROUP BY feature HAVING NOT (max(greatest(x1, x2)) < 10 OR min(least(x1, x2)) > 20.5 OR max(greatest(y1, y2)) < 12 OR min(least(y1, y2)) > 18.25)",
    "cost_colours": f"""{_WITH}, open AS (SELECT simple v FROM cells WHERE NOT building), ends AS (SELECT round(quantile_cont(v, 0.02), 6) a, round(quantile_cont(v, 0.98), 6) b FROM open), shares AS (SELECT greatest(0, least(1, (round(v, 6) - a) / (b - a))) s FROM open, ends)
SELECT CASE WHEN s <= 0.5 THEN printf('#%02x%02x%02x', floor(26 + 229 * s * 2 + 0.5)::INT, floor(152 + 103 * s * 2 + 0.5)::INT, floor(80 + 111 * s * 2 + 0.5)::INT) ELSE printf('#%02x%02x%02x', floor(255 - 40 * (s * 2 - 1) + 0.5)::INT, floor(255 - 207 * (s * 2 - 1) + 0.5)::INT, floor(191 - 152 * (s * 2 - 1) + 0.5)::INT) END colour, count(*) n FROM shares GROUP BY 1""",
    "zone_routing": "SELECT CASE (l_linenumber - 1) % 7 WHEN 0 THEN 'marine_shipping' WHEN 1 THEN 'marine_renewables' WHEN 2 THEN 'marine_renewables' WHEN 5 THEN 'marine_cable_corridor' ELSE 'marine_materials' END layer, count(*) n FROM lineitem WHERE (l_linenumber - 1) % 7 < 6 GROUP BY ALL",
    "status_classify": "SELECT CASE o_orderstatus WHEN 'O' THEN 'planned' ELSE 'barrier' END category, count(*) n, round(sum(o_totalprice), 2) total FROM orders GROUP BY ALL",
    "id_exclude": "SELECT l_returnflag, count(*) n FROM lineitem WHERE NOT EXISTS (FROM customer WHERE l_orderkey = c_custkey * 3 OR l_orderkey = c_custkey * 5) GROUP BY ALL",
    "dedup_first": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "points_along_line": f"WITH {_POINTS} SELECT feature, k, round(x, 6) x, round(y, 6) y FROM points",
    "line_offset_stats": f"""WITH {_POINTS}, {_BOXES}, apart AS (SELECT p.feature, k, x, y, x1, y1, x2 - x1 dx, y2 - y1 dy, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) t FROM points p JOIN edges e ON e.feature = p.other),
least_of AS (SELECT feature, k, min(sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)) d FROM apart GROUP BY ALL)
SELECT feature, round(avg(d), 5) mean, round(quantile_cont(d, 0.5), 5) median, round(quantile_cont(d, 0.9), 5) p90, round(max(d), 5) most, round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0 END), 5) within_1, round(avg(CASE WHEN d <= 5 THEN 1.0 ELSE 0 END), 5) within_5 FROM least_of GROUP BY feature""",
    "quantile_scale_orders": f"WITH {_quantiles('q', 'orders', 'o_totalprice', 1, 10, 10, 1).strip()} SELECT o_orderkey, round(score, 6) score FROM {_scaled('q', 'orders', 'o_totalprice')}",
    "scenario_multipliers": f"{_WITH} " + " UNION ALL ".join(
        f"SELECT '{x.name}' layer, {w!r}::DOUBLE weight, count(v) cells, round(sum(v), 3) total FROM (SELECT CASE WHEN NOT (building{'' if x.name == 'a1_0' and not w else ' OR h_a1_0'}) THEN CASE WHEN h_r2_2 AND {w if x.name == 'r2_2' else 1} > 0 THEN greatest(1.0, s - {w if x.name == 'r2_2' else 1.0}) ELSE s END + CASE WHEN h_n3_3 THEN 2.0 * {w if x.name == 'n3_3' else 1} ELSE 0 END + CASE WHEN h_a2_3 THEN 0.5 * {w if x.name == 'a2_3' else 1} ELSE 0 END END::DOUBLE v FROM (SELECT *, base"
        + f" + greatest({', '.join(f'CASE WHEN h_{n} THEN {s} * {w if x.name == n else 1} ELSE 0 END' for n, s in (('n1_1', 6.0), ('n2_1', 4.0), ('r4_4', 8.0)))}) + greatest({', '.join(f'CASE WHEN h_{n} THEN {s} * {w if x.name == n else 1} ELSE 0 END' for n, s in (('a3_4', 5.0), ('r5_2', 3.0)))}) + greatest({', '.join(f'CASE WHEN h_{n} THEN 7.0 * {w if x.name == n else 1} ELSE 0 END' for n in ('r1_2', 'r3_1'))}) s FROM static))"
        for x in RULES.layers for w in (0.0, 0.5, 1.0, 1.5)
    ),
}


def _halved_or_doubled() -> str:
    """Every layer's score times 0.5 and 2, the rules written out again."""
    runs = []
    for x in RULES.layers:
        for f in (0.5, 2.0):
            w = {y.name: f if y.name == x.name else 1.0 for y in RULES.layers}
            score = lambda n, s: f"CASE WHEN h_{n} THEN {s} * {w[n]} ELSE 0 END"  # noqa: B023, E731
            grouped = f"base + greatest({score('n1_1', 6)}, {score('n2_1', 4)}, {score('r4_4', 8)}) + greatest({score('a3_4', 5)}, {score('r5_2', 3)}) + greatest({score('r1_2', 7)}, {score('r3_1', 7)})"
            other = f"CASE WHEN NOT barrier THEN CASE WHEN h_r2_2 THEN greatest(1.0, {grouped} - {w['r2_2']}) ELSE {grouped} END + {score('n3_3', 2)} + {score('a2_3', 0.5)} END::DOUBLE"
            runs.append(f"SELECT '{x.name}' layer, {f!r}::DOUBLE factor, round(sum(o) / sum(v) - 1, 6) AS change, count(*) FILTER (WHERE o <> v) cells FROM (SELECT {other} o, (CASE WHEN NOT barrier THEN v4 END)::DOUBLE v FROM folded)")
    return f"{_WITH} " + " UNION ALL ".join(runs)


ORACLE_SQL["sensitivity_summary"] = _halved_or_doubled()
ORACLE_SQL["tree_check"] = f"WITH RECURSIVE net AS ({ORACLE_SQL['spanning_network']}), placed AS ({ORACLE_SQL['snap_sites']}) SELECT count(*) edges, (SELECT count(*) FROM placed) nodes, 1::BIGINT parts, count(*) - (SELECT count(*) FROM placed) + 1 AS cycles, count(*) = (SELECT count(*) FROM placed) - 1 is_tree FROM net"
ORACLE_SQL["order_graph_check"] = """WITH RECURSIVE edges AS (SELECT o_custkey a, -1 - s_nationkey b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45),
nodes AS (SELECT c_custkey site FROM customer UNION ALL SELECT -1 - n_nationkey FROM nation), both_ways AS (SELECT DISTINCT a, b FROM edges UNION SELECT b, a FROM edges),
label(site, l) USING KEY (site) AS (SELECT site, site FROM nodes UNION SELECT site, l FROM (SELECT e.b site, min(x.l) l FROM label x JOIN both_ways e ON x.site = e.a GROUP BY e.b) m WHERE NOT EXISTS (FROM recurring.label k WHERE k.site = m.site AND k.l <= m.l)),
n AS (SELECT (SELECT count(*) FROM edges) edges, (SELECT count(*) FROM nodes) nodes, (SELECT count(DISTINCT l) FROM label) parts)
SELECT edges, nodes, parts, edges - nodes + parts AS cycles, parts = 1 AND edges = nodes - 1 is_tree FROM n"""


def _scenario_rows() -> str:
    """Name, scores and factors of each run of the suite, written out again."""
    scores = {"n1_1": 6, "n2_1": 4, "r4_4": 8, "a3_4": 5, "r5_2": 3, "r1_2": 7, "r2_2": 1, "n3_3": 2, "a2_3": 0.5, "r3_1": 7, "a4_4": 2}
    keys = {x: "r1_2" if x == "r3_1" else x for x in scores}
    rows = [("baseline", scores, 1, 0.8), *((f"{key} x {f}", {x: v * (f if keys[x] == key else 1) for x, v in scores.items()}, 1, 0.8) for key in dict.fromkeys(keys.values()) for f in (0.5, 1.5))]
    rows += [("near x 0.5", scores, 0.5, 0.8), ("near x 1.5", scores, 1.5, 0.8), ("band 0.6", scores, 1, 0.6), ("band 1.0", scores, 1, 1.0)]
    return ", ".join(f"('{name}', {', '.join(f'{float(v)!r}::DOUBLE' for v in (*values.values(), near, band))})" for name, values, near, band in rows)


_MOST = lambda *names: "greatest(0, " + ", ".join(f"CASE WHEN h_{n} THEN s_{n} ELSE 0 END" for n in names) + ")"
_SUITE = f"""{_PARTS}, scen(scenario, s_n1_1, s_n2_1, s_r4_4, s_a3_4, s_r5_2, s_r1_2, s_r2_2, s_n3_3, s_a2_3, s_r3_1, s_a4_4, near_factor, band_factor) AS (VALUES {_scenario_rows()}),
grouped AS (SELECT *, base + {_MOST("n1_1", "n2_1", "r4_4")} + {_MOST("a3_4", "r5_2")} + {_MOST("r1_2", "r3_1")} g FROM nearby, scen WHERE NOT barrier),
lessened AS (SELECT *, CASE WHEN h_r2_2 THEN greatest(1.0, g - s_r2_2) ELSE g END + {_MOST("n3_3")} + {_MOST("a2_3")} + CASE WHEN surface = 'land' THEN coalesce(near_cost, 0) * near_factor ELSE 0 END l FROM grouped),
field AS (SELECT scenario, r, c, CASE WHEN in_band THEN greatest(0.4, l * band_factor) ELSE l END + greatest(coalesce(pop, 0), coalesce(risk, 0), {_MOST("a4_4")}) + simple / 100 AS cost FROM lessened JOIN (SELECT r, c, simple FROM cells) USING (r, c)),
{_SITES[: _SITES.index("open AS")]}snapped AS (SELECT site, role, r, c FROM (SELECT s.site, s.role, o.r, o.c, (s.r - o.r) * (s.r - o.r) + (s.c - o.c) * (s.c - o.c) d2 FROM sites s JOIN field o ON o.scenario = 'baseline' AND abs(s.r - o.r) <= 3 AND abs(s.c - o.c) <= 3)
  WHERE d2 <= 9 QUALIFY row_number() OVER (PARTITION BY site ORDER BY d2, r, c) = 1),
steps AS (SELECT a.scenario, a.r, a.c, b.r r2, b.c c2, CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END n, (a.cost + b.cost) / 2 * CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END w FROM field a JOIN field b ON a.scenario = b.scenario AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)),
acc(scenario, site, r, c, acc) USING KEY (scenario, site, r, c) AS (SELECT scenario, site, r, c, 0.0::DOUBLE FROM snapped, scen WHERE role = 'source' UNION
  SELECT scenario, site, r, c, acc FROM (SELECT a.scenario, a.site, s.r2 r, s.c2 c, min(a.acc + s.w) acc FROM acc a JOIN steps s ON a.scenario = s.scenario AND a.r = s.r AND a.c = s.c GROUP BY ALL) n
  WHERE NOT EXISTS (FROM recurring.acc k WHERE k.scenario = n.scenario AND k.site = n.site AND k.r = n.r AND k.c = n.c AND k.acc <= n.acc)),
best AS (SELECT scenario, a.site from_id, s.site to_id, s.r, s.c, round(acc, 9) AS cost FROM acc a JOIN snapped s ON s.role = 'storage' AND s.r = a.r AND s.c = a.c QUALIFY row_number() OVER (PARTITION BY scenario, a.site ORDER BY round(acc, 9), s.site) = 1)"""
ORACLE_SQL["sensitivity_runs"] = f"{_SUITE} SELECT scenario, from_id, to_id, round(cost, 6) AS cost FROM best"
ORACLE_SQL["sensitivity_outcomes"] = f"""{_SUITE},
hop AS (SELECT a.scenario, a.site, a.r, a.c, f.r r0, f.c c0, s.n FROM acc a JOIN steps s ON s.scenario = a.scenario AND s.r2 = a.r AND s.c2 = a.c JOIN acc f ON f.scenario = a.scenario AND f.site = a.site AND f.r = s.r AND f.c = s.c WHERE a.acc > 0
  QUALIFY row_number() OVER (PARTITION BY a.scenario, a.site, a.r, a.c ORDER BY round(f.acc + s.w, 9), f.r, f.c) = 1),
walk AS (SELECT scenario, from_id, r, c FROM best UNION ALL SELECT w.scenario, w.from_id, h.r0, h.c0 FROM walk w JOIN hop h ON h.scenario = w.scenario AND h.site = w.from_id AND h.r = w.r AND h.c = w.c),
shared AS (SELECT w.scenario, w.from_id, avg(CASE WHEN EXISTS (FROM walk b WHERE b.scenario = 'baseline' AND b.from_id = w.from_id AND (b.r - w.r) * (b.r - w.r) + (b.c - w.c) * (b.c - w.c) <= 4) THEN 1.0 ELSE 0.0 END) share, sum(coalesce(h.n, 0)) * 0.1 km FROM walk w LEFT JOIN hop h ON h.scenario = w.scenario AND h.site = w.from_id AND h.r = w.r AND h.c = w.c GROUP BY w.scenario, w.from_id)
SELECT a.scenario, count(*) sources, count(*) FILTER (WHERE a.to_id <> b.to_id) best_changed, round(avg(CASE WHEN b.cost > 0 THEN a.cost / b.cost - 1 END), 6) cost_change, round(avg(CASE WHEN y.km > 0 THEN x.km / y.km - 1 END), 6) length_change, round(avg(x.share), 6) share_within
FROM best a JOIN best b ON b.scenario = 'baseline' AND b.from_id = a.from_id JOIN shared x ON x.scenario = a.scenario AND x.from_id = a.from_id JOIN shared y ON y.scenario = 'baseline' AND y.from_id = a.from_id GROUP BY a.scenario"""
