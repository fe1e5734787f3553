"""Every query with SQL against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from costfield.catalogue import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def listed(rows):
    plain = lambda v: 0.0 if isinstance(v, float) and (v == 0 or math.isnan(v)) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    duck.execute(f"CREATE OR REPLACE TABLE expected AS {ORACLE_SQL[name]}")
    assert sorted(r[0] for r in duck.execute("DESCRIBE expected").fetchall()) == columns
    expected = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM expected").fetchall()
    assert listed(df.select(columns).collect()) == listed(expected)


def test_flagship():
    assert FLAGSHIP in QUERIES


def test_routes_are_no_shorter_than_straight_lines(spark):
    factors = [r.factor for r in QUERIES["detour_factors"](spark, str(TABLES)).collect()]
    assert len(factors) == 100 and min(factors) > 0.999


def broadcasts(spark, run):
    """The MB of each broadcast of all that ``run`` executes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    held = lambda x: [x.apply(k) for k in range(x.size())]
    ids = lambda: {x.executionId() for x in held(store.executionsList())}
    bus.waitUntilEmpty()
    before = ids()
    run()
    bus.waitUntilEmpty()
    found, unit = [], {"B": 1e-6, "KiB": 2**10 / 1e6, "MiB": 2**20 / 1e6, "GiB": 2**30 / 1e6}
    for k in ids() - before:
        values = store.executionMetrics(k)
        for node in held(store.planGraph(k).allNodes()):
            sizes = [m.accumulatorId() for m in held(node.metrics()) if m.name() == "data size"] if node.name() == "BroadcastExchange" else []
            found += [float(number) * unit[name] for x in sizes if values.contains(x) for number, name in [values.apply(x).split("\n")[-1].split()[:2]]]
    return found


@pytest.mark.skipif(not TABLES.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", ["tree_check", "corridor_area", "route_shorter_than_straight"])
def test_no_whole_page_is_broadcast(spark, name):
    # Joins of rounds by three keys took a page of 32 MB or more for few rows, in each round; the sites and pairs take 1 MB.
    sizes = broadcasts(spark, lambda: QUERIES[name](spark, str(TABLES)).collect())
    assert sizes and max(sizes) < 4
