"""The driver's tables as grids, layers, people, sites and features. All rows of a table are used, at every scale.

Cell p of ``part`` lies at row p div 50, column p mod 50. Every ``lineitem`` puts a layer on its part's cell, named by its
return flag, line number and quantity; those sold as R also bring people. ``nation`` gives sites, ``customer`` boxes, ``orders`` lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costfield.operators.cost import Layer, Rules, Scenario

RULES = Rules(
    layers=[
        Layer("a1_0", "barrier", bit=1),
        Layer("n1_1", "group", 6, "nature", "land", 2),
        Layer("n2_1", "group", 4, "nature", "land", 4),
        Layer("r4_4", "group", 8, "nature", "any", 8),
        Layer("a3_4", "group", 5, "people", "any", 16),
        Layer("r5_2", "group", 3, "people", "any", 32),
        Layer("r1_2", "add", 7, bit=64),
        Layer("r2_2", "discount", 1, bit=128),
        Layer("n3_3", "add", 2, surface="land", bit=1 << 33),
        Layer("a2_3", "add", 0.5, bit=1 << 34),
        Layer("r3_1", "add", 7, bit=1 << 39, key="r1_2"),
        Layer("a4_4", "group", 2, "living", bit=1 << 40),
    ],
    band=("n3_3", 100.0, 200.0, 0.8, 0.4),
    bits={"near": 1 << 35, "band": 1 << 36, "population": 1 << 37, "risk": 1 << 38},
    deferred={"living": ("population", "risk")},
)
TOLERANCES = [0.01, 0.03]
#: The runs of the sensitivity suite: each cost key by two factors, the costs near buildings too, and two factors of the band.
SCENARIOS = [Scenario("baseline")]
for _key in dict.fromkeys(x.cost_key for x in RULES.layers if x.kind != "barrier"):
    for _factor in (0.5, 1.5):
        SCENARIOS.append(Scenario(f"{_key} x {_factor}", {x.name: x.score * _factor for x in RULES.layers if x.cost_key == _key}))
SCENARIOS += [Scenario("near x 0.5", near=0.5), Scenario("near x 1.5", near=1.5), Scenario("band 0.6", band=0.6), Scenario("band 1.0", band=1.0)]
#: Classes of routes, each with the bits of its layers.
ROUTE_CLASSES = {"km_nature": 2 | 4, "km_group": 8 | 16 | 32, "km_added": 64 | 1 << 33 | 1 << 34, "km_discount": 128}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(table(spark, d, "part")).drop("cost")


def _cells(part: DataFrame) -> DataFrame:
    cost = F.when(F.col("p_size") % 7 != 0, F.lit(0.4) + F.col("p_size") / 10 + F.col("p_retailprice") / 100000)
    return part.select(F.floor(F.col("p_partkey") / 50).cast("int").alias("r"), (F.col("p_partkey") % 50).cast("int").alias("c"), F.when(F.col("p_size") % 10 == 0, "sea").otherwise("land").alias("surface"), (F.col("p_size") % 7 == 0).alias("building"), F.col("p_size").alias("size"), cost.alias("cost"))


def simple_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cells with a cost that ties hardly ever: part size and price; buildings have none. One pass over the parts, as each search asks for it several times."""
    return _cells(table(spark, d, "part")).select("r", "c", "surface", "cost")


def tie_free(spark: SparkSession, d: str) -> DataFrame:
    """The cells, with a little of their simple cost to add to others so that these hardly ever tie."""
    return _cells(table(spark, d, "part")).withColumn("little", F.col("cost") / 100).drop("cost")


def presence(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    name = F.concat(F.lower("l_returnflag"), F.col("l_linenumber").cast("string"), F.lit("_"), F.floor(F.col("l_quantity") / 10).cast("string"))
    return line.select(name.alias("layer"), F.floor(F.col("l_partkey") / 50).cast("int").alias("r"), (F.col("l_partkey") % 50).cast("int").alias("c")).distinct()


def population(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("people"))
    return sold.select(F.floor(F.col("l_partkey") / 50).cast("int").alias("r"), (F.col("l_partkey") % 50).cast("int").alias("c"), "people")


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites (site, role, r, c) spread over the grid, some of them on cells without cost."""
    n = table(spark, d, "part").agg(F.count("*").alias("n"))
    nation = table(spark, d, "nation").crossJoin(F.broadcast(n))
    at = F.pmod(F.col("n_nationkey") * 79 + F.floor(F.col("n") / 2), F.col("n"))
    role = F.when(F.col("n_nationkey") % 5 == 0, "source").otherwise("storage")
    return nation.select(F.col("n_nationkey").cast("int").alias("site"), role.alias("role"), F.floor(at / 50).cast("int").alias("r"), (at % 50).cast("int").alias("c"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """A triangle (feature and its edges, in cell units) for each customer."""
    k = F.col("c_custkey")
    corners = F.array(*(F.struct((k % 47 + dx).cast("double").alias("x"), (F.floor(k / 47) % 37 + dy).cast("double").alias("y")) for dx, dy in ((0.13, 0.21), (3.37, 0.89), (1.41, 3.77))))
    edges = table(spark, d, "customer").select(k.alias("feature"), F.posexplode(F.arrays_zip(corners.alias("a"), F.concat(F.slice(corners, 2, 2), F.slice(corners, 1, 1)).alias("b"))).alias("k", "e"))
    return edges.select("feature", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """A segment in cell units for each order."""
    k, to = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(k.alias("feature"), (k % 47 + 0.13).alias("x1"), (F.floor(k / 47) % 37 + 0.29).alias("y1"), (k % 47 + 0.13 + to % 7 - 2.5).alias("x2"), (F.floor(k / 47) % 37 + 0.29 + to % 5 - 1.75).alias("y2"))
