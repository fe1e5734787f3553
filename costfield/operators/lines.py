"""Polylines as rows of vertices (line, k, x, y): simplification by rounds of splits, parts merged to lines by list ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costfield.shared import materialise, release

#: Rows that a task of a merge of lines' parts takes, about: partitions follow the rows, so that a task's sorts don't grow with the input.
TASK_ROWS = 500_000


def _shares(rows: int, spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _apart() -> Column:
    """The distance of (x, y) from the stretch between (ax, ay) and (bx, by)."""
    x, y, ax, ay, bx, by = map(F.col, ("x", "y", "ax", "ay", "bx", "by"))
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / F.nullif(square, F.lit(0.0)))))
    dx, dy = x - ax - t * (bx - ax), y - ay - t * (by - ay)
    return F.sqrt(dx * dx + dy * dy)  # as the SQL has it: ``hypot`` rounds otherwise, and so parts distances that are equal


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """The vertices (line, k, x, y) that are left when each line strays from the original by ``tolerance`` at most (Douglas and Peucker).

    Each round splits every stretch whose farthest vertex is beyond the tolerance at that vertex (of several, the first), all stretches of all lines at once; the
    vertices of a stretch within it go. Sums are partial before an exchange, so a line of any length is no single task's. ``k`` orders a
    line's vertices and is kept; its first and last vertex always stay.
    """
    point = lambda which: which(F.struct("k", "x", "y"))
    ends = vertices.groupBy("line").agg(point(F.min).alias("a"), point(F.max).alias("b"))
    corners = F.explode(F.array_distinct(F.array("a", "b"))).alias("v")
    kept = [materialise(ends.select("line", corners).select("line", "v.*"), "corners")]
    spans = ends.select("line", F.col("a.k").alias("a"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.k").alias("b"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    inner = materialise(vertices.select("line", "k", "x", "y").join(spans, "line").filter("k > a and k < b"), "inner")
    while True:
        far = inner.withColumn("d", _apart()).groupBy("line", "a").agg(F.max(F.struct("d", (-F.col("k")).alias("k"), "x", "y")).alias("f")).filter(F.col("f.d") > tolerance)
        split = materialise(far.select("line", "a", (-F.col("f.k")).alias("s"), F.col("f.x").alias("sx"), F.col("f.y").alias("sy")), "splits")
        kept.append(split.select("line", F.col("s").alias("k"), F.col("sx").alias("x"), F.col("sy").alias("y")))
        left = F.col("k") < F.col("s")
        at = [F.when(left, F.col(old)).otherwise(F.col(new)).alias(old) for old, new in (("a", "s"), ("ax", "sx"), ("ay", "sy"))]
        at += [F.when(left, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in (("b", "s"), ("bx", "sx"), ("by", "sy"))]
        following = materialise(inner.join(split, ["line", "a"]).filter("k <> s").select("line", "k", "x", "y", *at), "inner")
        release(inner)
        inner = following
        if inner.isEmpty():
            return reduce(DataFrame.union, kept)


def lengths(vertices: DataFrame) -> DataFrame:
    """(line, vertices, length) of polylines."""
    order = Window.partitionBy("line").orderBy("k")
    step = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    return vertices.select("line", step.alias("step")).groupBy("line").agg(F.count("*").alias("vertices"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def _followed(links: DataFrame) -> DataFrame:
    """(id, to, left, end, least): from each ``id`` along the links (id, to) by pointer doubling, with how many links there are to the end, the end, and the least id on the way. ``to`` is null but on closed ways.

    Ids that stand at their end are looked up, but not joined any more: all of them have the null of ``to`` in common and would meet in one task.
    """
    shares = _shares(links.count(), links.sparkSession)
    now = materialise(links.select("id", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("left"), F.coalesce("to", "id").alias("end"), F.least("id", F.coalesce("to", "id")).alias("least")), "links")
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("left").alias("more"), F.col("end").alias("far"), F.col("least").alias("low"))
        live, there = now.filter("to is not null"), now.filter("to is null")
        joined = live.repartition(shares, "to").join(ahead.repartition(shares, "to").hint("merge"), "to", "left")
        found = joined.select("id", F.col("next").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), F.coalesce("far", "end").alias("end"), F.least("least", F.coalesce("low", "least")).alias("least"), (F.coalesce(F.col("low") < F.col("least"), F.lit(False)) | (F.col("to").isNotNull() & F.col("next").isNull())).alias("moved"))
        following = materialise(found.union(there.select("id", "to", "left", "end", "least", F.lit(False).alias("moved"))), "links")
        done = following.filter("moved").isEmpty()
        release(now)
        now = following
        if done:
            return now


def merged(vertices: DataFrame) -> DataFrame:
    """(line, k, x, y): the parts (part, k, x, y) joined to lines where exactly two ends of different parts meet; ``line`` is the least part of each.

    Parts keep their vertices; one is turned round where that takes it on, and the point where two meet is there once. Where one, three or more ends meet, lines end.
    Closed lines begin with their least part. Chains are ranked by pointer doubling, so the rounds are the logarithm of the longest, and none has to fit a task.
    """
    shares = _shares(vertices.count(), vertices.sparkSession)
    ends = vertices.groupBy("part").agg(F.min(F.struct("k", "x", "y")).alias("a"), F.max(F.struct("k", "x", "y")).alias("b"))
    # A part is gone along forwards (2 part) or backwards (2 part + 1); ``out`` is the way that leaves a node along the part.
    node = F.explode(F.array(F.struct(F.col("a.x").alias("x"), F.col("a.y").alias("y"), (F.col("part") * 2).alias("out")), F.struct(F.col("b.x").alias("x"), F.col("b.y").alias("y"), (F.col("part") * 2 + 1).alias("out")))).alias("n")
    met = ends.select("part", node).select("n.*").repartition(shares, "x", "y").groupBy("x", "y").agg(F.count("*").alias("n"), F.min("out").alias("p"), F.max("out").alias("q"))
    met = met.filter((F.col("n") == 2) & (F.floor(F.col("p") / 2) != F.floor(F.col("q") / 2)))
    turned = lambda k: F.col(k).bitwiseXOR(F.lit(1).cast("long"))
    joints = met.select(turned("p").alias("id"), F.col("q").alias("to")).union(met.select(turned("q").alias("id"), F.col("p").alias("to")))
    ways = ends.select(F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)).alias("id"))
    links = materialise(ways.repartition(shares, "id").join(joints.repartition(shares, "id").hint("merge"), "id", "left").select(F.col("id").cast("long").alias("id"), F.col("to").cast("long").alias("to")), "links")
    once = _followed(links)
    # A closed way is cut before its least id.
    closed = once.filter("to is not null").select("id", "least")
    cut = links.repartition(shares, "id").join(closed.repartition(shares, "id").hint("merge"), "id", "left").select("id", F.when(F.col("least").isNull() | (F.col("to") != F.col("least")), F.col("to")).alias("to"))
    ranked = _followed(cut)
    # Each line is there in both directions: an open one's way counts that begins with the lower id, a closed one's that begins with its least part forwards.
    back = ranked.select(turned("id").alias("id"), turned("end").alias("start"))
    open_ways = ranked.repartition(shares, "id").join(closed.repartition(shares, "id").hint("merge"), "id", "left_anti").join(back.repartition(shares, "id").hint("merge"), "id").filter(F.col("start") <= turned("end")).select("id", "left", "end")
    closed_ways = ranked.join(closed.withColumnRenamed("least", "first"), "id").filter("first % 2 = 0").select("id", "left", "end")
    chosen = materialise(open_ways.union(closed_ways), "ways")
    release(links, once, ranked)
    named = chosen.groupBy("end").agg(F.min(F.floor(F.col("id") / 2)).alias("line"), F.max("left").alias("all"))
    placed = chosen.join(named, "end").select(F.floor(F.col("id") / 2).alias("part"), (F.col("id") % 2 == 1).alias("back"), "line", (F.col("all") - F.col("left")).alias("rank"))
    along = F.when(F.col("back"), -F.col("k")).otherwise(F.col("k"))
    each = vertices.join(placed, "part").withColumn("along", along)
    first = F.row_number().over(Window.partitionBy("part").orderBy("along"))
    kept = each.withColumn("first", first).filter("rank = 0 or first > 1")
    order = Window.partitionBy("line").orderBy("rank", "along")
    return kept.select("line", (F.row_number().over(order) - 1).cast("long").alias("k"), "x", "y")


def farthest_ends(vertices: DataFrame) -> DataFrame:
    """One row (x1, y1, x2, y2): the two ends of lines (line, k, x, y) that are farthest apart. Lines are few here: all pairs of their ends are looked at."""
    ends = vertices.groupBy("line").agg(F.min(F.struct("k", "x", "y")).alias("a"), F.max(F.struct("k", "x", "y")).alias("b"))
    point = ends.select(F.explode(F.array("a", "b")).alias("p")).select("p.x", "p.y").distinct()
    other = point.select(F.col("x").alias("u"), F.col("y").alias("v"))
    apart = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    best = point.join(other, F.struct("x", "y") <= F.struct("u", "v")).agg(F.max(F.struct(apart.alias("d"), "x", "y", "u", "v")).alias("m"))
    return best.select(F.col("m.x").alias("x1"), F.col("m.y").alias("y1"), F.col("m.u").alias("x2"), F.col("m.v").alias("y2"))
