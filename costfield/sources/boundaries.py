"""Boundary files in the .poly format, as ring vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(path, ring, hole, k, x, y) of every vertex of the files at ``path``; a section named with ``!`` is a hole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("k", "line")).withColumn("line", F.trim("line")).filter("k > 0 and line <> ''")
    point = r"^(\S+)\s+(\S+)$"
    order = Window.partitionBy("path").orderBy("k")
    marked = lines.withColumn("is_point", F.col("line").rlike(r"^[-+0-9.eE]+\s+[-+0-9.eE]+$")).withColumn("is_name", ~F.col("is_point") & (F.col("line") != "END"))
    ringed = marked.withColumn("ring", F.sum(F.col("is_name").cast("int")).over(order)).withColumn("hole", F.last(F.when(F.col("is_name"), F.col("line").startswith("!")), True).over(order))
    return ringed.filter("is_point").select("path", "ring", "hole", "k", F.regexp_extract("line", point, 1).cast("double").alias("x"), F.regexp_extract("line", point, 2).cast("double").alias("y"))


def boundary_rings(vertices: DataFrame) -> DataFrame:
    """The rings that bound an area: a file's holes count only where it has one outer ring, as they don't say which ring they are in. A file without an outer ring is an error, raised where the rows are read."""
    outer = vertices.groupBy("path").agg(F.count_distinct(F.when(~F.col("hole"), F.col("ring"))).alias("outer"))
    held = vertices.join(outer, "path").filter(F.when(F.col("outer") == 0, F.raise_error(F.concat(F.lit("no boundary in "), "path")).cast("boolean")).otherwise(~F.col("hole") | (F.col("outer") == 1)))
    return held.select(vertices.columns)


def ring_areas(vertices: DataFrame) -> DataFrame:
    """(path, ring, hole, area) by the shoelace rule."""
    w = Window.partitionBy("path", "ring").orderBy("k")
    first = Window.partitionBy("path", "ring").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    turns = vertices.select("path", "ring", "hole", (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("turn"))
    return turns.groupBy("path", "ring", "hole").agg((F.abs(F.sum("turn")) / 2).alias("area"))
