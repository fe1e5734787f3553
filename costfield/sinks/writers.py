"""Writers of results. An empty result is refused, so that a failed run can't pass for one without routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costfield.sources.config import fingerprint


def features(rows: DataFrame, geometry: Column, places: int = 6) -> DataFrame:
    """A GeoJSON feature a row (``value``): all columns but those that begin with an underscore are properties."""
    properties = [F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes if not c.startswith("_")]
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def line(points: Column) -> Column:
    """The GeoJSON line of an array of (x, y) structs."""
    return F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))


def areas(polygons: Column) -> Column:
    """The GeoJSON geometry of nested polygons, as ``rings.polygons`` gives them."""
    return F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A table with a header, in one file, quotes doubled: for statistics, pairs and sites, which are few."""
    if rows.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    rows.coalesce(1).write.csv(path, header=True, escape='"')


def write_layers(features: DataFrame, path: str) -> None:
    """Features as Parquet, partitioned by ``layer``."""
    if features.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    features.write.partitionBy("layer").parquet(path)


def write_features(rows: DataFrame, geometry: Column, path: str) -> None:
    found = features(rows, geometry)
    if found.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    found.write.text(path)


def write_surface(surface: DataFrame, path: str, config: dict) -> dict:
    """Cells as Parquet, in ranges of rows, and one JSON line of metadata, which is returned."""
    surface.repartitionByRange("r", "c").sortWithinPartitions("r", "c").write.parquet(f"{path}/cells")
    kept = surface.sparkSession.read.parquet(f"{path}/cells")
    totals = kept.agg(F.count("*").alias("cells"), F.count("cost").alias("traversable_cells"), F.min("cost").alias("least_cost"), F.max("cost").alias("greatest_cost")).first().asDict()
    if not totals["traversable_cells"] or totals["least_cost"] <= 0:
        raise ValueError("a surface needs cells that can be entered, all with costs above zero")
    totals["config_sha256"] = fingerprint(config)
    surface.sparkSession.createDataFrame([tuple(totals.values())], ", ".join(f"{k} {'string' if k == 'config_sha256' else 'double' if 'cost' in k else 'long'}" for k in totals)).write.json(f"{path}/metadata")
    return totals


def _changed(spark: SparkSession, paths: list[str], which: Callable) -> list:
    """The time of each path's first or last change; its files aren't read."""
    return [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).agg(which("modificationTime")).first()[0] for p in paths]


def stale(spark: SparkSession, surfaces: list[str], inputs: list[str], config: dict) -> list[str]:
    """Why the ``surfaces`` that ``write_surface`` wrote are out of date; nothing if they are not.

    Each of ``inputs`` is compared with the oldest surface by the time of its last change, the configuration with each surface's fingerprint.
    """
    oldest = min(_changed(spark, surfaces, F.min))
    reasons = [f"{path} is newer than the surfaces" for path, at in zip(inputs, _changed(spark, inputs, F.max), strict=True) if at > oldest]
    now = fingerprint(config)
    recorded = ((path, spark.read.json(f"{path}/metadata").select("config_sha256").first()[0]) for path in surfaces)
    return reasons + [f"{path} was made with another configuration" for path, value in recorded if value != now]
