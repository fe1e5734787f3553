"""Site tables as CSV, strict or tolerant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costfield.functions.attributes import optional_amount

# The columns' other names, the box of longitudes and latitudes, and the beginnings of a storage's role.
ALIASES = {"id": ("id",), "name": ("name", "navn"), "role": ("role", "type"), "lon": ("lon", "longitude", "x"), "lat": ("lat", "latitude", "y"), "enabled": ("enabled",)}
BOX = (3.0, 20.0, 53.0, 60.0)
STORAGE = ("stor", "lager")


def read_sites(spark: SparkSession, path: str, amounts: tuple[str, ...] = ()) -> DataFrame:
    """Sites with id, name, role (default ``node``), lon and lat; ``amounts`` are optional numbers of zero or more.

    Blank or repeated ids, blank names and unknown roles are errors, raised where the rows are read.
    """
    table = spark.read.csv(path, header=True, escape='"', encoding="UTF-8")
    table = table.toDF(*(c.lstrip("﻿").strip() for c in table.columns))
    if missing := {"id", "name", "lon", "lat"} - set(table.columns):
        raise ValueError(f"{path} lacks columns: {sorted(missing)}")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    needed = lambda c: F.when(text(c) == "", F.raise_error(F.lit(f"blank {c}"))).otherwise(text(c))
    role = F.lower(text("role")) if "role" in table.columns else F.lit("")
    role = F.when(role == "", "node").when(role.isin("source", "storage", "node"), role).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), role)))
    rest = [optional_amount(F.col(c)).alias(c) if c in amounts else F.col(c) for c in table.columns if c not in ("id", "name", "role", "lon", "lat")]
    sites = table.select(needed("id").alias("id"), needed("name").alias("name"), role.alias("role"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), *rest)
    if repeated := sites.groupBy("id").count().filter("count > 1").select("id").limit(5).collect():
        raise ValueError(f"repeated ids: {[r[0] for r in repeated]}")
    return sites


def read_sites_tolerantly(spark: SparkSession, path: str) -> DataFrame:
    """(row, id, name, role, lon, lat, enabled, error): semicolons, decimal commas and other column names are read too.

    A row outside the box or without coordinates has an error and is for the caller to leave out.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    if first is None:
        raise ValueError("the file is empty")
    separator = ";" if ";" in first[0] and "," not in first[0] else ","
    table = spark.read.csv(path, header=True, sep=separator, escape='"', encoding="UTF-8")
    table = table.toDF(*(c.lstrip("﻿").strip().lower() for c in table.columns))
    held = {k: next((c for c in table.columns if c in names), None) for k, names in ALIASES.items()}
    if not held["lon"] or not held["lat"]:
        raise ValueError("the table needs lon and lat columns")
    text = lambda k: F.trim(F.coalesce(F.col(held[k]), F.lit(""))) if held[k] else F.lit("")
    number = lambda k: F.replace(text(k), F.lit(","), F.lit(".")).try_cast("double")
    row = F.monotonically_increasing_id() + 1
    read = table.select(row.alias("row"), text("id").alias("id0"), text("name").alias("name0"), F.lower(text("role")).alias("role0"), number("lon").alias("lon"), number("lat").alias("lat"), F.lower(text("enabled")).alias("enabled0"))
    inside = F.coalesce(F.col("lon").between(*BOX[:2]) & F.col("lat").between(*BOX[2:]), F.lit(False))
    storage = reduce(Column.__or__, (F.col("role0").startswith(s) for s in STORAGE))
    name = F.when(F.col("name0") != "", F.col("name0")).when(F.col("id0") != "", F.col("id0")).otherwise(F.concat(F.lit("Site "), F.col("row").cast("string")))
    return read.select(
        "row", F.when(F.col("id0") != "", F.col("id0")).otherwise(F.concat(F.lit("site_"), F.col("row").cast("string"))).alias("id"), name.alias("name"),
        F.when(storage, "storage").otherwise("source").alias("role"), "lon", "lat", (~F.col("enabled0").isin("false", "0", "no", "nej")).alias("enabled"), F.when(~inside, "coordinates outside the area").alias("error"),
    )
