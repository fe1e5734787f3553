"""Planes of a grid as a pack: row-major chunks in fixed types, compressed to the same bytes whatever the input's layout, with chained digests.

A chunk is ``CHUNK_ROWS`` whole rows of the grid, so a task encodes a chunk and no more, and all chunks are encoded in parallel. A plane's digest is that
of its chunks' digests in order, and the pack's that of its description with the planes' digests; so one number tells two packs apart, and what is
damaged is found chunk by chunk.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_ROWS = 64
#: Little-endian types by their names in a pack.
TYPES = {"u8": "<u1", "u16": "<u2", "u32": "<u4", "f32": "<f4"}
_CHUNK = "plane string, chunk int, raw_sha256 string, raw_bytes long, sha256 string, bytes long, data binary"


@dataclass(frozen=True)
class Plane:
    """A column of the cells, its type in the pack, and the value that stands for null and for cells that aren't there."""

    name: str
    type: str
    nodata: float = 0


def bit_planes(bits: str = "class_bits") -> tuple[Column, Column]:
    """The lower and the higher 32 bits of a column of class bits."""
    low = F.lit(0xFFFFFFFF).cast("long")
    return F.col(bits).bitwiseAND(low).alias("presence_lo"), F.shiftrightunsigned(bits, 32).bitwiseAND(low).alias("presence_hi")


def encoded(cells: DataFrame, planes: list[Plane], height: int, width: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The chunks (plane, chunk, raw_sha256, raw_bytes, sha256, bytes, data) of the planes of cells (r, c, ...) with 0 <= r < height and 0 <= c < width."""
    if unknown := [p.type for p in planes if p.type not in TYPES]:
        raise ValueError(f"unknown types: {unknown}")

    def chunk(held: pd.DataFrame) -> pd.DataFrame:
        k, out = int(held["chunk"].iloc[0]), []
        held = held.dropna(subset=["r"])
        rows = min(chunk_rows, height - k * chunk_rows)
        at = ((held["r"] - k * chunk_rows) * width + held["c"]).to_numpy().astype(np.int64)
        if len(np.unique(at)) < len(at):
            raise ValueError(f"cells of chunk {k} are there more than once")
        for plane in planes:
            values = np.full(rows * width, plane.nodata, TYPES[plane.type])
            given = held[plane.name].to_numpy(float)
            kept = ~np.isnan(given)
            if plane.type != "f32" and (np.any(given[kept] != np.rint(given[kept])) or np.any((given[kept] < 0) | (given[kept] > np.iinfo(TYPES[plane.type]).max))):
                raise ValueError(f"values of {plane.name} don't fit {plane.type}")
            values[at[kept]] = given[kept]
            raw = values.tobytes()
            data = gzip.compress(raw, mtime=0)
            out.append((plane.name, k, sha256(raw).hexdigest(), len(raw), sha256(data).hexdigest(), len(data), data))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _CHUNK.split(", ")])

    inside = cells.filter((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))
    inside = inside.select(F.floor(F.col("r") / chunk_rows).cast("int").alias("chunk"), "r", "c", *(F.col(p.name).cast("double").alias(p.name) for p in planes))
    every = cells.sparkSession.range(-(-height // chunk_rows)).select(F.col("id").cast("int").alias("chunk"))
    return every.join(inside, "chunk", "left").groupBy("chunk").applyInPandas(chunk, _CHUNK)


def _digests(chunks: DataFrame) -> dict[str, dict]:
    """Each plane's chained digests, and its chunks and bytes; a chunk's digests come to the driver one after the other."""
    out: dict[str, dict] = {}
    for x in chunks.select("plane", "chunk", "raw_sha256", "sha256", "raw_bytes", "bytes").orderBy("plane", "chunk").toLocalIterator():
        held = out.setdefault(x.plane, {"raw": sha256(), "packed": sha256(), "chunks": 0, "raw_bytes": 0, "bytes": 0})
        held["raw"].update(x.raw_sha256.encode())
        held["packed"].update(x.sha256.encode())
        held["chunks"] += 1
        held["raw_bytes"] += x.raw_bytes
        held["bytes"] += x.bytes
    return {name: {**held, "raw": held["raw"].hexdigest(), "packed": held["packed"].hexdigest()} for name, held in out.items()}


def _sealed(described: dict) -> str:
    return sha256(json.dumps(described, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_pack(cells: DataFrame, planes: list[Plane], height: int, width: int, path: str, extra: dict | None = None, chunk_rows: int = CHUNK_ROWS) -> dict:
    """Write the pack to ``path`` and return its manifest; ``extra`` (the grid, the layers, the configuration) is described and sealed with it."""
    encoded(cells, planes, height, width, chunk_rows).write.partitionBy("plane").parquet(f"{path}/planes")
    spark = cells.sparkSession
    found = _digests(spark.read.parquet(f"{path}/planes"))
    described = {"height": height, "width": width, "chunk_rows": chunk_rows, "order": "rows", "planes": [asdict(p) | found[p.name] for p in planes], "extra": extra or {}}
    manifest = described | {"digest": _sealed(described)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The pack's manifest; an error if it isn't the one that was sealed."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    described = {k: v for k, v in manifest.items() if k != "digest"}
    if _sealed(described) != manifest.get("digest"):
        raise ValueError(f"the manifest of {path} has been changed")
    return manifest


def pack_problems(spark: SparkSession, path: str) -> DataFrame:
    """(plane, chunk, problem): chunks whose bytes, before or after they are unpacked, aren't those that were written, and ones that are missing or too many; and (chunk -1) planes whose chain is another."""
    manifest = read_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/planes").select("plane", "chunk", "raw_sha256", "raw_bytes", "sha256", "bytes", "data")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                if len(x.data) != x.bytes or sha256(x.data).hexdigest() != x.sha256:
                    out.append((x.plane, x.chunk, "packed bytes"))
                    continue
                try:
                    raw = gzip.decompress(x.data)
                except (OSError, EOFError, zlib.error):
                    raw = b""
                if len(raw) != x.raw_bytes or sha256(raw).hexdigest() != x.raw_sha256:
                    out.append((x.plane, x.chunk, "unpacked bytes"))
            yield pd.DataFrame(out, columns=["plane", "chunk", "problem"])

    kind = "plane string, chunk int, problem string"
    wrong = chunks.mapInPandas(look, kind)
    count = -(-manifest["height"] // manifest["chunk_rows"])
    names = spark.createDataFrame([(p["name"],) for p in manifest["planes"]], "plane string")
    wanted = spark.range(count).select(F.col("id").cast("int").alias("chunk")).crossJoin(F.broadcast(names))
    there = chunks.groupBy("plane", "chunk").agg(F.count("*").alias("n"))
    said = lambda df, problem: df.select("plane", "chunk", F.lit(problem).alias("problem"))
    wrong = wrong.union(said(wanted.join(there, ["plane", "chunk"], "left_anti"), "missing")).union(said(there.join(wanted, ["plane", "chunk"], "left_anti").union(there.filter("n > 1")), "too many"))
    found = _digests(chunks)
    broken = [(p["name"], -1, "chain") for p in manifest["planes"] if {k: p[k] for k in ("raw", "packed", "chunks", "raw_bytes", "bytes")} != found.get(p["name"])]
    return wrong.union(spark.createDataFrame(broken, kind)) if broken else wrong


def read_pack(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(plane, r, c, value): all cells of the pack's planes that have a value. With ``check``, a damaged pack is an error that names what is wrong."""
    manifest = read_manifest(spark, path)
    if check and (bad := [tuple(r) for r in pack_problems(spark, path).limit(20).collect()]):
        raise ValueError(f"the pack {path} is damaged: {sorted(bad)}")
    kinds = {p["name"]: (TYPES[p["type"]], p["nodata"]) for p in manifest["planes"]}
    rows, width = manifest["chunk_rows"], manifest["width"]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                kind, nodata = kinds[x.plane]
                values = np.frombuffer(gzip.decompress(x.data), kind)
                at = np.flatnonzero(values != np.array(nodata, kind))
                yield pd.DataFrame({"plane": x.plane, "r": (x.chunk * rows + at // width).astype(np.int32), "c": (at % width).astype(np.int32), "value": values[at].astype(float)})

    return spark.read.parquet(f"{path}/planes").select("plane", "chunk", "data").mapInPandas(cells, "plane string, r int, c int, value double")
