"""Packs: the same bytes from any layout, and every damage found."""

import gzip
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from costfield.sinks import pack

PLANES = [pack.Plane("lo", "u32"), pack.Plane("far", "u16", 65535), pack.Plane("share", "u8"), pack.Plane("people", "f32", -9999.0)]


@pytest.fixture(scope="module")
def cells(spark):
    r = random.Random(4)
    rows = [(a, b, r.getrandbits(32), r.choice([None, r.randint(0, 65534)]), r.randint(0, 255), r.choice([None, r.randint(0, 999) / 8])) for a in range(37) for b in range(11) if r.random() < 0.7 and not 16 <= a < 24]
    return spark.createDataFrame(rows, "r int, c int, lo long, far int, share int, people double")


def test_two_layouts_give_one_digest(spark, cells, tmp_path):
    one = pack.write_pack(cells.repartition(7), PLANES, 37, 11, str(tmp_path / "one"), {"grid": {"x0": 1.5}}, 8)
    two = pack.write_pack(cells.orderBy(F.desc("c")).coalesce(1), PLANES, 37, 11, str(tmp_path / "two"), {"grid": {"x0": 1.5}}, 8)
    assert one == two and [p["chunks"] for p in one["planes"]] == [5] * 4
    other = pack.write_pack(cells, PLANES, 37, 11, str(tmp_path / "three"), {"grid": {"x0": 1.25}}, 8)
    assert other["digest"] != one["digest"] and other["planes"] == one["planes"]
    assert pack.pack_problems(spark, str(tmp_path / "one")).isEmpty()
    got = {(x.plane, x.r, x.c): x.value for x in pack.read_pack(spark, str(tmp_path / "one")).collect()}
    want = {(p.name, x.r, x.c): x[p.name] for x in cells.collect() for p in PLANES if x[p.name] is not None and x[p.name] != p.nodata}
    assert got == want


def test_chunks_are_row_major_and_little_endian(cells):
    found = {(x.plane, x.chunk): x for x in pack.encoded(cells, PLANES, 37, 11, 8).collect()}
    dense = np.full((37, 11), 65535, "<u2")
    for x in cells.collect():
        dense[x.r, x.c] = 65535 if x.far is None else x.far
    for k in range(5):
        chunk = found["far", k]
        assert gzip.decompress(chunk.data) == dense[8 * k : 8 * k + 8].tobytes() and chunk.data[4:8] == b"\0\0\0\0"
    assert found["share", 2].raw_bytes == 88 and set(gzip.decompress(found["share", 2].data)) == {0}  # no cell is there


def rewritten(spark, path, change):
    kept = spark.read.parquet(f"{path}/planes").toPandas()
    kept = change(kept)
    spark.createDataFrame(kept[["plane", "chunk", "raw_sha256", "raw_bytes", "sha256", "bytes", "data"]], pack._CHUNK).write.mode("overwrite").partitionBy("plane").parquet(f"{path}/planes")


def test_damage_is_found(spark, cells, tmp_path):
    path = str(tmp_path / "pack")
    pack.write_pack(cells, PLANES, 37, 11, path, chunk_rows=8)

    def flip(kept):
        at = kept[(kept.plane == "lo") & (kept.chunk == 3)].index[0]
        data = bytearray(kept.at[at, "data"])
        data[30] ^= 1
        kept.at[at, "data"] = bytes(data)
        return kept[~((kept.plane == "far") & (kept.chunk == 1))]

    rewritten(spark, path, flip)
    problems = {tuple(x) for x in pack.pack_problems(spark, path).collect()}
    assert problems == {("lo", 3, "packed bytes"), ("far", 1, "missing"), ("far", -1, "chain")}
    with pytest.raises(ValueError, match="damaged"):
        pack.read_pack(spark, path)
    (part,) = [p for p in Path(path, "manifest").iterdir() if p.suffix == ".txt"]
    manifest = json.loads(part.read_text()) | {"width": 12}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(ValueError, match="changed"):
        pack.read_manifest(spark, path)


def test_values_must_fit(spark, cells):
    with pytest.raises(Exception, match="don't fit"):
        pack.encoded(cells.withColumn("share", F.lit(256)), PLANES, 37, 11, 8).collect()
    with pytest.raises(Exception, match="more than once"):
        pack.encoded(cells.union(cells.limit(1)), PLANES, 37, 11, 8).collect()
    with pytest.raises(ValueError, match="unknown types"):
        pack.encoded(cells, [pack.Plane("lo", "i3")], 37, 11)
