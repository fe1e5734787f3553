"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one serves a local master; on a cluster that is an error."""
    context = spark.sparkContext
    found = spark.conf.get(_KEY, None) or context.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
    held = getattr(context, "_costfield_dir", None)
    if held is None:
        held = "file://" + tempfile.mkdtemp(prefix="spark-costfield-")
        context._costfield_dir = held
    return held


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and with it the means to delete
        _delete(spark, path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; rows with a last column ``band`` lie in a folder for each of its values, so that filters by it read no other.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and what non-deterministic expressions
    gave is fixed from here on. The table goes with ``release``, or else when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/costfield/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy("band") if df.columns[-1] == "band" else df.write).parquet(path)
    atexit.register(_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._costfield_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: all that came of them has been materialised itself."""
    for table in tables:
        _delete(table.sparkSession, table._costfield_path)
