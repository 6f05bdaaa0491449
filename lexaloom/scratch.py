"""Tables that a session keeps for itself in the folder that its executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_PATHS: list[tuple[SparkSession, str]] = []
_KEPT: dict[tuple[str, str], tuple[str, StructType]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexaloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by ``release`` or at exit."""
    path = f"{shared_dir(spark).rstrip('/')}/lexaloom/{name}-{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    return path


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], partition_by: str) -> DataFrame:
    """A table that is built and written when it is first asked for, once per application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _KEPT:
        path = scratch_path(spark, "kept")
        rows = build()
        rows.write.partitionBy(partition_by).parquet(path)
        _KEPT[key] = path, rows.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)  # an empty table has no file that tells its columns


def is_kept(spark: SparkSession, name: str) -> bool:
    return (spark.sparkContext.applicationId, name) in _KEPT


@atexit.register
def release() -> None:
    """Drop every scratch table. Call it only once the results that read them are written."""
    _KEPT.clear()
    while _PATHS:
        spark, path = _PATHS.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; the folder belongs to the cluster's own clean-up
            pass
