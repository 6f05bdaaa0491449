"""Shared plumbing of the training-data operators: scratch tables and sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaloom.scratch import release, scratch_path, shared_dir
from lexaloom.shipping import ship

__all__ = ["input_bytes", "materialize", "partitions", "release", "row_hash", "scratch_path", "shared_dir", "ship", "trim", "trimmed"]


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, column: str) -> int:
    """About the bytes of a text column: the sources' file sizes, which the plan knows, times a compression factor; counted only where a source has no files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return 3 * known if known < 1 << 55 else int(df.agg(F.sum(F.octet_length(F.col(f"`{column}`")).cast("long"))).first()[0] or 0)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, to order rows that are alike in every other key."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema if "variant" not in f.dataType.simpleString()])


def trim() -> None:
    """Give freed memory back to the system, where the C library can. Python workers outlive their tasks, so what one step freed would be held beside the next one's."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the worker's freed memory given back before and after each task."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return around


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
