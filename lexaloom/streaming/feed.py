"""Change feeds: events only say which source to look at again, so any order and any repeat converge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexaloom.operators import lifecycle as L


def targets(before: DataFrame, after: DataFrame, ceiling: int | None = None) -> DataFrame:
    """Sources that depend on a changed row, by its old and its new values: distinct and in order. Too many, or one key of two sources, are refused."""
    both = before.unionByName(after).distinct()
    if set(L.OWNER) <= set(both.columns) and len(both.columns) > len(L.OWNER) and not (twice := both.groupBy(*L.OWNER).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)).isEmpty():
        raise ValueError(f"two sources have one key: {tuple(twice.first())[:2]}")
    if ceiling is not None and (n := both.limit(ceiling + 1).count()) > ceiling:
        raise ValueError(f"more than {ceiling} sources depend on one change")
    return both.orderBy(*both.columns)


def dependents(changes: DataFrame, sources: DataFrame, on: str, key: str | tuple[str, ...]) -> DataFrame:
    """Source keys that refer to a changed dependency."""
    return sources.join(changes.select(on).distinct(), on, "left_semi").select(*([key] if isinstance(key, str) else key))


def synchronize(index: DataFrame, changed: DataFrame, current: DataFrame) -> DataFrame:
    """The index after the changed sources (partition, source_key) were looked up again: gone ones leave, others are replaced."""
    keys = changed.select(*L.OWNER).distinct()
    fresh = current.join(keys, list(L.OWNER), "left_semi")
    stale = index.join(keys, list(L.OWNER), "left_semi")
    unchanged = stale.join(fresh.select(*L.IDENTITY, "document_hash"), [*L.IDENTITY, "document_hash"], "left_semi")
    new = fresh.join(stale.select(*L.IDENTITY, "document_hash"), [*L.IDENTITY, "document_hash"], "left_anti")
    return index.join(keys, list(L.OWNER), "left_anti").unionByName(unchanged).unionByName(new.select(*index.columns))


def follow(feed: DataFrame, store: L.IndexStore, current: Callable[[], DataFrame], locate: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a streaming feed to a stored index, one snapshot per micro-batch.

    A batch that is run again after a failure gives the same snapshot, since it only reads current state.
    """

    def apply(batch: DataFrame, _: int) -> None:
        changed = locate(batch).dropDuplicates(list(L.OWNER))
        index = store.read()
        if index is not None and not changed.isEmpty():
            store.write(synchronize(index, changed, current()))

    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class JobQueue:
    """Synchronization jobs below a folder. A source that waits already isn't queued again, until its job is taken."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(JOB).parquet(f"{self.root}/{name}") if there else None

    def waiting(self) -> DataFrame:
        pushed, taken = self._read("pushed"), self._read("taken")
        if pushed is None:
            return self.spark.createDataFrame([], JOB)
        return pushed if taken is None else pushed.join(taken.select("job"), "job", "left_anti")

    def push(self, sources: DataFrame) -> None:
        """Sources (partition, source_key), each once."""
        keys = list(L.OWNER)
        new = sources.select(*keys).distinct().join(self.waiting().select(*keys), keys, "left_anti")
        new.select(F.expr("uuid()").alias("job"), *keys).write.mode("append").parquet(f"{self.root}/pushed")

    def take(self) -> DataFrame:
        """What waits, marked as taken."""
        jobs = self.waiting()
        before = self._read("taken")
        old = set() if before is None else set(before.inputFiles())
        jobs.write.mode("append").parquet(f"{self.root}/taken")
        files = sorted(set(self._read("taken").inputFiles()) - old)
        return self.spark.read.schema(JOB).parquet(*files) if files else self.spark.createDataFrame([], JOB)


JOB = "job string, partition string, source_key string"


def route(changed: DataFrame, mode: str, run: Callable[[DataFrame], None], queue: JobQueue | None = None) -> None:
    """Changed sources, each once: looked up again at once, or queued."""
    if mode == "sync":
        run(changed.dropDuplicates(list(L.OWNER)))
    elif mode == "queue" and queue is not None:
        queue.push(changed)
    else:
        raise ValueError(f"no way to run {mode}")


def follow_dependencies(changes: DataFrame, sources: Callable[[], DataFrame], on: str, dispatch: Callable[[DataFrame], None], checkpoint: str, ceiling: int = 1000, available_now: bool = True) -> StreamingQuery:
    """A feed of changed dependencies, (old, new) values of ``on``: dispatches the sources (partition, source_key, ``on``) that refer to either,
    once a micro-batch is committed by its source. The ceiling is that of one batch."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = sources()
        near = lambda c: dependents(batch.select(F.col(c).alias(on)).where(F.col(on).isNotNull()), rows.select(on, *L.OWNER), on, L.OWNER)
        both = targets(near("old"), near("new"), ceiling)
        if not both.isEmpty():
            dispatch(both)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def last_state(events: DataFrame, key: str, order: list[str], deleted: str) -> DataFrame:
    """Each key's last event, and whether it is there after all."""
    return L.latest(events, key, order).withColumn("present", F.col("event_type") != deleted)
