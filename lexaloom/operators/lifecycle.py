"""Keeping the index current: diffs, upserts, deletes, pruning, reports, checks and the maintenance lock."""

from __future__ import annotations

import json
import os
import socket
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaloom.functions.text import is_canonical_name
from lexaloom.plans.policy import DEFAULT, Policy
from lexaloom.sources.tables import COLUMNS, ENUMERATORS, HASHED, PROVIDERS, with_hash

IDENTITY = ("partition", "source_key", "locale")
OWNER = ("partition", "source_key")
EXIT_CODES = {"success": 0, "failed": 1, "warning": 2, "infrastructure": 3, "locked": 4, "unconfirmed": 5}


def identity_conflicts(documents: DataFrame) -> DataFrame:
    """Source keys that more than one type or source id claims."""
    who = F.struct("source_type", F.coalesce("source_id", F.lit("")).alias("source_id"), F.col("source_id").isNull().alias("none"))
    return documents.groupBy(*OWNER).agg(F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b").select(*OWNER)


def duplicates(documents: DataFrame) -> DataFrame:
    return documents.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _refuse(bad: DataFrame, what: str) -> None:
    if rows := bad.limit(3).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def diff(existing: DataFrame, incoming: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(identity, action): what replacing document sets would do. With ``scope`` only its sources' other documents are stale."""
    old = existing.select(*IDENTITY, F.col("document_hash").alias("old_hash"))
    if scope is not None:
        old = old.join(scope.select(*OWNER).distinct(), list(OWNER), "left_semi")
    new = incoming.select(*IDENTITY, F.col("document_hash").alias("new_hash"))
    action = F.when(F.col("old_hash").isNull(), "created").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return old.join(new, list(IDENTITY), "full_outer").select(*IDENTITY, action.alias("action"))


def replace(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The index after the incoming sources' document sets took the place of theirs; unchanged rows stay as they are."""
    _refuse(duplicates(incoming), "documents with one identity")
    _refuse(identity_conflicts(existing.select(*OWNER, "source_type", "source_id").unionByName(incoming.select(*OWNER, "source_type", "source_id"))), "source keys with two owners")
    sources = incoming.select(*OWNER).distinct()
    same = incoming.select(*IDENTITY, "document_hash")
    untouched = existing.join(sources, list(OWNER), "left_anti")
    kept = existing.join(same, [*IDENTITY, "document_hash"], "left_semi")
    new = incoming.join(existing.select(*IDENTITY, "document_hash"), [*IDENTITY, "document_hash"], "left_anti")
    return untouched.unionByName(kept).unionByName(new.select(*existing.columns))


def upsert(existing: DataFrame, document: DataFrame) -> DataFrame:
    """Single documents in; their siblings stay. A document whose source key belongs to another source is refused."""
    _refuse(duplicates(document), "documents with one identity")
    theirs = existing.join(document.select(*OWNER).distinct(), list(OWNER), "left_semi")
    _refuse(identity_conflicts(theirs.select(*OWNER, "source_type", "source_id").unionByName(document.select(*OWNER, "source_type", "source_id"))), "source keys with two owners")
    return existing.join(document.select(*IDENTITY), list(IDENTITY), "left_anti").unionByName(document.select(*existing.columns))


def delete(existing: DataFrame, **by: str) -> DataFrame:
    """Without the rows that have all the given values: an identity, a source, a type or a partition."""
    hit = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in by.items()])
    return existing.where(~hit)


def verify(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected rows that the stored index doesn't hold as they are."""
    return expected.select(*COLUMNS).exceptAll(stored.select(*COLUMNS))


def report(actions: DataFrame) -> DataFrame:
    names = ("created", "updated", "deleted", "unchanged")
    return actions.agg(*[F.count_if(F.col("action") == n).alias(n) for n in names], F.count(F.lit(1)).alias("documents"), F.countDistinct(*OWNER).alias("sources"))


def report_json(reports: DataFrame) -> DataFrame:
    """Reports as one JSON object each, keys sorted."""
    return reports.select(F.to_json(F.struct(*sorted(reports.columns))).alias("report"))


def sources_to_run(locators: DataFrame, limit: int | None = None, ceiling: int = 100_000) -> tuple[DataFrame, int]:
    """Distinct locators in order and how many were repeats; a limit makes the run partial, the ceiling refuses it."""
    once = locators.groupBy(*locators.columns).agg(F.count(F.lit(1)).alias("seen"))
    n, repeats = once.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("seen") - 1), F.lit(0))).first()
    if n > ceiling and limit is None:
        raise ValueError(f"{n} sources are more than the {ceiling} of one run")
    rows = once.drop("seen").orderBy(*locators.columns)
    return (rows.limit(limit) if limit else rows), repeats


def ownership(index: DataFrame) -> DataFrame:
    """Documents of each provider's persisted sources and whether their rows disagree about who they are."""
    kinds = F.countDistinct("source_type", F.coalesce("source_id", F.lit("")))
    return index.groupBy("provider_key", "partition", "source_key", "source_type").agg(F.count(F.lit(1)).alias("documents"), (kinds > 1).alias("conflict"))


def current_sources(located: list[DataFrame]) -> DataFrame:
    """The sources that enumerators name, each once; a key that two sources claim is refused."""
    both = reduce(DataFrame.unionByName, located).distinct()
    _refuse(identity_conflicts(both), "source keys with two owners")
    return both


def orphans(index: DataFrame, current: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """Persisted sources, of the given providers, that an authoritative enumeration no longer names."""
    rows = index if providers is None else index.where(F.col("provider_key").isin(providers))
    held = rows.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("documents"))
    now = current.select(*OWNER).distinct()
    return held.join(now, [held[k].eqNullSafe(now[k]) for k in OWNER], "left_anti")


def prune(index: DataFrame, current: DataFrame, *, authoritative: bool, dry_run: bool = True, limit: int | None = None, providers: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The index without orphans. More orphans than the limit refuse the run; a dry run changes nothing."""
    if not authoritative:
        raise ValueError("only an authoritative enumeration can prune")
    lost = orphans(index, current, providers)
    sources, documents = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum("documents"), F.lit(0))).first()
    if limit is not None and sources > limit:
        raise ValueError(f"{sources} orphaned sources are more than the limit of {limit}")
    said = {"dry_run": dry_run, "sources": sources, "documents": documents}
    gone = lost.select(*OWNER)
    return (index if dry_run else index.join(gone, [index[k].eqNullSafe(gone[k]) for k in OWNER], "left_anti")), said


def doctor_sample(index: DataFrame, n: int = 100) -> DataFrame:
    """The first rows by id, and whether their stored hash is that of their fields."""
    rows = index.orderBy("id").limit(n).withColumnRenamed("document_hash", "stored_hash")
    return with_hash(rows).select("id", (F.col("stored_hash") == F.col("document_hash")).alias("sound"))


def doctor(index: DataFrame, deep: bool = False, more: dict[str, Callable[[], list]] | None = None) -> list[dict]:
    """Isolated checks in the order of their names, the caller's own among them; one that fails to run is a finding, not an error."""
    checks = {
        "schema.columns": lambda: sorted(set(COLUMNS) - set(index.columns)),
        "schema.identities": lambda: [tuple(r) for r in duplicates(index).limit(5).collect()],
        "schema.owners": lambda: [tuple(r) for r in identity_conflicts(index).limit(5).collect()],
        "schema.required": lambda: [c for c, n in index.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("partition", "source_key", "source_type", "locale", "is_active")]).first().asDict().items() if n],
        "schema.names": lambda: [tuple(r) for r in index.where(~is_canonical_name(F.col("source_key")) | ~is_canonical_name(F.col("partition"))).select(*IDENTITY).limit(5).collect()],
        "extensions.enumerators": lambda: [] if ENUMERATORS.select() else ["no enumerator is registered"],
        "extensions.providers": lambda: sorted({e.provider for e in ENUMERATORS.select()} - {n for n, _, _ in PROVIDERS.claims}),
        "configuration.policies": lambda: [] if Policy() == DEFAULT else ["the default policy can't be made"],
    }
    if deep:
        checks["schema.semantic-sample"] = lambda: [r.id for r in doctor_sample(index).where("not sound").collect()]
    out = []
    for name, check in sorted((checks | (more or {})).items()):
        try:
            found = check()
        except Exception as e:  # noqa: BLE001
            found = [str(e)[:200]]
        out.append({"check": name, "healthy": not found, "findings": found})
    return out


class IndexStore:
    """Versioned snapshots of a table below one folder, and a pointer that moves at once.

    Paths may be anything Spark can write to; the pointer is renamed by the file system that holds it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, name: str = "") -> DataFrame | None:
        version = self.current()
        return self.spark.read.parquet(f"{self.root}/{version}/{name}".rstrip("/")) if version else None

    def write(self, table: DataFrame, partition_by: str = "locale") -> str:
        """A new version of one table; it is read back and checked before the pointer moves."""
        return self.write_all({"": table}, partition_by)

    def write_all(self, tables: dict[str, DataFrame], partition_by: str = "locale") -> str:
        """A new version of several tables, which one pointer makes current at once."""
        name = f"v-{datetime.now(timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
        for part, table in tables.items():
            path = f"{self.root}/{name}/{part}".rstrip("/")
            table.write.partitionBy(partition_by).parquet(path)
            if "document_hash" in table.columns:
                _refuse(unsound(self.spark.read.schema(table.schema).parquet(path)), "stored documents that differ from their hash")
        fresh = self._path(f"{self.root}/CURRENT.{name}")
        stream = self._fs.create(fresh)
        stream.write(bytearray(name.encode()))
        stream.close()
        old = self._path(f"{self.root}/CURRENT")
        options = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options.rename(fresh, old, kinds)
        return name

    @contextmanager
    def lock(self):
        """Exclusive among all machines that use this store: the file system creates the lock file for one of them."""
        at = self._path(f"{self.root}/LOCK")
        self._fs.mkdirs(self._path(self.root))
        try:
            stream = self._fs.create(at, False)
        except Exception as e:
            if "exist" in str(e).lower():
                raise Locked("another maintenance run holds the lock") from None
            raise
        try:
            stream.write(bytearray(f"{socket.gethostname()} {os.getpid()}".encode()))
            stream.close()
            yield
        finally:
            self._fs.delete(at, False)


class Locked(RuntimeError):
    pass


def unsound(stored: DataFrame) -> DataFrame:
    """Rows whose fields don't give their hash."""
    rows = with_hash(stored.withColumnRenamed("document_hash", "stored_hash"))
    return rows.where(~F.col("stored_hash").eqNullSafe(F.col("document_hash"))).select(*IDENTITY)


@contextmanager
def maintenance_lock(path: str | Path):
    """Exclusive among processes that name the same file."""
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise Locked("another maintenance run holds the lock") from None
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(path)


def output(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def latest(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    return feed.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))).where("nth = 1").drop("nth")


def hash_columns() -> tuple[str, ...]:
    return HASHED
