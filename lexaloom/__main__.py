"""Command line: index, dictionary, status, doctor, reindex and prune over a folder of tables.

Runs that write hold the store's lock. What deletes or replaces asks first: ``prune`` only reports unless --execute is given, and
both it and ``reindex`` need --force, or a yes at a terminal.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaloom.operators import dictionary as D
from lexaloom.operators import lifecycle as L
from lexaloom.plans.policy import Policy
from lexaloom.sources import tables as T

DICTIONARY = ("terms", "deletes", "ngrams", "builds")


class Unconfirmed(Exception):
    pass


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexaloom", description=__doc__)
    p.add_argument("command", choices=("install", "reindex", "prune", "status", "doctor", "dictionary-build", "dictionary-status"))
    p.add_argument("--tables", help="folder with the source tables")
    p.add_argument("--store", required=True, help="folder of the index")
    p.add_argument("--enumerator", action="append", help="only these enumerators")
    p.add_argument("--provider", action="append", help="only these providers")
    p.add_argument("--locale", action="append", help="rebuild the dictionary of these locales only")
    p.add_argument("--execute", action="store_true", help="prune for good")
    p.add_argument("--dry-run", action="store_true", help="reindex: report only")
    p.add_argument("--force", action="store_true", help="write without asking")
    p.add_argument("--deep", action="store_true", help="doctor: recompute a sample of hashes")
    p.add_argument("--strict", action="store_true", help="doctor: any finding is a failure")
    p.add_argument("--limit", type=int)
    p.add_argument("--maximum-terms", type=int, default=100_000)
    a = p.parse_args(argv)
    if a.limit is not None and a.limit < 1:
        return _said("failed", error="--limit is a positive number")
    if a.command in ("reindex", "prune") and not a.tables:
        return _said("failed", error="--tables is missing")
    spark = SparkSession.builder.appName(f"lexaloom {a.command}").getOrCreate()
    try:
        if (a.command == "prune" and a.execute) or (a.command == "reindex" and not a.dry_run) or a.command == "dictionary-build":
            _confirm(a)
            with L.IndexStore(spark, a.store).lock():
                return _run(spark, a)
        return _run(spark, a)
    except Unconfirmed as e:
        return _said("unconfirmed", error=str(e))
    except L.Locked as e:
        return _said("locked", error=str(e))
    except ValueError as e:
        return _said("failed", error=str(e))
    except (PySparkException, Py4JError, OSError) as e:
        return _said("infrastructure", error=str(e).split("\n")[0][:300])


def _said(code: str, **what: object) -> int:
    print(L.output(what))
    return L.EXIT_CODES[code]


def _confirm(a: argparse.Namespace) -> None:
    if a.force:
        return
    if not sys.stdin.isatty() or input(f"{a.command} writes to {a.store}; go on? [y/N] ").strip().lower() != "y":
        raise Unconfirmed(f"{a.command} needs --force or a confirmation")


def _incoming(spark: SparkSession, a: argparse.Namespace, chosen: list[T.Enumerator]) -> DataFrame:
    """One document per identity, the one with the smallest id."""
    rows = T.with_tokens(T.with_hash(T.corpus(spark, a.tables, tuple(dict.fromkeys(e.provider for e in chosen)))))
    first = F.row_number().over(Window.partitionBy(*L.IDENTITY).orderBy("id"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth").withColumn("indexed_at", F.current_timestamp())


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    index, words = L.IndexStore(spark, f"{a.store}/index"), L.IndexStore(spark, f"{a.store}/dictionary")
    if a.command == "install":
        return _said("success", store=a.store, tables=["index", *DICTIONARY])
    if a.command in ("reindex", "prune"):
        chosen = T.ENUMERATORS.select(a.enumerator, a.provider)
        path = spark._jvm.org.apache.hadoop.fs.Path
        if not (a.enumerator or a.provider):  # a provider without a table has nothing to name
            fs = path(a.tables).getFileSystem(spark._jsc.hadoopConfiguration())
            chosen = [e for e in chosen if fs.exists(path(f"{a.tables}/{e.provider}.parquet"))]
        if not chosen:
            raise ValueError("no enumerator has a table here")
    if a.command == "reindex":
        new, old = _incoming(spark, a, chosen), index.read()
        if a.limit:
            new = new.join(L.sources_to_run(new.select(*L.OWNER), a.limit)[0], list(L.OWNER), "left_semi")
        else:
            L.sources_to_run(new.select(*L.OWNER).distinct())
        base = old if old is not None else new.limit(0)
        said = L.report(L.diff(base, new, new)).first().asDict()
        if not a.dry_run:
            index.write(L.replace(base, new))
        return _said("success", **said, dry_run=a.dry_run, partial=bool(a.limit))
    have = index.read()
    if have is None:
        raise ValueError("there is no index yet")
    if a.command == "prune":
        claims = all(e.authoritative for e in chosen)
        current = L.current_sources([e.locate(spark, a.tables) for e in chosen]) if claims else have
        left, said = L.prune(have, current, authoritative=claims, dry_run=not a.execute, limit=a.limit, providers=sorted({e.provider for e in chosen}))
        if a.execute and said["sources"]:
            index.write(left)
        return _said("success", **said)
    if a.command == "status":
        return _said("success", rows=[r.asDict() for r in D.status(have).orderBy("dimension", "value").collect()], enumerators=[e.key for e in T.ENUMERATORS.select()], authoritative=[e.key for e in T.ENUMERATORS.select() if e.authoritative])
    tables = {n: words.read(n) for n in DICTIONARY} if words.current() else None
    if a.command == "doctor":
        ready = lambda: [] if tables is None else sorted(r.locale for r in tables["builds"].select("locale").subtract(D.readiness(tables["builds"])).collect())
        found = L.doctor(have, a.deep, {"operations.readiness": ready})
        whole = all(f["healthy"] for f in found)
        return _said("success" if whole else "failed" if a.strict else "warning", checks=found)
    if a.command == "dictionary-build":
        words.write_all(D.rebuilt(have, tables, uuid.uuid4().hex, a.locale, Policy(maximum_dictionary_terms=a.maximum_terms)))
        return _said("success", terms=words.read("terms").count(), ngrams=words.read("ngrams").count())
    if tables is None:
        raise ValueError("there is no dictionary yet")
    return _said("success", rows=[r.asDict() for r in D.dictionary_status(tables["terms"], tables["ngrams"], have, tables["builds"]).orderBy("locale").collect()])


if __name__ == "__main__":
    sys.exit(main())
