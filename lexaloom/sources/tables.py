"""Source adapters: rows of any table become search documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaloom.functions import text as X

COLUMNS = (
    "id", "partition", "source_key", "source_type", "source_id", "source_connection", "provider_key", "locale", "title", "excerpt", "normalized_title",
    "normalized_keywords", "normalized_excerpt", "normalized_content", "payload", "priority", "is_active", "source_updated_at",
)
#: What a document means, in the order of its canonical JSON.
HASHED = tuple(sorted(COLUMNS[1:]))
#: What names a source row: ids are unique within type and connection only.
SOURCE = ("source_type", "source_connection", "source_id")
#: An index id is a table's own id and the table's place here, so ids of different tables never meet.
PLACES = ("documents", "pages", "part")
KEYS = {"documents": "doc_id", "pages": "page_id", "part": "p_partkey"}
ID_STEP = 8
FIELDS = ("title", "keywords", "excerpt", "content")


TEXT_TABLES = ("documents", "pages", "conversations")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt out to all cores: a small file's one row group is one task. Larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def build_documents(rows: DataFrame, *, id: Column, source_id: Column, source_key: Column, source_type: str, locale: Column, title: Column, content: Column, keywords: Column | None = None, excerpt: Column | None = None, partition: Column | None = None, priority: Column | None = None, is_active: Column | None = None, payload: Column | None = None, html: bool = False, provider: str = "default", connection: str | None = None, updated_at: Column | None = None) -> DataFrame:
    """Documents of one source type. With ``html`` all fields are sanitized, else only normalized."""
    null = F.lit(None).cast("string")
    at = X.resolve_locale(locale)

    def normal(c: Column | None) -> Column:
        return null if c is None else X.normalize(X.sanitize(c) if html else c, at)

    return rows.select(
        id.cast("long").alias("id"),
        (partition if partition is not None else F.lit("default")).alias("partition"),
        source_key.alias("source_key"),
        F.lit(source_type).alias("source_type"),
        source_id.cast("string").alias("source_id"),
        F.lit(connection).cast("string").alias("source_connection"),
        F.lit(provider).alias("provider_key"),
        at.alias("locale"),
        title.alias("title"),
        (excerpt if excerpt is not None else null).alias("excerpt"),
        normal(title).alias("normalized_title"),
        normal(keywords).alias("normalized_keywords"),
        normal(excerpt).alias("normalized_excerpt"),
        normal(content).alias("normalized_content"),
        (payload if payload is not None else F.lit("{}")).alias("payload"),
        (priority if priority is not None else F.lit(0)).cast("int").alias("priority"),
        (is_active if is_active is not None else F.lit(True)).alias("is_active"),
        (updated_at if updated_at is not None else F.lit(None)).cast("timestamp").alias("source_updated_at"),
    )


def canonical_json(documents: DataFrame) -> Column:
    """The meaningful fields as JSON with sorted keys, those of the payload too; an empty payload is an empty list, times are UTC."""
    at = F.date_format(F.to_utc_timestamp("source_updated_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.parse_json(F.when(F.col("payload").isNull() | (F.col("payload") == "{}"), "[]").otherwise(F.col("payload")))
    made = {"payload": payload, "source_updated_at": at}
    text = F.to_json(F.struct(*[made.get(c, F.col(c)).alias(c) for c in HASHED]), {"ignoreNullFields": "false"})
    for mark in ("2028", "2029"):
        text = F.replace(text, F.lit(chr(int(mark, 16))), F.lit(f"\\u{mark}"))
    return text


def with_hash(documents: DataFrame) -> DataFrame:
    return documents.withColumn("document_hash", F.sha2(canonical_json(documents).cast("binary"), 256))


def with_tokens(documents: DataFrame) -> DataFrame:
    """Token arrays, kept in the index so that ranking never tokenizes."""
    for f in FIELDS:
        documents = documents.withColumn(f"{f}_tokens", X.tokens(F.col(f"normalized_{f}")))
    return documents


def index_id(key: str, table_name: str) -> Column:
    return F.col(key).cast("long") * ID_STEP + PLACES.index(table_name)


def from_documents(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return build_documents(
        docs, provider="documents", id=index_id("doc_id", "documents"), source_id=F.col("doc_id"), source_key=F.concat(F.lit("group:"), F.floor(F.col("doc_id") / 4).cast("string")), source_type="document", locale=F.col("lang"),
        title=F.array_join(F.slice(F.split(t, r"\s+"), 1, 6), " "), keywords=F.col("source"), excerpt=F.regexp_extract(t, r"^[^.!?\n]*", 0), content=t,
        partition=F.when(F.col("doc_id") % 5 != 0, "public").otherwise("archive"), priority=F.col("doc_id") % 3, is_active=F.col("doc_id") % 11 != 0,
        payload=F.to_json(F.struct("source", F.struct("n_chars", "lang").alias("about"))) if {"n_chars", "lang", "source"} <= set(docs.columns) else None,
    )


def from_pages(pages: DataFrame) -> DataFrame:
    return build_documents(
        pages, provider="pages", id=index_id("page_id", "pages"), source_id=F.col("page_id"), source_key=F.concat(F.lit("page:"), F.col("page_id").cast("string")), source_type="page", locale=F.regexp_extract("url", "/(en|de|fr|es)/", 1),
        title=F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), excerpt=F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), content=F.col("html"), partition=F.lit("public"), html=True,
    )


def from_parts(parts: DataFrame) -> DataFrame:
    return build_documents(
        parts, provider="part", id=index_id("p_partkey", "part"), source_id=F.col("p_partkey"), source_key=F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), source_type="product", locale=F.lit("en"),
        title=F.col("p_name"), keywords=F.col("p_brand"), excerpt=F.col("p_type"), content=F.concat_ws(" ", "p_name", "p_type"), partition=F.lit("public"), priority=F.col("p_size") % 5,
    )


@dataclass(frozen=True)
class Enumerator:
    """Names the sources of a provider. Only an authoritative one, which names them all, can tell what is gone."""

    key: str
    provider: str
    locate: Callable[[SparkSession, str], DataFrame]
    authoritative: bool = False


@dataclass
class EnumeratorRegistry:
    held: dict[str, Enumerator] = field(default_factory=dict)

    def register(self, e: Enumerator) -> None:
        if e.key in self.held:
            raise ValueError(f"the enumerator {e.key} is registered twice")
        self.held[e.key] = e

    def select(self, keys: list[str] | None = None, providers: list[str] | None = None) -> list[Enumerator]:
        if unknown := sorted(set(keys or ()) - self.held.keys()) + sorted(set(providers or ()) - {e.provider for e in self.held.values()}):
            raise ValueError(f"nothing is registered as {', '.join(unknown)}")
        return [e for _, e in sorted(self.held.items()) if (not keys or e.key in keys) and (not providers or e.provider in providers)]


@dataclass
class ProviderRegistry:
    """Adapters by table name. At most one custom provider may claim a source; without one the fallback applies."""

    fallback: Callable[[DataFrame], DataFrame] | None = None
    claims: list[tuple[str, Callable[[str], bool], Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def register(self, name: str, supports: Callable[[str], bool], build: Callable[[DataFrame], DataFrame]) -> None:
        self.claims.append((name, supports, build))

    def resolve(self, source: str) -> Callable[[DataFrame], DataFrame]:
        found = [(n, b) for n, s, b in self.claims if s(source)]
        if len(found) > 1:
            raise ValueError(f"several providers claim {source}: {', '.join(n for n, _ in found)}")
        if not found and self.fallback is None:
            raise LookupError(f"no provider for {source}")
        return found[0][1] if found else self.fallback

    def documents_for(self, source: str, rows: DataFrame) -> DataFrame:
        return self.resolve(source)(rows)


PROVIDERS = ProviderRegistry()
for _name, _build in (("documents", from_documents), ("pages", from_pages), ("part", from_parts)):
    PROVIDERS.register(_name, lambda s, n=_name: s == n, _build)


#: The driver's tables list all their rows, so their enumerators are authoritative.
ENUMERATORS = EnumeratorRegistry()
def _locate(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A row per source key; of the documents that share one, the smallest id stands for the source."""
    rows = PROVIDERS.documents_for(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return rows.groupBy("provider_key", "partition", "source_key", "source_type").agg(F.min("source_id").alias("source_id"))


for _name in PLACES:
    ENUMERATORS.register(Enumerator(_name, _name, lambda spark, d, n=_name: _locate(spark, d, n), True))


def corpus_ids(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = PLACES) -> DataFrame:
    """The index ids of ``corpus``, from the tables' keys alone."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{sf_dir}/{kind}.parquet").select(index_id(KEYS[kind], kind).alias("id")) for kind in kinds])


def corpus(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("documents", "part"), ids: DataFrame | None = None) -> DataFrame:
    """Search documents of the tables; with ``ids`` (few index ids), those rows only, chosen before any text is prepared."""
    out = None
    for kind in kinds:
        if ids is None:
            rows = table(spark, sf_dir, kind)
        else:
            rows = spark.read.parquet(f"{sf_dir}/{kind}.parquet")
            rows = rows.join(F.broadcast(ids.select(F.col("id").alias("chosen_id"))), index_id(KEYS[kind], kind).eqNullSafe(F.col("chosen_id")), "left_semi")
        part = PROVIDERS.documents_for(kind, rows)
        out = part if out is None else out.unionByName(part)
    return out
