"""Small search documents."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.sources.tables import COLUMNS, with_hash, with_tokens

KINDS = {"id": T.LongType(), "priority": T.IntegerType(), "is_active": T.BooleanType(), "source_updated_at": T.TimestampType()}
SCHEMA = T.StructType([T.StructField(c, KINDS.get(c, T.StringType())) for c in COLUMNS])


def doc(i, title, *, locale="en", key=None, kind="page", content=None, keywords=None, excerpt=None, partition="default", priority=0, active=True, source_id=None, provider="default"):
    low = lambda x: x.lower() if x is not None else None
    row = dict(id=i, partition=partition, source_key=key or f"{kind}:{i}", source_type=kind, source_id=source_id, source_connection=None, provider_key=provider, source_updated_at=None, locale=locale, title=title, excerpt=excerpt, normalized_title=low(title), normalized_keywords=low(keywords), normalized_excerpt=low(excerpt), normalized_content=low(content), payload="{}", priority=priority, is_active=active)
    return tuple(row[c] for c in COLUMNS)


def index(spark, rows):
    return with_tokens(with_hash(spark.createDataFrame(rows, SCHEMA)))


def ids(frame):
    return [r.id for r in frame.orderBy("place").select("id").collect()]


__all__ = ["F", "doc", "ids", "index"]
