"""Mixing sources to target weights by systematic sampling (operator 4).

Targets: the sources, in code-point order with null last, take the weights in turn and share ``share`` times all sizes; a
target stops at ``cap`` times its source's size and the excess goes to the others by weight, until none is above. Each round
is one aggregate over the table of sources.

Sampling: a document's expected copies are target / source size. Within a source the documents are ordered by size, then
by a hash of the id, and ties by a hash of the row; expected copies are prefix-summed in that order, one random offset per source is added, and a document is
emitted once per integer boundary that its interval crosses. Ordering by size makes the words taken follow the target closely.
The prefix sum is distributed: counts per (source, size, salt) are summed first, rows are numbered within such a
group only, so a source that holds a third of all rows is spread over all tasks.

Results for special cases: a null or blank text has size 0; a null source is a source of its own; a source of size 0 has target 0;
a null id hashes as an empty string; repeated rows are sampled one by one; an empty table gives an empty one; any other
columns, whatever their names, come back unchanged with ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaloom.llm.common import materialize, row_hash

WORDS = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def _fraction(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """From (source, source_size): source, source_size, target. share is a ratio of whole numbers."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, aggregated before
    choice = F.array(*[F.lit(w) for w in weights])
    t = materialize(sizes.select("source", F.col("source_size").cast("decimal(38,0)").alias("s"), F.get(choice, ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("decimal(38,0)").alias("w")), "sources")
    num, den = share
    total, weight = t.agg(F.sum("s"), F.sum("w")).first()
    capped, left = 0, int(weight or 1)
    while True:  # target = w * top / (den * left)
        top = num * int(total or 0) - den * cap * capped
        above = F.col("w") * F.lit(top).cast("decimal(38,0)") > F.lit(cap * den * left).cast("decimal(38,0)") * F.col("s")
        at_cap, rest = t.agg(F.sum(F.when(above, F.col("s"))), F.sum(F.when(~above, F.col("w")))).first()
        if int(at_cap or 0) == capped and int(rest or 1) == left:
            break
        capped, left = int(at_cap or 0), int(rest or 1)
    even = (F.col("w") * F.lit(top).cast("decimal(38,0)")).cast("double") / F.lit(float(den * left))
    return t.select("source", F.col("s").cast("long").alias("source_size"), F.when(above, F.col("s").cast("double") * cap).otherwise(even).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, seed: str = SEED) -> DataFrame:
    """Per row: kept (struct of the ``keep`` columns), size, source_size, target, copies. No copy is expanded here."""
    c = lambda name: F.col(f"`{name}`")
    h = F.md5(F.coalesce(c(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.struct(*[c(k) for k in keep or (id_col,)]).alias("kept"),
        c(id_col).alias("id"),
        c(source_col).alias("source"),
        F.when(c(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), c(source_col))).alias("skey"),
        F.coalesce(F.regexp_count(c(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        h.alias("h"),
        F.substring(h, 1, 2).alias("salt"),
        row_hash(docs.select(*[c(k) for k in keep]) if keep else docs.select(c(id_col), c(text_col), c(source_col))).alias("tie"),
    )
    if not keep:  # narrow: later passes needn't read the texts again
        rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("source", "skey", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "groups")
    sizes = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(sizes, weights=weights, share=share, cap=cap).withColumn("skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")
    goal = goal.withColumn("offset", _fraction(F.concat(F.lit(seed), F.col("skey"))))
    # two levels: a task adds up the sizes of a source, others the salts of a size
    earlier = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    level = groups.groupBy("skey", "size").agg(F.sum("n").alias("all")).withColumn("below", F.coalesce(F.sum("all").over(earlier), F.lit(0))).drop("all")
    salted = groups.drop("source").withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("n")
    placed = salted.join(level, ["skey", "size"]).select("skey", "size", "salt", (F.col("below") + F.col("inside")).alias("before")).join(goal, "skey")
    within = Window.partitionBy("skey", "size", "salt").orderBy("h", "id", "tie")
    ranked = rows.drop("source").withColumn("place", F.row_number().over(within)).join(placed, ["skey", "size", "salt"])
    rank = F.col("before") + F.col("place")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate * rank + F.col("offset")) - F.floor(rate * (rank - 1) + F.col("offset"))
    return ranked.select("kept", "size", "source_size", "target", copies.cast("long").alias("copies"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's columns, each row as often as it is taken."""
    mixed = mix(docs, keep=tuple(docs.columns), **options).where("copies > 0")
    return mixed.select("kept", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("kept.*")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("kept.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS s FROM d GROUP BY source
), w AS (
  SELECT source, s, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::HUGEINT AS w FROM s
), o AS (
  SELECT source, s, w, row_number() OVER (ORDER BY s::DOUBLE / w, source NULLS LAST) AS k FROM w
), p AS (
  SELECT source, s, w, k,
    coalesce(sum(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS capped,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest,
    sum(s) OVER ()::HUGEINT AS total
  FROM o
), c AS (
  SELECT k, 3 * total - 4 * capped AS top, rest FROM p WHERE w * (3 * total - 4 * capped) <= 4 * rest * s ORDER BY k LIMIT 1
), t AS (
  SELECT p.source, p.s::BIGINT AS source_size,
    CASE WHEN p.k < c.k THEN p.s::DOUBLE * 2 ELSE (p.w * c.top)::DOUBLE / (2 * c.rest)::DOUBLE END AS target,
    ('0x' || substr(md5('{SEED}' || CASE WHEN p.source IS NULL THEN 'n' ELSE 's' || p.source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM p, c
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate * place + u) - floor(rate * (place - 1) + u)))::BIGINT AS taken FROM r
"""
