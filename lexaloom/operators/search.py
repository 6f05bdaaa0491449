"""Retrieval, ranking, bridging and result shapes over DataFrames.

Everything is keyed by ``query_id``, so one plan answers one query or many. ``variants`` has the columns query_id,
variant, query, locale, tokens, source, priority, fingerprint, parent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaloom.functions.text import basis_points, id_order
from lexaloom.plans.policy import DEFAULT, REASONS, TIERS, Policy
from lexaloom.sources.tables import FIELDS, SOURCE, with_tokens

VARIANT_SCHEMA = "query_id long, variant int, query string, locale string, tokens array<string>, source string, priority int, fingerprint string, parent string"
#: So many variant terms may be broadcast; beyond them both sides are shuffled by locale and part.
BROADCAST_TERMS = 100_000
TERM_PARTS = 64
#: So many variants' candidates (a variant has at most ``per_variant_limit``) may be broadcast.
BROADCAST_VARIANTS = 200


def plan_terms(variants: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """One row per retrieval term: the whole phrase first, then the distinct tokens."""
    terms = F.slice(F.array_distinct(F.filter(F.concat(F.array("query"), "tokens"), lambda t: t != "")), 1, policy.maximum_terms)
    return variants.select("query_id", "variant", "locale", F.posexplode(terms).alias("term_at", "term"))


def matches(index: DataFrame, variants: DataFrame, *, policy: Policy = DEFAULT, partition: str | None = None, source_types: list[str] | None = None, bounded: bool = True) -> DataFrame:
    """(query_id, variant, id, fields, terms): the documents of a variant's locale with a term in a field, as substrings.

    With ``bounded`` only the first ``per_variant_limit`` + 1 ids of each variant.
    """
    active = index.where("is_active")
    if partition is not None:
        active = active.where(F.col("partition") == partition)
    if source_types:
        active = active.where(F.col("source_type").isin(source_types))
    terms = plan_terms(variants, policy)
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    inside = [F.coalesce(F.contains(F.col(f"normalized_{f}"), F.col("term")), F.lit(False)) for f in FIELDS]
    texts = active.select("id", "locale", *[f"normalized_{f}" for f in FIELDS])
    if small:
        pairs = texts.join(F.broadcast(terms), "locale")
    else:  # locales are few: documents are dealt out within them, and every part gets the terms
        parts = F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1)))
        pairs = texts.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(TERM_PARTS)).cast("int")).join(terms.withColumn("part", parts), ["locale", "part"])
    pairs = pairs.where(reduce(Column.__or__, inside))
    flags = [F.max(c).alias(f) for f, c in zip(FIELDS, inside)]
    found = pairs.groupBy("query_id", "variant", "id").agg(*flags, F.sort_array(F.collect_set(F.struct("term_at", "term"))).alias("t"))
    named = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    out = found.select("query_id", "variant", "id", named.alias("fields"), F.transform("t", lambda t: t["term"]).alias("terms"))
    if bounded:
        nth = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy("id"))
        out = out.withColumn("nth", nth).where(F.col("nth") <= policy.per_variant_limit + 1)
    return out


def retrieve(index: DataFrame, variants: DataFrame, *, policy: Policy = DEFAULT, found: DataFrame | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """Candidates (query_id, variant, id, fields, terms) and what was cut (query_id, reasons, executed).

    Equal to running the variants one after the other until the candidates are full: later variants don't run, and
    within a running one only known documents gain evidence. ``found`` may hold the rows of ``matches``.
    """
    every = matches(index, variants, policy=policy, **filters) if found is None else found
    doc, query = Window.partitionBy("query_id", "id"), Window.partitionBy("query_id")
    kept = every.where(F.col("nth") <= policy.per_variant_limit).withColumn("first", F.min("variant").over(doc))
    # windows instead of joins with aggregates: the matching scan occurs once in the plan
    earlier = query.orderBy("variant").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum((F.col("variant") == F.col("first")).cast("long")).over(earlier), F.lit(0))
    placed = kept.withColumn("arrival", F.dense_rank().over(query.orderBy("first", "id"))).withColumn("before", before)
    candidates = placed.where((F.col("arrival") <= policy.maximum_candidates) & (F.col("before") < policy.maximum_candidates)).select("query_id", "variant", "id", "fields", "terms")

    new = every.groupBy("query_id", "id").agg(F.min(F.when(F.col("nth") <= policy.per_variant_limit, F.col("variant"))).alias("variant"))
    counts = new.where("variant is not null").groupBy("query_id", "variant").agg(F.count(F.lit(1)).alias("n"))
    over = every.where(F.col("nth") > policy.per_variant_limit).select("query_id", "variant").distinct().withColumn("over", F.lit(True))
    ran = variants.select("query_id", "variant").join(counts, ["query_id", "variant"], "left").join(over, ["query_id", "variant"], "left")
    seen = F.coalesce(F.sum("n").over(query.orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = ran.withColumn("runs", seen < policy.maximum_candidates).groupBy("query_id").agg(
        F.coalesce(F.max(F.col("over") & F.col("runs")), F.lit(False)).alias("limited"),
        (F.coalesce(F.sum("n"), F.lit(0)) >= policy.maximum_candidates).alias("full"),
        F.count_if(~F.col("runs")).alias("skipped"),
        F.count_if("runs").alias("executed"),
    )
    flags = [F.when(F.col("limited"), REASONS[0]), F.when(F.col("full"), REASONS[1]), F.when(F.col("skipped") > 0, REASONS[2])]
    return candidates, told.select("query_id", F.filter(F.array(*flags), lambda r: r.isNotNull()).alias("reasons"), "executed")


def tier(query: Column, query_tokens: Column) -> tuple[Column, Column, Column]:
    """Tier ordinal (null: no match), matched tokens and coverage of a document row for a variant. The first field with any token decides."""
    q, n = query_tokens, F.size(query_tokens)
    result = F.lit(None).cast("struct<tier:int,matched:int>")
    made = lambda t, m: F.struct(F.lit(TIERS.index(t)).alias("tier"), m.cast("int").alias("matched"))
    for f in reversed(FIELDS):
        tokens = F.col(f"{f}_tokens")
        hits = F.size(F.array_intersect(q, tokens))
        at = F.array_position(tokens, F.get(q, 0)).cast("int")
        step = F.when(F.slice(tokens, 1, n) == q, made("title_prefix", n)) if f == "title" else F
        step = step.when((at > 0) & (F.slice(tokens, F.greatest(at, F.lit(1)), n) == q), made(f"{f}_phrase", n))
        step = step.when(hits == n, made(f"{f}_all_tokens", hits)).when(hits > 0, made(f"{f}_any_token", hits))
        result = F.when(F.size(tokens) > 0, F.coalesce(step, result)).otherwise(result)
    result = F.when(F.col("normalized_title").isNotNull() & (F.col("normalized_title") == query), made("exact_title", n)).when(n == 0, None).otherwise(result)
    full = result["tier"].isin([i for i, t in enumerate(TIERS) if not t.endswith("_any_token")])
    return result["tier"], result["matched"], F.when(full, F.lit(10000).cast("long")).otherwise(basis_points(result["matched"], n))


def variant_ranks(candidates: DataFrame, index: DataFrame, variants: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """A row for each candidate and variant with evidence whose tokens match: tier, score, matched, coverage."""
    unique = variants.withColumn("q", F.array_distinct("tokens"))
    # at most per_variant_limit candidates a variant; the stored fields of other documents are then never evaluated
    few = variants.limit(BROADCAST_VARIANTS + 1).count() <= BROADCAST_VARIANTS
    found = index.join(F.broadcast(candidates) if few else candidates, "id")
    if "title_tokens" not in index.columns:  # an index without stored tokens: of the candidates only
        found = with_tokens(found)
    rows = found.join(unique.select("query_id", "variant", "query", "q", F.col("source").alias("variant_source"), "fingerprint", F.col("priority").alias("variant_priority")), ["query_id", "variant"])
    t, matched, coverage = tier(F.col("query"), F.col("q"))
    scores = F.array(*[F.lit(policy.tier_scores[x]) for x in TIERS])
    names = F.array(*[F.lit(x) for x in TIERS])
    ranked = rows.withColumn("tier_at", t).where("tier_at is not null").withColumn("matched", matched).withColumn("coverage", coverage)
    return ranked.withColumn("tier", F.get(names, F.col("tier_at"))).withColumn("score", F.get(scores, F.col("tier_at")))


BEST = ("tier_at", "score desc", "variant_priority desc", "coverage desc", "matched desc", "fingerprint")


def _order(names: tuple[str, ...]) -> list[Column]:
    return [F.col(n.split()[0]).desc() if n.endswith(" desc") else F.col(n) for n in names]


def rank(candidates: DataFrame, index: DataFrame, variants: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Each candidate with its best variant, and its ``place`` among all of the query."""
    best = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*_order(BEST)))
    rows = variant_ranks(candidates, index, variants, policy).withColumn("nth", best).where("nth = 1").drop("nth")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*final_order())))


def final_order() -> list[Column]:
    length = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.lit(2147483647)).otherwise(F.char_length("title"))
    return [*_order(("tier_at", "variant_priority desc", "coverage desc", "matched desc", "priority desc")), length, F.col("source_key"), F.col("partition"), F.col("locale"), *id_order(F.col("id").cast("string"))]


def bridge(ranked: DataFrame, index: DataFrame, locale: str, policy: Policy = DEFAULT) -> DataFrame:
    """Present each hit in the wanted locale where its source has an active document there; one row per presented document.

    Only documents of that locale whose source is among the hits are grouped.
    """
    want = F.lit(locale)
    if not policy.bridge:
        status = F.when(F.col("locale") == want, "not_required").otherwise("disabled")
        shown = ranked.select("*", F.col("id").alias("presented_id"), status.alias("bridge_status"))
    else:
        key = ["partition", "source_key"]
        there = index.where(F.col("is_active") & (F.col("locale") == want)).select(*key, F.struct("id", "source_type", "source_id").alias("other"))
        asked = ranked.where(F.col("locale") != want).select(*key).distinct()
        pick = there.join(asked, key, "left_semi").groupBy(*key).agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("n"))
        joined = ranked.join(pick, key, "left").withColumn("elsewhere", (F.col("locale") != want) & F.col("n").isNotNull())
        same = (F.col("other.source_type") == F.col("source_type")) & F.col("other.source_id").eqNullSafe(F.col("source_id"))
        sure = F.when(F.col("n") > 1, F.raise_error(F.lit("several counterparts for one identity"))).when(~same, F.raise_error(F.lit("the counterpart belongs to another source"))).otherwise(F.col("other.id"))
        status = F.when(F.col("locale") == want, "not_required").when(F.col("elsewhere"), "bridged").otherwise("counterpart_missing")
        shown = joined.withColumn("bridge_status", status).withColumn("presented_id", F.when(F.col("elsewhere"), sure).otherwise(F.col("id"))).drop("other", "n", "elsewhere")
    once = F.row_number().over(Window.partitionBy("query_id", "presented_id").orderBy("place"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return shown.withColumn("nth", once).where("nth = 1").drop("nth").withColumn("place", again)


def page(window: DataFrame, number: int, per_page: int) -> DataFrame:
    low = (number - 1) * per_page
    return window.where((F.col("place") > low) & (F.col("place") <= low + per_page))


def page_metadata(total: int, exact: bool, number: int, per_page: int, limited: bool = False) -> dict:
    """Numbers that describe a page; the last page is unknown where the window was cut."""
    last = max(1, -(-total // per_page))
    if limited and number > last:
        raise ValueError("the page lies behind a cut result window")
    first = (number - 1) * per_page + 1
    shown = max(0, min(total, number * per_page) - first + 1)
    return {"total": total, "exact": exact, "page": number, "per_page": per_page, "last_page": last if exact else None, "has_next": number * per_page < total, "from": first if shown else None, "to": first + shown - 1 if shown else None}


def page_table(window: DataFrame, told: DataFrame, number: int, per_page: int) -> DataFrame:
    """``page_metadata`` of every query (told as of ``retrieve``): the last page is unknown where the window was cut, and a page behind it is refused."""
    n = window.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    rows = told.select("query_id", (F.size("reasons") == 0).alias("exact")).join(n, "query_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long")
    first = (number - 1) * per_page + 1
    shown = F.greatest(F.lit(0), F.least("total", F.lit(number * per_page)) - first + 1)
    end = F.when(~F.col("exact") & (F.lit(number) > last), F.raise_error(F.lit("the page lies behind a cut result window"))).when(F.col("exact"), last)
    some = F.when(shown > 0, F.lit(first).cast("long"))
    return rows.select("query_id", "total", "exact", end.alias("last_page"), (F.lit(number * per_page) < F.col("total")).alias("has_next"), some.alias("first"), (some + shown - 1).cast("long").alias("last"))


def facets(window: DataFrame, fields: tuple[str, ...] = ("source_type", "partition", "locale")) -> DataFrame:
    """(query_id, field, value, n) over the whole window, in one aggregation."""
    pairs = window.select("query_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"))
    return pairs.groupBy("query_id", "x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def groups(window: DataFrame, per_group: int, policy: Policy = DEFAULT) -> DataFrame:
    """The first items of each source type with the type's count; groups in the order of their first item."""
    own = Window.partitionBy("query_id", "source_type")
    rows = window.withColumn("group_count", F.count(F.lit(1)).over(own)).withColumn("group_first", F.min("place").over(own)).withColumn("in_group", F.row_number().over(own.orderBy("place")))
    rows = rows.where(F.col("in_group") <= per_group)
    return rows.withColumn("group_place", F.dense_rank().over(Window.partitionBy("query_id").orderBy("group_first"))).where(F.col("group_place") <= policy.maximum_groups)


def preview(window: DataFrame, limit: int, per_type: int) -> DataFrame:
    """At most ``per_type`` of a type while that fills the preview, then the best of the rest; in rank order."""
    nth = F.row_number().over(Window.partitionBy("query_id", "source_type").orderBy("place"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("nth") > per_type, "place"))
    return window.withColumn("nth", nth).withColumn("turn", turn).where(F.col("turn") <= limit).drop("nth", "turn")


def hydrate(shown: DataFrame, sources: DataFrame, keys: tuple[str, ...] = SOURCE) -> DataFrame:
    """Source rows for the few documents that are shown, by type, connection and id; the join comes after the limit."""
    theirs = sources.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in sources.columns if c not in keys])
    return shown.join(theirs, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def full_coverage(matched: DataFrame, variants: DataFrame, cap: int) -> DataFrame:
    """(query_id, variant, n, approximate): documents that have every token of a variant as a substring, counted up to a cap."""
    rows = matched.join(variants.select("query_id", "variant", "tokens"), ["query_id", "variant"]).where(F.size(F.array_except("tokens", "terms")) == 0)
    n = rows.groupBy("query_id", "variant").agg(F.count(F.lit(1)).alias("all"))
    whole = variants.select("query_id", "variant").join(n, ["query_id", "variant"], "left").withColumn("all", F.coalesce("all", F.lit(0)))
    return whole.select("query_id", "variant", F.least("all", F.lit(cap).cast("long")).alias("n"), (F.col("all") > cap).alias("approximate"))
