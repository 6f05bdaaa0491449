"""The search engine: a fluent builder whose terminal calls return DataFrames and small metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaloom.operators import contextual as C
from lexaloom.operators import correction as K
from lexaloom.operators import search as S
from lexaloom.operators import suggestion as G
from lexaloom.plans import query as Q
from lexaloom.plans.policy import DEFAULT, Policy


@dataclass
class Outcome:
    """Rows in rank order and what is known about them."""

    rows: DataFrame | None
    window: DataFrame | None
    status: str
    total: int = 0
    exact: bool = True
    reasons: tuple[str, ...] = ()
    suggestion: dict | None = None
    variants: list = field(default_factory=list)
    meta: dict = field(default_factory=dict)
    facets: DataFrame | None = None


@dataclass(frozen=True)
class Contracts:
    """The stages of a search. Each may be another function of the same shape; signals are 0 to 1 for a query and its locale."""

    text: Q.TextPipeline = Q.TEXT
    correctors: Q.Correctors = Q.CORRECTORS
    expand: Callable[..., K.Variants] = Q.expand
    matches: Callable[..., DataFrame] = S.matches
    retrieve: Callable[..., tuple[DataFrame, DataFrame]] = S.retrieve
    rank: Callable[..., DataFrame] = S.rank
    bridge: Callable[..., DataFrame] = S.bridge
    contextual: Callable[..., list[dict]] = C.corrections
    evidence: Callable[..., list[C.Evidence]] = C.evidence
    count: Callable[..., tuple[int, bool]] | None = None
    popularity: Callable[[str, str], float] = lambda query, locale: 0.0
    clicks: Callable[[str, str], float] = lambda query, locale: 0.0
    suggest: Callable[..., dict | None] = G.suggest


class SearchEngine:
    def __init__(self, index: DataFrame, dictionary: K.Dictionary | None = None, policy: Policy = DEFAULT, default_partition: str = "default", contracts: Contracts | None = None) -> None:
        self.index, self.dictionary, self.policy, self.default_partition = index, dictionary, policy, default_partition
        self.by = contracts or Contracts()

    def query(self, text: str | None) -> Search:
        return Search(self, text)

    # direct diagnostics
    def process(self, text: str | None, locale: str | None = None) -> Q.Processed:
        return Q.process(text, locale, self.policy, self.by.text)

    def prepare_text(self, text: str | None, locale: str | None = None) -> dict:
        return self.by.text.prepare(text, locale)

    def normalize(self, text: str, locale: str = "und") -> str:
        return self.prepare_text(text, locale)["normalized"]

    def tokens(self, text: str, locale: str = "und") -> list[str]:
        return self.prepare_text(text, locale)["tokens"]

    def expand(self, text: str, locale: str | None = None) -> list[K.Variant]:
        p = self.process(text, locale)
        return self.by.expand(p, self.policy, self.dictionary, self.by.text, self.by.correctors).items if p.status == "ready" else []

    def spelling_corrections(self, text: str, locale: str | None = None) -> list[dict]:
        p = self.process(text, locale)
        return self.by.correctors.spelling(p.normalized, p.locale, self.dictionary, self.policy) if self.dictionary and p.status == "ready" else []

    def advanced_corrections(self, text: str, locale: str | None = None) -> list[dict]:
        p = self.process(text, locale)
        return self.by.correctors.advanced(p.normalized, p.locale, self.dictionary, self.policy) if self.dictionary and p.status == "ready" else []


@dataclass(frozen=True)
class Search:
    engine: SearchEngine
    text: str | None
    at: str | None = None
    where: str | None = None
    types: tuple[str, ...] = ()
    limited: int | None = None
    skipped: int = 0
    expanded: bool = True
    facet_fields: tuple[str, ...] = ()

    def locale(self, value: str) -> Search:
        return replace(self, at=value)

    def partition(self, value: str) -> Search:
        return replace(self, where=value)

    def source_types(self, *values: str) -> Search:
        return replace(self, types=tuple(dict.fromkeys(values)))

    def limit(self, value: int) -> Search:
        if value < 1:
            raise ValueError("a limit is at least 1")
        return replace(self, limited=value)

    def offset(self, value: int) -> Search:
        if value < 0:
            raise ValueError("an offset is not negative")
        return replace(self, skipped=value)

    def facets(self, *fields: str) -> Search:
        if set(fields) - {"source_type", "partition", "locale"}:
            raise ValueError("facets are source_type, partition and locale")
        return replace(self, facet_fields=fields)

    def without_expansion(self) -> Search:
        return replace(self, expanded=False)

    def _filters(self) -> dict:
        return {"partition": self.where or self.engine.default_partition, "source_types": list(self.types) or None}

    def _run(self, preview: bool = False) -> Outcome:
        e, policy, by = self.engine, self.engine.policy, self.engine.by
        p = e.process(self.text, self.at)
        if p.status != "ready":
            return Outcome(None, None, p.status)
        variants = by.expand(p, policy, e.dictionary, by.text, by.correctors) if self.expanded else K.Variants(policy.maximum_variants, [Q.original(p, policy)])
        spark = e.index.sparkSession
        if policy.contextual and e.dictionary and self.expanded:
            memo: dict[tuple, tuple[int, bool]] = {}

            def count(v: K.Variant) -> tuple[int, bool]:
                if (v.locale, v.query) not in memo:
                    one = K.Variants(1, [v]).frame(spark)
                    r = S.full_coverage(by.matches(e.index, one, policy=policy, **self._filters()), one, policy.count_cap).first()
                    memo[v.locale, v.query] = (r.n, r.approximate)
                return memo[v.locale, v.query]

            signals = lambda q, loc: by.popularity(q, loc) + by.clicks(q, loc)
            for c in by.contextual(list(variants.items), e.dictionary, by.count or count, policy, preview, signals, by.evidence):
                variants.add_over_weaker(c["variant"])
        frame = variants.frame(spark)
        # a bounded table (variants times their limit), read by several steps
        matched = by.matches(e.index, frame, policy=policy, **self._filters())
        matched = spark.createDataFrame(matched.collect(), matched.schema)
        candidates, told = by.retrieve(e.index, frame, policy=policy, found=matched)
        said = told.first()
        reasons = tuple(said.reasons) if said else ()
        window = by.bridge(by.rank(candidates, e.index, frame, policy), e.index, p.locale, policy)
        out = Outcome(window, window, p.status, window.count(), not reasons, reasons, None, variants.items)
        if len(variants.items) > 1:
            kin = G.families(variants.items)
            members = spark.createDataFrame(list(kin.items()), "fingerprint string, family string")
            found = G.family_results(S.variant_ranks(candidates, e.index, frame, policy), members).collect()
            out.suggestion = by.suggest(variants.items, {r.family: (r.n, r.tier_at) for r in found}, out.exact, policy)
        if self.facet_fields:
            out.facets = S.facets(window, self.facet_fields).orderBy("field", F.desc("n"), "value")
        return out

    def _shown(self, out: Outcome) -> Outcome:
        """A contextual suggestion stays only if its own variant is among the rows shown."""
        s = out.suggestion
        if s and s["source"] == "contextual" and out.rows.where(F.col("fingerprint") == s["fingerprint"]).isEmpty():
            out.suggestion = None
        return out

    def results(self) -> Outcome:
        out = self._run()
        if out.window is None:
            return out
        low = self.skipped
        rows = out.window.where(F.col("place") > low)
        if self.limited is not None:
            rows = rows.where(F.col("place") <= low + self.limited)
        out.rows = rows.orderBy("place")
        return self._shown(out)

    def paginate(self, page: int = 1, per_page: int | None = None) -> Outcome:
        policy = self.engine.policy
        size = per_page or policy.per_page
        if page < 1 or not 1 <= size <= policy.maximum_per_page:
            raise ValueError("no such page")
        out = self._run()
        out.meta = S.page_metadata(out.total, out.exact, page, size, bool(out.reasons))
        if out.window is not None:
            out.rows = S.page(out.window, page, size).orderBy("place")
            self._shown(out)
        return out

    def preview(self, limit: int | None = None, per_type: int | None = None) -> Outcome:
        policy = self.engine.policy
        out = self._run(True)
        if out.window is not None:
            out.rows = S.preview(out.window, limit or policy.preview_limit, per_type or policy.preview_per_type).orderBy("place")
            self._shown(out)
        return out

    def group_by_source_type(self, per_group: int = 5) -> Outcome:
        out = self._run()
        if out.window is not None:
            out.rows = S.groups(out.window, per_group, self.engine.policy).orderBy("group_place", "place")
        return out


def batch_search(index: DataFrame, queries: DataFrame, policy: Policy = DEFAULT, **filters) -> DataFrame:
    """Ranked results of many queries (query_id, text, locale) without expansion, in one plan."""
    variants = Q.original_variants(Q.process_table(queries, policy, entities=False), policy)
    candidates, _ = S.retrieve(index, variants, policy=policy, **filters)
    return S.rank(candidates, index, variants, policy)
