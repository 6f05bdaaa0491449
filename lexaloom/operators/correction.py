"""Query corrections: spelling, phonetic, split and merge, keyboard and synonyms, as bounded searches over few rows.

The searches prune step by step and the pruning shows in their results, so they run per query: on the driver for one
query, or inside ``applyInPandas`` per query id for a batch. All corpus data comes from dictionary joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaloom.functions import edit as E
from lexaloom.functions.text import TOKEN
from lexaloom.operators import dictionary as D
from lexaloom.plans.policy import DEFAULT, Policy

_TOKEN = regex.compile(TOKEN)
_WORD = regex.compile(r"[\p{M}\p{L}]+")
_UNSAFE = regex.compile(r"(?i)@|_|www\.|[a-z][-+.a-z0-9]*://|\p{N}\p{L}|\p{L}\p{N}|[0-9][,.][0-9]|[\p{N}\p{L}]+-[\p{N}\p{L}]+")
_BLANK = regex.compile(r"\h+")
LONGEST = 191


def digest(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def bytes_of(texts) -> bytes:
    return "\0".join(texts).encode()


@dataclass(frozen=True)
class Variant:
    query: str
    locale: str
    tokens: tuple[str, ...]
    source: str
    priority: int
    fingerprint: str
    parent: str | None = None
    depth: int = 0
    keyboard: bool = False
    cost: int = 0
    note: tuple = ()


class Dictionary:
    """The dictionary tables as the correctors ask for them; every answer is a few bounded rows."""

    def __init__(self, terms: DataFrame, deletes: DataFrame, ngrams: DataFrame | None = None, ready: set[str] | None = None) -> None:
        self.terms, self.deletes, self.ngrams, self.ready = terms, deletes, ngrams, ready or set()

    @property
    def spark(self) -> SparkSession:
        return self.terms.sparkSession

    def rows(self, terms, locales: list[str], limit: int) -> dict[str, dict[str, dict]]:
        found: dict[str, dict[str, dict]] = {}
        wanted = sorted(set(terms))
        if wanted:
            for r in self.terms.where(F.col("locale").isin(locales) & F.col("term").isin(wanted)).orderBy("locale", "term").limit(limit).collect():
                found.setdefault(r.locale, {})[r.term] = r.asDict()
        return found

    def spelling(self, query: str, locale: str, policy: Policy) -> dict[int, list[dict]]:
        queries = self.spark.createDataFrame([(0, locale, query)], "query_id long, locale string, query string")
        rows = D.spelling_options(self.deletes, self.terms, D.spelling_requests(queries, self.terms, policy), policy).orderBy("at", "option").collect()
        out: dict[int, list[dict]] = {}
        for r in rows:
            out.setdefault(r.at, []).append(r.asDict())
        return out

    def near(self, keys: list[str], locales: list[str], limit: int) -> list[dict]:
        if not keys:
            return []
        hit = self.deletes.where(F.col("locale").isin(locales) & F.col("delete_key").isin(keys)).join(self.terms, ["locale", "term"])
        return [r.asDict() for r in hit.orderBy("locale", F.desc("document_frequency"), "term").limit(limit).collect()]

    def grams(self, hashes: list[str], locales: list[str], limit: int) -> dict[tuple[str, str], int]:
        if self.ngrams is None or not hashes or not locales:
            return {}
        rows = self.ngrams.where(F.col("locale").isin(locales) & F.col("gram_hash").isin(hashes)).withColumn("score", D.corpus_score()).select("locale", "gram", "score", "gram_hash").orderBy("locale", "gram_hash").limit(limit).collect()
        return {(r.locale, r.gram): r.score for r in rows}


# --- spelling


def spelling_beam(words: list[str], options: dict[int, list[dict]], policy: Policy = DEFAULT) -> list[dict]:
    """Ordered corrected token lists, of at most ``corrected_tokens`` changes; each step keeps the best few."""
    places = [at for at in sorted(options) if options[at]]
    keep = max(20, policy.spelling_variants * 4)
    states = [{"tokens": list(words), "fixed": [], "cost": 0, "frequency": 0, "open": len(places)}]
    for at in places:
        grown = []
        for s in states:
            grown.append(s)
            if len(s["fixed"]) < policy.corrected_tokens:
                for o in options[at]:
                    tokens = [*s["tokens"][:at], o["term"], *s["tokens"][at + 1 :]]
                    grown.append({"tokens": tokens, "fixed": [*s["fixed"], o], "cost": s["cost"] + o["cost"], "frequency": s["frequency"] + o["document_frequency"], "open": s["open"] - 1})
        grown.sort(key=lambda s: (s["open"], s["cost"], -s["frequency"], bytes_of(s["tokens"])))
        states = list({bytes_of(s["tokens"]): s for s in reversed(grown)}.values())[::-1][:keep]
    return [s for s in states if s["fixed"]]


def spelling_corrections(words: list[str], options: dict[int, list[dict]], locale: str, policy: Policy = DEFAULT) -> list[dict]:
    out: dict[tuple, dict] = {}
    for s in spelling_beam(words, options, policy):
        at = s["fixed"][0]
        where = next((o["locale"] for o in options[at["at"]] if o["term"] == at["term"]), locale)
        out.setdefault((where, " ".join(s["tokens"])), {**s, "query": " ".join(s["tokens"]), "locale": where})
    return list(out.values())[: policy.spelling_variants]


def spelling_batch(queries: DataFrame, terms: DataFrame, deletes: DataFrame, policy: Policy = DEFAULT, requests: DataFrame | None = None) -> DataFrame:
    """Corrections of many queries (query_id, locale, query): query_id, place, corrected, locale, cost, corrections. Equal queries are corrected once.

    ``requests``: those of ``distinct_queries``, where they are at hand.
    """
    once, back = D.distinct_queries(queries)
    options = D.spelling_options(deletes, terms, D.spelling_requests(once, terms, policy) if requests is None else requests, policy)
    rows = options.join(once.select("query_id", "query", F.col("locale").alias("own")), "query_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list[dict]] = {}
        for r in group.sort_values(["at", "option"]).to_dict("records"):
            by.setdefault(r["at"], []).append(r)
        found = spelling_corrections(_TOKEN.findall(group["query"].iloc[0]), by, group["own"].iloc[0], policy)
        return pd.DataFrame([(group["query_id"].iloc[0], i + 1, s["query"], s["locale"], s["cost"], len(s["fixed"])) for i, s in enumerate(found)], columns=["first", "place", "corrected", "locale", "cost", "corrections"])

    found = rows.groupBy("query_id").applyInPandas(run, "first long, place int, corrected string, locale string, cost long, corrections int")
    return back.join(found, "first").drop("first")


# --- phonetic, split, merge


@dataclass
class _Proposal:
    kind: str
    at: int
    old: list[str]
    new: list[str]
    query: str
    cost: int
    rule: str
    locale: str = ""
    frequency: int = 0


_KINDS = {"phonetic": 0, "split": 1, "merge": 2}


def safe_word(token: str) -> bool:
    return _WORD.fullmatch(token) is not None


def _parts(query: str) -> list[tuple[str, int, int, str]]:
    out, last = [], 0
    for m in _TOKEN.finditer(query):
        out.append((m[0], m.start(), m.end(), query[last : m.start()]))
        last = m.end()
    return out


class _Proposals(list):
    def __init__(self, limit: int, known) -> None:
        super().__init__()
        self.limit, self.terms = limit, dict.fromkeys(list(dict.fromkeys(known))[:limit])

    def offer(self, p: _Proposal) -> bool:
        """A proposal whose terms would exceed the lookup budget is left out whole."""
        new = [t for t in p.new if t not in self.terms]
        if len(self.terms) + len(new) > self.limit:
            return False
        self.terms |= dict.fromkeys(new)
        self.append(p)
        return True


def _phonetic(found: _Proposals, query: str, parts: list, family: str, protected: set[str], policy: Policy) -> None:
    looked = 0
    for at, (token, start, end, _) in enumerate(parts):
        if looked >= policy.inspected_tokens:
            return
        if not safe_word(token) or len(token) < policy.phonetic_minimum_length or token in protected:
            continue
        looked += 1
        frontier, seen, made = [(token, 0, ())], {token}, 0
        for _ in range(policy.phonetic_changes):
            following = []
            for text, cost, rules in frontier:
                for other, extra, rule in E.sound_alternatives(text, family):
                    made += 1
                    if made > policy.phonetic_alternatives:
                        break
                    if other in seen or not safe_word(other) or len(other) > LONGEST:
                        continue
                    seen.add(other)
                    total = cost + extra
                    if found.offer(_Proposal("phonetic", at, [token], [other], query[:start] + other + query[end:], total + policy.phonetic_cost, "+".join([*rules, rule]))):
                        following.append((other, total, (*rules, rule)))
                if made > policy.phonetic_alternatives:
                    break
            if made > policy.phonetic_alternatives:
                break
            frontier = following


def _split(found: _Proposals, query: str, parts: list, family: str, protected: set[str], policy: Policy) -> None:
    gap, least = E.SEPARATOR.get(family, " "), policy.segment_minimum_length
    for at, (token, start, end, _) in enumerate(parts):
        if safe_word(token) and len(token) >= policy.split_minimum_length and token not in protected:
            for cut in list(range(least, len(token) - least + 1))[: policy.split_positions]:
                two = [token[:cut], token[cut:]]
                found.offer(_Proposal("split", at, [token], two, query[:start] + gap.join(two) + query[end:], policy.split_cost, "dictionary_split"))


def _merge(found: _Proposals, query: str, parts: list, protected: set[str], policy: Policy) -> None:
    for at in range(min(len(parts) - 1, policy.merge_pairs)):
        (a, start, _, _), (b, _, end, gap) = parts[at], parts[at + 1]
        one = a + b
        if _BLANK.fullmatch(gap) and safe_word(a) and safe_word(b) and not protected & {a, b, one} and len(one) <= LONGEST:
            found.offer(_Proposal("merge", at, [a, b], [one], query[:start] + one + query[end:], policy.merge_cost, "dictionary_merge"))


def common_locale(rows: dict, locales: list[str], terms) -> str | None:
    return next((x for x in locales if all(t in rows.get(x, {}) for t in terms)), None)


def score(row: dict) -> int:
    return row["document_frequency"] * 100 + row["title_frequency"] * 10 + row["keyword_frequency"]


def advanced_corrections(query: str, locale: str, dictionary: Dictionary, policy: Policy = DEFAULT, phonetic_left: int | None = None) -> list[dict]:
    """Phonetic, split and merge corrections in order: kind, query, locale, cost, changes, unresolved."""
    left = policy.corrected_tokens if phonetic_left is None else phonetic_left
    locales = E.chain(locale)
    family = locales[-1]
    if family not in E.PROFILES or _UNSAFE.search(query) or not (parts := _parts(query)):
        return []
    protected = policy.protected_terms(locale)
    found = _Proposals(policy.lookup_terms, [p[0] for p in parts])
    if policy.phonetic and left > 0:
        _phonetic(found, query, parts, family, protected, policy)
    if policy.segmentation:
        _split(found, query, parts, family, protected, policy)
        _merge(found, query, parts, protected, policy)
    if not found:
        return []
    rows = dictionary.rows(found.terms, locales, policy.lookup_rows)
    known = lambda t: any(t in rows.get(x, {}) for x in locales)
    ranked = []
    for p in found:
        if (p.kind == "merge" or not known(p.old[0])) and (at := common_locale(rows, locales, p.new)):
            p.locale, p.frequency = at, sum(score(rows[at][t]) for t in p.new)
            ranked.append(p)
    ranked.sort(key=lambda p: (p.cost, _KINDS[p.kind], -p.frequency, p.query.encode()))
    by: dict[int, list[_Proposal]] = {}
    for p in ranked:
        if p.kind == "phonetic" and len(by.setdefault(p.at, [])) < policy.options_per_token:
            by[p.at].append(p)
    states = _phonetic_states(query, parts, by, rows, locales, left, policy)
    states += [{"kind": p.kind, "query": p.query, "locale": p.locale, "cost": p.cost, "frequency": p.frequency, "open": len(by), "changes": [p]} for p in ranked if p.kind == "split" or (p.kind == "merge" and policy.merges_per_query >= 1)]
    states.sort(key=lambda s: (s["open"], s["cost"], _KINDS[s["kind"]], -s["frequency"], s["query"].encode()))
    room = {"phonetic": policy.phonetic_variants, "other": policy.segmentation_variants}
    out: dict[tuple, dict] = {}
    for s in states:
        kind = "phonetic" if s["kind"] == "phonetic" else "other"
        if room[kind] > 0:
            room[kind] -= 1
            out.setdefault((s["locale"], s["query"]), s)
    return list(out.values())


def _phonetic_states(query: str, parts: list, by: dict, rows: dict, locales: list[str], left: int, policy: Policy) -> list[dict]:
    if not by or left < 1:
        return []
    states = [{"new": {}, "changes": [], "cost": 0, "frequency": 0, "open": len(by)}]
    for at in sorted(by):
        grown = []
        for s in states:
            grown.append(s)
            if len(s["changes"]) < left:
                grown += [{"new": s["new"] | {at: p.new[0]}, "changes": [*s["changes"], p], "cost": s["cost"] + p.cost, "frequency": s["frequency"] + p.frequency, "open": s["open"] - 1} for p in by[at]]
        key = lambda s: bytes_of(f"{i}:{t}" for i, t in sorted(s["new"].items()))
        grown.sort(key=lambda s: (s["open"], s["cost"], -s["frequency"], key(s)))
        states = list({key(s): s for s in reversed(grown)}.values())[::-1][: max(20, policy.phonetic_variants * 4)]
    out = []
    for s in states:
        need = [p.new[0] for p in s["changes"]]
        if need and (at := common_locale(rows, locales, need)):
            text = query
            for i in sorted(s["new"], reverse=True):
                text = text[: parts[i][1]] + s["new"][i] + text[parts[i][2] :]
            out.append({"kind": "phonetic", "query": text, "locale": at, "cost": s["cost"], "frequency": sum(score(rows[at][t]) for t in need), "open": s["open"], "changes": s["changes"]})
    return out


# --- synonyms and the variant collection


def synonym_rules(rules: dict[str, dict[str, list[str]]], prepare) -> dict[str, list[tuple]]:
    """Normalized one-way rules by locale: (source tokens, replacement tokens), without repeats and self-replacements."""
    out: dict[str, list[tuple]] = {}
    for locale, pairs in rules.items():
        for source, replacements in pairs.items():
            for text in replacements:
                rule = (tuple(prepare(source, locale)), tuple(prepare(text, locale)))
                if not rule[0] or not rule[1]:
                    raise ValueError(f"a synonym of {source!r} has no word")
                if rule[0] != rule[1] and rule not in out.setdefault(locale, []):
                    out[locale].append(rule)
    return out


def synonyms(variant: Variant, rules: dict[str, list[tuple]]) -> Iterator[tuple[str, ...]]:
    """Token lists with one rule applied at one place."""
    seen = {variant.tokens}
    for old, new in rules.get(variant.locale, ()):
        for i in range(len(variant.tokens) - len(old) + 1):
            if variant.tokens[i : i + len(old)] == old:
                made = tuple(dict.fromkeys((*variant.tokens[:i], *new, *variant.tokens[i + len(old) :])))
                if made not in seen:
                    seen.add(made)
                    yield made


def synonym_table(variants: DataFrame, rules: DataFrame) -> DataFrame:
    """``synonyms`` for a table: variants (query_id, locale, tokens), rules (locale, rule, old, new) with token arrays.

    Adds rule, at and made: each rule at each place where its words stand, made once per query in the order of rules and places.
    """
    n, k = F.size("tokens"), F.size("old")
    # rules are a configuration of one row a pair; the count is checked before they are broadcast
    small = rules.limit(SYNONYM_RULES + 1).count() <= SYNONYM_RULES
    met = variants.join(F.broadcast(rules) if small else rules, "locale").where(F.array_contains("tokens", F.get("old", 0)) & (k <= n))
    placed = met.withColumn("at", F.explode(F.sequence(F.lit(0), n - k))).where(F.slice("tokens", F.col("at") + 1, k) == F.col("old"))
    made = F.array_distinct(F.concat(F.slice("tokens", F.lit(1), F.col("at")), "new", F.slice("tokens", F.col("at") + k + 1, n)))
    once = F.row_number().over(Window.partitionBy("query_id", "made").orderBy("rule", "at"))
    return placed.withColumn("made", made).where(F.col("made") != F.col("tokens")).withColumn("nth", once).where("nth = 1").drop("nth", "old", "new")


SYNONYM_RULES = 50_000


def _cuts(words: DataFrame, policy: Policy) -> DataFrame:
    """(locale, token, cut, left, right) of the words that may be split."""
    n, least = F.char_length("token"), policy.segment_minimum_length
    cuts = F.slice(F.sequence(F.lit(least), n - least), 1, policy.split_positions)
    cut = words.where(E.safe_word(F.col("token")) & (n >= policy.split_minimum_length)).withColumn("cut", F.explode(cuts))
    return cut.withColumn("left", F.substr("token", F.lit(1), F.col("cut"))).withColumn("right", F.substr("token", F.col("cut") + 1))


def split_terms(words: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The (locale, term) that ``split_table`` looks up."""
    return _cuts(words, policy).select("locale", F.explode(F.array("token", "left", "right")).alias("term")).distinct()


def split_table(words: DataFrame, vocabulary: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Splits of unknown words (locale, token) into two known ones of their locale: locale, token, cut, left, right, frequency."""
    cut = _cuts(words, policy).join(vocabulary.select("locale", F.col("term").alias("token")), ["locale", "token"], "left_anti")
    side = lambda name: vocabulary.select("locale", F.col("term").alias(name), D.corpus_score().alias(f"{name}_score"))
    both = cut.join(side("left"), ["locale", "left"]).join(side("right"), ["locale", "right"])
    return both.select("locale", "token", "cut", "left", "right", (F.col("left_score") + F.col("right_score")).alias("frequency"))


def _merged(queries: DataFrame, policy: Policy) -> DataFrame:
    w = F.col("words")
    pairs = F.transform(F.slice(w, 1, F.least(F.greatest(F.size(w) - 1, F.lit(0)), F.lit(policy.merge_pairs))), lambda a, i: F.struct(i.alias("at"), a.alias("a"), F.get(w, i + 1).alias("b")))
    each = queries.select("query_id", "locale", F.explode(pairs).alias("p")).select("query_id", "locale", "p.*").where(E.safe_word(F.col("a")) & E.safe_word(F.col("b")))
    return each.withColumn("term", F.concat("a", "b")).where(F.char_length("term") <= LONGEST)


def merge_terms(queries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The (locale, term) that ``merge_table`` looks up."""
    return _merged(queries, policy).select("locale", "term").distinct()


def merge_table(queries: DataFrame, vocabulary: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Neighbouring words of a query (query_id, locale, words) that are one known word together: query_id, at, merged, frequency."""
    one = _merged(queries, policy)
    return one.join(vocabulary.select("locale", "term", D.corpus_score().alias("frequency")), ["locale", "term"]).select("query_id", "at", F.col("term").alias("merged"), "frequency")


@dataclass
class Variants:
    """Ordered variants without repeats of (locale, query); a stronger source takes a weaker one's place."""

    capacity: int
    items: list[Variant] = field(default_factory=list)

    @property
    def full(self) -> bool:
        return len(self.items) >= self.capacity

    def add(self, v: Variant) -> bool:
        for i, have in enumerate(self.items):
            if have.fingerprint == v.fingerprint:
                return False
            if (have.locale, have.query) == (v.locale, v.query):
                if have.source == "original" or v.priority <= have.priority:
                    return False
                self.items[i] = v
                return True
        if self.full:
            return False
        self.items.append(v)
        return True

    def add_over_weaker(self, v: Variant) -> bool:
        """Like ``add``, but a full collection gives up a leaf of lower priority that isn't an ancestor: the one
        with the same (locale, query), else the weakest. The new one goes before the first of lower priority."""
        if not self.full:
            return self.add(v)
        by = {x.fingerprint: x for x in self.items}
        if v.fingerprint in by:
            return False
        kept, at = {x.parent for x in self.items}, v.parent
        lineage: set[str] = set()
        while at is not None:
            if at not in by or at in lineage:
                return False
            lineage.add(at)
            at = by[at].parent
        may_go = lambda x: x.source != "original" and x.fingerprint not in kept | lineage and x.priority < v.priority
        twin = next((x for x in self.items if (x.locale, x.query) == (v.locale, v.query)), None)
        if twin is not None and not may_go(twin):
            return False
        victim = twin or min(filter(may_go, self.items), key=lambda x: (x.priority, x.source, x.fingerprint), default=None)
        if victim is None:
            return False
        rest = [x for x in self.items if x is not victim]
        place = next((i for i, x in enumerate(rest) if x.priority < v.priority), len(rest))
        self.items = [*rest[:place], v, *rest[place:]]
        return True

    def frame(self, spark: SparkSession, query_id: int = 0) -> DataFrame:
        from lexaloom.operators.search import VARIANT_SCHEMA

        rows = [(query_id, i, v.query, v.locale, list(v.tokens), v.source, v.priority, v.fingerprint, v.parent) for i, v in enumerate(self.items)]
        return spark.createDataFrame(rows, VARIANT_SCHEMA)


def derived(parent: Variant, source: str, query: str, locale: str, tokens, policy: Policy, operation: str, **more) -> Variant:
    return replace(parent, query=query, locale=locale, tokens=tuple(dict.fromkeys(tokens)), source=source, priority=policy.priorities[source], fingerprint=digest(source, query, locale, parent.fingerprint, operation), parent=parent.fingerprint, **more)


def tokens_of(query: str) -> list[str]:
    return _TOKEN.findall(query)
