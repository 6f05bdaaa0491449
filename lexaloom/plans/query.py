"""Query processing and variant expansion: on the driver for one query, as expressions for a table of queries."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaloom.functions import edit as E
from lexaloom.functions import text as X
from lexaloom.operators import correction as K
from lexaloom.plans.policy import DEFAULT, Policy


def _java(pattern: str) -> str:
    return regex.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)


_STEPS = [(regex.compile(_java(p)), " " if p != X.COMMENT else "") for p in (X.HIDDEN_BLOCK, X.COMMENT, X.BLOCK_TAG)] + [(regex.compile(X.TAG), "")]
_BLANKS, _INVISIBLE, _DROP = (regex.compile(_java(p)) for p in (X.BLANKS, X.INVISIBLE, X.PERSIAN_DROP))
_PERSIAN = str.maketrans(X.PERSIAN_FROM, X.PERSIAN_TO)
_LETTER = regex.compile(r"[\p{L}\p{N}]")


def sanitize(text: str) -> str:
    t = X._ENTITY.sub(lambda m: html.unescape(m[0]), text)
    for pattern, by in _STEPS:
        t = pattern.sub(by, t)
    t = t.translate(dict.fromkeys(map(ord, X.JOINERS), " "))
    return regex.sub(" +", " ", _INVISIBLE.sub("", _BLANKS.sub(" ", t))).strip(" ")


def normalize(text: str, locale: str) -> str:
    if E.chain(locale.strip().lower())[-1] == "fa":
        text = _DROP.sub("", text.translate(_PERSIAN))
    return regex.sub(r"[\p{Z}\s]+", " ", text.lower()).strip(" ")


def tokens(normalized: str) -> list[str]:
    return list(dict.fromkeys(K.tokens_of(normalized)))


@dataclass(frozen=True)
class Processed:
    raw: str
    locale: str
    sanitized: str
    normalized: str
    tokens: tuple[str, ...]
    searchable: tuple[str, ...]
    status: str
    truncated: bool


@dataclass(frozen=True)
class TextPipeline:
    """The text steps, each of which may be another function."""

    sanitize: Callable[[str], str] = sanitize
    normalize: Callable[[str, str], str] = normalize
    tokenize: Callable[[str], list[str]] = tokens

    def prepare(self, value: str | None, locale: str | None = None) -> dict:
        at = (locale or "").strip() or "und"
        clean = self.sanitize(value or "")
        normal = self.normalize(clean, at)
        return {"locale": at, "raw": value or "", "sanitized": clean, "normalized": normal, "tokens": list(dict.fromkeys(self.tokenize(normal)))}


TEXT = TextPipeline()


def process(query: str | None, locale: str | None = None, policy: Policy = DEFAULT, text: TextPipeline = TEXT) -> Processed:
    raw, at = query or "", (locale or "").strip() or "und"
    if len(raw) > policy.maximum_length and policy.reject_long:
        return Processed(raw, at, "", "", (), (), "too_long", False)
    clean = text.sanitize(raw[: policy.maximum_length])
    normal = text.normalize(clean, at)
    found = list(dict.fromkeys(text.tokenize(normal)))
    some = tuple(t for t in found if len(t) >= policy.minimum_token_length)[: policy.maximum_tokens]
    status = "empty" if not clean else "punctuation_only" if not _LETTER.search(normal) else "too_short" if len(normal) < policy.minimum_length or not some else "ready"
    return Processed(raw, at, clean, normal, tuple(found), some, status, len(raw) > policy.maximum_length)


def process_table(queries: DataFrame, policy: Policy = DEFAULT, entities: bool = True) -> DataFrame:
    """``process`` for a table (query_id, text, locale): adds sanitized, normalized, tokens, searchable, status, truncated."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    long = F.char_length(raw) > policy.maximum_length
    rows = queries.withColumn("p", X.prepare(F.substring(raw, 1, policy.maximum_length), X.resolve_locale(F.col("locale")), entities)).select("*", "p.*").drop("p")
    some = F.slice(F.filter("tokens", lambda t: F.char_length(t) >= policy.minimum_token_length), 1, policy.maximum_tokens)
    status = F.when(F.lit(policy.reject_long) & long, "too_long").when(F.col("sanitized") == "", "empty").when(~F.col("normalized").rlike(r"[\p{L}\p{N}]"), "punctuation_only").when((F.char_length("normalized") < policy.minimum_length) | (F.size("searchable") == 0), "too_short").otherwise("ready")
    return rows.withColumn("searchable", some).withColumn("status", status).withColumn("truncated", long & F.lit(not policy.reject_long))


def original_variants(processed: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The original variant of each ready query, for batch search without expansion."""
    ready = processed.where("status = 'ready'")
    key = X.fingerprint("original", F.col("normalized"), X.resolve_locale(F.col("locale")), "", "")
    return ready.select("query_id", F.lit(0).alias("variant"), F.col("normalized").alias("query"), X.resolve_locale(F.col("locale")).alias("locale"), F.col("searchable").alias("tokens"), F.lit("original").alias("source"), F.lit(policy.priorities["original"]).alias("priority"), key.alias("fingerprint"), F.lit(None).cast("string").alias("parent"))


def keyboard_variants(processed: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """``keyboard`` of each ready query of an English locale: what its keys type on a Persian layout (query_id, query, locale, tokens)."""
    at, typed = X.resolve_locale(F.col("locale")), F.col("sanitized")
    rows = processed.where((F.col("status") == "ready") & (F.get(F.split(at, "[-_]"), 0) == "en") & (F.char_length(typed) >= policy.minimum_length))
    mapped = rows.select("query_id", typed.alias("typed"), E.keyboard_remap(typed).alias("text"), F.lit("fa").alias("locale")).where("text <> typed")
    made = process_table(mapped.drop("typed"), policy)
    return made.where(F.col("normalized").rlike(r"[\p{L}\p{N}]") & (F.size("tokens") > 0)).select("query_id", F.col("normalized").alias("query"), "locale", "tokens")


def original(p: Processed, policy: Policy = DEFAULT) -> K.Variant:
    return K.Variant(p.normalized, p.locale, p.searchable, "original", policy.priorities["original"], K.digest("original", p.normalized, p.locale, "", ""))


def keyboard(v: K.Variant, typed: str, policy: Policy = DEFAULT, text: TextPipeline = TEXT) -> K.Variant | None:
    if not policy.keyboard or E.chain(v.locale)[-1] != "en" or len(typed) < policy.minimum_length:
        return None
    mapped = E.remap_keys(typed)
    fa = process(mapped, "fa", policy, text)
    if mapped == typed or not _LETTER.search(fa.normalized) or not fa.tokens:
        return None
    operation = K.digest("en_to_fa", typed, fa.normalized, v.locale, fa.locale)
    return K.derived(v, "keyboard", fa.normalized, "fa", fa.tokens, policy, operation, keyboard=True)


def spelling(query: str, locale: str, dictionary: K.Dictionary, policy: Policy) -> list[dict]:
    return K.spelling_corrections(K.tokens_of(query), dictionary.spelling(query, locale, policy), locale, policy)


@dataclass(frozen=True)
class Correctors:
    """What expansion asks for other queries; each may be another function."""

    spelling: Callable[..., list[dict]] = spelling
    advanced: Callable[..., list[dict]] = K.advanced_corrections
    synonyms: Callable[..., Iterable[tuple[str, ...]]] = K.synonyms


CORRECTORS = Correctors()


def expand(p: Processed, policy: Policy = DEFAULT, dictionary: K.Dictionary | None = None, text: TextPipeline = TEXT, by: Correctors = CORRECTORS) -> K.Variants:
    """All variants in their fixed order; one that doesn't fit any more is left out."""
    out = K.Variants(policy.maximum_variants)
    first = original(p, policy)
    out.add(first)
    roots = [(first, "")]
    if other := keyboard(first, p.sanitized, policy, text):
        out.add(other)
        roots.append((other, "keyboard_"))
    fixed = []
    if policy.spelling and dictionary:
        for root, prefix in roots:
            if out.full:
                break
            for s in by.spelling(root.query, root.locale, dictionary, policy):
                operation = K.digest("spelling", root.fingerprint, root.query, s["query"], s["locale"])
                v = K.derived(root, prefix + "spelling", s["query"], s["locale"], s["tokens"], policy, operation, cost=s["cost"])
                if out.add(v):
                    fixed.append(v)
    if dictionary and (policy.phonetic or policy.segmentation):
        kept, done = {v.fingerprint for v in out.items}, set()
        for root in [*[v for v in fixed if v.fingerprint in kept], *[r for r, _ in roots]]:
            if out.full or (root.locale, root.query) in done:
                continue
            done.add((root.locale, root.query))
            for s in by.advanced(root.query, root.locale, dictionary, policy, min(policy.corrected_tokens, policy.transformation_depth)):
                name = ("keyboard_" if root.keyboard else "") + s["kind"]
                operation = K.digest("advanced", root.fingerprint, s["kind"], s["query"], s["locale"], s["cost"], len(s["changes"]))
                out.add(K.derived(root, name, s["query"], s["locale"], K.tokens_of(s["query"]), policy, operation, depth=len(s["changes"]), cost=s["cost"]))
                if out.full:
                    break
    if policy.synonyms:
        rules = K.synonym_rules(policy.synonyms, lambda t, loc: text.prepare(t, loc)["tokens"])
        for root, prefix in roots:
            for made in by.synonyms(root, rules):
                if out.full:
                    return out
                out.add(K.derived(root, prefix + "synonym", " ".join(made), root.locale, made, policy, K.digest("synonym", root.query, " ".join(made))))
    return out
