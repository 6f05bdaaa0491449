"""Text preparation as Spark expressions: sanitize, normalize, tokenize, fingerprints."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.shipping import ship

_RUN = r"[\p{N}\p{L}][\p{N}\p{M}\p{L}]*"
TOKEN = f"{_RUN}(?:['’]{_RUN})*"
HIDDEN_BLOCK = r"(?is)<[\s]*(noscript|script|style|template)\b[^>]*>(?:.*?<[\s]*/[\s]*\1[\s]*>|.*$)"
BLOCK_TAG = r"(?i)<\s*/?\s*(?:h[1-6]|article|section|header|footer|blockquote|table|div|pre|br|td|th|tr|li|p)\b[^>]*>"
COMMENT, TAG = r"(?s)<!--.*?(?:-->|$)", r"<[^\s>][^>]*>?"
JOINERS = "​‌‍"
BLANKS = r"[\p{Z}\x09-\x0D\x{85}]+"
INVISIBLE = r"[\x{FEFF}\x{2066}-\x{2069}\x{202A}-\x{202E}\x{200E}-\x{200F}\x{86}-\x{9F}\x7F-\x{84}\x0E-\x1F\x00-\x08]"
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
#: The ampersand comes last, so nothing is decoded twice.
_COMMON = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_RARE = "&(?!(?:" + "|".join(n[1:-1] for n, _ in _COMMON) + ");)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
#: Arabic letter shapes to Persian ones, and both sets of digits to ASCII; vowel signs and tatweel go.
PERSIAN_FROM = "كيىآأإةؤ" + "۰۱۲۳۴۵۶۷۸۹" + "٠١٢٣٤٥٦٧٨٩"
PERSIAN_TO = "کییاااهو" + "0123456789" * 2
PERSIAN_DROP = r"[\x{640}\x{64B}-\x{65F}\x{670}]"


def decode_entities(text: Column) -> Column:
    """HTML entities that end in a semicolon, once. Rows that hold only the few common ones never leave the JVM."""
    ship()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: _ENTITY.sub(lambda m: html.unescape(m[0]), t) if t is not None and "&" in t else t)

    plain = text
    for name, char in _COMMON:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    rare = text.rlike(_RARE)
    return F.coalesce(F.pandas_udf(run, "string")(F.when(rare, text)), plain)


def sanitize(text: Column, entities: bool = True) -> Column:
    """Visible text of a value that may hold HTML; entities are decoded before tags go."""
    t = F.validate_utf8(F.coalesce(text, F.lit("")))
    if entities:
        t = decode_entities(t)
    for pattern in (HIDDEN_BLOCK, COMMENT, BLOCK_TAG):
        t = F.regexp_replace(t, pattern, " " if pattern != COMMENT else "")
    t = F.regexp_replace(t, TAG, "")
    t = F.translate(t, JOINERS, "   ")
    t = F.regexp_replace(F.regexp_replace(t, BLANKS, " "), INVISIBLE, "")
    return F.trim(F.regexp_replace(t, " +", " "))


def locale_family(locale: Column) -> Column:
    return F.get(F.split(F.lower(F.trim(locale)), "[-_]"), 0)


def resolve_locale(locale: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(locale), F.lit("")), F.lit("und"))


def locale_chain(locale: Column) -> Column:
    """The locale and its base, without repeats."""
    return F.array_distinct(F.array(locale, F.get(F.split(locale, "[-_]"), 0)))


def normalize(text: Column, locale: Column | None = None) -> Column:
    plain = F.lower(text)
    if locale is not None:
        persian = F.lower(F.regexp_replace(F.translate(text, PERSIAN_FROM, PERSIAN_TO), PERSIAN_DROP, ""))
        plain = F.when(locale_family(locale) == "fa", persian).otherwise(plain)
    return F.trim(F.regexp_replace(plain, r"(?U)[\p{Z}\s]+", " "))


def words(normalized: Column) -> Column:
    """Tokens with repeats."""
    return F.regexp_extract_all(normalized, F.lit(TOKEN), F.lit(0))


def tokens(normalized: Column) -> Column:
    """Distinct tokens in the order in which they first occur."""
    return F.array_distinct(words(F.coalesce(normalized, F.lit(""))))


def prepare(text: Column, locale: Column | None = None, entities: bool = True) -> Column:
    clean = sanitize(text, entities)
    normal = normalize(clean, locale)
    return F.struct(clean.alias("sanitized"), normal.alias("normalized"), tokens(normal).alias("tokens"))


def value_text(value: Column, kind: T.DataType) -> Column:
    """The searchable text of a value of any type: null is empty, a flag is 1 or 0, whole floats have no fraction, times are UTC, and
    the parts of nested values stand in order with one blank between, empty ones left out."""
    none = F.lit("")
    if isinstance(kind, T.BooleanType):
        made = F.when(value, "1").otherwise("0")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        made = F.regexp_replace(value.cast("string"), r"\.0$", "")
    elif isinstance(kind, T.TimestampType):
        made = F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(kind, T.TimestampNTZType):
        made = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(kind, T.ArrayType):
        made = _joined(F.transform(value, lambda x: value_text(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        made = _joined(F.transform(F.map_entries(value), lambda e: value_text(e["value"], kind.valueType)))
    elif isinstance(kind, T.StructType):
        made = _joined(F.array(*[value_text(value[f.name], f.dataType) for f in kind.fields])) if kind.fields else none
    elif isinstance(kind, (T.StringType, T.NumericType, T.DateType)):
        made = value.cast("string")
    else:
        raise TypeError(f"{kind.simpleString()} is no searchable type")
    return F.when(value.isNull(), none).otherwise(made)


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def searchable_value(rows: DataFrame, *names: str) -> Column:
    """Several columns as one text."""
    kinds = {f.name: f.dataType for f in rows.schema}
    return _joined(F.array(*[value_text(F.col(f"`{n}`"), kinds[n]) for n in names]))


def fingerprint(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\u0000", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def framed_hash(*parts: Column) -> Column:
    """SHA-256 over length-framed parts: no two different lists give one text. A null differs from an empty text."""
    framed = [F.when(p.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"), F.lit(";"))) for p in parts]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def basis_points(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 10000 / whole).cast("long"))


def is_canonical_name(name: Column) -> Column:
    return name.isNotNull() & (name != "") & ~name.rlike(r"[\p{Zp}\p{Zl}\p{Cf}\p{Cc}]") & ~name.rlike(r"(?U)^[\s\p{Z}]|[\s\p{Z}]$")


def id_order(identifier: Column) -> list[Column]:
    """Sort keys under which unsigned decimal texts order as numbers and all other texts by bytes, behind them."""
    digits = identifier.rlike("^[0-9]+$")
    bare = F.regexp_replace(identifier, "^0+(?=.)", "")
    return [F.when(digits, 0).otherwise(1), F.when(digits, F.char_length(bare)).otherwise(0), F.when(digits, bare).otherwise(identifier), identifier]
