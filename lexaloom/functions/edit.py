"""Edit distance, symmetric deletes, keyboard and phonetic rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaloom.shipping import ship

KEY_ROWS = {"en": ("qwertyuiop", "asdfghjkl", "zxcvbnm"), "fa": ("ضصثقفغعهخحجچ", "شسیبلاتنمکگ", "ظطزرذدپو")}
ADJACENT = {lang: {frozenset(pair) for row in rows for pair in zip(row, row[1:])} for lang, rows in KEY_ROWS.items()}
INSERT = DELETE = SUBSTITUTE = 1000
TRANSPOSE, NEIGHBOUR = 700, 450


def chain(locale: str) -> list[str]:
    base = locale.replace("_", "-").split("-")[0]
    return [locale] if base == locale else [locale, base]


def distance(source: str, target: str, locale: str) -> tuple[int, int]:
    """(edits, cost) of the cheapest alignment; adjacent letters may swap once, and equal costs take fewer edits."""
    near = set().union(*[ADJACENT.get(x, set()) for x in chain(locale)])
    unit = 1024  # a cell is cost * unit + edits, so one minimum decides both
    previous: list[int] = []
    row = [j * (INSERT * unit + 1) for j in range(len(target) + 1)]
    for i, a in enumerate(source, 1):
        older, previous, row = previous, row, [i * (DELETE * unit + 1)]
        for j, b in enumerate(target, 1):
            step = 0 if a == b else (NEIGHBOUR if frozenset((a, b)) in near else SUBSTITUTE) * unit + 1
            best = min(previous[j - 1] + step, previous[j] + DELETE * unit + 1, row[j - 1] + INSERT * unit + 1)
            if i > 1 and j > 1 and a == target[j - 2] and source[i - 2] == b:
                best = min(best, older[j - 2] + TRANSPOSE * unit + 1)
            row.append(best)
    return row[-1] % unit, row[-1] // unit


def distances(sources: list[str], targets: list[str], locales: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``distance`` of many pairs: one table cell of all pairs at a time."""
    out = np.zeros(len(sources), np.int64)
    locale = np.array(locales, dtype=object)
    for name in set(locales):
        own = np.flatnonzero(locale == name)
        near = set().union(*[ADJACENT.get(x, set()) for x in chain(name)])
        letters = sorted({c for pair in near for c in pair})
        place = {c: i for i, c in enumerate(letters)}
        close = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in (tuple(pair) for pair in near):
            close[place[a], place[b]] = close[place[b], place[a]] = True
        order = own[np.argsort([len(sources[i]) * 256 + len(targets[i]) for i in own], kind="stable")]
        for at in range(0, len(order), 4096):  # pairs of about one size
            rows = order[at : at + 4096]
            out[rows] = _table([sources[i] for i in rows], [targets[i] for i in rows], place, close)
    return out % UNIT, out // UNIT


UNIT = 1024  # a cell is cost * UNIT + edits, so one minimum decides both


def _table(sources: list[str], targets: list[str], place: dict[str, int], close: np.ndarray) -> np.ndarray:
    def spread(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts])
        code, key = np.zeros((max(1, size.max()), len(texts)), np.int64), np.full((max(1, size.max()), len(texts)), len(place))
        for k, t in enumerate(texts):
            code[: len(t), k] = [ord(c) for c in t]
            key[: len(t), k] = [place.get(c, len(place)) for c in t]
        return size, code, key

    n, a, ka = spread(sources)
    m, b, kb = spread(targets)
    out = np.where(n == 0, m * (INSERT * UNIT + 1), n * (DELETE * UNIT + 1))
    older = row = np.arange(len(b) + 1)[:, None] * (INSERT * UNIT + 1) + np.zeros(len(n), np.int64)
    for i in range(len(a)):
        older, previous, row = (row, row, np.empty_like(row)) if i == 0 else (previous, row, np.empty_like(row))
        row[0] = (i + 1) * (DELETE * UNIT + 1)
        step = np.where(a[i] == b, 0, np.where(close[ka[i], kb], NEIGHBOUR, SUBSTITUTE) * UNIT + 1)
        for j in range(len(b)):
            best = np.minimum(np.minimum(previous[j] + step[j], previous[j + 1] + DELETE * UNIT + 1), row[j] + INSERT * UNIT + 1)
            if i and j:
                swap = (a[i] == b[j - 1]) & (a[i - 1] == b[j])
                best = np.where(swap, np.minimum(best, older[j - 1] + TRANSPOSE * UNIT + 1), best)
            row[j + 1] = best
        done = (n == i + 1) & (m > 0)
        out[done] = row[m[done], np.flatnonzero(done)]
    return out


def edit_distance(source: Column, target: Column, locale: Column) -> Column:
    """struct<edits, cost>, in Arrow batches, all pairs of a batch at once."""
    ship()

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b, l in batches:
            edits, cost = distances(a.tolist(), b.tolist(), l.tolist())
            yield pd.DataFrame({"edits": edits, "cost": cost})

    return F.pandas_udf(run, "edits int, cost int")(source, target, locale)


def safe_word(token: Column) -> Column:
    """Letters and marks only: what phonetic, split and merge corrections may touch."""
    return token.rlike(r"^[\p{M}\p{L}]+$")


def safe_context_word(token: Column) -> Column:
    """The same with inner apostrophes and a bounded length: what contextual corrections may touch."""
    return (F.char_length(token) <= 191) & token.rlike(r"^[\p{M}\p{L}]+(?:['’][\p{M}\p{L}]+)*$")


def maximum_edits(token: Column, least: int = 4, most: int = 64, two_from: int = 8) -> Column:
    n = F.char_length(token)
    return F.when((n < least) | (n > most), 0).when(n < two_from, 1).otherwise(2)


def _drop_one(token: Column) -> Column:
    n = F.char_length(token)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(places, lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1))))


def deletes(token: Column, distance_: Column, most: int) -> Column:
    """The token and what is left of it without one or two letters, nearest first, at most ``most``, never empty."""
    first = _drop_one(token)
    second = F.flatten(F.transform(first, _drop_one))
    none = F.array().cast("array<string>")
    found = F.concat(F.array(token), F.when(distance_ >= 1, first).otherwise(none), F.when(distance_ >= 2, second).otherwise(none))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, most)


def delete_distance(token: Column, key: Column) -> Column:
    return F.char_length(token) - F.char_length(key)


def delete_keys(token: str, most_edits: int, most: int) -> list[str]:
    """``deletes`` for one token on the driver."""
    found, frontier = {token: None}, [token]
    for _ in range(most_edits):
        frontier = [k for t in frontier if len(t) > 1 for i in range(len(t)) if (k := t[:i] + t[i + 1 :])]
        found |= dict.fromkeys(frontier)
        frontier = list(dict.fromkeys(frontier))
    return list(found)[:most]


_PLAIN, _SHIFT = "qwertyuiop[]asdfghjkl;'\\zxcvbnm,", "ضصثقفغعهخحجچشسیبلاتنمکگپظطزرذدئو"
_CAPITAL = dict(zip("ABCDEFGHIJKLMNOPQSTUVWXYZ?{}`~", "َإژٍِّۀآ]ـ«»ءأ[\\ًُ،,ؤٌي؛ة؟}{÷×"))
KEYBOARD = dict(zip(_PLAIN, _SHIFT)) | _CAPITAL | {"R": "ریال"}


def remap_keys(text: str) -> str:
    return "".join(KEYBOARD.get(c, c) for c in text)


def keyboard_remap(text: Column) -> Column:
    """What the same keys type on a Persian layout."""
    table = F.create_map(*[F.lit(x) for pair in KEYBOARD.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


_SOUNDS = {"س": "ص750 ث800", "ص": "س350 ث650", "ث": "س400 ص650", "ز": "ذ800 ض850 ظ850", "ذ": "ز400 ض700 ظ700", "ض": "ز450 ذ700 ظ650", "ظ": "ز450 ذ700 ض650", "ت": "ط750", "ط": "ت400", "ق": "غ450", "غ": "ق650", "ه": "ح800", "ح": "ه550"}
_SPELLINGS = (("ph", "f", 450), ("f", "ph", 650), ("ck", "k", 500), ("k", "ck", 750), ("c", "k", 700), ("k", "c", 850))
SEPARATOR = {"fa": " ", "en": " "}
Alternatives = Iterator[tuple[str, int, str]]


def _persian(token: str) -> Alternatives:
    for i, c in enumerate(token):
        for option in _SOUNDS.get(c, "").split():
            yield token[:i] + option[0] + token[i + 1 :], int(option[1:]), f"{c}>{option[0]}"


def _english(token: str) -> Alternatives:
    for old, new, cost in _SPELLINGS:
        at = token.find(old)
        while at >= 0:
            yield token[:at] + new + token[at + len(old) :], cost, f"{old}>{new}"
            at = token.find(old, at + len(old))


#: Language profiles by family: (alternative, cost, rule) of a token, one change each.
PROFILES: dict[str, Callable[[str], Alternatives]] = {"fa": _persian, "en": _english}


def register_profile(family: str, alternatives: Callable[[str], Alternatives], separator: str = " ") -> None:
    PROFILES[family], SEPARATOR[family] = alternatives, separator


def sound_alternatives(token: str, family: str) -> Alternatives:
    yield from PROFILES[family](token) if family in PROFILES else ()


def sound_rules(spark):
    """The rules as a table: family, old, new, cost."""
    rows = [("fa", c, o[0], int(o[1:])) for c, options in _SOUNDS.items() for o in options.split()] + [("en", *r) for r in _SPELLINGS]
    return spark.createDataFrame(rows, "family string, old string, new string, cost int")


def sound_alternatives_table(tokens, rules):
    """(token, family, alternative, cost, rule) for a table (token, family): each rule at each place where it applies."""
    n = F.char_length("token")
    places = tokens.join(F.broadcast(rules), "family").where(F.col("token").contains(F.col("old"))).withColumn("at", F.explode(F.sequence(F.lit(1), n)))
    hits = places.where(F.substr("token", F.col("at"), F.char_length("old")) == F.col("old"))
    changed = F.concat(F.substr("token", F.lit(1), F.col("at") - 1), F.col("new"), F.substr("token", F.col("at") + F.char_length("old")))
    return hits.select("token", "family", changed.alias("alternative"), "cost", F.concat("old", F.lit(">"), "new").alias("rule"))
