"""Benchmark decontamination with an Aho-Corasick automaton (operator 5).

Texts are normalised alike on both sides: A-Z lower-cased, words are runs of letters, digits and anything outside ASCII. Items of
at least ``width`` words are cut into blocks of ``(width + 1) // 2`` words, side by side; any window of ``width`` words holds a whole block.
The blocks, and whole items where they are shorter than a window, are the patterns of one automaton, so it has about as many nodes
as the benchmark has letters of code, not ``width`` times as many. Words are spelled as fixed-length codes over 64 symbols, one
alphabet per place, so a match always begins at a word and the automaton's nodes stay narrow. Each text is scanned once, whole; a block's
match is extended word by word to both sides, and what reaches ``width`` words is hit. Hits come back as byte spans of the original.

The automaton is built once per worker. Its size follows the benchmark's, which is counted before: up to ``max_words`` words it is
one automaton; a larger benchmark is split into several that scan in turn and merge their findings, so nothing is dropped.

Results for special cases: a null or wordless text has no words, hits or items; a null or wordless item has no windows; a null
item_id is reported as an empty string; equal items all count; repeated rows give repeated rows; an empty benchmark hits nothing;
other columns are ignored (``clean`` returns them unchanged).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaloom.llm.chunks import text_buffer
from lexaloom.llm.common import ship

WIDTH = 13
_LETTERS = [chr(c) for c in range(0x100, 0x100 + 64 * 6)]
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SEPARATES = np.array([c == 32 for c in _TO_WORDS])
_BUILT: dict[str, tuple] = {}

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_full", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(SPAN))])
FOUND_SQL = "struct<n_words:bigint,n_hit:bigint,n_full:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def _build(items: list[tuple[str, bytes]], width: int) -> tuple:
    """Automaton, word numbers, word codes, code length, item names, items as word numbers, width; patterns map to [(item, place, length)]."""
    split = [words_of(t) for _, t in items]
    vocabulary = sorted({w for ws in split for w in ws})
    places = 1
    while 64**places < len(vocabulary):
        places += 1
    number = {w: i for i, w in enumerate(vocabulary)}
    code = ["".join(_LETTERS[64 * min(p, 5) + (i >> 6 * p) % 64] for p in range(places)) for i in range(len(vocabulary))]
    held = [[number[w] for w in ws] for ws in split]
    owners: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for item, ws in enumerate(held):
        size = len(ws) if len(ws) < width else (width + 1) // 2
        for at in range(0, len(ws) - size + 1, size) if ws else ():
            owners["".join(code[w] for w in ws[at : at + size])].append((item, at, size))
    machine = ahocorasick.Automaton()
    for block, who in owners.items():
        machine.add_word(block, who)
    if owners:
        machine.make_automaton()
    return machine if owners else None, number, code, places, [name for name, _ in items], held, width


def _automaton(held, width: int) -> tuple:
    """Built once per worker for each broadcast of (name, items)."""
    name, items = held.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _build(items, width)
    return _BUILT[name]


def _byte_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the maximal runs of hit words."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SEPARATES[np.frombuffer(raw, np.uint8)]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(start[a]), int(end[b - 1])) for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))]


def scan(raw: bytes, built: tuple, before: dict | None = None) -> dict:
    """Finding of one text, merged with that of an earlier automaton."""
    machine, number, code, places, names, held, width = built
    words = words_of(raw)
    found: set[int] = set()
    runs: list[tuple[int, int]] = []
    full: list[tuple[int, int]] = []
    if machine is not None and words:
        get, other = number.get, "?" * places
        mine = [get(w, -1) for w in words]
        n, ends = len(mine), {}
        for last, who in machine.iter("".join([code[i] if i >= 0 else other for i in mine])):
            stop = last // places + 1
            for item, at, size in who:
                start = stop - size
                theirs = held[item]
                if len(theirs) < width:
                    found.add(item)
                    runs.append((start, stop))
                    continue
                diagonal = (item, start - at)
                if ends.get(diagonal, 0) > start:
                    continue
                a, i, b, j = start, at, stop, at + size
                while a and i and mine[a - 1] == theirs[i - 1]:
                    a, i = a - 1, i - 1
                while b < n and j < len(theirs) and mine[b] == theirs[j]:
                    b, j = b + 1, j + 1
                ends[diagonal] = b
                if b - a >= width:
                    found.add(item)
                    full.append((a, b))
    hit = np.zeros(len(words), bool)
    for a, b in full:
        hit[a:b] = True
    n_full = int(hit.sum())
    for a, b in runs:
        hit[a:b] = True
    items = [names[i] for i in found]
    if before and before["n_hit"]:
        items += before["items"]
        n_full += before["n_full"]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_SEPARATES[np.frombuffer(raw, np.uint8)]
        start = np.flatnonzero(np.diff(inside) == 1)
        for s in before["spans"]:
            hit[np.searchsorted(start, s["start"]) : np.searchsorted(start, s["end"])] = True
    n_hit = int(hit.sum())
    return {"n_words": len(words), "n_hit": n_hit, "n_full": min(n_full, n_hit), "items": sorted(items), "spans": [{"start": a, "end": b} for a, b in _byte_spans(raw, hit)] if n_hit else []}


def _scan_all(text: pa.Array, before: list, built: tuple) -> pa.Array:
    data, offsets, _ = text_buffer(text)
    body = data.tobytes()
    return pa.array([scan(body[a:b], built, old) for a, b, old in zip(offsets, offsets[1:], before)], FOUND)


def _scanner(held, width: int):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in columns:
            yield _scan_all(text, [None] * len(text), _automaton(held, width))

    return run


def _scanner_again(held, width: int):
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, before in columns:
            yield _scan_all(text, before.to_pylist(), _automaton(held, width))

    return run


def find(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, max_words: int = 1_000_000, into: str = "found") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, n_full (words hit by windows of full width), items (sorted as strings), spans (bytes of the text)."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).cast("binary").alias("t"))
    total = items.agg(F.sum(F.regexp_count(F.col("t").cast("string"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    shards = max(1, -(-total // max_words))
    out = docs
    for k in range(shards):  # one automaton at a time on the driver too
        own = sorted((r.i, bytes(r.t)) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k).toLocalIterator())
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, own))

        if k:
            out = out.withColumn(into, F.arrow_udf(_scanner_again(held, width), FOUND_SQL)(F.col(f"`{text_col}`"), F.col(f"`{into}`")))
        else:
            out = out.withColumn(into, F.arrow_udf(_scanner(held, width), FOUND_SQL)(F.col(f"`{text_col}`")))
    return out


def contaminated(found: str = "found"):
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a leak, with their own columns only.

    A leak is any window of full width, however long the document is, or, where only items shorter than a window are hit
    (which plain prose may hold by chance), a twentieth of the words.
    """
    into = "__found"
    while into in docs.columns:
        into += "_"
    return find(docs, benchmark, into=into, **options).where(~(contaminated(into) | (F.col(f"{into}.n_full") > 0))).drop(into)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents
), item AS (
  SELECT row_number() OVER () AS k, coalesce(item_id::VARCHAR, '') AS name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark
), pattern AS (
  SELECT k, name, n, unnest(list_transform(range(1, len(l) - n + 2), lambda i: array_to_string(l[i:i + n - 1], ' '))) AS w FROM (SELECT *, least(13, len(l)) AS n FROM item) WHERE len(l) > 0
), place AS (
  SELECT r, n, unnest(range(1, len(l) - n + 2)) AS i, unnest(list_transform(range(1, len(l) - n + 2), lambda i: array_to_string(l[i:i + n - 1], ' '))) AS w FROM doc, (SELECT DISTINCT n FROM pattern)
), hit AS (
  SELECT DISTINCT r, i, n, k, name FROM place JOIN pattern USING (n, w)
), covered AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, k, name FROM hit) GROUP BY r
)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
