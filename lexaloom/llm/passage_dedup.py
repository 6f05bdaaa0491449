"""Substring de-duplication over words with difference-cover anchors (operator 9).

D is a difference cover modulo ``period``: for any two positions i, j some shift s < period brings both i + s and j + s
onto D. Only the windows of ``length - period + 1`` words that begin at cover positions are hashed and compared. Two
equal windows of ``length`` words, wherever they begin, share such an anchor at the same shift, so a window without
a repeated anchor can't repeat. The windows that extend a repeated anchor are then compared in full.

Words are maximal runs of anything but ASCII white space. Windows are compared by 128-bit hashes of their word sequence; anchors by
32 bits within a bucket, since they only select. Anchors and windows that a good part of all chunks hold are known beforehand (see ``chunks``).

Results for special cases: a null or empty text has no words and keeps an empty string; fewer words than a window are
kept whole; windows never cross documents; repeated rows count as occurrences of each other; each input row gives one
row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.llm import chunks as C
from lexaloom.llm import rolling as R

#: Perfect difference sets: every residue is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}


def period_for(length: int) -> int:
    """The longest period that leaves anchors of at least 40 % of a window."""
    fit = [p for p in COVERS if length - p + 1 >= max(1, 0.4 * length)]
    return max(fit) if fit else 1


class _Words:
    def __init__(self, chunk: C.Chunk, length: int, period: int, buckets: int, hot: np.ndarray) -> None:
        self.chunk, self.length = chunk, length
        start, end, self.bounds = R.words_of_texts(chunk.data, chunk.offsets, R.SPACES)  # words of document d: bounds[d]:bounds[d+1]
        self.start, self.end = start, end
        self.counts = np.diff(self.bounds)
        self.h = R.prefix(R.spans(R.byte_prefix(chunk.data), start, end))
        self.period, self.size = period, length - period + 1
        cover = np.zeros(period, bool)
        cover[list(COVERS.get(period, (0,)))] = True
        fit = np.maximum(self.counts - self.size + 1, 0)
        at = R.ranges(self.bounds[:-1], fit)
        inside = R.ranges(np.zeros(len(fit), np.int64), fit)
        self.at = at[cover[inside % period]]
        anchors = R.spans(self.h, self.at, self.at + self.size)
        self.anchors, self.inverse, count = np.unique(anchors, return_inverse=True, return_counts=True)
        self.hot = C.among(hot, self.anchors)[0]
        self.keys, self.more = self.anchors[~self.hot], (count[~self.hot] > 1).astype(np.uint8)
        self.order, self.names, self.edges = C.by_bucket(self.keys, buckets)

    def live(self, replies: pa.Table) -> np.ndarray:
        told = np.empty(len(self.keys), bool)
        told[self.order] = C.codes_of(replies, 1, self.names, len(self.keys)) > 0
        out = np.ones(len(self.anchors), bool)
        out[~self.hot] = told
        return out

    def windows(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows with a live anchor, as two hashes, and the number of each."""
        flag = np.zeros(len(self.start) + self.period + 1, np.int64)
        flag[self.at[live[self.inverse]]] = 1
        total = np.append(0, np.cumsum(flag))
        at = R.ranges(self.bounds[:-1], np.maximum(self.counts - self.length + 1, 0))
        self.starts = at[total[at + self.period] > total[at]]
        other = R.prefix(R.spans(R.byte_prefix(self.chunk.data, R.OTHER), self.start, self.end, R.OTHER), R.OTHER) if len(self.starts) else self.h
        a, b, count, self.which = C.distinct_pairs(R.spans(self.h, self.starts, self.starts + self.length), R.spans(other, self.starts, self.starts + self.length, R.OTHER))
        return a, b, count

    def ask(self, live: np.ndarray, hot: np.ndarray, buckets: int) -> None:
        a, b, count = self.windows(live)
        self.known = C.among(hot, a, b)[0]
        self.wkeys, self.seen = C.pairs(a, b)[~self.known], (count[~self.known] > 1).astype(np.uint8)
        self.worder, self.wnames, self.wedges = C.by_bucket(self.wkeys["a"], buckets)

    def twice(self, replies: pa.Table) -> np.ndarray:
        told = np.empty(len(self.wkeys), bool)
        told[self.worder] = C.codes_of(replies, 2, self.wnames, len(self.wkeys)) > 0
        out = np.ones(len(self.known), bool)
        out[~self.known] = told
        return out[self.which]


def remove_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35, period: int | None = None, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_words, removed spans (word positions, maximal), kept (the other words, joined by one space)."""
    packed = C.pack(docs, id_col, text_col, chunk_bytes)
    step = period or period_for(length)
    size, n = C.totals(packed)
    buckets = C.bucket_count(packed, size, 32 << 20)
    fine = C.bucket_count(packed, size, 16 << 20)
    none = np.zeros((0, 1), np.uint64)
    found = C.sampled(packed, n, lambda chunk: {"a": _Words(chunk, length, step, buckets, none).anchors}, "a long")
    hot = C.hottest(found.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")

    def in_windows(chunk: C.Chunk) -> dict[str, np.ndarray]:
        w = _Words(chunk, length, step, buckets, hot)
        a, b, _ = w.windows(w.hot)
        return {"a": a, "b": b}

    wide = C.hottest(C.sampled(packed, n, in_windows, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "a", "b") if len(hot) else np.zeros((0, 2), np.uint64)
    held = docs.sparkSession.sparkContext.broadcast((hot, wide))  # bounded by HOT_KEYS

    def first(name: int, chunk: C.Chunk) -> pa.Table:
        w = _Words(chunk, length, step, buckets, held.value[0])
        return C.sent(name, w.names, w.edges, w.keys[w.order].astype(np.uint32), w.more[w.order])

    def asked(chunk: C.Chunk, replies: pa.Table) -> _Words:
        w = _Words(chunk, length, step, buckets, held.value[0])
        w.ask(w.live(replies), held.value[1], fine)
        return w

    def second(name: int, chunk: C.Chunk, replies: pa.Table) -> pa.Table:
        w = asked(chunk, replies)
        return C.sent(name, w.wnames, w.wedges, w.wkeys[w.worder], w.seen[w.worder])

    def finish(chunk: C.Chunk, replies: pa.Table) -> pa.Table:
        w = asked(chunk, replies)
        hit = w.starts[w.twice(replies)]
        n = len(w.start)
        change = np.bincount(hit, minlength=n + 1).astype(np.int64) - np.bincount(hit + length, minlength=n + 1)
        return kept_words(w, np.cumsum(change)[:n] > 0, id_col)

    schema = T.StructType().add(id_col, docs.schema[id_col].dataType).add("n_words", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "string")
    return C.two_phases(packed, size, first, C.repeated(1, np.uint32), second, C.repeated(2, C.PAIR), finish, schema)


def kept_words(w: _Words, gone: np.ndarray, id_col: str) -> pa.Table:
    head = np.zeros(len(gone) + 1, bool)
    head[w.bounds] = True
    before, after = np.append(False, gone[:-1])[: len(gone)], np.append(gone[1:], False)[: len(gone)]
    start = np.flatnonzero(gone & (~before | head[:-1]))
    end = np.flatnonzero(gone & (~after | head[1:])) + 1
    edges = np.searchsorted(start, w.bounds, side="left")
    base = np.repeat(w.bounds[:-1], np.diff(edges))
    keep = np.flatnonzero(~gone)
    owner = np.searchsorted(w.bounds, keep, side="right") - 1
    size = w.end[keep] - w.start[keep] + 1  # with a space behind each word, but for a document's last
    take = R.ranges(w.start[keep], size)
    text = np.append(w.chunk.data, np.uint8(32))[take]
    close = np.cumsum(size) - 1
    text[close] = 32
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    text = np.delete(text, close[last])
    length = np.bincount(owner, weights=size, minlength=len(w.counts)).astype(np.int64)
    length -= np.bincount(owner[last], minlength=len(w.counts))
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    return pa.table({
        id_col: w.chunk.ids,
        "n_words": pa.array(w.counts, pa.int64()),
        "spans": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"])),
        "kept": pa.Array.from_buffers(pa.string(), len(w.counts), [None, pa.py_buffer(offsets), pa.py_buffer(text.tobytes())]),
    })


def query(docs: DataFrame) -> DataFrame:
    out = remove_repeated_passages(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), place AS (
  SELECT r, unnest(range(1, len(l) - 33)) AS i, unnest(list_transform(range(1, len(l) - 33), lambda i: md5(array_to_string(l[i:i + 34], ' ')))) AS w FROM doc WHERE len(l) >= 35
), hit AS (
  SELECT r, i FROM place SEMI JOIN (SELECT w FROM place GROUP BY w HAVING count(*) > 1) USING (w)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM hit
), word AS (
  SELECT r, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS t FROM doc
), kept AS (
  SELECT r, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(l)::BIGINT AS n_words, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)
"""
