"""Exact substring de-duplication by grouping hashes of anchors, blocks and windows (operator 3).

This takes the place of the depth-limited radix sort of suffixes: only equality up to the threshold depth matters, so nothing is
ordered by digit passes. What is alone in its group drops out after each pass, and the groups that are left at full depth are
the repeated windows, up to collisions of 128-bit hashes.

* Which suffixes: shipping all of them costs more than ten times the text. A window's *anchor* is the smallest hash
  among its ``width // 2``-byte grams, so equal windows have equal anchors at equal offsets. Only what begins where an
  anchor starts is sent, about one in 51 bytes for windows of 200.
* Pass 1, by the anchor gram: groups of one drop out.
* Pass 2, by the block (the union of the consecutive windows that share the anchor): where the block repeats all its
  windows repeat, and where it is the only block of its gram none does.
* Pass 3, by the whole window: for grams with several different blocks, one block of each kind sends each window.

Windows are compared by 128-bit hashes, blocks by 64 bits among those of one gram (32 bits within a bucket), so by more than 96. Grams that
a good part of all chunks hold go straight to pass 3, where one chunk speaks for each of their hot blocks (see ``chunks``).

Results for special cases: a null text has no bytes and gives an empty ``kept``; an empty or short text is kept whole;
matches never cross documents; repeated rows (same id or not) count as occurrences of each other; every input row gives
one output row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.llm import chunks as C
from lexaloom.llm import rolling as R
from lexaloom.llm.common import materialize

SPANS = "array<struct<start:bigint,end:bigint>>"


class _Blocks:
    """Anchors and blocks of a chunk. Sent pairs are distinct by block."""

    def __init__(self, chunk: C.Chunk, width: int, buckets: int, hot: tuple) -> None:
        self.width, self.chunk = width, chunk
        gram = width // 2
        span = width - gram + 1
        self.h = R.byte_prefix(chunk.data)
        grams = R.windows(self.h, gram)
        key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        low = R.sliding_min(key, span)  # for each window start
        begin, count = chunk.offsets[:-1], np.maximum(chunk.lens - width + 1, 0)
        starts = R.ranges(begin, count)
        at = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(at) != 0) | (np.diff(starts) != 1)
        where = np.flatnonzero(new)
        self.first = starts[where]
        self.last = starts[np.append(where[1:], len(starts)) - 1] if len(starts) else starts
        anchor = at[where]
        block = R.spans(self.h, self.first, self.last + width)
        self.blocks, index, self.inverse, count = np.unique(block, return_index=True, return_inverse=True, return_counts=True)
        self.grams = grams[anchor[index]]
        self.hot = C.among(hot[0], self.grams)[0]
        self.rest = np.flatnonzero(~self.hot)
        self.more = (count[self.rest] > 1).astype(np.uint8)
        self.order, self.names, self.bounds = C.by_bucket(self.grams[self.rest], buckets)

    def codes(self, replies: pa.Table, hot: tuple) -> np.ndarray:
        """Pass 2's code for each block in text order."""
        out = np.full(len(self.blocks), 3, np.uint8)
        told = np.empty(len(self.rest), np.uint8)
        told[self.order] = C.codes_of(replies, 1, self.names, len(self.rest))
        out[self.rest] = told
        known, at = C.among(hot[1], self.blocks, self.grams)
        known &= self.hot
        if known.any():
            out[known] = np.where(hot[1][at[known], 2] == np.uint64(self.chunk.name), 2, 1)
        return out[self.inverse]

    def windows(self, codes: np.ndarray, hot: tuple, buckets: int) -> None:
        """Pass 3's windows of the blocks with code 2 or 3."""
        some = codes >= 2
        length = self.last[some] - self.first[some] + 1
        self.starts = R.ranges(self.first[some], length)
        self.wanted = np.repeat(codes[some] == 3, length)
        other = R.byte_prefix(self.chunk.data, R.OTHER) if len(self.starts) else self.h
        a, b, count, self.which = C.distinct_pairs(R.spans(self.h, self.starts, self.starts + self.width), R.spans(other, self.starts, self.starts + self.width, R.OTHER))
        sure = np.bincount(self.which, weights=~self.wanted, minlength=len(a)) > 0
        self.known = C.among(hot[2], a, b)[0]
        self.keys, self.seen = C.pairs(a, b)[~self.known], ((count > 1) | sure)[~self.known].astype(np.uint8)
        self.korder, self.knames, self.kbounds = C.by_bucket(self.keys["a"], buckets)

    def twice(self, replies: pa.Table) -> np.ndarray:
        told = np.empty(len(self.keys), bool)
        told[self.korder] = C.codes_of(replies, 2, self.knames, len(self.keys)) > 0
        out = np.ones(len(self.known), bool)
        out[~self.known] = told
        return out[self.which]


def _pair(grams: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    out = np.empty(len(grams), np.dtype([("gram", "<u4"), ("block", "<u8")]))
    out["gram"], out["block"] = grams & np.uint64(0xFFFFFFFF), blocks
    return out


_PAIR = np.dtype([("gram", "<u4"), ("block", "<u8")])


def _judge(table: pa.Table) -> pa.Table:
    """Codes: 0 no window repeats, 1 all do, 2 all do and the sender speaks for the block in pass 3, 3 pass 3 decides."""
    pair, more, bounds = C.received(table, _PAIR, np.uint8)
    order = np.lexsort((pair["block"], pair["gram"]))
    gram, block = pair["gram"][order], pair["block"][order]
    new_gram = np.append(True, gram[1:] != gram[:-1])
    new_block = np.append(True, (block[1:] != block[:-1]) | new_gram[1:])
    which_gram, which_block = np.cumsum(new_gram) - 1, np.cumsum(new_block) - 1
    kinds = np.bincount(which_gram[new_block])[which_gram]
    times = np.bincount(which_block)[which_block]
    seen_more = (np.bincount(which_block, weights=more[order]) > 0)[which_block]
    again = (times > 1) | seen_more
    codes = np.where(kinds == 1, again.astype(np.uint8), np.where(again, np.where(new_block, 2, 1), 3)).astype(np.uint8)
    out = np.empty(len(codes), np.uint8)
    out[order] = codes
    return C.answer(table, 1, out, bounds)


def _hot(packed: DataFrame, n: int, width: int, buckets: int, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hot grams; hot blocks (block, gram, the chunk that speaks for it); hot windows among the other blocks of hot grams."""
    one, three, two = (np.zeros((0, k), np.uint64) for k in (1, 3, 2))

    def blocks(chunk: C.Chunk) -> dict[str, np.ndarray]:
        b = _Blocks(chunk, width, buckets, (one, three, two))
        return {"gram": b.grams, "block": b.blocks, "chunk": np.full(len(b.blocks), chunk.name)}

    found = materialize(C.sampled(packed, n, blocks, "gram long, block long, chunk long").groupBy("gram", "block").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("chunk")), "hot")
    grams = C.hottest(found.groupBy("gram").agg(F.sum("n").alias("n")), "gram")
    if not len(grams):
        return one, three, two
    same = C.hottest(found, "block", "gram", "chunk")
    told = (grams, same, two)

    def windows(chunk: C.Chunk) -> dict[str, np.ndarray]:
        b = _Blocks(chunk, width, buckets, told)
        known, _ = C.among(same, b.blocks, b.grams)
        b.windows(np.where(b.hot & ~known, 3, 0).astype(np.uint8)[b.inverse], told, fine)
        return {"a": b.keys["a"], "b": b.keys["b"]}

    return grams, same, C.hottest(C.sampled(packed, n, windows, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "a", "b")


def remove_repeated_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_bytes, removed spans (byte offsets, maximal), kept (the other bytes).

    A byte goes if a ``width``-byte string that covers it also starts anywhere else in the input.
    """
    packed = C.pack(docs, id_col, text_col, chunk_bytes)
    size, n = C.totals(packed)
    buckets = C.bucket_count(packed, size, 32 << 20)
    fine = C.bucket_count(packed, size, 8 << 20)
    held = docs.sparkSession.sparkContext.broadcast(_hot(packed, n, width, buckets, fine))  # bounded by HOT_KEYS

    def first(name: int, chunk: C.Chunk) -> pa.Table:
        b = _Blocks(chunk, width, buckets, held.value)
        return C.sent(name, b.names, b.bounds, _pair(b.grams[b.rest][b.order], b.blocks[b.rest][b.order]), b.more[b.order])

    def second(name: int, chunk: C.Chunk, replies: pa.Table) -> pa.Table:
        b = _Blocks(chunk, width, buckets, held.value)
        b.windows(b.codes(replies, held.value), held.value, fine)
        return C.sent(name, b.knames, b.kbounds, b.keys[b.korder], b.seen[b.korder])

    def finish(chunk: C.Chunk, replies: pa.Table) -> pa.Table:
        b = _Blocks(chunk, width, buckets, held.value)
        codes = b.codes(replies, held.value)
        b.windows(codes, held.value, fine)
        twice = b.twice(replies)
        change = np.zeros(len(chunk.data) + 1, np.int32)
        whole = (codes == 1) | (codes == 2)
        np.add.at(change, b.first[whole], 1)
        np.add.at(change, b.last[whole] + width, -1)
        single = b.starts[b.wanted & twice]
        change[: len(chunk.data)] += np.bincount(single, minlength=len(chunk.data) + 1)[: len(chunk.data)].astype(np.int32)
        change -= np.bincount(single + width, minlength=len(chunk.data) + 1)[: len(chunk.data) + 1].astype(np.int32)
        return kept_table(chunk, np.cumsum(change[:-1]) > 0, id_col)

    schema = T.StructType().add(id_col, docs.schema[id_col].dataType).add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    return C.two_phases(packed, size, first, _judge, second, C.repeated(2, C.PAIR), finish, schema)


def kept_table(chunk: C.Chunk, gone: np.ndarray, id_col: str) -> pa.Table:
    head = np.zeros(len(gone) + 1, bool)
    head[chunk.offsets[:-1]] = True
    before = np.append(False, gone[:-1]) if len(gone) else gone
    start = np.flatnonzero(gone & (~before | head[:-1]))
    after = np.append(gone[1:], False) if len(gone) else gone
    end = np.flatnonzero(gone & (~after | head[1:])) + 1
    doc_first = np.searchsorted(start, chunk.offsets[:-1], side="left")
    bounds = np.append(doc_first, len(start))
    owner = np.repeat(np.arange(len(chunk.lens)), np.diff(bounds))
    base = chunk.offsets[owner]
    total = np.append(0, np.cumsum(gone))
    removed = total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]
    kept = chunk.data[~gone]
    offsets = np.append(0, np.cumsum(chunk.lens - removed)).astype(np.int32)
    return pa.table({
        id_col: chunk.ids,
        "n_bytes": pa.array(chunk.lens, pa.int64()),
        "spans": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"])),
        "kept": pa.Array.from_buffers(pa.binary(), len(chunk.lens), [None, pa.py_buffer(offsets), pa.py_buffer(kept.tobytes())]),
    })


def query(docs: DataFrame) -> DataFrame:
    out = remove_repeated_substrings(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
