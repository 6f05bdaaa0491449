"""Texts packed into chunks, and the question "which of my hashes occur elsewhere?" asked between chunks.

A chunk holds about ``chunk_bytes`` of whole documents, compressed, in a written table: it has a stable
identity, is never skewed, and later passes read it without touching the source again. A chunk sends each of its
distinct hashes once, so a passage that a third of all documents share costs one record per chunk.

Hot hashes, which a good part of all chunks hold, aren't even sent: a sample of chunks finds them (in ``HOT_LEAST`` of
``HOT_CHUNKS``; a hash that is missed is in few of all chunks), they are broadcast, and since they are known to repeat every chunk answers
itself. No bucket gets a record from each chunk then. The sample decides only who answers, never what: results are those without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.llm.common import materialize, partitions, ship

SENT = "bucket int, chunk long, keys binary, more binary"
REPLY = "chunk long, phase int, bucket int, codes binary"
CHUNK_BYTES = 1 << 20
TASK_BYTES = 64 << 20
HOT_CHUNKS, HOT_LEAST = 128, 3
#: Hot hashes that are broadcast at most, the most frequent first: 24 bytes each at most.
HOT_KEYS = 400_000
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets from 0 and null flags of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    null = np.asarray(column.is_null())
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0], null


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk table (chunk, n_bytes, ids, lens, payload): lens is -1 for a null text. Written to the shared folder."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType().add("n_bytes", "long").add("ids", T.ArrayType(id_type)).add("lens", T.ArrayType(T.LongType())).add("payload", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        ids: list = []
        lens: list = []
        parts: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lens, parts, size
            out = pa.table({
                "n_bytes": pa.array([size], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                "lens": pa.array([np.concatenate(lens)]),
                "payload": pa.array([squeeze.compress(b"".join(parts))], pa.binary()),
            }).to_batches()[0]
            ids, lens, parts, size = [], [], [], 0
            return out

        for batch in batches:
            data, offsets, null = text_buffer(batch.column(1))
            n, at = batch.num_rows, 0
            while at < n:
                upto = int(np.searchsorted(offsets, offsets[at] + chunk_bytes - size, side="left"))
                upto = min(n, max(upto, at + 1))
                own = np.diff(offsets[at : upto + 1])
                ids.append(batch.column(0).slice(at, upto - at))
                lens.append(np.where(null[at:upto], -1, own))
                parts.append(data[offsets[at] : offsets[upto]].tobytes())
                size += int(own.sum())
                at = upto
                if size >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    packed = docs.select(id_col, text_col).mapInArrow(run, schema)
    return materialize(packed.select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks", compression="uncompressed")


class Chunk:
    """One row of the chunk table, unpacked."""

    def __init__(self, row: pa.Table) -> None:
        self.name = row.column("chunk")[0].as_py()
        self.ids = row.column("ids").combine_chunks().flatten()
        lens = np.asarray(row.column("lens").combine_chunks().flatten())
        self.null = lens < 0
        self.lens = np.maximum(lens, 0)
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row.column("payload")[0].as_py(), max_output_size=int(self.offsets[-1]) + 1)
        self.data = np.frombuffer(raw, np.uint8)


def totals(chunks: DataFrame) -> tuple[int, int]:
    """Bytes and chunks."""
    r = chunks.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    return r[0] or 0, r[1]


def bucket_count(chunks: DataFrame, size: int, bytes_per_bucket: int) -> int:
    """So many buckets that each holds a bounded part, whatever the size of the corpus."""
    return max(partitions(chunks.sparkSession), -(-size // bytes_per_bucket))


def sampled(chunks: DataFrame, n: int, emit: Callable[[Chunk], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """What emit finds in about ``HOT_CHUNKS`` of the n chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = emit(Chunk(pa.Table.from_batches([batch.slice(i, 1)])))
                yield pa.record_batch({k: pa.array(np.ascontiguousarray(v).view(np.int64)) for k, v in found.items()})

    some = chunks if n <= HOT_CHUNKS else chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(n)) < HOT_CHUNKS)
    return some.mapInArrow(run, schema)


def hottest(counted: DataFrame, *keys: str) -> np.ndarray:
    """The keys with n >= ``HOT_LEAST``, sorted; a column for each key."""
    table = counted.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), *keys).limit(HOT_KEYS).select(*keys).toArrow()
    out = np.stack([np.asarray(table.column(k)).view(np.uint64) for k in keys], 1) if table.num_rows else np.zeros((0, len(keys)), np.uint64)
    return out[np.argsort(out[:, 0], kind="stable")]


def among(hot: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are rows of ``hot`` (in its first columns), and where."""
    if not len(hot):
        return np.zeros(len(keys[0]), bool), np.zeros(len(keys[0]), np.int64)
    at = np.minimum(np.searchsorted(hot[:, 0], keys[0]), len(hot) - 1)
    same = np.ones(len(keys[0]), bool)
    for k, key in enumerate(keys):
        same &= hot[at, k] == key
    return same, at


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), PAIR)
    out["a"], out["b"] = a, b
    return out


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b), the number of each and which one every element is. Should two pairs share an a, one may come twice."""
    order = np.argsort(a, kind="stable")
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    first = np.flatnonzero(new)
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[order[first]], b[order[first]], np.diff(np.append(first, len(a))), inverse


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that groups the keys by bucket, the buckets that occur and where each begins (and the last ends)."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    return order, names.astype(np.int32), np.append(first, len(keys))


def sent(chunk: int, names: np.ndarray, bounds: np.ndarray, keys: np.ndarray, more: np.ndarray) -> pa.Table:
    """Rows for the reducers: keys and more are already in bucket order."""
    return pa.table({
        "bucket": pa.array(names, pa.int32()),
        "chunk": pa.array(np.full(len(names), chunk), pa.int64()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
        "more": pa.array([more[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
    })


def received(table: pa.Table, keys: type | np.dtype, more: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and more of a bucket's rows, and where each row begins."""
    k = [np.frombuffer(x.as_buffer(), keys) for x in table.column("keys")]
    m = [np.frombuffer(x.as_buffer(), more) for x in table.column("more")]
    return np.concatenate(k), np.concatenate(m), np.cumsum([0, *map(len, k)])


def answer(table: pa.Table, phase: int, codes: np.ndarray, bounds: np.ndarray) -> pa.Table:
    return pa.table({
        "chunk": table.column("chunk"),
        "phase": pa.array(np.full(table.num_rows, phase), pa.int32()),
        "bucket": table.column("bucket"),
        "codes": pa.array([codes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
    })


def repeated(phase: int, keys: type | np.dtype) -> Callable[[pa.Table], pa.Table]:
    """Reducer of a bucket: code 1 for each key that another chunk sent too, or that its sender saw more than once."""

    def run(table: pa.Table) -> pa.Table:
        key, more, bounds = received(table, keys, np.uint8)
        parts = [key[n] for n in keys.names] if isinstance(keys, np.dtype) and keys.names else [key]
        order = np.lexsort(parts[::-1])
        new = np.ones(len(key), bool)
        new[1:] = np.any([p[order[1:]] != p[order[:-1]] for p in parts], axis=0)
        group = np.cumsum(new) - 1
        twice = (np.bincount(group) > 1) | (np.bincount(group, weights=more[order]) > 0)
        codes = np.empty(len(key), np.uint8)
        codes[order] = twice[group]
        return answer(table, phase, codes, bounds)

    return run


def codes_of(replies: pa.Table, phase: int, names: np.ndarray, size: int) -> np.ndarray:
    """The replies of a phase in bucket order, as they were sent."""
    got = {b.as_py(): c.as_py() for p, b, c in zip(replies.column("phase"), replies.column("bucket"), replies.column("codes")) if p.as_py() == phase}
    out = np.frombuffer(b"".join(got[int(b)] for b in names), np.uint8)
    if len(out) != size:
        raise RuntimeError(f"phase {phase}: {len(out)} replies to {size} keys")
    return out


def two_phases(chunks: DataFrame, size: int, first: Callable, reduce_first: Callable, second: Callable, reduce_second: Callable, finish: Callable, schema: T.StructType) -> DataFrame:
    """first(chunk id, Chunk) sends; its replies go with the chunk to second, which sends again; finish makes the rows.

    The chunks are shuffled by chunk id once: Spark reuses that exchange for both joins with the replies. Tasks follow the bytes of text,
    ``size``, where the session's shuffle partitions would be too few.
    """
    tasks = max(partitions(chunks.sparkSession), -(-size // TASK_BYTES))
    grouped = lambda df, key: df.repartition(tasks, key).groupBy(key)

    def send_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                yield from first(row.column("chunk")[0].as_py(), Chunk(row)).to_batches()

    def send_second(left: pa.Table, right: pa.Table) -> pa.Table:
        return second(left.column("chunk")[0].as_py(), Chunk(left), right)

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(Chunk(left), right)

    replies = materialize(grouped(chunks.mapInArrow(send_first, SENT), "bucket").applyInArrow(reduce_first, REPLY), "replies")
    both = grouped(chunks, "chunk").cogroup(grouped(replies, "chunk")).applyInArrow(send_second, SENT)
    later = grouped(both, "bucket").applyInArrow(reduce_second, REPLY)
    return grouped(chunks, "chunk").cogroup(grouped(replies.unionByName(later), "chunk")).applyInArrow(end, schema)
