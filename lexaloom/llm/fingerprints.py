"""Document fingerprints: invertible Bloom lookup tables of paragraph digests (operator 8).

A text's paragraphs are its lines; a longer line is cut behind sentence ends (at fixed lengths where it has none) into parts
of 160 to 320 characters or so. A digest is a 64-bit hash of a part and of how often it came before, so repeats count. The table
has three rows of ``size`` cells (a power of two); a cell holds the count, the exclusive-or of its digests and of their
checks. Tables subtract cell by cell, a larger one folded onto a smaller first, and peeling recovers the digests that differ.

Retrying: a text's own table is doubled until it peels completely. A difference that does not peel at the common size is
retried with each table at its own, full size, which always peels; so likeness (shared digests over all digests) is exact.

Results for special cases: a null text is empty, without paragraphs; two texts without paragraphs have likeness 1; equal texts have
equal fingerprints; ids are whole numbers, null first; rows of equal id follow each other in text order; of one document the next
is itself; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexaloom.llm.common import input_bytes, partitions, ship
from lexaloom.llm.rolling import mix

LONG, PART = 320, 160
_SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+", re.S)
_CELL = np.dtype([("count", "<i2"), ("check", "<u4"), ("key", "<u8")])
#: A run of chance matches could go round for ever; no table that peels needs as many rounds.
ROUNDS = 1000
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        if len(line) <= LONG:
            if line:
                out.append(line)
            continue
        part = ""
        for sentence in _SENTENCE.findall(line):
            part += sentence
            while len(part) > LONG:
                out.append(part[:LONG])
                part = part[LONG:]
            if len(part) >= PART:
                out.append(part)
                part = ""
        if part:
            out.append(part)
    return out


def digests(text: str) -> list[int]:
    seen: dict[int, int] = {}
    out = []
    for p in paragraphs(text):
        d = xxhash.xxh64_intdigest(p)
        times = seen.get(d, 0)
        seen[d] = times + 1
        out.append(xxhash.xxh64_intdigest(p, times) if times else d)
    return out


class Tables:
    """Many tables side by side: table t has 3 * size[t] cells from first[t] on."""

    def __init__(self, size: np.ndarray) -> None:
        self.size = size.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(3 * self.size)])
        n = int(self.first[-1])
        self.count, self.check, self.key = np.zeros(n, np.int64), np.zeros(n, np.uint32), np.zeros(n, np.uint64)

    def cells(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = (mix(keys[None, :] ^ _SEEDS[:, None]) >> np.uint64(32)).astype(np.int64) & (self.size[table] - 1)[None, :]
        return self.first[table][None, :] + at + self.size[table][None, :] * np.arange(3)[:, None]

    def add(self, table: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        at = self.cells(table, keys)
        check = _check(keys)
        for row in at:
            np.add.at(self.count, row, sign)
            np.bitwise_xor.at(self.key, row, keys)
            np.bitwise_xor.at(self.check, row, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (table, key, sign), and the tables that peeled completely. Empties the cells."""
        owner = np.repeat(np.arange(len(self.size)), 3 * self.size)
        out = []
        look = np.arange(len(self.key))
        for _ in range(ROUNDS):
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _check(self.key[look]))]
            table, key, sign = owner[pure], self.key[pure], self.count[pure]
            pair = np.empty(len(pure), [("t", "<i8"), ("k", "<u8")])
            pair["t"], pair["k"] = table, key
            _, index = np.unique(pair, return_index=True)
            table, key, sign = table[index], key[index], sign[index]
            if not len(key):
                break
            own = (self.cells(table, key) == pure[index]).any(0)  # a chance match sits in a cell that isn't the key's
            table, key, sign = table[own], key[own], sign[own]
            if not len(key):
                break
            self.add(table, key, -sign)
            out.append((table, key, sign))
            look = np.unique(self.cells(table, key))
        left = np.bincount(owner[(self.count != 0) | (self.key != 0)], minlength=len(self.size))
        join = lambda i, kind: np.concatenate([x[i] for x in out]) if out else np.zeros(0, kind)
        return join(0, np.int64), join(1, np.uint64), join(2, np.int64), left == 0

    def packed(self, t: int, n: int) -> str:
        a, b = self.first[t], self.first[t + 1]
        cells = np.empty(b - a, _CELL)
        cells["count"], cells["check"], cells["key"] = self.count[a:b], self.check[a:b], self.key[a:b]
        return base64.b64encode(np.array([n, self.size[t]], "<u4").tobytes() + cells.tobytes()).decode()


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def fingerprints(texts: list[str]) -> list[str]:
    """One string per text: number of digests, size and cells."""
    found = [digests(t) for t in texts]
    n = np.array([len(d) for d in found], np.int64)
    keys = np.array([k for d in found for k in d], np.uint64)
    owner = np.repeat(np.arange(len(texts)), n)
    size = np.maximum(4, 2 ** np.ceil(np.log2(np.maximum(1, 2 * n / 3))).astype(np.int64))
    todo = np.arange(len(texts))
    out = [""] * len(texts)
    while len(todo):
        place = np.full(len(texts), -1)
        place[todo] = np.arange(len(todo))
        mine = place[owner] >= 0
        tables = Tables(size[todo])
        tables.add(place[owner[mine]], keys[mine], 1)
        packed = [tables.packed(i, int(n[t])) for i, t in enumerate(todo)]
        good = tables.peel()[3]
        for i, t in enumerate(todo):
            if good[i]:
                out[t] = packed[i]
        todo = todo[~good]
        size[todo] *= 2
    return out


def _unpack(fingerprint: str) -> tuple[int, int, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    n, size = np.frombuffer(raw[:8], "<u4")
    return int(n), int(size), np.frombuffer(raw[8:], _CELL)


def recovered(fingerprint: str) -> set[int]:
    """The digests that a fingerprint holds."""
    return _recover_all({fingerprint: _unpack(fingerprint)})[fingerprint]


def differing(a: str, b: str) -> tuple[set[int], set[int]]:
    """Digests of a alone and of b alone."""
    (_, sa, _), (_, sb, _) = ua, ub = _unpack(a), _unpack(b)
    d = _subtract([(ua, ub)])
    table, key, sign, good = d.peel()
    if good[0]:
        return {int(k) for k in key[sign > 0]}, {int(k) for k in key[sign < 0]}
    left, right = recovered(a), recovered(b)
    return left - right, right - left


def _subtract(pairs: list[tuple]) -> Tables:
    t = Tables(np.array([min(a[1], b[1]) for a, b in pairs], np.int64))
    for i, (a, b) in enumerate(pairs):
        s, at = int(t.size[i]), int(t.first[i])
        for (_, size, cells), sign in ((a, 1), (b, -1)):
            grid = cells.reshape(3, size // s, s)
            end = at + 3 * s
            t.count[at:end] += sign * grid["count"].astype(np.int64).sum(1).ravel()
            t.key[at:end] ^= np.bitwise_xor.reduce(grid["key"], axis=1).ravel()
            t.check[at:end] ^= np.bitwise_xor.reduce(grid["check"], axis=1).ravel()
    return t


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """Shared digests over all digests, for each pair of fingerprints."""
    if not pairs:
        return []
    unpacked: dict[str, tuple] = {}
    for f in {f for p in pairs for f in p}:
        unpacked[f] = _unpack(f)
    t = _subtract([(unpacked[a], unpacked[b]) for a, b in pairs])
    table, _, _, good = t.peel()
    apart = np.bincount(table, minlength=len(pairs))
    whole = _recover_all({f: unpacked[f] for pair, fine in zip(pairs, good) if not fine for f in pair})
    out = []
    for i, (a, b) in enumerate(pairs):
        d = int(apart[i]) if good[i] else len(whole[a] ^ whole[b])
        total = unpacked[a][0] + unpacked[b][0]
        out.append((total - d) / (total + d) if total else 1.0)
    return out


def _recover_all(unpacked: dict[str, tuple]) -> dict[str, set[int]]:
    t = Tables(np.array([size for _, size, _ in unpacked.values()], np.int64))
    if not unpacked:
        return {}
    cells = np.concatenate([c for _, _, c in unpacked.values()])
    t.count[:], t.check[:], t.key[:] = cells["count"], cells["check"], cells["key"]
    table, key, _, _ = t.peel()
    order = np.argsort(table, kind="stable")
    parts = np.split(key[order], np.searchsorted(table[order], np.arange(1, len(unpacked))))
    return {f: set(p.tolist()) for f, p in zip(unpacked, parts)}


def tail_edit(text: str, following: str) -> str:
    """The last quarter replaced by as much of the beginning of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def versions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[str, str], str] = tail_edit, block_bytes: int = 8 << 20, slice_bytes: int = 2 << 20) -> DataFrame:
    """Per row: id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    The corpus is cut into blocks of ids at quantiles, about ``block_bytes`` of text each; each block also gets the first document of the
    next one, so texts are shuffled once and no window runs over the whole table. A task reads its blocks in order as a stream and holds
    a slice of about ``slice_bytes`` and one document more, so neither equal ids nor few partitions fill its memory.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = input_bytes(docs, text_col)
    blocks = max(4 * partitions(spark), -(-size // block_bytes))
    cuts = np.unique(np.array(rows.select(F.col("id").cast("double")).approxQuantile("id", [i / blocks for i in range(1, blocks)], 0.1 / blocks), np.float64))

    def number(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, np.asarray(ids.cast(pa.float64()), dtype=np.float64), side="right"), pa.int32())

    number.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    block = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.arrow_udf(number, "int")(F.col("id")))
    own = rows.withColumn("block", block)
    heads = sorted(own.select("block", "id").groupBy("block").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("null")).collect(), key=lambda r: r.block)
    first = {r.block: None if r.null else r.id for r in heads}
    names = list(first)
    before = {b: names[i - 1] for i, b in enumerate(names)}  # of the first: the last
    target = F.lit(None).cast("int")
    if names:
        table = spark.createDataFrame([(b, first[b], before[b]) for b in names], T.StructType().add("block", "integer").add("head", docs.schema[id_col].dataType).add("to", "integer"))
        own = own.join(F.broadcast(table), "block")  # as many rows as blocks
        target = F.when(F.col("id").eqNullSafe(F.col("head")), F.col("to"))
    sent = own.select("id", "text", F.explode(F.filter(F.array(F.struct(F.col("block"), F.lit(True).alias("own")), F.struct(target.alias("block"), F.lit(False).alias("own"))), lambda x: x["block"].isNotNull())).alias("x")).select("x.block", "x.own", "id", "text")

    def measured(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
        """Rows of consecutive documents of a block; after is the text that follows them."""
        chain = [*texts, after]
        edited = [edit(a, b) for a, b in zip(chain, chain[1:])]
        prints = fingerprints(chain + edited)
        plain, changed = prints[: len(chain)], prints[len(chain) :]
        near = likeness([*zip(plain, changed), *zip(plain, plain[1:])])
        columns = [ids, list(map(len, texts)), edited, plain[:-1], changed, near[: len(edited)], near[len(edited) :]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held, open_ = 0, None
        for batch in batches:
            block, mine = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, (b, own) in enumerate(zip(block.tolist(), mine.tolist())):
                if not own and b != open_:
                    continue  # the follower is known already
                text = batch.column(3)[i].as_py()
                if texts and (not own or held >= slice_bytes or len(texts) >= 1000):
                    yield measured(ids, texts, text)
                    ids, texts, held = [], [], 0
                if own:
                    ids.append(batch.column(2)[i].as_py())
                    texts.append(text)
                    held += len(text)
                open_ = b if own else None

    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("n_chars", "long").add("edited", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")
    arrow = to_arrow_schema(schema)
    tasks = max(partitions(spark), -(-size // (8 * block_bytes)))
    ordered = sent.repartition(tasks, "block").sortWithinPartitions("block", F.col("own").desc(), F.col("id").asc_nulls_first(), "text")
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(docs: DataFrame) -> DataFrame:
    out = versions(docs)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
