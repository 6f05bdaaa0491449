"""Token-id files: Parquet list columns, delta-encoded, with controlled row groups and page indexes (operator 6).

Documents are range-partitioned and sorted by id, tokenised after the shuffle (texts are smaller than their ids and no text
is tokenised twice), and written by Spark's own committer, one file per range, so a lost executor costs only
its tasks. Ids are DELTA_BINARY_PACKED, the other columns dictionary-encoded; row groups and pages are small and every
file has page indexes, so readers can fetch the metadata alone or a few documents' ids.

Tokenising: white space never takes part in a token of a word-level vocabulary, so a text's ids are those of its
blank-separated pieces in order. Pieces are encoded by the tokenizers library and remembered per worker. Other
tokenizers encode whole texts.

Results for special cases: a null or blank text has the end id alone; a null id comes first; repeated rows and ids are written one
by one (ties in text order); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.llm.common import input_bytes, partitions, scratch_path, ship, trim, trimmed

END_ID = 1
KEEP_PIECES = 250_000
KEEP_LENGTH = 64
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORKER: dict[str, tuple] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of blank-separated pieces of a lower-casing word-level tokenizer, computed when first met.

    A run of Latin letters with ASCII punctuation behind it is two words of the model, each computed once; anything else takes
    the whole tokenizer. Two generations are kept, so common pieces survive when the older one goes.
    """

    latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
    letters = _byte_letters()
    tail = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model, self.old, self.tails = tokenizer, tokenizer.model, {}, {}
        self[""] = b""

    def age(self) -> None:
        self.old, self.tails = dict(self), {}
        self.clear()
        self[""] = b""

    def word(self, text: str) -> bytes:
        spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            core = piece.rstrip(self.tail)
            if len(piece) > KEEP_LENGTH or not self.latin(core):
                packed = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
            elif len(core) == len(piece):
                packed = self.word(core.lower())
            else:
                end = piece[len(core) :]
                if end not in self.tails:
                    self.tails[end] = self.word(end)
                packed = self[core] + self.tails[end]
        if len(piece) <= KEEP_LENGTH:
            self[piece] = packed
        return packed


def _folded(text: str) -> str:
    """In lower case where that is sure to be what the tokenizer makes of it; fewer pieces then differ."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _tokenizer(path: str) -> tuple:
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _WORKER.clear()
        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        by_word = steps == ["NFC", "Replace", "Lowercase"] and splits == [{"Regex": WORD_PATTERN}, None] and spec["model"]["type"] == "BPE"
        _WORKER[path] = (tokenizer, _Pieces(tokenizer) if by_word else None)
    return _WORKER[path]


def encode(texts: list[str], path: str, end_id: int = END_ID) -> list[bytes]:
    """Little-endian 32-bit ids of each text, the end id last."""
    tokenizer, pieces = _tokenizer(path)
    end = array("I", [end_id]).tobytes()
    if pieces is None:
        return [array("I", e.ids).tobytes() + end for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if len(pieces) > KEEP_PIECES:
        pieces.age()
    get = pieces.__getitem__
    return [b"".join(map(get, _folded(t).replace("\n", " ").split(" "))) + end for t in texts]


def write(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20, files: int | None = None, file_bytes: int = 128 << 20) -> None:
    """Write (id, shard, start_in_shard, n_tokens, tokens) below ``path`` in ascending id order over the shards.

    A shard is a file of about ``file_bytes`` of text, or less where that would leave tasks idle. Ranges are cut by id, then text, so
    rows that share an id, or have none, are spread too.
    """
    spark = docs.sparkSession
    ship(spark)
    n = files or max(partitions(spark), -(-input_bytes(docs, text_col) // file_bytes))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            sizes = np.cumsum(np.diff(np.frombuffer(whole.column(1).buffers()[1], np.int32)[whole.column(1).offset : whole.column(1).offset + whole.num_rows + 1]).astype(np.int64)) if whole.num_rows else np.zeros(0)
            at = 0
            while at < whole.num_rows:  # about 2 MB of text at a time
                base = sizes[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(sizes, base + (2 << 20), side="right")))
                batch = whole.slice(at, upto - at)
                at = upto
                ids = encode(batch.column(1).to_pylist(), tokenizer_path, end_id)
                count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                ends = np.cumsum(count)
                offsets = np.append(0, ends)
                yield pa.record_batch({
                    "id": batch.column(0),
                    "shard": pa.array(np.full(len(ids), shard, np.int32)),
                    "start_in_shard": pa.array(start + ends - count),
                    "n_tokens": pa.array(count),
                    "tokens": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32))),
                })
                start += int(ends[-1])

    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("shard", "integer").add("start_in_shard", "long").add("n_tokens", "long").add("tokens", T.ArrayType(T.IntegerType()))
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary#tokens.list.element": "false",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": "1000",
    }
    ordered.mapInArrow(trimmed(run), schema).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, start (ids before the document in the whole corpus), n_tokens, tokens; unread columns are pruned."""
    table = spark.read.parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row per file, and write() makes as many files as there are partitions
    return table.join(F.broadcast(base), "shard").select("id", (F.col("base") + F.col("start_in_shard")).alias("start"), F.size("tokens").cast("long").alias("n_tokens"), "tokens")


def crc32_of(tokens):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            offsets = np.asarray(column.offsets, dtype=np.int64)
            body = memoryview(np.ascontiguousarray(np.asarray(column.values, dtype="<i4"))).cast("B")
            yield pa.array([zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])], pa.int64())
        trim()

    return F.arrow_udf(run, "long")(tokens)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the corpus into the shared folder and return what its files hold."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, path, tokenizer_path or default_tokenizer())
    return read(spark, path)


def query(docs: DataFrame) -> DataFrame:
    back = round_trip(docs)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", crc32_of(F.col("tokens")).alias("ids_crc32"))
