import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from lexaloom.llm import token_files
from lexaloom.llm.common import scratch_path

ALPHABET = "aA éÉßİıǅσς'’.,!?\n\t ́<|endoftext|>09²½日本ﬁ-_\x1c\x85​&"


def texts(seed, n):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*out, None, "", " \n ", "It's a NAÏVE test, don't!", "x" * 200, "word " * 40_000, "<|endoftext|>"]


def test_pieces_equal_whole_texts():
    path = token_files.default_tokenizer()
    some = [t or "" for t in texts(5, 3000)]
    want = [np.array([*e.ids, 1], "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    assert token_files.encode(some, path) == want


def test_round_trip(spark):
    some = texts(6, 200)
    keys = [*range(len(some) - 3, 0, -1), 4, None, 7]
    docs = list(zip(keys, some))
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in docs], "doc_id long, text string, n_tokens int, shard string").repartition(5)
    got = sorted(map(tuple, token_files.query(df).collect()), key=lambda r: r[1])
    tokenizer, start, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_file_format_and_empty(spark):
    df = spark.createDataFrame([(1, "hello world")] * 50, "doc_id long, text string")
    path = scratch_path(spark, "format")
    token_files.write(df, path, token_files.default_tokenizer(), files=1)
    name = next(f for f in spark.read.parquet(path).inputFiles())
    column = pq.ParquetFile(name.removeprefix("file://")).metadata.row_group(0).column(4)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_column_index and column.has_offset_index
    assert token_files.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
