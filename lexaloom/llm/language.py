"""Language identification by compression (operator 1).

Each language has a raw-content zstandard dictionary made of labelled text. A text is compressed whole, in blocks of
``block`` bytes, once with every dictionary; the language whose dictionary makes it smallest wins. The margin is the
second size over the best minus one; a text whose margin is below ``reject_margin`` is rejected. Blocks keep the margin of
a long text as large as that of a short one, since the dictionary is in reach of every block. Case is folded on both sides.

Training reads a bounded sample: of the ``max_labels`` most frequent labels, the ``sample_docs`` documents with the smallest hash of
their id, and of each a stretch of at most ``sample_chars`` characters from a place that the hash chooses. The sample is split in two, and what
the other half's dictionaries clearly take for another language is left out, since labels contain errors. The two parameters bound what is broadcast.

Results for special cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; a tie goes to the first
label in code-point order and is rejected; with one label every text with letters has it, score 1; without labelled text all are
``und``; null labels and null ids aren't learned from; repeated rows are judged alike; other columns come back unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaloom.llm.common import ship

UNKNOWN = "und"
BLOCK = 4096
LEVEL = 6
REJECT_MARGIN = 0.01
MIN_DICTIONARY = 32 << 10
RESULT = "lang_pred string, score double, margin double, accepted boolean"


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 96, sample_chars: int = 2000, max_labels: int = 200) -> dict[str, bytes]:
    """Dictionary bytes by language, learned from the labelled rows of ``docs``."""
    c = lambda name: F.col(f"`{name}`")
    rows = docs.where(c(lang_col).isNotNull() & c(id_col).isNotNull() & c(text_col).isNotNull())
    labels = [r.lang for r in rows.groupBy(c(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_labels).collect()]
    if not labels:
        return {}
    known = rows.where(c(lang_col).isin(labels))
    keys = known.select(c(lang_col).alias("lang"), c(id_col).alias("id"), F.xxhash64(c(id_col)).alias("h"))
    best = lambda *more: F.row_number().over(Window.partitionBy("lang").orderBy("h", *more))
    ids = sorted({r.id for r in keys.withColumn("place", best("id")).where(F.col("place") <= sample_docs).select("id").collect()})
    at = F.pmod("h", F.greatest(F.char_length("text") - sample_chars + 1, F.lit(1))).cast("int") + 1
    some = known.where(c(id_col).isin(ids)).select(c(lang_col).alias("lang"), F.xxhash64(c(id_col)).alias("h"), c(text_col).alias("text")).select("lang", "h", F.substr("text", at, F.lit(sample_chars)).alias("text"))
    texts = some.withColumn("place", best("text")).where(F.col("place") <= sample_docs).collect()  # repeated ids too
    parts: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r.lang, r.h, r.text)):
        parts.setdefault(r.lang, []).append(r.text.lower())
    parts = _agreed(_agreed(parts))
    joined = {lang: "\n".join(p).encode() for lang, p in parts.items()}
    even = max(MIN_DICTIONARY, min(map(len, joined.values())))  # a larger dictionary would win by its size
    return {lang: raw[:even] for lang, raw in joined.items()}


def _agreed(parts: dict[str, list[str]]) -> dict[str, list[str]]:
    out = {lang: [] for lang in sorted(parts)}
    halves = [{lang: p[k::2] for lang, p in parts.items()} for k in (0, 1)]
    for mine, other in (halves, halves[::-1]):
        judge = Classifier({lang: "\n".join(p).encode() for lang, p in other.items()})
        for lang, texts in mine.items():
            for text in texts:
                label, _, margin, _ = judge.judge(text, 0)
                if label in (lang, UNKNOWN) or margin < 2 * REJECT_MARGIN:
                    out[lang].append(text)
    return {lang: kept or parts[lang] for lang, kept in out.items()}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK, level: int = LEVEL) -> None:
        self.labels, self.block, self.coders = sorted(dictionaries), block, []
        for lang in self.labels:
            d = zstandard.ZstdCompressionDict(dictionaries[lang] or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def judge(self, text: str | None, reject_margin: float) -> tuple[str, float, float, bool]:
        if not self.labels or text is None or not has_letter(text):
            return UNKNOWN, 0.0, 0.0, False
        if len(self.labels) == 1:
            return self.labels[0], 1.0, 1.0, True
        sizes = np.array(self.sizes(text))
        first = int(np.argmin(sizes))
        best, second = sizes[first], np.partition(sizes, 1)[1]
        margin = float(second / best - 1)
        return self.labels[first], margin / (margin + 0.02), margin, bool(margin >= reject_margin and margin > 0)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", reject_margin: float = REJECT_MARGIN, into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred, score (0 to 1), margin, accepted. Only the text is read."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(dictionaries)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(held.value)
        for texts in columns:
            rows = [classifier.judge(t, reject_margin) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "accepted"])

    return docs.withColumn(into, F.pandas_udf(run, RESULT)(F.col(f"`{text_col}`")))


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], **options) -> DataFrame:
    """The documents with an accepted language, with their own columns only."""
    into = "__language"
    while into in docs.columns:
        into += "_"
    return identify(docs, dictionaries, into=into, **options).where(F.col(f"{into}.accepted")).drop(into)


def query(docs: DataFrame) -> DataFrame:
    dictionaries = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), dictionaries)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.margin", "language.accepted")
