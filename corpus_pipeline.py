"""From raw documents to token files: language, near duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
stages but the last return the columns of documents. Other columns come back unchanged, whatever their names; an empty table gives an
empty one; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaloom.llm import common, decontaminate, language, mixing, near_join, token_files

#: A rejected document has no letter, or two languages compress it almost equally well.
REJECT_MARGIN = 0.002


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification; documents that it rejects go.

    Null, empty and letterless texts are rejected, as are ties between two languages; repeated rows are judged alike; null labels and
    ids are not learned from.
    """
    return language.accepted(docs, language.fit(docs), reject_margin=REJECT_MARGIN)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join; one document of each group of near duplicates stays.

    It is the one with the smallest id (a null id comes last), then text digest; of repeated rows one stays, chosen by a hash of the other columns. A null
    or wordless text is a group of its own.
    """
    return near_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; documents that hold a full window of a benchmark item go, or a twentieth of short items.

    Null and wordless texts have no hits and stay; repeated rows are judged alike; an empty benchmark drops nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights; a document comes as often as it is taken, twice at most.

    A null source is a source of its own; null and blank texts have size 0; ties in size go by a hash of the id, then of the text and
    the other columns; repeated rows are sampled one by one.
    """
    return mixing.sample(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens and a checksum of the ids.

    A null or blank text has the end id alone; a null id comes first; repeated rows and ids are written one by one.
    """
    return token_files.query(docs)


STAGES = [
    ("language", keep_identified),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", to_tokens),
]

#: Compression, chosen paths and the tokenizer have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage{k}")
    return docs
