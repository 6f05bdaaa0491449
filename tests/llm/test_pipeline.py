import random
import zlib

import numpy as np

from brute import contamination_rows
from test_mixing_chat import oracle
from tokenizers import Tokenizer

import corpus_pipeline
from lexaloom.llm import language, mixing, token_files
from lexaloom.llm.decontaminate import words_of


LANGS = {"en": "the and ing tion th er", "de": "der die ung sch ich ein", "fr": "les eau oui ère què ment"}


def tables():
    rng = random.Random(12)
    say = lambda lang, n: " ".join("".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(i, say("en", 30)) for i in range(3)]
    docs = []
    for i in range(90):
        lang = rng.choice(list(LANGS))
        docs.append((i, say(lang, rng.randint(30, 120)), lang, rng.choice(["a", "a", "b", None])))
    docs += [(100 + k, docs[k][1], "en", "c") for k in range(5)]  # copies
    docs += [(200 + k, docs[k][1].rsplit(" ", 2)[0] + " changed end", "en", "c") for k in range(5, 9)]  # near copies
    docs += [(300 + k, say("en", 20) + " " + items[k][1], "en", "b") for k in range(3)]  # leaks
    docs += [(400, None, "en", "a"), (401, "", None, None), (402, "123 !!", "de", "b"), (403, say("fr", 20_000), "fr", "b")]
    return docs, items


def test_against_plain_python(spark, tmp_path):
    docs, items = tables()
    names = "doc_id long, text string, lang string, source string"
    frame = spark.createDataFrame(docs, names).selectExpr("*", "CAST(length(text) AS LONG) AS n_chars")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("start", "doc_id", "n_tokens", "ids_crc32").collect())

    judge = language.Classifier(language.fit(frame))
    left = [d for d in docs if judge.judge(d[1], corpus_pipeline.REJECT_MARGIN)[3]]
    assert {d[0] for d in docs} - {d[0] for d in left} == {400, 401, 402}
    sets = {}
    for d in left:
        w = words_of(d[1].encode())
        sets[d[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    group = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    left = [d for d in left if group[d[0]] == d[0]]
    dirty = {r[0] for r in contamination_rows([d[:2] for d in left], items) if r[5]}
    assert dirty == {300, 301, 302}
    left = [d for d in left if d[0] not in dirty]
    columns, rows = oracle(mixing.SQL, documents=spark.createDataFrame(left, names))
    assert columns == ["doc_id", "size", "source_size", "target", "taken"]
    copies = {r[0]: r[4] // r[1] for r in map(eval, rows)}
    tokenizer, start, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for k, text, *_ in sorted(left):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for _ in range(copies[k]):
            want.append((start, k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, source string, found string")
    empty = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == frame.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
