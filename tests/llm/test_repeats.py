import random

import pytest
from brute import passage_rows, substring_rows
from test_mixing_chat import oracle

from lexaloom.llm import chunks as C
from lexaloom.llm import passage_dedup, substring_dedup

SCHEMA = "doc_id long, text string, n_bytes string, chunk int"


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 6)))
    prose = lambda n: rng.choice([" ", "\n", "  "]).join(word() for _ in range(n))
    shared = [prose(90) for _ in range(4)]
    docs = [None, "", "a", " ", "x" * 199, "x" * 200, "y" * 450, "ab " * 300, "no-end", prose(34), prose(36)]
    for _ in range(40):
        parts = [prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        parts.insert(rng.randint(0, len(parts)), rng.choice(shared)[rng.randint(0, 40) :][: rng.randint(100, 600)])
        docs.append(rng.choice([" ", ""]).join(parts))
    docs += [docs[20], docs[20], docs[25] + "!", prose(30_000)]
    docs[30] = docs[31][:150] + "?" + docs[31][150:]
    return [*enumerate(docs), (7, docs[22]), (None, docs[23])]


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 20), (2, 700)])
def test_against_brute_force(spark, seed, chunk):
    docs = fixture(seed)
    df = spark.createDataFrame([(k, t, "other", 1) for k, t in docs], SCHEMA).repartition(3)
    for module, name, brute in ((substring_dedup, "remove_repeated_substrings", substring_rows), (passage_dedup, "remove_repeated_passages", passage_rows)):
        inner = getattr(module, name)
        try:
            setattr(module, name, lambda d: inner(d, chunk_bytes=chunk))  # noqa: B023
            got = module.query(df).collect()
        finally:
            setattr(module, name, inner)
        assert sorted(map(tuple, got), key=str) == brute(docs)


def test_passage_in_a_third_of_all_documents(spark, monkeypatch):
    """Hot hashes: many chunks, each with the same passage between its own words; the sample finds it, whole and at its edges."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    hot, also = prose(90), prose(45)
    docs = []
    for i in range(240):
        body = [prose(rng.randint(20, 60)), prose(rng.randint(0, 30))]
        if i % 3 == 0:
            body.insert(1, hot)
        elif i % 5 == 0:
            body.insert(1, " ".join(hot.split()[rng.randint(0, 40) :]))
        elif i % 50 == 1:
            body.insert(1, also)
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame([(k, t, "other", 1) for k, t in docs], SCHEMA).repartition(3)
    for limits in ({}, {"HOT_KEYS": 20}):
        for name, value in limits.items():
            monkeypatch.setattr(C, name, value)
        for module, name, brute in ((substring_dedup, "remove_repeated_substrings", substring_rows), (passage_dedup, "remove_repeated_passages", passage_rows)):
            inner = getattr(module, name)
            with monkeypatch.context() as m:
                m.setattr(module, name, lambda d: inner(d, chunk_bytes=600))  # noqa: B023
                sent = []
                before = C.two_phases
                m.setattr(C, "two_phases", lambda chunks, *rest: (sent.append(chunks.count()), before(chunks, *rest))[1])  # noqa: B023
                got = module.query(df).collect()
            assert sent[0] > C.HOT_CHUNKS and sorted(map(tuple, got), key=str) == brute(docs)


def test_sql(spark):
    df = spark.createDataFrame([(k, t) for k, t in fixture(3)], "doc_id long, text string")
    names, want = oracle(passage_dedup.SQL, documents=df)
    assert sorted(str(tuple(r)) for r in passage_dedup.query(df).select(*names).collect()) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.query(df).collect() == []
    assert passage_dedup.query(df).collect() == []


def test_spans_and_text(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text + " tail one"), (2, "head " + text)], "doc_id long, text string")
    rows = {r.doc_id: r for r in passage_dedup.remove_repeated_passages(df).collect()}
    assert [(s.start, s.end) for s in rows[1].spans] == [(0, 50)] and rows[1].kept == "tail one"
    assert [(s.start, s.end) for s in rows[2].spans] == [(1, 51)] and rows[2].kept == "head"


def test_cover_is_complete():
    for period, cover in passage_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
