import random

import pytest
from brute import contamination_rows, words13
from test_mixing_chat import oracle

from lexaloom.llm import decontaminate


def fixture():
    rng = random.Random(3)
    vocabulary = ["Aé", "b1", "C", "中文", "zz", "q9"]
    prose = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randint(5, 40))) for i in range(12)] + [(20, None), (21, "..."), (22, "short One"), (22, "short One"), (None, prose(20))]
    docs = [(i, prose(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, f"lead {items[i][1].upper() if items[i][1].isascii() else items[i][1]}; tail") for i in range(12)]
    docs += [(200, None), (201, ""), (202, "SHORT-one"), (202, "SHORT-one"), (None, "x short\tone y"), (203, "\x7fshort\x00one{")]
    return docs, items


@pytest.mark.parametrize("max_words", [1_000_000, 60])
def test_against_brute_force(spark, max_words, monkeypatch):
    docs, items = fixture()
    d = spark.createDataFrame([(k, t, "x", 5) for k, t in docs], "doc_id long, text string, found string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    inner = decontaminate.find
    monkeypatch.setattr(decontaminate, "find", lambda x, y: inner(x, y, max_words=max_words))
    assert sorted(map(tuple, decontaminate.query(d, b).collect()), key=str) == contamination_rows(docs, items)


def test_sql(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    names, want = oracle(decontaminate.SQL, documents=d, benchmark=b)
    assert sorted(str(tuple(r)) for r in decontaminate.query(d, b).select(*names).collect()) == want


def test_clean_keeps_columns_and_spans_map_back(spark):
    d = spark.createDataFrame([(1, "é: Alpha BETA!", "f"), (2, "nothing here", "g")], "doc_id long, text string, __found string")
    b = spark.createDataFrame([(9, "alpha beta")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(d, b).collect()] == [(2, "nothing here", "g")]
    row = decontaminate.find(d, b).where("doc_id = 1").first()
    raw = row.text.encode()
    assert [raw[s.start : s.end].decode() for s in row.found.spans] == ["Alpha BETA"]


def test_clean_drops_leaks_in_long_texts(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, short = say(30), "blue moon"
    docs = [(1, say(3000)), (2, f"{say(1500)} {passage} {say(1500)}"), (3, f"{say(900)} {short} {say(900)}"), (4, f"{say(5)} {short}"), (5, f"{say(2000)} {' '.join(passage.split()[7:20])}"), (6, f"{say(2000)} {' '.join(passage.split()[7:19])}"), (7, f"{say(200_000)} {passage}")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, passage), (2, short)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [1, 3, 6]
    full = {r.doc_id: (r.found.n_hit, r.found.n_full) for r in decontaminate.find(d, b).collect()}
    assert full == {1: (0, 0), 2: (30, 30), 3: (2, 0), 4: (2, 0), 5: (13, 13), 6: (0, 0), 7: (30, 30)}


def test_repeated_and_shifted_blocks(spark):
    """Items that hold a block twice, and texts that repeat it."""
    items = [(1, " ".join(["a"] * 40)), (2, " ".join(f"w{i % 7}" for i in range(30))), (3, " ".join(f"w{i % 6}" for i in range(14)))]
    docs = [(i, " ".join(["x", *["a"] * i, "y", *[f"w{k % 7}" for k in range(i)], "z", *[f"w{k % 6}" for k in range(3, i)]])) for i in range(1, 45)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.query(d, b).collect()), key=str) == contamination_rows(docs, items)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.query(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.query(one, b).first().n_hit == 0


def test_words_agree():
    for text in ["aB9é_中{x}\x7f", "A\x80b", "﻿Ünï"]:
        assert [w.decode() for w in decontaminate.words_of(text.encode())] == words13(text)
