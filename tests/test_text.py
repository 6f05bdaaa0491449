import pytest
from pyspark.sql import functions as F

from lexaloom.functions import edit as E
from lexaloom.functions import text as X
from lexaloom.plans import query as Q

SANITIZED = [
    ("<h2>Salt &amp; Bread</h2><script>x()</script><div>New&nbsp;today</div>", "Salt & Bread New today"),
    ("&lt;script&gt;hidden()&lt;/script&gt;<p>seen</p>", "seen"),
    ("<div>before <strong>text", "before text"),
    ("price 5 < 10 and 10 > 5", "price 5 < 10 and 10 > 5"),
    ("left‎‪﻿right", "leftright"),
    ("a‌b‍c​d", "a b c d"),
    ("a\x0bb  c", "a b c"),
    ("<style>p{}</style>x<template>hidden", "x"),
    ("caf&eacute; &#65;&#x42; &bogus; &amp;lt;", "café AB &bogus; &lt;"),
    ("", ""),
]


def test_sanitize(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SANITIZED)] + [(99, None)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", X.sanitize(F.col("s")).alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(SANITIZED)} | {99: ""}
    assert [Q.sanitize(s) for s, _ in SANITIZED] == [t for _, t in SANITIZED]


TOKENS = [
    ("can't d’hiver out-of-the-way 3.5", ["can't", "d’hiver", "out", "of", "the", "way", "3", "5"]),
    ("one two one سه two سه", ["one", "two", "سه"]),
    ("--- ،؛؟", []),
]


def test_tokens_and_normalize(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(TOKENS)], "i int, s string")
    assert {r.i: r.t for r in df.select("i", X.tokens(F.col("s")).alias("t")).collect()} == {i: t for i, (_, t) in enumerate(TOKENS)}
    assert [Q.tokens(s) for s, _ in TOKENS] == [t for _, t in TOKENS]
    pairs = [("  MIXED\nCase  ۱۲۳ ك ", "en", "mixed case ۱۲۳ ك"), ("كتابَ آب۱٢ يـا", "fa-IR", "کتاب اب12 یا")]
    df = spark.createDataFrame(pairs, "s string, l string, w string")
    assert all(r.ok for r in df.select((X.normalize(F.col("s"), F.col("l")) == F.col("w")).alias("ok")).collect())
    assert [Q.normalize(s, loc) for s, loc, _ in pairs] == [w for *_, w in pairs]


@pytest.mark.parametrize("text,status", [(None, "empty"), ("  ", "empty"), ("  \u0085", "empty"), ("<br><div></div>", "empty"), ("---", "punctuation_only"), ("،؛؟", "punctuation_only"), ("a", "too_short"), ("ک", "too_short"), ("ab", "ready"), ("12", "ready"), ("کی", "ready"), ("x" * 300, "ready")])
def test_status(spark, text, status):
    assert Q.process(text, "en").status == status
    df = spark.createDataFrame([(1, text, "en")], "query_id long, text string, locale string")
    r = Q.process_table(df).first()
    assert r.status == status and r.truncated == (len(text or "") > 200)


def test_edit_distance(spark):
    cases = [("prtقال", "prtقالx", 1, 1000), ("oragne", "orange", 1, 700), ("پترقال", "پرتقال", 1, 700), ("prange", "orange", 1, 450), ("same", "same", 0, 0), ("", "ab", 2, 2000), ("kitten", "sitting", 3, 3000)]
    df = spark.createDataFrame([(a, b, "en") for a, b, *_ in cases], "a string, b string, l string")
    got = [(r.d.edits, r.d.cost) for r in df.select(E.edit_distance(F.col("a"), F.col("b"), F.col("l")).alias("d")).collect()]
    assert got == [(e, c) for *_, e, c in cases]


def test_deletes(spark):
    words = ["abc", "aab", "orange", "chocolate", "a", "déjà"]
    df = spark.createDataFrame([(w, d) for w in words for d in (0, 1, 2)], "t string, d int")
    for r in df.select("t", "d", E.deletes(F.col("t"), F.col("d"), 20).alias("k")).collect():
        assert r.k == E.delete_keys(r.t, r.d, 20), r.t


def test_keyboard_and_sounds(spark):
    assert E.remap_keys("\\vjrhg") == "پرتقال" and E.remap_keys("R") == "ریال"
    df = spark.createDataFrame([("\\vjrhg R",)], "s string")
    assert df.select(E.keyboard_remap(F.col("s"))).first()[0] == "پرتقال ریال"
    words = [("fone", "en"), ("ckick", "en"), ("بصطنی", "fa")]
    table = E.sound_alternatives_table(spark.createDataFrame(words, "token string, family string"), E.sound_rules(spark)).collect()
    assert {(r.token, r.alternative, r.cost) for r in table} == {(w, a, c) for w, f in words for a, c, _ in E.sound_alternatives(w, f)}


def test_small_functions(spark):
    df = spark.createDataFrame([("en-GB", " a", "10", 2, 3), ("", "ok", "9", 1, 0)], "l string, n string, i string, a int, b int")
    r = df.select(X.resolve_locale(F.col("l")).alias("l"), X.locale_chain(F.col("l")).alias("c"), X.is_canonical_name(F.col("n")).alias("n"), X.basis_points(F.col("a"), F.col("b")).alias("bp")).collect()
    assert (r[0].l, r[0].c, r[0].n, r[0].bp) == ("en-GB", ["en-GB", "en"], False, 6666)
    assert (r[1].l, r[1].n, r[1].bp) == ("und", True, 0)
    ids = spark.createDataFrame([("10",), ("9",), ("0009",), ("x1",), ("99999999999999999999",)], "i string")
    assert [r.i for r in ids.orderBy(*X.id_order(F.col("i"))).collect()] == ["0009", "9", "10", "99999999999999999999", "x1"]
