import hashlib

import duckdb
import pytest

from lexaloom.llm import chat, mixing


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name + "_a", rows.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_a")
    r = con.execute(sql)
    return [c[0] for c in r.description], sorted(map(str, r.fetchall()))


def test_mix_agrees_with_sql_and_is_balanced(spark):
    rows = [(i, "w " * ((i * 37) % 50), None if i % 11 == 0 else f"s{i % 7 if i % 3 else 0}", 1) for i in range(3000)]
    rows += [(5, "w " * 10, "s1", 2), (None, None, "s2", 3), (None, "one two", None, 4), (9999, "", "empty", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    names, want = oracle(mixing.SQL, documents=df)
    got = mixing.query(df).select(*names)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    per = {}
    for r in mixing.mix(df, keep=("doc_id", "source")).collect():
        assert r["copies"] in (0, 1, 2)
        key = r["kept"]["source"]
        taken, target = per.get(key, (0, 0))
        per[key] = (taken + r["size"] * r["copies"], r["target"])
    for taken, target in per.values():
        assert abs(taken - target) <= 60
    assert sum(t for _, t in per.values()) == pytest.approx(1.5 * sum(len((t or "").split()) for _, t, _, _ in rows))


def test_sample_repeats_rows(spark):
    df = spark.createDataFrame([(i, "a b c", "s", i) for i in range(100)], "doc_id long, text string, source string, copies long")
    out = mixing.sample(df)
    assert out.columns == df.columns and out.count() == 150
    assert mixing.query(df.limit(0)).collect() == [] and mixing.sample(df.limit(0)).count() == 0


CHATS = [
    (1, 0, "user", "a <|im_end|> \\ <\\|im_sep|>"), (1, 1, "assistant", "one"), (1, 2, "assistant", "<"), (1, 3, "user", "|x\n<|"),
    (1, 3, "user", "|x\n<|"), (2, 1, "assistant", None), (2, None, "sys\\n\n<|im_start|>", "é中"), (3, 0, None, ""), (None, 0, "user", "no id"), (4, 0, "assistant", "q" * 5000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    names, want = oracle(chat.SQL, conversations=df)
    assert sorted(str(tuple(r)) for r in chat.query(df).select(*names).collect()) == want
    out = chat.format_chats(df)
    for r in out.select("conv_id", "formatted", chat.read_back(out.formatted).alias("t"), chat.loss_text(out.formatted, out.loss_spans).alias("loss"), "blocks").collect():
        own = sorted([x for x in CHATS if x[0] == r.conv_id], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.t] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.formatted.count("<|im_start|>") == len(r.blocks)
    attack = chat.query(df).where("conv_id = -1").first()
    assert attack.n_turns == 2 and attack.loss_sha256 == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest()
    assert len(chat.query(df.limit(0)).collect()) == 1


def test_long_conversations_and_texts(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i} <|im_sep|> \\" * (i % 4)) for i in range(2000)] + [(2, 0, "assistant", "é<|" * 100_000)] + [(3, i, "assistant", "same") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names, want = oracle(chat.SQL, conversations=df)
    assert sorted(str(tuple(r)) for r in chat.query(df).select(*names).collect()) == want


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i // 3, "one two three", "s", i) for i in range(300)] + [(7, "w " * 100_000, "s", 1), (7, "w " * 100_000, "s", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    a, b = (sorted(map(tuple, mixing.sample(d).select("doc_id", "extra").collect())) for d in (df, df.orderBy("extra", ascending=False).repartition(5)))
    assert a == b and len(a) > 300
