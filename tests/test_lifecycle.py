import json

import pytest
from docs import F, doc, index

from lexaloom import __main__ as cli
from lexaloom.functions import text as X
from lexaloom.operators import dictionary as D
from lexaloom.operators import lifecycle as L
from lexaloom.sources import tables as T
from lexaloom.streaming import feed as W


def titles(frame):
    return sorted((r.source_key, r.locale, r.title) for r in frame.collect())


def test_replace_is_a_diff(spark):
    old = index(spark, [doc(1, "a", key="s1"), doc(2, "a fr", key="s1", locale="fr"), doc(3, "b", key="s2")])
    new = index(spark, [doc(1, "a", key="s1"), doc(4, "a de", key="s1", locale="de")])
    assert {(r.locale, r.action) for r in L.diff(old, new, new).collect()} == {("en", "unchanged"), ("fr", "deleted"), ("de", "created")}
    assert titles(L.replace(old, new)) == [("s1", "de", "a de"), ("s1", "en", "a"), ("s2", "en", "b")]
    r = L.report(L.diff(old, new, new)).first()
    assert (r.created, r.updated, r.deleted, r.unchanged, r.sources) == (1, 0, 1, 1, 1)
    assert L.verify(L.replace(old, new), new).count() == 0 and L.verify(old, new).count() == 1


def test_replace_refuses(spark):
    old = index(spark, [doc(1, "a", key="s1")])
    with pytest.raises(ValueError, match="identity"):
        L.replace(old, index(spark, [doc(5, "x", key="s9"), doc(6, "y", key="s9")]))
    with pytest.raises(ValueError, match="owners"):
        L.replace(old, index(spark, [doc(5, "x", key="s1", kind="product")]))


def test_upsert_and_delete(spark):
    old = index(spark, [doc(1, "a", key="s1"), doc(2, "a fr", key="s1", locale="fr"), doc(3, "b", kind="product", source_id=None)])
    assert ("s1", "en", "new") in titles(L.upsert(old, index(spark, [doc(1, "new", key="s1")]))) and L.upsert(old, index(spark, [doc(1, "new", key="s1")])).count() == 3
    assert L.delete(old, source_key="s1", locale="fr").count() == 2 and L.delete(old, source_type="product").count() == 2
    assert L.delete(old, source_id=None, source_key="product:3").count() == 2


def test_prune(spark):
    have = index(spark, [doc(i, "t", key=f"s{i % 3}", locale=f"l{i}") for i in range(6)])
    current = have.where("source_key <> 's1'")
    left, said = L.prune(have, current, authoritative=True)
    assert said == {"dry_run": True, "sources": 1, "documents": 2} and left.count() == 6
    assert L.prune(have, current, authoritative=True, dry_run=False)[0].count() == 4
    with pytest.raises(ValueError, match="limit"):
        L.prune(have, current, authoritative=True, limit=0)
    with pytest.raises(ValueError, match="authoritative"):
        L.prune(have, current, authoritative=False)


def test_sources_to_run(spark):
    rows = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "a")], "partition string, source_key string")
    some, repeats = L.sources_to_run(rows, limit=1)
    assert [r.source_key for r in some.collect()] == ["a"] and repeats == 1
    with pytest.raises(ValueError):
        L.sources_to_run(rows, ceiling=1)


def test_doctor(spark):
    good = index(spark, [doc(i, "t", key=f"s{i}") for i in range(5)])
    assert all(f["healthy"] for f in L.doctor(good, True))
    bad = good.withColumn("title", F.when(F.col("id") == 3, "x").otherwise(F.col("title"))).unionByName(good.where("id = 1"))
    found = {f["check"]: f["findings"] for f in L.doctor(bad, True)}
    assert found["schema.semantic-sample"] == [3] and len(found["schema.identities"]) == 1
    assert [f["healthy"] for f in L.doctor(good.drop("title")) if f["check"] == "schema.columns"] == [False]


def test_hash_covers_every_field(spark):
    rows = spark.createDataFrame([doc(1, "a"), doc(2, "a")], index(spark, [doc(1, "a")]).select(*T.COLUMNS).schema)
    base = T.with_hash(rows.where("id = 1")).first().document_hash
    for c in T.HASHED:
        other = {"priority": F.lit(7), "is_active": F.lit(False), "payload": F.lit('{"a": 1}'), "source_updated_at": F.lit("2024-01-01").cast("timestamp")}.get(c, F.lit("other"))
        assert T.with_hash(rows.where("id = 1").withColumn(c, other)).first().document_hash != base
    assert T.with_hash(rows.where("id = 1").withColumn("excerpt", F.lit(""))).first().document_hash != base


def test_hash_is_canonical(spark):
    """Key order in a payload doesn't count, that of lists does; an empty payload is an empty list; times are in UTC."""
    base = spark.createDataFrame([doc(1, "a/ü", source_id="7")], index(spark, [doc(1, "a")]).select(*T.COLUMNS).schema)
    made = lambda p: T.with_hash(base.withColumn("payload", F.lit(p))).first().document_hash
    assert made('{"b": {"y": [1, 2], "x": null}, "a": 1}') == made('{"a": 1, "b": {"x": null, "y": [1, 2]}}') != made('{"a": 1, "b": {"x": null, "y": [2, 1]}}')
    assert made("{}") == made(None) == made("[]")
    row = base.withColumn("payload", F.lit('{"b":1,"a":"é"}')).withColumn("source_updated_at", F.lit("2024-05-06 07:08:09.12").cast("timestamp"))
    want = '{"excerpt":null,"is_active":true,"locale":"en","normalized_content":null,"normalized_excerpt":null,"normalized_keywords":null,"normalized_title":"a/ü","partition":"default","payload":{"a":"é","b":1},"priority":0,"provider_key":"default","source_connection":null,"source_id":"7","source_key":"page:1","source_type":"page","source_updated_at":"2024-05-06T07:08:09.120000Z","title":"a/ü"}'
    assert row.select(T.canonical_json(row)).first()[0] == want


def test_upsert_refuses_another_owner(spark):
    old = index(spark, [doc(1, "a", key="s1")])
    with pytest.raises(ValueError, match="owners"):
        L.upsert(old, index(spark, [doc(2, "b", key="s1", kind="product", locale="fr")]))


def test_prune_keeps_to_its_providers(spark):
    have = index(spark, [doc(1, "a", key="s1", provider="p"), doc(2, "b", key="s2", provider="q")])
    left, said = L.prune(have, have.limit(0), authoritative=True, dry_run=False, providers=["p"])
    assert [r.source_key for r in left.collect()] == ["s2"] and said["sources"] == 1


def test_enumerators(spark):
    r = T.EnumeratorRegistry()
    one = spark.createDataFrame([("p", "d", "s1", "page", "1")], "provider_key string, partition string, source_key string, source_type string, source_id string")
    r.register(T.Enumerator("a", "p", lambda spark, d: one, True))
    r.register(T.Enumerator("b", "q", lambda spark, d: one))
    with pytest.raises(ValueError, match="twice"):
        r.register(T.Enumerator("a", "z", lambda spark, d: one))
    with pytest.raises(ValueError, match="registered as x"):
        r.select(["x"])
    assert [e.key for e in r.select(providers=["q"])] == ["b"] and [e.key for e in r.select()] == ["a", "b"]
    assert L.current_sources([e.locate(spark, "") for e in r.select()]).count() == 1
    with pytest.raises(ValueError, match="owners"):
        L.current_sources([one, one.withColumn("source_id", F.lit("2"))])


def test_stored_documents_are_checked(spark, tmp_path):
    store = L.IndexStore(spark, f"file://{tmp_path}/index")
    good = index(spark, [doc(1, "a")])
    store.write(good)
    with pytest.raises(ValueError, match="hash"):
        store.write(good.withColumn("title", F.lit("other")))
    assert store.read().first().title == "a"


def test_lock_of_a_store(spark, tmp_path):
    a, b = (L.IndexStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    with a.lock(), pytest.raises(L.Locked), b.lock():
        pass
    with b.lock():
        pass


def test_generations(spark):
    rows = index(spark, [doc(1, "orange juice"), doc(2, "jus d'orange frais", locale="fr")])
    old = D.rebuilt(rows, None, "g1")
    assert {r.locale for r in D.readiness(old["builds"]).collect()} == {"en", "fr"}
    assert [r.locale for r in D.readiness(D.invalidated(old["builds"], ["fr"])).collect()] == ["en"]
    more = index(spark, [doc(1, "orange juice"), doc(3, "melon bread"), doc(4, "pain perdu", locale="fr")])
    new = D.rebuilt(more, old, "g2", ["en"])
    assert {(r.locale, r.dictionary_generation) for r in new["builds"].collect()} == {("en", "g2"), ("fr", "g1")}
    assert {r.term for r in new["terms"].where("locale = 'fr'").collect()} == {r.term for r in old["terms"].where("locale = 'fr'").collect()}
    assert "melon" in {r.term for r in new["terms"].collect()}


def test_store_and_stream(spark, tmp_path):
    source = {"rows": index(spark, [doc(i, f"t{i}", key=f"s{i}") for i in range(4)])}
    store = L.IndexStore(spark, f"file://{tmp_path}/index")
    assert store.read() is None
    first = store.write(source["rows"])
    assert store.current() == first and store.read().count() == 4
    source["rows"] = index(spark, [doc(0, "t0", key="s0"), doc(1, "new", key="s1"), doc(9, "more", key="s9")])
    events = tmp_path / "events"
    spark.createDataFrame([("default", k, n) for n, k in enumerate(["s1", "s2", "s1", "s9", "gone"])], "partition string, source_key string, n int").coalesce(1).write.parquet(str(events))
    feed = spark.readStream.schema("partition string, source_key string, n int").parquet(str(events))
    q = W.follow(feed, store, lambda: source["rows"], lambda b: b.select("partition", "source_key"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert titles(store.read()) == [("s0", "en", "t0"), ("s1", "en", "new"), ("s3", "en", "t3"), ("s9", "en", "more")]
    assert store.current() != first


def test_dependencies(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, brand string")
    brand = lambda b: spark.createDataFrame([(b,)], "brand string")
    both = W.targets(W.dependents(brand("a"), products, "brand", "id"), W.dependents(brand("b"), products, "brand", "id"))
    assert [r.id for r in both.collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        W.targets(both, both, ceiling=2)


def test_dependencies_refuse_two_sources_of_one_key(spark):
    one = spark.createDataFrame([("p", "k", "1")], "partition string, source_key string, source_id string")
    with pytest.raises(ValueError, match="one key"):
        W.targets(one, one.withColumn("source_id", F.lit("2")))


def test_queue_holds_a_source_once(spark, tmp_path):
    q = W.JobQueue(spark, f"file://{tmp_path}/jobs")
    rows = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "a")], "partition string, source_key string")
    W.route(rows, "queue", None, q)
    W.route(rows, "queue", None, q)
    assert sorted(r.source_key for r in q.take().collect()) == ["a", "b"] and q.waiting().count() == 0 and q.take().count() == 0
    q.push(rows.where("source_key = 'a'"))
    assert [r.source_key for r in q.take().collect()] == ["a"]
    seen = []
    W.route(rows, "sync", lambda r: seen.append(r.count()))
    assert seen == [2]
    with pytest.raises(ValueError):
        W.route(rows, "queue", None)


def test_dependency_feed(spark, tmp_path):
    products = spark.createDataFrame([("p", f"k{i}", b) for i, b in enumerate("aabcd")], "partition string, source_key string, brand string")
    feed = tmp_path / "brands"
    spark.createDataFrame([("a", "c"), (None, "zz")], "old string, new string").coalesce(1).write.parquet(str(feed))
    store = W.JobQueue(spark, f"file://{tmp_path}/jobs")
    q = W.follow_dependencies(spark.readStream.schema("old string, new string").parquet(str(feed)), lambda: products, "brand", lambda t: W.route(t, "queue", None, store), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None and sorted(r.source_key for r in store.take().collect()) == ["k0", "k1", "k3"]


def test_providers():
    r = T.ProviderRegistry(fallback=lambda rows: "fallback")
    r.register("a", lambda s: s.startswith("x"), lambda rows: "a")
    r.register("b", lambda s: s == "xy", lambda rows: "b")
    assert r.documents_for("x1", None) == "a" and r.documents_for("other", None) == "fallback"
    with pytest.raises(ValueError):
        r.resolve("xy")
    with pytest.raises(LookupError):
        T.ProviderRegistry().resolve("q")


def test_status(spark):
    rows = index(spark, [doc(1, "a"), doc(2, "b", locale="fr", active=False), doc(3, "c", kind="product")])
    got = {(r.dimension, r.value): (r.total, r.active, r.inactive) for r in D.status(rows).collect()}
    assert got["all", ""] == (3, 2, 1) and got["locale", "fr"] == (1, 0, 1) and got["source_type", "product"] == (1, 1, 0)


def test_command_line(spark, tmp_path, capsys):
    tables = tmp_path / "tables"
    docs = spark.createDataFrame([(i, f"The word number {i}. More text here", "en", "s", 10) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tables}/documents.parquet")
    run = lambda *a: (cli.main([*a, "--store", f"file://{tmp_path}/store", "--tables", str(tables)]), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    assert run("status")[0] == L.EXIT_CODES["failed"] == 1
    assert run("install")[0] == 0
    assert run("reindex")[0] == L.EXIT_CODES["unconfirmed"] == 5
    assert run("reindex", "--dry-run")[1]["created"] == 14 and run("status")[0] == 1
    code, said = run("reindex", "--force")
    assert code == 0 and said["created"] == said["documents"] == 14
    assert run("reindex", "--force")[1]["unchanged"] == 14
    assert run("doctor", "--deep")[0] == 0 and run("dictionary-build", "--force")[1]["terms"] > 3
    told = run("dictionary-status")[1]["rows"]
    assert [(r["locale"], r["stale"]) for r in told] == [("en", False)] and told[0]["terms"] > 3
    assert run("dictionary-build", "--force", "--locale", "en")[0] == 0 and run("doctor")[0] == 0
    assert run("prune")[1] == {"dry_run": True, "sources": 0, "documents": 0}
    (tmp_path / "tables" / "documents.parquet").rename(tmp_path / "old")
    docs.where("doc_id > 20").write.parquet(f"{tables}/documents.parquet")
    code, said = run("prune")
    assert code == 0 and said["dry_run"] and said["sources"] > 3 and run("prune", "--execute")[0] == 5
    assert run("prune", "--execute", "--force", "--limit", "1")[0] == 1 and run("prune", "--execute", "--force")[1]["sources"] == said["sources"]
    assert run("prune")[1]["sources"] == 0 and run("prune", "--enumerator", "nothing")[0] == 1
    lock = tmp_path / "store" / "LOCK"
    lock.touch()
    assert run("reindex", "--force")[0] == L.EXIT_CODES["locked"] == 4
    lock.unlink()
    assert cli.main(["reindex", "--force", "--store", f"file://{tmp_path}/store", "--tables", str(tmp_path / "nowhere")]) == 1


def test_values_as_text(spark):
    rows = spark.sql("SELECT CAST(NULL AS STRING) AS a, true AS b, 2.0D AS c, 2.5D AS d, array('x', '', NULL, 'y') AS e, named_struct('p', 1, 'q', map('k', false)) AS f, DATE'2024-01-02' AS g, TIMESTAMP'2024-01-02 03:04:05.6' AS h")
    assert rows.select(X.searchable_value(rows, *rows.columns)).first()[0] == "1 2 2.5 x y 1 0 2024-01-02 2024-01-02T03:04:05.600000Z"
    with pytest.raises(TypeError):
        X.searchable_value(spark.sql("SELECT X'00' AS a"), "a")
