import random

import pytest
from docs import F, doc, ids, index

from lexaloom.functions import edit as E
from lexaloom.operators import search as S
from lexaloom.plans import query as Q
from lexaloom.plans.engine import Contracts, SearchEngine, batch_search
from lexaloom.plans.policy import Policy

TIERS = {"orange juice": "exact_title", "orange juice drink": "title_prefix", "fresh orange juice drink": "title_phrase", "juice from orange": "title_all_tokens", "fresh orange": "title_any_token"}


def test_tiers(spark):
    rows = [doc(i, t) for i, t in enumerate(TIERS)]
    rows += [doc(10 + 3 * k + i, "other", **{f: t}) for k, f in enumerate(("keywords", "excerpt", "content")) for i, t in enumerate(("fresh orange juice drink", "juice from orange", "fresh orange"))]
    out = SearchEngine(index(spark, rows)).query("orange juice").locale("en").without_expansion().results()
    got = {r.id: (r.tier, r.coverage) for r in out.rows.collect()}
    assert [got[i][0] for i in range(5)] == list(TIERS.values()) and got[4][1] == 5000
    for k, f in enumerate(("keywords", "excerpt", "content")):
        assert [got[10 + 3 * k + i][0] for i in range(3)] == [f"{f}_phrase", f"{f}_all_tokens", f"{f}_any_token"]
    assert ids(out.rows) == [0, 1, 2, 3, 4, *range(10, 19)]


def test_coverage_and_first_field_wins(spark):
    rows = [doc(1, "گلدان زیبا", locale="fa", content="یک گل زیبا"), doc(2, "x", locale="en", content="orange orange fruit"), doc(3, "orange tree", content="orange fruit juice")]
    e = SearchEngine(index(spark, rows))
    assert e.query("گل").locale("fa").without_expansion().results().rows.first().tier == "content_phrase"
    r = {x.id: x for x in e.query("orange orange fruit juice").locale("en").without_expansion().results().rows.collect()}
    assert (r[2].matched, r[2].coverage) == (2, 6666) and r[3].tier == "title_any_token"


@pytest.mark.parametrize("text", ["100%", "file_name", "wow!", "folder\\file", "it's", 'say "yes"', "value -- safe", "value /* safe */"])
def test_literals(spark, text):
    rows = [doc(1, text), doc(2, "1000 filexname wow foldersfile its say yes value safe")]
    i = index(spark, rows)
    one = S.matches(i, SearchEngine(i).index.sparkSession.createDataFrame([(0, 0, text, "en", [], "original", 1000, "f", None)], S.VARIANT_SCHEMA))
    assert [r.id for r in one.collect()] == [1]


def model(hits, per_variant, cap):
    """The sequential retrieval loop: hits is a list of id lists by variant."""
    have, evidence, reasons, executed = [], set(), set(), 0
    for v, found in enumerate(hits):
        if len(have) >= cap:
            reasons |= {"global_candidate_limit", "unexecuted_variants"}
            break
        executed += 1
        if len(found) > per_variant:
            reasons.add("per_variant_limit")
        for i in sorted(found)[:per_variant]:
            if i in have or len(have) < cap:
                have += [i] * (i not in have)
                evidence.add((v, i))
        if len(have) >= cap:
            reasons |= {"global_candidate_limit"} | ({"unexecuted_variants"} if v < len(hits) - 1 else set())
    return evidence, reasons, executed


def test_limits_equal_the_loop(spark):
    rng = random.Random(5)
    for _ in range(4):
        words = [f"w{v}x" for v in range(4)]
        text = {i: " ".join(w for w in words if rng.random() < 0.5) for i in range(30)}
        i = index(spark, [doc(k, t) for k, t in text.items()])
        variants = spark.createDataFrame([(0, v, w, "en", [w], "spelling", 9 - v, f"f{v}", None) for v, w in enumerate(words)], S.VARIANT_SCHEMA)
        per, cap = rng.choice([5, 12, 40]), rng.choice([8, 20, 100])
        got, told = S.retrieve(i, variants, policy=Policy(per_variant_limit=per, maximum_candidates=cap))
        evidence, reasons, executed = model([[k for k, t in text.items() if w in t.split()] for w in words], per, cap)
        assert {(r.variant, r.id) for r in got.collect()} == evidence
        r = told.first()
        assert set(r.reasons) == reasons and r.executed == executed


def test_order_of_ties(spark):
    rows = [doc(1, "Orange tea", priority=1), doc(2, "Orange tea", priority=5), doc(3, "Orange a", priority=1, key="b"), doc(4, "Orange a", priority=1, key="a"), doc(5, "Orange a", priority=1, key="a", partition="b")]
    out = SearchEngine(index(spark, rows)).query("orange").locale("en").without_expansion().results()
    assert ids(out.rows) == [2, 4, 3, 1]


def shaped(spark):
    kinds = ["product", "page", "product", "article", "page"]
    return SearchEngine(index(spark, [doc(i, "Orange", kind=k, priority=50 - 10 * i) for i, k in enumerate(kinds)]))


def test_shapes(spark):
    e = shaped(spark)
    q = e.query("orange").locale("en").without_expansion().facets("source_type")
    p = q.paginate(2, 2)
    assert p.meta == {"total": 5, "exact": True, "page": 2, "per_page": 2, "last_page": 3, "has_next": True, "from": 3, "to": 4} and ids(p.rows) == [2, 3]
    assert [(r.value, r.n) for r in p.facets.collect()] == [("page", 2), ("product", 2), ("article", 1)]
    g = q.group_by_source_type(1).rows.collect()
    assert [(r.source_type, r.group_count, r.id) for r in g] == [("product", 2, 0), ("page", 2, 1), ("article", 1, 3)]
    assert ids(q.preview(4, 1).rows) == [0, 1, 2, 3]
    assert ids(q.source_types("page").results().rows) == [1, 4] and ids(q.limit(2).offset(1).results().rows) == [1, 2]
    for bad in (lambda: q.paginate(0), lambda: q.limit(0), lambda: q.offset(-1), lambda: q.facets("x")):
        with pytest.raises(ValueError):
            bad()
    empty = e.query("--").results()
    assert empty.status == "punctuation_only" and empty.rows is None and empty.exact


def test_preview_equals_two_passes(spark):
    rng = random.Random(2)
    for _ in range(4):
        kinds = [rng.choice("abc") for _ in range(12)]
        frame = spark.createDataFrame([(0, i + 1, i, k) for i, k in enumerate(kinds)], "query_id long, place int, id long, source_type string")
        limit, per = rng.randint(1, 8), rng.randint(1, 3)
        chosen, n = [], {}
        for i, k in enumerate(kinds):
            if len(chosen) < limit and n.get(k, 0) < per:
                chosen.append(i)
                n[k] = n.get(k, 0) + 1
        chosen += [i for i in range(12) if i not in chosen][: limit - len(chosen)]
        assert ids(S.preview(frame, limit, per)) == sorted(chosen)


def test_bridge(spark):
    rows = [doc(1, "پرتقال", locale="fa", key="p:1"), doc(2, "Orange", locale="en", key="p:1"), doc(3, "پرتقال تازه", locale="fa", key="p:2")]
    out = SearchEngine(index(spark, rows)).query("\\vjrhg").locale("en").results()
    got = {r.id: (r.presented_id, r.bridge_status) for r in out.rows.collect()}
    assert got == {1: (2, "bridged"), 3: (3, "counterpart_missing")}
    bad = index(spark, [*rows, doc(4, "Orange 2", locale="en", key="p:1")])
    with pytest.raises(Exception, match="several counterparts"):
        SearchEngine(bad).query("\\vjrhg").locale("en").results().rows.collect()


def test_batch_equals_single(spark):
    rows = [doc(i, t) for i, t in enumerate(["red tea", "tea cup", "red cup", "green tea cup"])]
    i = index(spark, rows)
    queries = spark.createDataFrame([(1, "Red  tea", "en"), (2, "cup", "en"), (3, "?", "en"), (4, None, "en")], "query_id long, text string, locale string")
    batch = batch_search(i, queries, partition="default").collect()
    for q, text in ((1, "Red  tea"), (2, "cup")):
        one = SearchEngine(i).query(text).locale("en").without_expansion().results().rows.collect()
        assert sorted((r.place, r.id, r.tier) for r in batch if r.query_id == q) == [(r.place, r.id, r.tier) for r in one]
    assert {r.query_id for r in batch} == {1, 2}


def test_bridge_checks_the_source_and_says_disabled(spark):
    rows = [doc(1, "پرتقال", locale="fa", key="p:1", source_id="1"), doc(2, "Orange", locale="en", key="p:1", source_id="2")]
    with pytest.raises(Exception, match="another source"):
        SearchEngine(index(spark, rows)).query("\\vjrhg").locale("en").results().rows.collect()
    off = SearchEngine(index(spark, [*rows, doc(3, "پرتقال خوب", locale="en")]), policy=Policy(bridge=False)).query("\\vjrhg").locale("en").results()
    assert {r.id: (r.presented_id, r.bridge_status) for r in off.rows.collect()} == {1: (1, "disabled")}


def test_hydration_goes_by_type_connection_and_id(spark):
    shown = index(spark, [doc(1, "a", source_id="7"), doc(2, "b", kind="product", source_id="7"), doc(3, "c", source_id=None)])
    sources = spark.createDataFrame([("page", None, "7", "page seven"), ("product", None, "7", "product seven"), ("page", "other", "7", "no")], "source_type string, source_connection string, source_id string, name string")
    assert {r.id: r.name for r in S.hydrate(shown, sources).collect()} == {1: "page seven", 2: "product seven", 3: None}


def test_stages_can_be_replaced(spark):
    i = index(spark, [doc(1, "alpha beta"), doc(2, "beta")])
    text = Q.TextPipeline(sanitize=lambda t: t.replace("#", " "), tokenize=lambda t: t.split("-"))
    seen = []

    def matches(index, variants, **more):
        seen.append([r.query for r in variants.collect()])
        return S.matches(index, variants, **more)

    by = Contracts(text=text, matches=matches, bridge=lambda ranked, index, locale, policy: ranked.where("id = 2").withColumn("presented_id", F.col("id")), suggest=lambda *a: {"source": "mine"}, correctors=Q.Correctors(synonyms=lambda v, rules: [("alpha",)]))
    e = SearchEngine(i, policy=Policy(keyboard=False, synonyms={"en": {"a": ["b"]}}), contracts=by)
    assert e.tokens("X#y-z") == ["x y", "z"] and e.prepare_text("A#-b")["normalized"] == "a -b"
    out = e.query("beta").locale("en").results()
    assert ids(out.rows) == [2] and seen == [["beta", "alpha"]] and out.suggestion == {"source": "mine"}


def test_language_profiles_can_be_added():
    E.register_profile("eo", lambda t: iter([(t.replace("c", "ĉ"), 500, "c>ĉ")]))
    try:
        assert list(E.sound_alternatives("cu", "eo")) == [("ĉu", 500, "c>ĉ")] and list(E.sound_alternatives("cu", "xx")) == []
    finally:
        del E.PROFILES["eo"], E.SEPARATOR["eo"]


def test_many_distances_equal_one_by_one():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("qwaéoprsپچ") for _ in range(rng.randint(0, 12)))
    pairs = [(word(), word(), rng.choice(["en", "fa", "fa-IR", "fr"])) for _ in range(3000)]
    edits, cost = E.distances(*map(list, zip(*pairs)))
    assert [*zip(edits.tolist(), cost.tolist())] == [E.distance(*p) for p in pairs]


def test_page_table_equals_the_numbers_of_one_query(spark):
    window = spark.createDataFrame([(q, p) for q, n in ((0, 47), (1, 3)) for p in range(n)], "query_id long, place int")
    told = spark.createDataFrame([(0, ["per_variant_limit"]), (1, []), (2, [])], "query_id long, reasons array<string>")
    got = {r.query_id: r for r in S.page_table(window, told, 1, 15).collect()}
    for q, n in ((0, 47), (1, 3), (2, 0)):
        m = S.page_metadata(n, q > 0, 1, 15, q == 0)
        assert (got[q].total, got[q].exact, got[q].last_page, got[q].has_next, got[q].first, got[q].last) == tuple(m[k] for k in ("total", "exact", "last_page", "has_next", "from", "to"))
    with pytest.raises(Exception, match="cut result window"):
        S.page_table(window, told, 9, 15).collect()


def test_many_terms_are_joined_by_parts(spark, monkeypatch):
    i = index(spark, [doc(k, f"word{k % 7} other{k % 3}") for k in range(60)])
    variants = spark.createDataFrame([(0, v, f"word{v}", "en", [f"word{v}", f"other{v}"], "original", 1, f"f{v}", None) for v in range(4)], S.VARIANT_SCHEMA)
    want = sorted(map(str, S.matches(i, variants).collect()))
    monkeypatch.setattr(S, "BROADCAST_TERMS", 3)
    assert sorted(map(str, S.matches(i, variants).collect())) == want and want
