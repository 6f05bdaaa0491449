import itertools
import random

import pytest
from docs import doc, index

from lexaloom.operators import contextual as C
from lexaloom.operators import correction as K
from lexaloom.operators import dictionary as D
from lexaloom.operators import suggestion as G
from lexaloom.plans import query as Q
from lexaloom.plans.engine import SearchEngine
from lexaloom.plans.policy import Policy

ALL = Policy(spelling=True, phonetic=True, segmentation=True)


def dictionary(i, policy=ALL, ready=()):
    terms = D.terms(i, policy)
    return K.Dictionary(terms, D.delete_index(terms, policy), D.bigrams(i, policy), set(ready))


@pytest.fixture(scope="module")
def food(spark):
    titles = {"en": ["orange", "chocolate", "phone", "cream", "website page", "ice cream"], "fr": ["chocolat"], "fa": ["پرتقال", "بستنی", "غذا"]}
    rows = [doc(next(n), t, locale=loc) for n in [itertools.count(1)] for loc, ts in titles.items() for t in ts]
    i = index(spark, [*rows, doc(99, "inactive", active=False)]).cache()
    policy = Policy(spelling=True, phonetic=True, segmentation=True, term_minimum_length=3)
    return i, dictionary(i, policy), policy


@pytest.mark.parametrize("typed,locale,want", [("oragne", "en", "orange"), ("ornge", "en", "orange"), ("orannge", "en", "orange"), ("choclatex", "en", "chocolate"), ("ornagx", "en", None), ("chocloat", "fr", "chocolat"), ("oragne", "en-GB", "orange"), ("پرتفال بستنیی", "fa", "پرتقال بستنی"), ("orange", "en", None)])
def test_spelling(food, typed, locale, want):
    i, d, policy = food
    found = SearchEngine(i, d, policy).spelling_corrections(typed, locale)
    assert (found[0]["query"] if found else None) == want
    if locale == "en-GB":
        assert found[0]["locale"] == "en"


@pytest.mark.parametrize("typed,locale,kind,want", [("بصطنی", "fa", "phonetic", "بستنی"), ("قذا", "fa", "phonetic", "غذا"), ("fone", "en-GB", "phonetic", "phone"), ("icecream", "en", "split", "ice cream"), ("web site", "en", "merge", "website")])
def test_advanced(food, typed, locale, kind, want):
    i, d, policy = food
    found = SearchEngine(i, d, policy).advanced_corrections(typed, locale)
    assert (found[0]["kind"], found[0]["query"]) == (kind, want)


def test_advanced_keeps_quiet(food):
    i, d, policy = food
    e = SearchEngine(i, d, policy)
    assert not e.advanced_corrections("orange", "en") and not e.advanced_corrections("x@fone.com", "en") and not e.advanced_corrections("fone", "de")


def test_variants_in_order(food):
    i, d, policy = food
    found = SearchEngine(i, d, policy).expand("oragne", "en")
    assert [v.source for v in found[:3]] == ["original", "keyboard", "spelling"] and found[2].query == "orange" and found[2].parent == found[0].fingerprint
    with_rules = Policy(synonyms={"en": {"car": ["automobile", "motor car"]}})
    made = [v.query for v in Q.expand(Q.process("red car", "en"), with_rules).items if v.source == "synonym"]
    assert made == ["red automobile", "red motor car"]


def test_batch_equals_driver(spark, food):
    i, d, policy = food
    texts = ["oragne", "ornge choclate", "orange", "zzzz"]
    queries = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "query_id long, locale string, query string")
    batch = K.spelling_batch(queries, d.terms, d.deletes, policy).collect()
    for k, t in enumerate(texts):
        one = SearchEngine(i, d, policy).spelling_corrections(t, "en")
        assert [r.corrected for r in sorted(batch, key=lambda r: r.place) if r.query_id == k] == [s["query"] for s in one]


def test_beam_prunes_step_by_step():
    rng = random.Random(3)
    options = {at: [{"at": at, "term": f"{'abcde'[k]}{at}", "locale": "en", "cost": rng.choice([450, 700, 1000]), "edits": 1, "document_frequency": rng.randint(1, 9)} for k in range(5)] for at in range(4)}
    states = K.spelling_beam(list("wxyz"), options)
    assert 0 < len(states) <= 20 and all(1 <= len(s["fixed"]) <= 2 for s in states)
    assert [s["cost"] for s in states if s["open"] == states[0]["open"]] == sorted(s["cost"] for s in states if s["open"] == states[0]["open"])


def test_collection_rules():
    v = lambda q, s, p, f, parent="o": K.Variant(q, "en", (q,), s, p, f, parent)
    c = K.Variants(3, [v("a", "original", 1000, "o", None)])
    assert c.add(v("b", "synonym", 600, "1")) and not c.add(v("a", "spelling", 700, "2")) and not c.add(v("b", "contextual", 500, "3"))
    assert c.add(v("b", "spelling", 700, "4")) and [x.fingerprint for x in c.items] == ["o", "4"]
    assert c.add(v("c", "keyboard_synonym", 400, "5")) and c.full and not c.add(v("d", "keyboard", 800, "6"))
    assert c.add_over_weaker(v("d", "contextual", 500, "7")) and [x.query for x in c.items] == ["a", "b", "d"]
    assert not c.add_over_weaker(v("e", "keyboard_synonym", 400, "8"))


def test_terms_and_limits(spark):
    i = index(spark, [doc(1, "Orange juice", content="orange orange pie"), doc(2, "tea", keywords="orange"), doc(3, "orange", active=False)])
    rows = {r.term: r for r in D.terms(i, Policy()).collect()}
    o = rows["orange"]
    assert (o.document_frequency, o.title_frequency, o.keyword_frequency, o.content_frequency) == (2, 1, 1, 1) and "tea" not in rows
    with pytest.raises(ValueError, match="more than"):
        D.terms(i, Policy(maximum_dictionary_terms=1))
    kept = D.terms(i, Policy(minimum_document_frequency=2, protected={"*": ["juice"]})).collect()
    assert {(r.term, r.is_protected) for r in kept} == {("orange", False), ("juice", True)}


def test_readiness(spark):
    builds = spark.createDataFrame([("a", "1", "1", "t"), ("b", "1", "2", "t"), ("c", "1", None, "t"), ("d", "", "", "t"), ("e", "1", "1", None)], "locale string, dictionary_generation string, ngram_generation string, ngram_indexed_at string")
    assert [r.locale for r in D.readiness(builds).collect()] == ["a"]


def contextual(spark, direct):
    rows = [doc(i, "message from home") for i in range(6)] + [doc(50 + i, "message form home") for i in range(direct)] + [doc(90, "form", kind="reference")]
    i = index(spark, rows)
    policy = Policy(contextual=True, keyboard=False)
    return SearchEngine(i, dictionary(i, policy, {"en"}), policy)


def test_contextual(spark):
    e = contextual(spark, 0)
    out = e.query("message form home").locale("en").source_types("page").results()
    v = next(v for v in out.variants if v.source == "contextual")
    assert v.query == "message from home" and out.suggestion["source"] == "contextual"
    busy = contextual(spark, 7).query("message form home").locale("en").results()
    assert all(v.source != "contextual" for v in busy.variants)


def test_confidence_arithmetic():
    parent = K.Variant("a b", "en", ("a", "b"), "original", 1000, "f")
    c = C.Candidate(parent, "a c", "en", ("a", "c"), (1,), 700, 100, 900, "x")
    e = C.Evidence(True, True, 100, 900)
    assert C.confidence(c, e, 0, 4) == min(10000, 2150 + 2350 + 1900 + 3000 + 1000)
    assert C.confidence(c, C.Evidence(False, False, 0, 0), None, None) == 2150 + 2350 + 1000 + 1500
    assert C.pairs(("a", "b", "c"), (0,)) == ["a b"]


def variant(f, source="spelling", query="q2", priority=700, parent="o"):
    return K.Variant(query, "en", (query,), source, priority, f, parent)


FIRST = variant("o", "original", "q", 1000, None)


@pytest.mark.parametrize("results,reason,ratio", [({"s": (1, 3)}, "original_had_no_results", 0), ({"original": (1, 11), "s": (1, 2)}, "better_semantic_tier", 10000), ({"original": (1, 2), "s": (3, 2)}, "material_result_gain", 30000), ({"original": (1, 2), "s": (1, 2)}, None, 0), ({"original": (2, 2), "s": (3, 2)}, None, 0)])
def test_suggestions(results, reason, ratio):
    got = G.suggest([FIRST, variant("s")], results, True)
    assert (got and got["reason"]) == reason and (not got or got["ratio"] == ratio)
    assert G.suggest([FIRST, variant("s")], results, False) is None


def test_families():
    chain = [FIRST, variant("s"), variant("y", "synonym", "q3", 600, "s"), variant("z", "synonym", "q4", 600, "o")]
    assert G.families(chain) == {"o": "original", "s": "s", "y": "s", "z": "original"}
    with pytest.raises(ValueError, match="missing"):
        G.families([FIRST, variant("y", "synonym", parent="gone")])
    with pytest.raises(ValueError, match="cycle"):
        G.families([variant("y", "synonym", parent="z"), variant("z", "synonym", parent="y")])


def test_suggestion_end_to_end(food):
    i, d, policy = food
    out = SearchEngine(i, d, policy).query("oragne").locale("en").results()
    assert out.suggestion["query"] == "orange" and out.suggestion["reason"] == "original_had_no_results" and out.total == 1
