import random

from pyspark.sql import functions as F

from lexaloom.llm import near_join as N
from lexaloom.llm.decontaminate import words_of


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    docs = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(30, 200))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    base = [word() for _ in range(150)]  # one hot group of different texts
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(150)] = word()
        docs.append(" ".join(copy))
    rows = list(enumerate(docs))
    return rows + [(9000, None), (9001, ""), (9002, "?!"), (9003, "one"), (9004, "One!"), (None, docs[0]), (5, docs[5]), (9005, "w " * 50_000)]


def brute(rows, n=5, threshold=0.4):
    sets = {}
    for _, t in rows:
        w = tuple(words_of((t or "").encode()))
        if w:
            sets[w] = {w[i : i + n] for i in range(max(1, len(w) - n + 1))}
    return sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


def check(spark, **options):
    rows = corpus(4)
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, uid int, label string").repartition(3)
    got = N.join(df, **options).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    sets, links = brute(rows)
    where = {tuple(words_of((t or "").encode())): of[k][0].class_id for k, t in rows if t}
    assert sum(where[a] == where[b] for a, b in links) >= 0.98 * len(links)
    assert sum(r.n_links for r in {r.digest: r for r in got}.values()) >= 0.9 * 2 * len(links)
    assert of[9003][0].class_id == of[9004][0].class_id == 9003
    for k in (9000, 9001, 9002, 9005):
        assert [(r.class_id, r.n_links, r.keeper) for r in of[k]] == [(k, 0, True)]
    strangers = [(x, y) for x in list(where)[:40] for y in list(where)[:40] if x < y and len(sets[x] & sets[y]) < 0.15 * len(sets[x] | sets[y])]
    linked = {frozenset(p) for p in links}
    assert not [1 for p in strangers if where[p[0]] == where[p[1]] and frozenset(p) not in linked and of[where[p[0]]][0].n_links == 0]
    keepers = [r for r in got if r.keeper]
    assert len(keepers) == len({r.class_id for r in got})
    kept = N.representatives(df, **options)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in keepers)


def test_against_brute_force(spark):
    check(spark)


def test_large_nodes(spark):
    check(spark, small=4, deepest=4, block=16)


def test_far_from_the_pivot(spark):
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = N.signatures(df, id_col="doc_id", text_col="text", ngram=5)
    judged = N._judged(table.selectExpr("1L AS node", "uid"), table, 52)
    far = judged.where("not near").groupBy("node").agg(F.count("*").alias("m"))
    near = judged.where("near and uid <> pivot").selectExpr("pivot AS a", "uid AS b")
    edges = near.unionByName(N._far_edges(judged, far, table, 16)(52))
    assert N.components(edges).select("label").distinct().count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.query(df).collect() == [] and N.representatives(df).count() == 0


def test_recall_follows_the_runs():
    assert N.runs_for(0.4, 0.98) == 10 and N.recall_of_run(0.9) > 0.95


def near_threshold(seed, shared, words=204):
    """Pairs of texts of 5-gram sets that share the given numbers of their 200 n-grams; the first pair has ids 0 and 1."""
    rng = random.Random(seed)
    rows = []
    for n in shared:
        a, b = ([f"w{rng.random()}".replace(".", "") for _ in range(words)] for _ in range(2))
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(a[: n + 4] + b[n + 4 :]))]
    return rows


def test_links_are_decided_on_the_exact_sets(spark):
    shared = [*range(100, 130)] * 8  # Jaccard 0.33 to 0.48; 115 of 285 is the first that reaches 0.4
    rows = near_threshold(8, shared)
    got = {r.doc_id: r for r in N.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[2 * i].n_links == got[2 * i + 1].n_links == 1 and got[2 * i].class_id == got[2 * i + 1].class_id for i in range(len(shared))]
    assert not [n for n, f in zip(shared, found) if f and n / (400 - n) < 0.4]
    wanted = [f for n, f in zip(shared, found) if n / (400 - n) >= 0.4]
    assert sum(wanted) >= 0.97 * len(wanted)
    assert all(got[k].class_id == k and got[k].n_links == 0 for i, f in enumerate(found) if not f for k in (2 * i, 2 * i + 1))


def test_hot_passage_loses_no_links(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.random()}".replace(".", "")
    passage, rows = [word() for _ in range(54)], []  # 50 of 200 n-grams are in all texts: Jaccard 0.14, and 0.4 to 0.5 within a pair
    for i in range(100):
        own = [word() for _ in range(150)]
        keep = 65 + i % 20
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:keep] + [word() for _ in range(150 - keep)]))]
    # all texts meet in one node, by the passage, and nowhere else
    monkeypatch.setattr(N, "_walk", lambda sets, runs: sets.select(F.lit(1).cast("long").alias("node"), "uid"))
    got = {r.doc_id: r for r in N.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, links = brute(rows)
    assert len(links) == 100
    assert sum(got[2 * i].n_links == got[2 * i + 1].n_links == 1 and got[2 * i + 1].class_id == 2 * i for i in range(100)) >= 98


def test_links_count_texts(spark):
    base = " ".join(f"word{i}" for i in range(60))
    family = [base, base.upper(), base.replace(" ", ", "), base + "."]  # the same words
    rows = list(enumerate([*family, base, base + " more", "One!", "one", "alone"]))
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(5), (0, 4)), 5: (0, 4), 6: (6, 1), 7: (6, 1), 8: (8, 0)}
