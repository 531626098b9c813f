"""Golden examples of the operators, and properties."""

from math import inf

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import bayes, cluster, evaluate, fuzzy, hmm, index, lsi, postings, search, triples, vsm

MOVIES = ["Movie 1 Animated movie.", "Movie 2 Non-animated film.", "Movie 3 Short animation.", "Movie 4 Short animated short film."]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def lists(spark, *found):
    return [spark.createDataFrame(x, "doc_id long, score long") for x in found]


def test_boolean(spark):
    d = docs(spark, ["First document", "Second document", "Third document"])
    assert rows(search.boolean_and(d, {"a": "document", "b": "document third", "c": "", "d": "nothing document"}), "query", "doc_id") == [("a", 1), ("a", 2), ("a", 3), ("b", 3)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert rows(postings.intersect_ids([ids(1, 3, 4, 6, 7), ids(2, 4, 5, 7, 10), ids(3, 4, 6, 8, 10)]), "doc_id") == [(4,)]
    assert rows(postings.intersect_ids([ids(1, 1, 3), ids(1, 3, 3)]), "doc_id") == [(1,), (1,), (3,)]
    assert rows(postings.intersect_ids([ids(1, 5, 7), ids(2, 4)]), "doc_id") == []


def scores(spark, **options):
    found = index.postings(docs(spark, MOVIES), **options).select("term", "doc_id", F.round("score", 3).alias("s")).collect()
    out = {}
    for r in sorted(found):
        out.setdefault(r["term"], {})[r["doc_id"]] = r["s"]
    return out


def test_scores(spark):
    got = scores(spark, b=0.0, k=inf)
    assert got["animated"] == {1: 0.415, 2: 0.415, 4: 0.415} and got["short"] == {3: 1.0, 4: 2.0} and set(got["movie"].values()) == {0.0}
    got = scores(spark, b=0.75, k=1.75)
    assert got == {"animated": {1: 0.459, 2: 0.402, 4: 0.358}, "animation": {3: 2.211}, "film": {2: 0.969, 4: 0.863}, "movie": {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}, "non": {2: 1.938}, "short": {3: 1.106, 4: 1.313}}
    with pytest.raises(ValueError):
        scores(spark, kind="other")


def test_dictionary_and_ranking(spark):
    d = docs(spark, MOVIES)
    terms = [t for _, t in rows(index.dictionary(index.tokens(index.measured(d))), "term_id", "term")]
    assert terms == ["movie", "animated", "non", "film", "short", "animation"]
    got = search.top(search.search(d, {"a": "movie short", "b": "non animated film"}))
    assert [r[2] for r in rows(got, "query", "rank", "doc_id")] == [4, 3, 2, 1, 2, 4, 1]
    assert rows(search.search(d, {"a": "Movie"}, case_fold=False), "doc_id") == []


def test_ranked_sums_and_union(spark):
    p = spark.createDataFrame([("foo", 1, 0.2), ("foo", 3, 0.6), ("bar", 1, 0.4), ("bar", 2, 0.7), ("bar", 3, 0.5), ("baz", 2, 0.1)], "term string, doc_id long, score double")
    asked, _ = search.query_terms(spark, {"q": "foo bar"})
    assert [(i, s) for _, i, s in rows(search.top(search.ranked(p, asked)), "rank", "doc_id", "score")] == [(3, 1.1), (2, 0.7), (1, 0.6)]
    a, b = (spark.createDataFrame(x, "doc_id long, score double") for x in ([(1, 1.0)], [(2, 1.0), (3, 1.0), (4, 1.0)]))
    assert rows(postings.union([a, b]), "doc_id") == [(1,), (2,), (3,), (4,)]
    twice, _ = search.query_terms(spark, {"q": "foo bar foo bar"})
    p = spark.createDataFrame([("foo", 1, 0.2), ("foo", 3, 0.6), ("bar", 2, 0.4), ("bar", 3, 0.1), ("bar", 4, 0.8)], "term string, doc_id long, v double")
    assert [(i, round(s, 6)) for _, i, s in rows(search.top(vsm.query(p, twice)), "rank", "doc_id", "score")] == [(4, 1.6), (3, 1.4), (2, 0.8), (1, 0.4)]


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index.save(index.postings(docs(spark, MOVIES)), path)
    found = search.search_stored(spark.read.parquet(path), {"a": "movie short", "b": ""})
    assert [i for _, i in rows(search.top(found), "rank", "doc_id")] == [4, 3, 2, 1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [movie,short])" in plan, plan


def test_evaluation(spark):
    d = docs(spark, ["Movie\tAnimated movie.", "Movie\tNon-animated film.", "Movie\tShort animation.", "Movie\tShort animated short film."])
    qrels = spark.createDataFrame([("animated film", i) for i in (1, 3, 4)] + [("short film", 3), ("short film", 4)], "query string, doc_id long")
    results = search.search(d, {q: q for q in ("animated film", "short film")}, k=1.25)
    found = evaluate.means(evaluate.evaluate(results, qrels)).first()
    assert [round(x, 3) for x in found] == [0.667, 0.833, 0.694]


def test_measures_of_a_list(spark):
    def of(results, relevant, k):
        scored = spark.createDataFrame([("q", i, float(len(results) - n)) for n, i in enumerate(results)], "query string, doc_id long, score double")
        return evaluate.evaluate(scored, spark.createDataFrame([("q", i) for i in relevant], "query string, doc_id long"), k).first()

    assert [of([5, 3, 6, 1, 2], [1, 2, 5, 6, 7, 8], k)["p_at_k"] for k in (2, 4, 0)] == [0.5, 0.75, 0.0]
    assert of([], [1], 3)["p_at_k"] == 0 and of([], [1], 3)["ap"] == 0
    assert round(of([7, 17, 9, 42, 5], [5, 7, 12, 42], 3)["ap"], 3) == 0.525


def test_posting_lists(spark):
    one, two, three = lists(spark, [(2, 5), (3, 1), (6, 2)], [(1, 1), (2, 4), (4, 3), (6, 3)], [(5, 1), (7, 2)])
    long, short = lists(spark, [(i, 1) for i in range(1, 101)], [(5, 1), (90, 1), (95, 1)])
    empty = one.where("false")
    for s in postings.STRATEGIES:
        assert rows(postings.intersect(one, two, s), "doc_id", "score") == [(2, 9), (6, 5)]
        assert rows(postings.intersect(one, three, s), "doc_id") == [] and rows(postings.intersect(one, empty, s), "doc_id") == []
        assert rows(postings.intersect(short, long, s), "doc_id") == [(5,), (90,), (95,)]
    assert rows(postings.intersect_all([one, two]), "doc_id", "score") == [(2, 9), (6, 5)]
    pairs = postings.intersect(one, two).agg(F.sort_array(F.collect_list(F.struct("doc_id", "score"))).alias("l"))
    assert pairs.select(T.posting_string(F.col("l"))).first()[0] == "[(2, 9), (6, 5)]"
    ids = [spark.createDataFrame([(i,) for i in x], "word_id long") for x in ([1, 1, 3, 5], [2, 3, 3, 9, 9])]
    assert rows(postings.counted_union(ids), "word_id", "cnt") == [(1, 2), (2, 1), (3, 3), (5, 1), (9, 2)]


def test_gaps_and_codes(spark):
    p = spark.createDataFrame([("a", i) for i in (3, 5, 200_000, 200_001)] + [("b", 7)], "term string, doc_id long")
    assert rows(postings.gaps(p, 64), "term", "doc_id", "gap") == [("a", 3, 3), ("a", 5, 2), ("a", 200_000, 199_995), ("a", 200_001, 1), ("b", 7, 7)]
    n = spark.createDataFrame([(i,) for i in (1, 2, 5, 127, 128)], "n long")
    assert [tuple(r) for r in n.select(T.gamma_bits(F.col("n")), T.delta_bits(F.col("n")), T.vbyte_bits(F.col("n"))).collect()] == [(1, 1, 8), (3, 4, 8), (5, 5, 8), (13, 11, 8), (15, 14, 16)]
    assert n.select(T.golomb_bits(F.col("n"), F.lit(0.1))).first()[0] == 1 + 3


ENTITIES = [(1, "frei", 3, "a word"), (2, "brei", 2, "another word")]


def test_fuzzy(spark):
    e = spark.createDataFrame(ENTITIES, "word_id long, name string, score long, description string")
    got = {}
    for g, i in rows(fuzzy.qgram_index(e), "qgram", "word_id"):
        got.setdefault(g, []).append(i)
    assert got == {"$$b": [2], "$$f": [1], "$br": [2], "$fr": [1], "bre": [2], "ei$": [1, 2], "fre": [1], "i$$": [1, 2], "rei": [1, 2]}
    assert "ei$" not in {r[0] for r in rows(fuzzy.qgram_index(e, pad="left"), "qgram")}
    one = spark.createDataFrame([("Frei, burg !!", "freiburg")], "a string, b string")
    assert one.select(T.normal(F.col("a"))).first()[0] == "freiburg"
    assert one.select(T.qgrams(F.col("b"))).first()[0] == "$$f $fr fre rei eib ibu bur urg rg$ g$$".split()
    peds = [("frei", "frei", 0, 0), ("frei", "freiburg", 0, 0), ("frei", "breifurg", 1, 1), ("freiburg", "stuttgart", 2, 3), ("", "abc", 1, 0), ("abc", "", 1, 2)]
    p = spark.createDataFrame(peds, "x string, y string, d int, want int")
    assert [r[0] == r[1] for r in p.select("want", T.prefix_edit_distance(F.col("x"), F.col("y"), F.col("d"))).collect()] == [True] * 6
    for raw in (False, True):
        for x, delta, want, n in (("frei", 0, [("frei", 0)], 1), ("frei", 2, [("frei", 0), ("brei", 1)], 2), ("freibu", 2, [("frei", 2)], 2)):
            asked = spark.createDataFrame([(x, delta)], "x string, delta int")
            found = fuzzy.matches(e, asked, raw_length=raw).orderBy(*fuzzy.rank_order())
            assert [(r["name"], r["ped"]) for r in found.collect()] == want
            assert fuzzy.checked(e, asked, raw_length=raw).count() == n
    order = spark.createDataFrame([("foo", 3, 2, 1), ("bar", 7, 0, 2), ("baz", 2, 1, 3), ("boo", 5, 1, 4)], "name string, score long, ped int, word_id long")
    assert [r["name"] for r in order.orderBy(*fuzzy.rank_order()).collect()] == ["bar", "boo", "baz", "foo"]


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=9), st.integers(0, 3)), min_size=20, max_size=40))
def test_prefix_distance_is_the_least_over_prefixes(spark, cases):
    p = spark.createDataFrame(cases, "x string, y string, d int")
    for r in p.select("x", "y", "d", T.prefix_edit_distance(F.col("x"), F.col("y"), F.col("d")).alias("ped")).collect():
        best = min(distance(r["x"], r["y"][:j]) for j in range(len(r["y"]) + 1))
        assert r["ped"] == (0 if not r["x"] else min(best, r["d"] + 1))


def test_vector_space(spark):
    matrix = index.postings(docs(spark, MOVIES), "bm25", 0.75, 1.75)
    got = {(t, i): round(v, 3) for t, i, v in rows(vsm.normalised(matrix, "col_l2"), "term", "doc_id", "v")}
    assert got == {("animated", 1): 1.0, ("animated", 2): 0.182, ("animated", 4): 0.222, ("non", 2): 0.879, ("film", 2): 0.44, ("film", 4): 0.535, ("short", 3): 0.447, ("short", 4): 0.815, ("animation", 3): 0.894}
    for norm, side in (("col_l1", 1), ("row_l1", 0), ("col_l2", 1), ("row_l2", 0)):
        sums = {}
        for r in rows(vsm.normalised(matrix, norm), "term", "doc_id", "v"):
            sums[r[side]] = sums.get(r[side], 0) + (abs(r[2]) if norm.endswith("1") else r[2] ** 2)
        assert all(abs(x - 1) < 1e-9 for x in sums.values())


def test_naive_bayes(spark):
    train = spark.createDataFrame([(0, "A", "a b a"), (1, "A", "b a a b a a a"), (2, "B", "b b a a b b a b"), (3, "A", "a b b a a"), (4, "B", "a b b b"), (5, "B", "b b b a a b")], "doc_id long, class string, text string")
    test = spark.createDataFrame([(0, "A", "b a a a a a a"), (1, "B", "a b b b b b b"), (2, "B", "a a a b")], "doc_id long, class string, text string")
    classes, model = bayes.train(train)
    assert {r["class"]: r["p_c"] for r in bayes.priors(train).collect()} == {"A": 0.5, "B": 0.5}
    assert {(c, w): round(p, 3) for c, w, p in rows(bayes.likelihood(classes, model), "class", "word", "p_wc")} == {("A", "a"): 0.664, ("A", "b"): 0.336, ("B", "a"): 0.335, ("B", "b"): 0.665}
    said = bayes.predict(test, classes, model)
    assert [c for _, c in rows(said, "doc_id", "class")] == ["A", "B", "A"]
    assert [c for _, c in rows(bayes.predict(train, classes, model), "doc_id", "class")] == list("AABABB")
    got = [tuple(round(x, 2) for x in r[1:]) for r in rows(bayes.evaluate(said, test, classes), "class", "precision", "recall", "f1")]
    assert got == [(0.5, 1.0, 0.67), (1.0, 0.5, 0.67)]
    assert rows(bayes.top_words(classes, model, 1), "class", "word") == [("A", "a"), ("B", "b")]
    nothing = spark.createDataFrame([(9, "B", "zzz")], "doc_id long, class string, text string")
    assert bayes.predict(nothing, classes, model).first()["class"] == "A"
    assert bayes.predict(nothing, classes, model, prior={"A": 0.1, "B": 0.9}).first()["class"] == "B"


TRIPLES = [(s, p, o) for s, facts in {
    "The Life of Emile Zola": [("instance of", "film"), ("award received", "Academy Award for Best Picture"), ("director", "William Dieterle")],
    "William Dieterle": [("country of citizenship", "Germany"), ("country of citizenship", "United States of America")],
    "Lawyer Man": [("instance of", "film"), ("director", "William Dieterle")],
    "Rebecca": [("instance of", "film"), ("award received", "Academy Award for Best Picture"), ("director", "Alfred Hitchcock")],
    "Alfred Hitchcock": [("country of citizenship", "United Kingdom")],
    "The River Thief": [("instance of", "film"), ("director", "N.D. Wilson")],
}.items() for p, o in facts]
FILM = '?f "instance of" "film" . ?f "award received" "Academy Award for Best Picture" . ?f "director" ?p . ?p "country of citizenship" "Germany"'


def test_graph_patterns(spark):
    t = spark.createDataFrame(TRIPLES, "subject string, predicate string, object string")
    t.createOrReplaceTempView("wikidata")
    ask = lambda q: [tuple(r) for r in triples.match(t, q).collect()]
    query = f"SELECT ?f ?p WHERE {{ {FILM} }}"
    assert ask(query) == [("The Life of Emile Zola", "William Dieterle")]
    assert [tuple(r) for r in spark.sql(triples.to_sql(query, "wikidata")).collect()] == ask(query)
    want = (
        "SELECT f0.subject AS f, f2.object AS p FROM wikidata AS f0, wikidata AS f1, wikidata AS f2, wikidata AS f3 WHERE f0.predicate='instance of' AND f0.object='film' AND f1.predicate='award received' "
        "AND f1.object='Academy Award for Best Picture' AND f2.predicate='director' AND f3.predicate='country of citizenship' AND f3.object='Germany' AND f1.subject=f0.subject AND f2.subject=f0.subject AND f3.subject=f2.object"
    )
    assert triples.to_sql(query, "wikidata") == want
    assert ask('SELECT ?f WHERE { ?f "director" "N.D. Wilson" }') == [("The River Thief",)]
    assert ask(f"SELECT ?p WHERE {{ {FILM} }};") == [("William Dieterle",)]
    assert ask('SELECT ?F WHERE { ?F "director" ?f . ?f "country of citizenship" "United Kingdom" }') == [("Rebecca",)]
    assert len(ask('SELECT ?x WHERE {\n\t?x "instance of" "film"\n\t?x "director" ?y\n}\nLIMIT 2;')) == 2
    assert sorted(ask('SELECT ?p WHERE { ?f ?p "film" }')) == [("instance of",)] * 4
    for bad in ("SELECT WHERE { }", 'SELECT ?x WHERE { ?x "p" }', 'SELECT ?y WHERE { ?x "p" "o" }', 'SELECT ?x WHERE { ?x "p" "o" } LIMIT x'):
        with pytest.raises(ValueError):
            triples.parse(bad)


TRANS = [("BEG", "NNP", 0.4), ("BEG", "OTHER", 0.2), ("BEG", "NN", 0.4), ("NNP", "END", 0.2), ("NNP", "NNP", 0.5), ("NNP", "VB", 0.3), ("VB", "NNP", 0.4), ("VB", "NN", 0.4), ("VB", "OTHER", 0.2), ("OTHER", "NNP", 0.1), ("OTHER", "OTHER", 0.4), ("OTHER", "NN", 0.5), ("NN", "NN", 0.4), ("NN", "VB", 0.4), ("NN", "END", 0.2)]
EMIT = [("James", "NNP", 0.5), ("James", "NN", 0.1), ("James", "OTHER", 0.2), ("Bond", "NNP", 0.5), ("Bond", "VB", 0.2), ("Bond", "OTHER", 0.2), ("agent", "NN", 0.9), ("is", "VB", 0.8), ("an", "OTHER", 0.6)]


def test_tagging(spark):
    m = hmm.model(spark.createDataFrame(TRANS, "tag1 string, tag2 string, p double"), spark.createDataFrame(EMIT, "word string, tag string, p double"))
    assert m.tags == ("NN", "NNP", "OTHER", "VB")
    s = spark.createDataFrame([(1, "James Bond is an agent".split()), (2, "Bond is unknown".split()), (3, []), (4, None)], "sent_id long, words array<string>")
    for tagger in (lambda w: hmm.viterbi(w, m), hmm.viterbi_udf(m)):
        got = {r["sent_id"]: r["v"] for r in s.select("sent_id", tagger(F.col("words")).alias("v")).collect()}
        assert got[1]["tags"] == ["NNP", "NNP", "VB", "OTHER", "NN"] and round(got[1]["lp"], 4) == -12.9136
        assert all(got[i] is None or got[i]["tags"] is None for i in (2, 3, 4))
    tagged = [(1, i, w, t) for i, (w, t) in enumerate(zip("I hate Donald Trump".split(), "PRP VBP NNP NNP".split()), 1)] + [(2, i, w, t) for i, (w, t) in enumerate(zip("a b c".split(), "NNP NN NNP".split()), 1)]
    got = rows(hmm.runs(spark.createDataFrame(tagged, "sent_id long, pos long, word string, tag string"), "NNP"), "sent_id", "start", "text")
    assert got == [(1, 3, "Donald Trump"), (2, 1, "a"), (2, 3, "c")]


def test_kmeans(spark):
    a = [[1, 1, 0, 0, 0], [1, 0, 1, 0, 0], [0, 0, 0, 1, 1], [0, 0, 0, 0, 1]]
    v = spark.createDataFrame([(j + 1, [float(a[i][j]) for i in range(4)]) for j in range(5)], "vec_id long, v array<double>")
    found = list(cluster.kmeans(v, {1: [1.0, 1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0, 0.0]}))
    groups = [[i for i, c in rows(x, "vec_id", "cluster") if c == 1] for _, x in found]
    assert groups[:3] == [[1, 2], [1, 2, 3], [1, 2, 3]] and len(found) == 3
    assert found[-1][0] == {1: pytest.approx([2 / 3, 2 / 3, 0, 0]), 2: pytest.approx([0, 0, 1, 0.5])}
    assert cluster.rss(found[-1][1], found[-1][0]).first()[0] == pytest.approx(4 / 3 + 0.5)
    assert cluster.best_k({1: 10.0, 2: 4.0, 3: 3.5}, 1.0) == 2


def test_lsi(spark):
    a = [[13, 5, 5, 0, 13], [9, 15, 15, 0, 9], [0, 0, 0, 20, 0]]
    columns = spark.createDataFrame([(j, [float(a[i][j]) for i in range(3)]) for j in range(5)], "doc_id long, v array<double>")
    g = lsi.gram(columns, 3)
    assert g.tolist() == [[388, 384, 0], [384, 612, 0], [0, 0, 400]]
    s, u = lsi.concepts(g, 3)
    assert s == pytest.approx([30, 20, 10])
    v = np.array([x for _, x in rows(lsi.concept_columns(columns, s, u), "doc_id", "c")]).T
    assert np.abs(v) == pytest.approx(np.array([[0.5, 0.5, 0.5, 0, 0.5], [0, 0, 0, 1, 0], [0.5, 0.5, 0.5, 0, 0.5]]))
    assert [round(x, 6) for _, x in rows(lsi.concept_scores(lsi.concept_columns(columns, s, u), [4, 1, 2], s, u), "doc_id", "score")] == [61, 35, 35, 40, 61]
    s, u = lsi.concepts(g, 2)
    assert [round(x, 6) for _, x in rows(lsi.concept_scores(lsi.concept_columns(columns, s, u), [4, 1, 2], s, u), "doc_id", "score")] == [48, 48, 48, 40, 48]
    score = lambda t: [round(x, 6) for _, x in rows(lsi.scores(columns, [4, 1, 2], t), "doc_id", "score")]
    assert lsi.expansion(u).ravel() == pytest.approx([9 / 25, 12 / 25, 0, 12 / 25, 16 / 25, 0, 0, 0, 1])
    assert score(lsi.expansion(u)) == [48, 48, 48, 40, 48]
    assert score(lsi.expansion(u, 12 / 25)) == [58, 80, 80, 40, 58]
    with pytest.raises(ValueError):
        lsi.gram(columns, lsi.MAX_TERMS + 1)


def test_lsi_query_covers_content_words(spark, tmp_path):
    """The query over more than 50 terms, held against a plain decomposition of the whole matrix."""
    import numpy as np

    from corpuscle.plans import registry

    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + d) for d in (i // 26, i % 26)) for i in range(200)]
    texts = [" ".join(rng.choice(words, 40, p=np.arange(200, 0, -1) / 20100)) for _ in range(60)] + [words[120], ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tf = np.array([[t.split().count(w) for t in texts] for w in words], float)
    order = sorted((i for i in range(200) if tf[i].any()), key=lambda i: (-(tf[i] > 0).sum(), words[i]))
    a = tf[order]
    u = np.linalg.svd(a)[0][:, :10]
    want = (u @ u.T)[0] @ a
    got = {r["doc_id"]: r["score"] for r in registry.queries()["lsi_scores"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(62)] == pytest.approx(want.tolist(), abs=1e-5) and got[60] != 0 and got[61] == 0
