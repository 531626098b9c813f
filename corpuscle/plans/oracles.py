"""DuckDB SQL for the queries of the registry, written from the operators' definitions."""

from __future__ import annotations

from re import findall

from corpuscle.functions.text import STOP_WORDS


def _values(rows: list[tuple], columns: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({columns}))"


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(stop: bool = False) -> str:
    extra = f" AND lower(w) NOT IN ({STOP})" if stop else ""
    return f"""tok AS (SELECT doc_id, lang, o, lower(w) AS term FROM (SELECT doc_id, lang, unnest(s) AS w, generate_subscripts(s, 1) AS o FROM (SELECT doc_id, lang, string_split_regex(text, '[^a-zA-Z]+') AS s FROM documents)) WHERE w <> ''{extra}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


TOKENS = _tokens()


def _weights(kind: str, k: str = "1.75", stop: bool = False) -> str:
    size, gain = "(0.25 + 0.75 * dl / avdl)", "log2(n / df)"
    formula = {
        "tf": "CAST(tf AS DOUBLE)", "tfidf": f"tf * {gain}", "bm25": f"tf * ({k} + 1) / ({k} * {size} + tf) * {gain}",
        "bm25_inf": f"tf / {size} * {gain}", "bm25_no_idf": f"tf * ({k} + 1) / ({k} * {size} + tf)",
    }[kind]
    return f"""{_tokens(stop)},
w AS (SELECT term, doc_id, tf, dl, df, {formula} AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st)"""


def _asked(searches: dict[str, str]) -> str:
    rows = [(q, w.lower()) for q, t in searches.items() for w in findall("[a-zA-Z]+", t)]
    return f"q AS (SELECT query, term, count(*) AS qtf FROM {_values(rows, 'query, term')} GROUP BY ALL)"


RANKED = "SELECT query, doc_id, round(sum({score} * qtf), 6) AS score FROM {table} JOIN q USING (term) GROUP BY ALL"


def _topk(searches: dict[str, str], kind: str, stop: bool = False) -> str:
    return f"""WITH {_weights(kind, stop=stop)}, {_asked(searches)},
r AS ({RANKED.format(score='score', table='w')})
SELECT query, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id DESC) AS rank FROM r) WHERE rank <= 10"""


def _list(term: str) -> str:
    return f"(SELECT doc_id, tf AS score FROM tf WHERE term = '{term}')"


def _measures(weights: str, score: str, table: str) -> str:
    return f"""WITH {weights},
b AS (SELECT CAST(item_id AS VARCHAR) AS query, text, list_filter(string_split_regex(text, '[^a-zA-Z]+'), lambda x: x <> '') AS ws FROM benchmark),
rel AS (SELECT query, doc_id FROM b JOIN documents d ON contains(d.text, b.text)),
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, lower(unnest(ws[2:4])) AS term FROM b WHERE query IN (SELECT query FROM rel)) GROUP BY ALL),
r AS ({RANKED.format(score=score, table=table)}),
k AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id DESC) AS rank, count(*) OVER (PARTITION BY query) AS n FROM r),
rr AS (SELECT query, count(*) AS r FROM rel GROUP BY 1),
h AS (SELECT query, rank, n, r, row_number() OVER (PARTITION BY query ORDER BY rank) AS seen FROM k JOIN rel USING (query, doc_id) JOIN rr USING (query)),
m AS (SELECT query,
  coalesce(max((SELECT count(*) FROM h h2 WHERE h2.query = rr.query AND h2.rank <= least(3, h2.n))) / max(least(3, (SELECT max(n) FROM k WHERE k.query = rr.query))), 0) AS p_at_k,
  coalesce(max((SELECT count(*) FROM h h2 WHERE h2.query = rr.query AND h2.rank <= least(h2.r, h2.n))) / max(least(r, (SELECT max(n) FROM k WHERE k.query = rr.query))), 0) AS p_at_r,
  coalesce(max((SELECT sum(seen / rank) FROM h h2 WHERE h2.query = rr.query)) / max(r), 0) AS ap
  FROM rr GROUP BY query)
"""


MEASURES = _measures(_weights("bm25"), "score", "w")
COSINE = "c AS (SELECT term, doc_id, score / sqrt(sum(score * score) OVER (PARTITION BY doc_id)) AS v FROM w WHERE score <> 0)"
VSM_MEASURES = _measures(f"{_weights('tfidf')}, {COSINE}", "v", "c")

NORMAL = r"regexp_replace(lower({0}), '\W', '', 'g')"


def _grams(table: str, text: str, keep: str) -> str:
    padded = f"'$$' || {NORMAL.format(text)} || '$$'"
    return f"SELECT {keep}, p[i:i + 2] AS qgram FROM (SELECT {keep}, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT {keep}, {padded} AS p FROM {table}))"


PED = "CASE WHEN length(x) = 0 THEN 0 ELSE least(list_min(list_transform(range(0, least(length(x) + delta, length(y)) + 1), lambda j: levenshtein(x, y[1:j]))), delta + 1) END"

ENTITIES = """v AS (SELECT term, row_number() OVER (ORDER BY doc_id, o) - 1 AS word_id FROM (SELECT term, doc_id, o, row_number() OVER (PARTITION BY term ORDER BY doc_id, o) AS first FROM tok) WHERE first = 1),
e AS (SELECT word_id, term AS name, score, description FROM v JOIN (SELECT term, count(*) AS score, min(lang) AS description FROM tok GROUP BY 1) USING (term))"""


def _fuzzy(asked: list[tuple]) -> str:
    return f"""WITH {TOKENS}, {ENTITIES}, a AS {_values(asked, 'x, delta')},
xg AS ({_grams('a', 'x', 'x, delta')}), yg AS ({_grams('e', 'name', 'word_id')}),
c AS (SELECT x, delta, word_id, count(*) AS cnt FROM xg JOIN yg USING (qgram) GROUP BY ALL),
f AS (SELECT c.x AS raw, word_id, name, score, description, delta, {NORMAL.format('c.x')} AS x, {NORMAL.format('name')} AS y FROM c JOIN e USING (word_id)
      WHERE cnt >= length({NORMAL.format('c.x')}) - 1 - delta * 3 AND (delta > 0 OR starts_with({NORMAL.format('name')}, {NORMAL.format('c.x')}))),
p AS (SELECT raw AS x, word_id, name, score, description, delta, CAST({PED} AS BIGINT) AS ped FROM f)
"""


NB = """w AS (SELECT doc_id, class, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents JOIN (SELECT doc_id, quality AS class FROM labels) USING (doc_id)),
c AS (SELECT class, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
cl AS (SELECT DISTINCT class FROM (SELECT quality AS class FROM labels JOIN documents USING (doc_id)) WHERE class IS NOT NULL), vo AS (SELECT DISTINCT word FROM c), nc AS (SELECT class, sum(n) AS n_c FROM c GROUP BY 1),
p AS (SELECT cl.class, vo.word, (coalesce(n, 0) + 0.1) / (n_c + 0.1 * (SELECT count(*) FROM vo)) AS p_wc FROM cl CROSS JOIN vo LEFT JOIN c USING (class, word) JOIN nc USING (class)),
pr AS (SELECT class, count(*) / sum(count(*)) OVER () AS p_c FROM (SELECT quality AS class FROM labels JOIN documents USING (doc_id)) WHERE class IS NOT NULL GROUP BY 1)"""
NB_PREDICTED = """dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
s AS (SELECT doc_id, class, sum(n * log2(p_wc)) AS s FROM dw JOIN p USING (word) GROUP BY ALL),
g AS (SELECT d.doc_id, cl.class, round(coalesce(s, 0) + {prior}, 6) AS s FROM documents d CROSS JOIN cl JOIN pr USING (class) LEFT JOIN s USING (doc_id, class)),
said AS (SELECT doc_id, class FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, class) AS k FROM g) WHERE k = 1)"""
NB_METRICS = f"""WITH {NB}, {NB_PREDICTED.format(prior='0')}, pairs AS (SELECT said.class AS said, labels.quality AS truth FROM said JOIN labels USING (doc_id)),
m AS (SELECT class, tp / (sn + 1e-7) AS precision, tp / (tn + 1e-7) AS recall FROM (SELECT cl.class, count(*) FILTER (said = class AND truth = class) AS tp, count(*) FILTER (said = class) AS sn, count(*) FILTER (truth = class) AS tn FROM cl CROSS JOIN pairs GROUP BY 1)),
f AS (SELECT class, precision, recall, 2 * precision * recall / (precision + recall + 1e-7) AS f1 FROM m)
"""

GRAPH = """g AS (SELECT 'C' || c_custkey AS s, 'nation' AS p, 'N' || c_nationkey AS o FROM customer UNION ALL SELECT 'C' || c_custkey, 'segment', c_mktsegment FROM customer
UNION ALL SELECT 'N' || n_nationkey, 'region', 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'name', r_name FROM region
UNION ALL SELECT 'O' || o_orderkey, 'placed by', 'C' || o_custkey FROM orders UNION ALL SELECT 'O' || o_orderkey, 'status', o_orderstatus FROM orders UNION ALL SELECT 'O' || o_orderkey, 'priority', o_orderpriority FROM orders)"""

CENTRES = "cm AS (SELECT label AS cluster, dim, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY ALL)"
ASSIGNED = f"""{CENTRES}, e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
sim AS (SELECT vec_id, cluster, round(sum(e.x * cm.x), 9) AS sim FROM e JOIN cm USING (dim) GROUP BY ALL),
a AS (SELECT vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster DESC) AS k FROM sim) WHERE k = 1)"""

GAPS = f"""{TOKENS}, g AS (SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM tf)"""


def _tagged(buckets: tuple[float, ...]) -> str:
    level = " + ".join(f"CASE WHEN value >= {b} THEN 1 ELSE 0 END" for b in buckets)
    return f"""t AS (SELECT user_id AS sent_id, event_id AS pos, 'w' || ({level}) AS word, event_type AS tag FROM events),
n AS (SELECT *, lag(tag, 1, 'BEG') OVER s AS before, lead(tag) OVER s AS after, row_number() OVER s AS k FROM t WINDOW s AS (PARTITION BY sent_id ORDER BY pos)),
pair AS (SELECT before AS tag1, tag AS tag2 FROM n UNION ALL SELECT tag, 'END' FROM n WHERE after IS NULL),
tr AS (SELECT tag1, tag2, count(*) / sum(count(*)) OVER (PARTITION BY tag1) AS p FROM pair GROUP BY tag1, tag2),
em AS (SELECT word, tag, count(*) / sum(count(*)) OVER (PARTITION BY tag) AS p FROM t GROUP BY word, tag)"""


def _held_out() -> str:
    learned = NB.replace("(SELECT doc_id, quality AS class FROM labels)", "(SELECT doc_id, quality AS class FROM labels WHERE doc_id % 3 <> 0)").replace("FROM labels JOIN documents USING (doc_id)", "FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0")
    return f"""WITH {learned}, {NB_PREDICTED.format(prior='0')}, pairs AS (SELECT said.class AS said, labels.quality AS truth FROM said JOIN labels USING (doc_id) WHERE doc_id % 3 = 0),
m AS (SELECT class, tp / (sn + 1e-7) AS precision, tp / (tn + 1e-7) AS recall FROM (SELECT cl.class, count(*) FILTER (said = class AND truth = class) AS tp, count(*) FILTER (said = class) AS sn, count(*) FILTER (truth = class) AS tn FROM cl CROSS JOIN pairs GROUP BY 1))
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-7), 6) AS f1 FROM m"""


def _kmeans(rounds: int) -> str:
    """Common table expressions a1, a2, ... of the assignments in each round."""
    out = [CENTRES.replace("cm AS", "cm0 AS"), "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"]
    for k in range(rounds):
        out.append(f"s{k} AS (SELECT vec_id, cluster, round(sum(e.x * cm{k}.x), 9) AS sim FROM e JOIN cm{k} USING (dim) GROUP BY ALL)")
        out.append(f"a{k + 1} AS (SELECT vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster DESC) AS k FROM s{k}) WHERE k = 1)")
        out.append(f"cm{k + 1} AS (SELECT cluster, dim, coalesce(m.x, cm{k}.x) AS x FROM cm{k} LEFT JOIN (SELECT cluster, dim, avg(x) AS x FROM a{k + 1} JOIN e USING (vec_id) GROUP BY ALL) m USING (cluster, dim))")
    return ", ".join(out[:-1])


def _choice(penalty: float) -> str:
    one = "SELECT CAST({k} AS BIGINT) AS k, sum((x - m) * (x - m)) AS rss FROM (SELECT x, avg(x) OVER (PARTITION BY label % {k}, dim) AS m FROM e)"
    return f"""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), r AS ({' UNION ALL '.join(one.format(k=k) for k in (2, 4, 8))})
SELECT k, round(rss, 4) AS rss, row_number() OVER (ORDER BY rss + {penalty} * k, k) = 1 AS chosen FROM r"""


VITERBI = """vit AS (SELECT n.sent_id, n.k, tr.tag2 AS tag, log2(tr.p) + log2(em.p) AS lp, tr.tag2 AS path FROM n JOIN tr ON tr.tag1 = 'BEG' JOIN em ON em.word = n.word AND em.tag = tr.tag2 WHERE n.k = 1
UNION ALL
SELECT sent_id, k, tag, lp, path FROM (SELECT n.sent_id, n.k, tr.tag2 AS tag, v.lp + log2(tr.p) + log2(em.p) AS lp, v.path || ' ' || tr.tag2 AS path,
  row_number() OVER (PARTITION BY n.sent_id, tr.tag2 ORDER BY v.lp + log2(tr.p) DESC, v.tag DESC) AS best
  FROM vit v JOIN n ON n.sent_id = v.sent_id AND n.k = v.k + 1 JOIN tr ON tr.tag1 = v.tag JOIN em ON em.word = n.word AND em.tag = tr.tag2) WHERE best = 1),
fin AS (SELECT v.sent_id, v.lp + log2(tr.p) AS lp, v.path, row_number() OVER (PARTITION BY v.sent_id ORDER BY v.lp + log2(tr.p) DESC, v.tag DESC) AS best
  FROM vit v JOIN tr ON tr.tag1 = v.tag AND tr.tag2 = 'END' JOIN (SELECT sent_id, max(k) AS k FROM n GROUP BY 1) l ON l.sent_id = v.sent_id AND l.k = v.k)"""


def sql(searches: dict[str, str], fuzzy: list[tuple], buckets: tuple[float, ...], entity: str, rounds: int, penalty: float) -> dict[str, str]:
    tagged, asked, found = _tagged(buckets), _asked(searches), _fuzzy(fuzzy)
    out = {
        "word_freq": f"WITH {TOKENS} SELECT term, count(*) AS freq FROM tok GROUP BY 1",
        "df_idf": f"WITH {TOKENS} SELECT term, df, round(log2(n / df), 6) AS idf FROM df, st",
        "doc_lengths": f"WITH {TOKENS} SELECT doc_id, dl FROM dl",
        "doc_len_stats": f"WITH {TOKENS} SELECT n, round(avdl, 6) AS avdl FROM st",
        "stop_word_filter": f"WITH {_tokens(True)} SELECT doc_id, dl FROM dl",
        "vocabulary": f"WITH {TOKENS}, {ENTITIES} SELECT term, word_id AS term_id FROM v",
        "boolean_and": f"WITH {TOKENS}, {asked} SELECT query, doc_id FROM (SELECT query, doc_id, count(*) AS n FROM tf JOIN q USING (term) GROUP BY query, doc_id) JOIN (SELECT query, count(*) AS n FROM q GROUP BY query) USING (query, n)",
        "bm25_postings": f"WITH {_weights('bm25')} SELECT term, doc_id, tf, dl, df, round(score, 6) AS score FROM w",
        "bm25_topk": _topk(searches, "bm25"), "bm25_k_inf": _topk(searches, "bm25_inf"), "bm25_no_idf": _topk(searches, "bm25_no_idf"), "bm25_stopwords": _topk(searches, "bm25", True),
        "tfidf_topk": _topk(searches, "tfidf"), "tf_topk": _topk(searches, "tf"),
        "posting_intersect_3way": f"WITH {TOKENS} SELECT doc_id, CAST(a.score + b.score + c.score AS BIGINT) AS score FROM {_list('the')} a JOIN {_list('of')} b USING (doc_id) JOIN {_list('hewh')} c USING (doc_id)",
        "posting_union": f"WITH {TOKENS} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS score FROM tf WHERE term IN ('the', 'of', 'de') GROUP BY 1",
        "posting_semi_chain": f"WITH {TOKENS} SELECT doc_id, count(*) AS n FROM tok WHERE term = 'hewh' AND doc_id IN (SELECT doc_id FROM tok WHERE term = 'the') GROUP BY 1",
        "counted_union": f"WITH {TOKENS} SELECT doc_id AS word_id, count(*) AS cnt FROM tok WHERE term IN ('the', 'de', 'hewh') GROUP BY 1",
        "posting_strings": "SELECT p_name, '[' || string_agg('(' || p_partkey || ', ' || p_size || ')', ', ' ORDER BY p_partkey) || ']' AS postings FROM part GROUP BY 1",
        "qrels_build": "SELECT CAST(item_id AS VARCHAR) AS query, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
        "precision_at_3": f"{MEASURES} SELECT query, round(p_at_k, 6) AS p_at_k FROM m", "precision_at_r": f"{MEASURES} SELECT query, round(p_at_r, 6) AS p_at_r FROM m", "average_precision": f"{MEASURES} SELECT query, round(ap, 6) AS ap FROM m",
        "mean_measures": f"{MEASURES} SELECT round(avg(p_at_k), 6) AS mp_at_k, round(avg(p_at_r), 6) AS mp_at_r, round(avg(ap), 6) AS map FROM m",
        "vsm_query_topk": f"""WITH {_weights('tfidf')}, {asked}, {COSINE},
r AS ({RANKED.format(score='v', table='c')}) SELECT query, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id DESC) AS rank FROM r) WHERE rank <= 10""",
        "qgram_index": f"WITH e AS (SELECT p_partkey AS word_id, p_name FROM part), y AS ({_grams('e', 'p_name', 'word_id')}) SELECT qgram, word_id, count(*) AS n FROM y GROUP BY ALL",
        "qgram_candidates": f"{found} SELECT x, cnt, count(*) AS n FROM c GROUP BY ALL",
        "prefix_edit_distance": f"""WITH a AS {_values([('small rig', 2), ('red', 0), ('larg', 1), ('blue', 2)], 'raw, delta')}, s AS (SELECT raw, delta, p_partkey AS word_id, {NORMAL.format('raw')} AS x, {NORMAL.format('p_name')} AS y FROM part CROSS JOIN a)
SELECT raw AS x, word_id, CAST({PED} AS BIGINT) AS ped FROM s""",
        "fuzzy_match": f"{found} SELECT x, word_id, name, score, description, ped FROM p WHERE ped <= delta",
        "fuzzy_counts": f"{found} SELECT x, count(*) AS n_ped, count(*) FILTER (ped <= delta) AS n_found FROM p GROUP BY 1",
        "fuzzy_top": f"""WITH a AS {_values([('smal rin', 1), ('red wid', 1)], 'x, delta')}, e AS (SELECT p_partkey AS word_id, p_name AS name, p_size AS score FROM part), xg AS ({_grams('a', 'x', 'x, delta')}), yg AS ({_grams('e', 'name', 'word_id')}),
c AS (SELECT x, delta, word_id, count(*) AS cnt FROM xg JOIN yg USING (qgram) GROUP BY ALL),
f AS (SELECT c.x AS raw, word_id, name, score, delta, {NORMAL.format('c.x')} AS x, {NORMAL.format('name')} AS y FROM c JOIN e USING (word_id) WHERE cnt >= length({NORMAL.format('c.x')}) - 1 - delta * 3),
p AS (SELECT raw AS x, word_id, name, score, delta, CAST({PED} AS BIGINT) AS ped FROM f)
SELECT x, rank, word_id, name, ped FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY ped, score DESC, word_id) AS rank FROM p WHERE ped <= delta) WHERE rank <= 5""",
        "boolean_and_titles": f"""WITH {TOKENS}, {asked}, b AS (SELECT query, doc_id FROM (SELECT query, doc_id, count(*) AS n FROM tf JOIN q USING (term) GROUP BY query, doc_id) JOIN (SELECT query, count(*) AS n FROM q GROUP BY query) USING (query, n))
SELECT query, rank, doc_id, text[1:40] AS head FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id) AS rank FROM b) JOIN documents USING (doc_id) WHERE rank <= 3""",
        "nb_prior": f"WITH {NB} SELECT class, round(p_c, 6) AS p_c FROM pr", "nb_likelihood": f"WITH {NB} SELECT class, word, round(p_wc, 9) AS p_wc FROM p",
        "nb_predict": f"WITH {NB}, {NB_PREDICTED.format(prior='0')} SELECT doc_id, class FROM said", "nb_predict_prior": f"WITH {NB}, {NB_PREDICTED.format(prior='log2(p_c)')} SELECT doc_id, class FROM said",
        "nb_metrics": f"{NB_METRICS} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f", "nb_macro_f1": f"{NB_METRICS} SELECT round(avg(f1), 6) AS macro_f1 FROM f",
        "nb_top_words": f"WITH {NB} SELECT class, rank, word, round(p_wc, 9) AS p_wc FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p_wc DESC, word) AS rank FROM p) WHERE rank <= 20",
        "sparql_bgp2": f"WITH {GRAPH} SELECT a.s AS c FROM g a JOIN g b ON a.s = b.s WHERE a.p = 'segment' AND a.o = 'BUILDING' AND b.p = 'nation' AND b.o = 'N3'",
        "sparql_bgp4": f"WITH {GRAPH} SELECT a.s AS o, c.o AS c FROM g a JOIN g b ON a.s = b.s JOIN g c ON c.s = a.s JOIN g d ON d.s = c.o WHERE a.p = 'priority' AND a.o = '1-URGENT' AND b.p = 'status' AND b.o = 'F' AND c.p = 'placed by' AND d.p = 'nation' AND d.o = 'N3'",
        "sparql_chain": f"WITH {GRAPH} SELECT b.o AS n, a.s AS o FROM g a JOIN g b ON a.o = b.s JOIN g c ON c.s = b.o JOIN g d ON d.s = c.o JOIN g e ON e.s = a.s WHERE a.p = 'placed by' AND b.p = 'nation' AND c.p = 'region' AND d.p = 'name' AND d.o = 'ASIA' AND e.p = 'priority' AND e.o = '2-HIGH'",
        "sparql_predicate": f"WITH {GRAPH} SELECT s, p FROM g WHERE o = 'N3'",
        "sparql_limit": f"WITH {GRAPH} SELECT a.s AS c, b.o AS n FROM g a JOIN g b ON a.s = b.s WHERE a.p = 'segment' AND a.o = 'MACHINERY' AND b.p = 'nation' ORDER BY c LIMIT 10",
        "sparql_sql_text": f"WITH {GRAPH} SELECT a.s AS o FROM g a JOIN g b ON a.o = b.s JOIN g c ON c.s = a.s WHERE a.p = 'placed by' AND b.p = 'segment' AND b.o = 'BUILDING' AND c.p = 'status' AND c.o = 'P'",
        "hmm_transitions": f"WITH {tagged} SELECT tag1, tag2, round(p, 9) AS p FROM tr", "hmm_emissions": f"WITH {tagged} SELECT word, tag, round(p, 9) AS p FROM em",
        "viterbi": f"WITH RECURSIVE {tagged}, {VITERBI} SELECT sent_id, round(lp, 6) AS lp, path AS tags FROM fin WHERE best = 1",
        "named_entities": f"""WITH RECURSIVE {tagged}, {VITERBI}, p AS (SELECT sent_id, string_split(path, ' ') AS t FROM fin WHERE best = 1),
u AS (SELECT sent_id, unnest(t) AS tag, generate_subscripts(t, 1) AS k FROM p),
r AS (SELECT sent_id, k, word, k - row_number() OVER (PARTITION BY sent_id ORDER BY k) AS island FROM u JOIN (SELECT sent_id, k, word FROM n) USING (sent_id, k) WHERE tag = '{entity}')
SELECT sent_id, min(k) - 1 AS start, string_agg(word, ' ' ORDER BY k) AS text FROM r GROUP BY sent_id, island""",
        "index_build": f"WITH {TOKENS}, v AS (SELECT DISTINCT term FROM tok) SELECT (SELECT count(*) FROM tf) AS postings, count(*) AS words, CAST(sum(length(term) + 2) AS BIGINT) AS qgrams FROM v",
        "vsm_mean_measures": f"{VSM_MEASURES} SELECT round(avg(p_at_k), 6) AS mp_at_k, round(avg(p_at_r), 6) AS mp_at_r, round(avg(ap), 6) AS map FROM m",
        "fuzzy_complete": f"""{found[: found.index("f AS (SELECT c.x AS raw")]}f AS (SELECT a.x AS raw, e.word_id, e.name, e.score, e.description, a.delta, {NORMAL.format('a.x')} AS x, {NORMAL.format('name')} AS y FROM a CROSS JOIN e LEFT JOIN c ON c.x = a.x AND c.word_id = e.word_id
      WHERE (cnt >= length({NORMAL.format('a.x')}) - 1 - a.delta * 3 OR length({NORMAL.format('a.x')}) - 1 - a.delta * 3 <= 0) AND (a.delta > 0 OR starts_with({NORMAL.format('name')}, {NORMAL.format('a.x')}))),
p AS (SELECT raw AS x, word_id, name, score, description, delta, CAST({PED} AS BIGINT) AS ped FROM f)
SELECT x, word_id, name, score, description, ped FROM p WHERE ped <= delta""",
        "nb_held_out": _held_out(),
        "nb_top_words_stop": f"WITH {NB} SELECT class, rank, word, round(p_wc, 9) AS p_wc FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p_wc DESC, word) AS rank FROM p WHERE word NOT IN ({STOP})) WHERE rank <= 20",
        "lsi_full_rank": f"""WITH {TOKENS}, one AS (SELECT term FROM df ORDER BY df DESC, term LIMIT 1)
SELECT d.doc_id, CAST(coalesce(tf, 0) AS DOUBLE) AS score FROM documents d LEFT JOIN (SELECT doc_id, tf FROM tf JOIN one USING (term)) USING (doc_id)""",
        "kmeans_rounds": f"WITH {_kmeans(rounds)} SELECT vec_id, cluster FROM a{rounds}", "kmeans_choice": _choice(penalty),
        "tag_runs": f"""WITH {tagged}, r AS (SELECT sent_id, k, word, k - row_number() OVER (PARTITION BY sent_id ORDER BY k) AS island FROM n WHERE tag = 'purchase')
SELECT sent_id, min(k) AS start, string_agg(word, ' ' ORDER BY k) AS text FROM r GROUP BY sent_id, island""",
        "kmeans_assign": f"WITH {ASSIGNED} SELECT vec_id, cluster FROM a",
        "kmeans_step": f"WITH {ASSIGNED} SELECT a.cluster, CAST(dim AS INT) AS dim, round(avg(e.x), 6) AS x FROM a JOIN e USING (vec_id) GROUP BY ALL",
        "rss": f"WITH {CENTRES}, e AS (SELECT label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT round(sum((e.x - cm.x) * (e.x - cm.x)), 6) AS rss FROM e JOIN cm USING (cluster, dim)",
        "gap_encoding": f"WITH {GAPS} SELECT term, doc_id, gap FROM g",
        "code_bits": f"""WITH {GAPS}, h AS (SELECT term, greatest(gap, 1) AS gap, count(*) OVER (PARTITION BY term) AS df FROM g), b AS (SELECT *, length(bin(gap)) - 1 AS l FROM h)
SELECT term, count(*) AS df, CAST(sum(2 * l + 1) AS BIGINT) AS gamma_bits, CAST(sum(l + 2 * (length(bin(l + 1)) - 1) + 1) AS BIGINT) AS delta_bits, CAST(sum(8 * ((l + 7) // 7)) AS BIGINT) AS vbyte_bits,
  CAST(sum(floor(gap * (df / n) / ln(2)) + 1 + greatest(ceil(log2(ln(2) / (df / n))), 0)) AS BIGINT) AS golomb_bits FROM b, st GROUP BY term""",
        "term_entropy": f"WITH {TOKENS}, f AS (SELECT term, count(*) AS n FROM tok GROUP BY 1), s AS (SELECT sum(n) AS a FROM f) SELECT round(-sum(n / a * log2(n / a)), 6) AS entropy FROM f, s",
    }
    out["boolean_and_scan"] = out["boolean_and"]
    for name in ("basic", "less_conditional", "sentinel", "skip_pointer", "binary_search", "galloping", "hybrid"):
        out[f"posting_intersect_{name}"] = f"WITH {TOKENS} SELECT doc_id, CAST(a.score + b.score AS BIGINT) AS score FROM {_list('the')} a JOIN {_list('hewh')} b USING (doc_id)"
    for name, side, norm in (("none", "", "1"), ("col_l1", "doc_id", "sum(abs(score))"), ("col_l2", "doc_id", "sqrt(sum(score * score))"), ("row_l1", "term", "sum(abs(score))"), ("row_l2", "term", "sqrt(sum(score * score))")):
        over = f"{norm} OVER (PARTITION BY {side})".replace("sqrt(sum(score * score)) OVER", "sqrt(sum(score * score) OVER") + ")" * norm.startswith("sqrt") if side else "1"
        out[f"vsm_{name}"] = f"WITH {_weights('bm25')} SELECT term, doc_id, round(score / {over}, 6) AS v FROM w WHERE score <> 0"
    return out
