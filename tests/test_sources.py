"""Loaders and writers, the numbering of rows, the stream extension."""

import pytest
from pyspark.sql import functions as F

from corpuscle.operators.ranking import numbered
from corpuscle.sources import text_files as S
from corpuscle.streaming import queries as Q


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_loaders(spark, tmp_path):
    corpus = S.corpus(spark, put(tmp_path, "c", "a\tx y\nb\tz"))
    assert rows(corpus) == [(1, "a\tx y"), (2, "b\tz")] and rows(S.document(corpus, 2)) == [(2, "b\tz")]
    assert rows(S.qrels(spark, put(tmp_path, "q", "film a\t1 3  4\nno tab\nfilm a\t3 9\n"))) == [("film a", 1), ("film a", 3), ("film a", 4), ("film a", 9)]
    assert rows(S.posting_list(spark, put(tmp_path, "p", "3\n2 5\n3 1\n6 2\n"))) == [(2, 5), (3, 1), (6, 2)]
    assert rows(S.entities(spark, put(tmp_path, "e", "name\tscore\tdescription\nfrei\t3\ta word\textra\nbrei\t2\tanother word\n"))) == [(1, "frei", 3, "a word"), (2, "brei", 2, "another word")]
    assert rows(S.labelled(spark, put(tmp_path, "l", "A\ta b a\nB\tb b \n"))) == [(0, "A", "a b a"), (1, "B", "b b")]
    assert rows(S.stop_words(spark, put(tmp_path, "s", " the \n\na\nthe\n"))) == [("a",), ("the",)]
    assert rows(S.probabilities(spark, put(tmp_path, "h", "A\tB\t0.5\nbad line\nA B x\nA\tB\t0.25\nA\tC\t1\n"))) == [("A", "B", 0.25), ("A", "C", 1.0)]
    assert rows(S.triples(spark, put(tmp_path, "t", 'a\tb "q"\tc\n'))) == [("a", 'b "q"', "c")]


@pytest.mark.parametrize(("loader", "text"), [("qrels", "a\t1 x\n"), ("posting_list", "1\n2\n"), ("posting_list", "1\n2 a\n"), ("entities", "h\nname\tno number\td\n"), ("entities", "h\nname\t1\n"), ("labelled", "A\tb\tc\n")])
def test_loaders_fail_on_bad_lines(spark, tmp_path, loader, text):
    with pytest.raises(Exception, match="not a"):
        getattr(S, loader)(spark, put(tmp_path, "bad", text)).collect()


def test_writers(spark, tmp_path):
    q = spark.createDataFrame([("a", 2), ("a", 10), ("b", 1)], "query string, doc_id long")
    S.write_qrels(q, str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == [("a\t1 9",), ("b\t0",)]
    assert rows(S.as_json(q.where("doc_id = 2"))) == [('["a","2"]',)]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert all(r["x"] == r["n"] for r in numbered(df, [F.col("x")], "n").collect())
    assert numbered(df.where("false"), [F.col("x")], "n").count() == 0


def test_search_stream(spark, tmp_path):
    postings = spark.createDataFrame([("film", 1, 1.0), ("film", 2, 2.0), ("short", 2, 0.5)], "term string, doc_id long, score double")
    spark.createDataFrame([("q", "Short film"), ("n", "nothing")], "query string, text string").write.json(str(tmp_path / "in"))
    found = {}
    stream = spark.readStream.schema("query string, text string").json(str(tmp_path / "in"))

    def sink(batch, _):
        found.update({(r["query"], r["doc_id"]): r["score"] for r in Q.summed(batch).collect()})

    q = Q.search_stream(stream, postings).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert found == {("q", 1): 1.0, ("q", 2): 2.5}
