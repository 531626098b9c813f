"""Queries over the text formats: rows of the tables are written as files of a format in the shared folder and
come back through its loader. Their SQL twins say what has to come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import hmm
from corpuscle.sources import text_files
from corpuscle.sources.storage import new_path

TAB = "\t"


def _written(rows: DataFrame, *line: Column | str, order: str | None = None, head: str | None = None, sep: str = TAB) -> str:
    """The path of a file of lines: fields joined by `sep`, in an order, perhaps behind a first line."""
    path = new_path(rows.sparkSession, "lines")
    lines = rows.select(F.concat_ws(sep, *line).alias("value"), *([F.col(order).alias("at_")] if order else []))
    if order:  # a file whose lines are numbered is one file
        if head is not None:
            lines = lines.unionByName(lines.sparkSession.createDataFrame([(head,)], "value string").withColumn("at_", F.lit(None).cast(lines.schema["at_"].dataType)))
        lines = lines.coalesce(1).sortWithinPartitions(F.col("at_").asc_nulls_first()).select("value")
    lines.write.text(path)
    return path


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus_scan(spark, d):
    return text_files.corpus(spark, _written(_table(spark, d, "part"), "p_name", "p_brand", order="p_partkey"))


def corpus_document(spark, d):
    return text_files.document(corpus_scan(spark, d), 7)


def qrels_scan(spark, d):
    rows = _table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("ids"))
    good = rows.select(F.col("s_nationkey").cast("string").alias("q"), F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))
    bad = spark.createDataFrame([("no ids",)], "q string").withColumn("ids", F.lit(None).cast("string"))
    return text_files.qrels(spark, _written(good.unionByName(bad), "q", "ids"))


def qrels_rewrite(spark, d):
    path = new_path(spark, "qrels")
    text_files.write_qrels(_table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("query"), F.col("s_suppkey").alias("doc_id")), path)
    return text_files.qrels(spark, path)


def posting_list_scan(spark, d):
    rows = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("score"), "p_partkey")
    return text_files.posting_list(spark, _written(rows, "id", "score", order="p_partkey", head=str(rows.count()), sep=" "))


def entities_scan(spark, d):
    rows = _table(spark, d, "part").withColumn("score", F.col("p_size").cast("string"))
    return text_files.entities(spark, _written(rows, "p_name", "score", "p_brand", order="p_partkey", head="name\tscore\tdescription"))


def labelled_scan(spark, d):
    return text_files.labelled(spark, _written(_table(spark, d, "part"), "p_brand", "p_name", order="p_partkey"))


def stop_words_scan(spark, d):
    return text_files.stop_words(spark, _written(_table(spark, d, "part"), F.concat(F.lit(" "), F.col("p_brand"))))


def probabilities_scan(spark, d):
    events = _table(spark, d, "events").select(F.col("user_id").alias("sent_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("tag"))
    rows = hmm.transitions(events, "sent_id", ["pos"]).withColumn("p", F.format_string("%.9f", "p")).withColumn("at", F.concat("tag1", F.lit(" "), "tag2"))
    return text_files.probabilities(spark, _written(rows, "tag1", "tag2", "p", order="at", head="a line of other fields"))


def triples_scan(spark, d):
    rows = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("s"), F.lit("segment").alias("p"), "c_mktsegment")
    return text_files.triples(spark, _written(rows, "s", "p", "c_mktsegment"))


def json_sink(spark, d):
    return text_files.as_json(_table(spark, d, "part").select("p_partkey", "p_name"))


SCANS = (corpus_scan, corpus_document, qrels_scan, qrels_rewrite, posting_list_scan, entities_scan, labelled_scan, stop_words_scan, probabilities_scan, triples_scan, json_sink)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in SCANS}


def oracle_sql() -> dict[str, str]:
    numbered = "SELECT row_number() OVER (ORDER BY p_partkey) AS n, * FROM part"
    steps = """n AS (SELECT user_id, event_type AS tag, lag(event_type, 1, 'BEG') OVER s AS before, lead(event_type) OVER s AS after FROM events WINDOW s AS (PARTITION BY user_id ORDER BY event_id)),
pair AS (SELECT before AS tag1, tag AS tag2 FROM n UNION ALL SELECT tag, 'END' FROM n WHERE after IS NULL)"""
    corpus = f"SELECT n AS doc_id, p_name || chr(9) || p_brand AS text FROM ({numbered})"
    return {
        "corpus_scan": corpus, "corpus_document": f"SELECT * FROM ({corpus}) WHERE doc_id = 7",
        "qrels_scan": "SELECT CAST(s_nationkey AS VARCHAR) AS query, CAST(s_suppkey AS BIGINT) AS doc_id FROM supplier",
        "qrels_rewrite": "SELECT CAST(s_nationkey AS VARCHAR) AS query, CAST(s_suppkey - 1 AS BIGINT) AS doc_id FROM supplier",
        "posting_list_scan": "SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(p_size AS BIGINT) AS score FROM part",
        "entities_scan": f"SELECT n AS word_id, p_name AS name, CAST(p_size AS BIGINT) AS score, p_brand AS description FROM ({numbered})",
        "labelled_scan": f'SELECT n - 1 AS doc_id, p_brand AS "class", p_name AS text FROM ({numbered})',
        "stop_words_scan": "SELECT DISTINCT p_brand AS word FROM part",
        "probabilities_scan": f"WITH {steps} SELECT tag1, tag2, CAST(printf('%.9f', count(*) / sum(count(*)) OVER (PARTITION BY tag1)) AS DOUBLE) AS p FROM pair GROUP BY tag1, tag2",
        "triples_scan": "SELECT CAST(c_custkey AS VARCHAR) AS subject, 'segment' AS predicate, c_mktsegment AS object FROM customer",
        "json_sink": """SELECT '["' || p_partkey || '","' || p_name || '"]' AS json FROM part""",
    }
