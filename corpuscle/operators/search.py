"""Keyword search for many queries at once: boolean AND, ranked OR, top k."""

from __future__ import annotations

from collections import Counter
from re import findall

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions.text import terms as terms_of
from corpuscle.operators import index


def query_terms(spark: SparkSession, queries: dict[str, str], stop: tuple[str, ...] = (), case_fold: bool = True) -> tuple[DataFrame, list[str]]:
    """query, term, qtf of a stated, small set of queries; and their distinct terms."""
    rows = []
    for name, text in queries.items():
        found = findall("[a-zA-Z]+", text)
        found = [w.lower() for w in found] if case_fold else found
        rows += [(name, w, n) for w, n in Counter(w for w in found if w not in stop).items()]
    return spark.createDataFrame(rows, "query string, term string, qtf long"), sorted({r[1] for r in rows})


def boolean_and(docs: DataFrame, queries: dict[str, str], text: str = "text") -> DataFrame:
    """query, doc_id of documents that hold all words of a query. An empty query has no results."""
    found = docs.select("doc_id", F.explode(F.array_distinct(terms_of(F.col(text)))).alias("term"))
    return all_words(found, queries)


def all_words(entries: DataFrame, queries: dict[str, str]) -> DataFrame:
    """The same from term, doc_id, a row for each pair."""
    asked, only = query_terms(entries.sparkSession, queries)
    needed = asked.groupBy("query").agg(F.count("*").alias("need"))
    found = entries.where(F.col("term").isin(*only) if only else F.lit(False)).join(asked, "term")
    return found.groupBy("query", "doc_id").count().join(needed, "query").where("count = need").select("query", "doc_id")


def ranked(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """query, doc_id, score: sums over a query's words, a repeated word counting twice."""
    return postings.join(asked, "term").groupBy("query", "doc_id").agg(F.sum(F.col("score") * F.col("qtf")).alias("score"))


def top(results: DataFrame, k: int | None = None, places: int = 6) -> DataFrame:
    """Results with their rank: score descending, then doc_id descending. Scores are compared after
    rounding, so that the order of a sum's parts decides nothing. With k, tasks pass on k rows each."""
    rounded = results.withColumn("score", F.round("score", places))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("doc_id"))
    out = rounded.withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= k) if k is not None else out


def search(docs: DataFrame, queries: dict[str, str], kind: str = "bm25", b: float = 0.75, k: float = 1.75, stop: tuple[str, ...] = (), case_fold: bool = True) -> DataFrame:
    """query, doc_id, score of every matching document."""
    asked, only = query_terms(docs.sparkSession, queries, stop, case_fold)
    return ranked(index.postings(docs, kind, b, k, stop, only), asked)


def search_stored(postings: DataFrame, queries: dict[str, str], stop: tuple[str, ...] = ()) -> DataFrame:
    """query, doc_id, score from stored postings; the terms reach the scan."""
    asked, only = query_terms(postings.sparkSession, queries, stop)
    return ranked(postings.where(F.col("term").isin(*only) if only else F.lit(False)), asked)
