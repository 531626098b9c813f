"""Inverted index: tokens, term frequencies, document lengths, corpus figures, dictionary, scores.

A document's length is the size of its array of terms, so it needs no shuffle and travels with the terms.
Shared by all: an index is a set of plain DataFrames; store them as Parquet, clustered by term, to serve
many queries.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import terms as terms_of
from corpuscle.operators.ranking import numbered

SCORES = ("bm25", "bm25_no_idf", "tfidf", "tf")


@dataclass(frozen=True)
class Stats:
    """Number of documents and average length."""

    n: int
    avdl: float


def measured(docs: DataFrame, stop: tuple[str, ...] = (), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, terms, dl of every document; documents without terms have dl 0."""
    found = F.coalesce(terms_of(F.col(text), stop), F.array().cast("array<string>"))
    return docs.select(F.col(key).alias("doc_id"), found.alias("terms")).withColumn("dl", F.size("terms").cast("long"))


def stats(measured_docs: DataFrame) -> Stats:
    """One row meets the driver."""
    row = measured_docs.agg(F.count("*").alias("n"), F.sum("dl").alias("s")).first()
    return Stats(row["n"], row["s"] / row["n"] if row["n"] else 0.0)


def tokens(measured_docs: DataFrame) -> DataFrame:
    """doc_id, dl, pos, term: a row for each occurrence."""
    return measured_docs.select("doc_id", "dl", F.posexplode("terms").alias("pos", "term"))


def term_frequencies(measured_docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """doc_id, dl, term, tf; with `only`, of these terms, filtered before anything is shuffled."""
    rows = measured_docs.select("doc_id", "dl", F.explode("terms").alias("term"))
    if only is not None:
        rows = rows.where(F.col("term").isin(*only) if only else F.lit(False))
    return rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def word_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, freq over all occurrences: partial counts in the map tasks, then one row for each term and task."""
    return docs.select(F.explode(terms_of(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def idf(df: Column, n: int) -> Column:
    return F.log2(F.lit(float(n)) / df)


def score(kind: str, tf: Column, dl: Column, df: Column, at: Stats, b: float = 0.75, k: float = 1.75) -> Column:
    """The score of a posting; k may be infinite."""
    if kind == "tf":
        return tf.cast("double")
    if kind == "tfidf":
        return tf * idf(df, at.n)
    if kind not in SCORES:
        raise ValueError(f"unknown score: {kind}")
    size = 1 - b + b * dl / F.lit(at.avdl or 1.0)
    weight = tf / size if k == inf else tf * (k + 1) / (k * size + tf)
    return weight if kind == "bm25_no_idf" else weight * idf(df, at.n)


#: Parts into which a term's rows are dealt where a value of each term is joined to them.
SALTS = 16


def with_term_values(rows: DataFrame, values: DataFrame, salts: int = SALTS, key: str = "doc_id", on: str = "term") -> DataFrame:
    """rows joined with a row of values for each term. A term of every document would put all its rows
    into one task, and the planner cannot split a side that faces an aggregate; so rows are dealt out by
    document too, and the values, a row for each term, are there once for each part."""
    parts = values.withColumn("salt_", F.explode(F.array(*map(F.lit, range(salts)))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(parts, [on, "salt_"]).drop("salt_")


def postings(docs: DataFrame, kind: str = "bm25", b: float = 0.75, k: float = 1.75, stop: tuple[str, ...] = (), only: list[str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """term, doc_id, tf, dl, df, score."""
    base = measured(docs, stop, text, key)
    tf, at = term_frequencies(base, only), stats(base)
    df = document_frequencies(tf)
    joined = with_term_values(tf, df) if only is None else tf.join(df, "term")
    return joined.select("term", "doc_id", "tf", "dl", "df", score(kind, F.col("tf"), F.col("dl"), F.col("df"), at, b, k).alias("score"))


def dictionary(tokens_: DataFrame) -> DataFrame:
    """term, term_id: 0-based in order of first occurrence (document, then position)."""
    first = tokens_.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return numbered(first.select("term", F.col("first.doc_id").alias("d_"), F.col("first.pos").alias("p_")), [F.col("d_"), F.col("p_")], "term_id").select("term", "term_id")


def save(postings_: DataFrame, path: str) -> None:
    """Writes scored postings as Parquet, ordered by term over ranges of terms, so that a search reads only
    the row groups whose statistics hold its terms: the stored form of an index that serves many queries."""
    postings_.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(path)
