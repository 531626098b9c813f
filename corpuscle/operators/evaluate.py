"""Quality of rankings against relevant documents: P@k, P@R, average precision and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.operators.ranking import ranged


def ranges(results: DataFrame, places: int = 6) -> DataFrame:
    """results (query, doc_id, score) in ranges (part_) of query, score and doc_id, both descending: stored
    once, whatever is asked of the ranking then."""
    rounded = results.select("query", "doc_id", F.round("score", places).alias("score"))
    return ranged(rounded, [F.asc("query"), F.desc("score"), F.desc("doc_id")])


def relevant_ranks(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    """query, doc_id, rank of the relevant documents among rows (from `ranges`). A rank is a place in its
    range plus the sizes of the query's ranges before it: no query's ranking is sorted in one task, and only
    relevant documents are joined."""
    order = [F.desc("score"), F.desc("doc_id")]
    placed = rows.withColumn("place_", F.row_number().over(Window.partitionBy("query", "part_").orderBy(*order)))
    earlier = Window.partitionBy("query").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("query", "part_").agg(F.count("*").alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(earlier), F.lit(0))).drop("n_")
    return placed.join(qrels, ["query", "doc_id"]).join(sizes, ["query", "part_"]).select("query", "doc_id", (F.col("before_") + F.col("place_")).alias("rank"))


def measures(ranks: DataFrame, sizes: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """query, p_at_k, p_at_r, ap for every query of qrels. ranks: those of relevant documents; sizes:
    query, n results. P@k divides by the smaller of k and n, AP by the number of relevant documents."""
    facts = qrels.groupBy("query").agg(F.count("*").alias("r")).join(sizes, "query", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    hits = ranks.withColumn("hit", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).join(facts, "query")

    def among(at: Column) -> Column:
        return F.count(F.when(F.col("rank") <= F.least(at, F.col("n")), 1))

    found = hits.groupBy("query").agg(among(F.lit(k)).alias("at_k"), among(F.col("r")).alias("at_r"), F.sum(F.col("hit") / F.col("rank")).alias("sum_"))
    out = facts.join(found, "query", "left")

    def precision(hit: str, at: Column) -> Column:
        seen = F.least(at, F.col("n"))
        return F.when(seen > 0, F.coalesce(hit, F.lit(0)) / seen).otherwise(0.0)

    return out.select("query", precision("at_k", F.lit(k)).alias("p_at_k"), precision("at_r", F.col("r")).alias("p_at_r"), (F.coalesce("sum_", F.lit(0.0)) / F.col("r")).alias("ap"))


def evaluate(results: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """Measures of each query, from scored results, which are stored once."""
    rows = ranges(results)
    return measures(relevant_ranks(rows, qrels), rows.groupBy("query").agg(F.count("*").alias("n")), qrels, k)


def means(per_query: DataFrame) -> DataFrame:
    """mp_at_k, mp_at_r, map."""
    return per_query.agg(F.avg("p_at_k").alias("mp_at_k"), F.avg("p_at_r").alias("mp_at_r"), F.avg("ap").alias("map"))
