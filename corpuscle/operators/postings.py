"""Posting lists: scored intersection and union, gaps and their code lengths.

All intersection strategies are one inner join on doc_id with added scores; a strategy only names a
physical hint: the merging ones sort both lists, the searching ones hash the second list, `hybrid` leaves the
choice to the adaptive planner, which knows the lists' sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Strategy -> join hint of the second list.
STRATEGIES = {"basic": "merge", "less_conditional": "merge", "sentinel": "merge", "skip_pointer": "merge", "binary_search": "shuffle_hash", "galloping": "shuffle_hash", "hybrid": None}


def intersect(left: DataFrame, right: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """doc_id, score of the ids in both lists. Neither list may repeat an id."""
    hint = STRATEGIES[strategy]
    other = right.select("doc_id", F.col("score").alias("score_"))
    return left.join(other.hint(hint) if hint else other, "doc_id").select("doc_id", (F.col("score") + F.col("score_")).alias("score"))


def intersect_all(lists: list[DataFrame]) -> DataFrame:
    """Many lists at once: one aggregate instead of a chain of joins."""
    rows = reduce(DataFrame.unionByName, (x.select("doc_id", "score") for x in lists))
    return rows.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n_")).where(F.col("n_") == len(lists)).drop("n_")


def intersect_ids(lists: list[DataFrame]) -> DataFrame:
    """doc_id of the first list that are in all others; it keeps its repeats."""
    return reduce(lambda a, b: a.join(b.select("doc_id"), "doc_id", "left_semi"), lists)


def union(lists: list[DataFrame]) -> DataFrame:
    """doc_id, score: ids of any list, scores added."""
    return reduce(DataFrame.unionByName, (x.select("doc_id", "score") for x in lists)).groupBy("doc_id").agg(F.sum("score").alias("score"))


def counted_union(lists: list[DataFrame], key: str = "word_id") -> DataFrame:
    """key, cnt: how often an id is in the lists together."""
    return reduce(DataFrame.unionByName, (x.select(key) for x in lists)).groupBy(key).agg(F.count("*").alias("cnt"))


def gaps(postings: DataFrame, size: int = 1 << 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """term, doc_id, keep..., gap: the distance to the term's previous id (of the first: the id itself). A
    term's list is cut into ranges of ids, so that a term of every document has many tasks; the ranges' last
    ids are linked by a second, small window."""
    rows = postings.select("term", "doc_id", *keep).withColumn("range_", F.floor(F.col("doc_id") / size))
    inner = Window.partitionBy("term", "range_").orderBy("doc_id")
    ends = rows.groupBy("term", "range_").agg(F.max("doc_id").alias("end_"))
    ends = ends.withColumn("before_", F.lag("end_", 1, 0).over(Window.partitionBy("term").orderBy("range_"))).drop("end_")
    return rows.withColumn("prev_", F.lag("doc_id").over(inner)).join(ends, ["term", "range_"]).select("term", "doc_id", *keep, (F.col("doc_id") - F.coalesce("prev_", "before_")).alias("gap"))
