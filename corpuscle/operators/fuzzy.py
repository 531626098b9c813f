"""Error-tolerant prefix search: q-gram candidates, count filter, prefix edit distance, ranking.

The cheap count comes first; the distance is worked out for candidates that pass it only. Queries are a
stated, small set and go to every task; the index and the entities may be of any size and never meet the
driver, whatever Spark takes their sizes to be: q-grams are many times the file that they come from. As is usual for this search, only entities that share a q-gram
with the query are candidates: where the count filter lets everything pass (its bound is 0 or less, as for
short queries with a delta) entities without one are missed, unless `complete` asks for them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import normal, prefix_edit_distance, qgrams


def qgram_index(entities: DataFrame, q: int = 3, pad: str = "both") -> DataFrame:
    """qgram, word_id; a row for each occurrence."""
    return entities.select(F.explode(qgrams(F.col("name"), q, pad)).alias("qgram"), "word_id")


def with_delta(queries: DataFrame) -> DataFrame:
    """queries (x) with delta = a quarter of the normal form's length, where it is not given."""
    return queries if "delta" in queries.columns else queries.withColumn("delta", F.floor(F.length(normal(F.col("x"))) / 4).cast("int"))


def candidates(index: DataFrame, queries: DataFrame, q: int = 3, pad: str = "both") -> DataFrame:
    """x, delta, word_id, cnt: common q-grams, each occurrence on either side counting."""
    asked = with_delta(queries).select("x", "delta", F.explode(qgrams(F.col("x"), q, pad)).alias("qgram"))
    return index.join(F.broadcast(asked), "qgram").groupBy("x", "delta", "word_id").agg(F.count("*").alias("cnt"))


def checked(entities: DataFrame, queries: DataFrame, q: int = 3, pad: str = "both", raw_length: bool = False, index: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """Candidates that pass the filters, with ped: the rows whose distance is worked out. With raw_length
    the filter takes the bytes of x as given and, at delta 0, the name as given must start with it. index: a
    stored q-gram index of the entities. complete: queries whose filter lets everything pass are held against
    all entities, the stated queries against each row."""
    size = F.octet_length("x") if raw_length else F.length(normal(F.col("x")))
    least = size - 1 - F.col("delta") * q
    asked = with_delta(queries).withColumn("loose_", (least <= 0) & F.lit(complete))
    found = candidates(qgram_index(entities, q, pad) if index is None else index, asked.where("NOT loose_"), q, pad)
    found = found.where(F.col("cnt") >= least).join(entities.hint("merge"), "word_id")
    if complete:
        all_ = entities.join(F.broadcast(asked.where("loose_").select("x", "delta")), how="cross")
        found = found.unionByName(all_.withColumn("cnt", F.lit(None).cast("long")))
    begins = F.startswith(F.col("name"), F.col("x")) if raw_length else F.startswith(normal(F.col("name")), normal(F.col("x")))
    found = found.where((F.col("delta") > 0) | begins)
    return found.withColumn("ped", prefix_edit_distance(normal(F.col("x")), normal(F.col("name")), F.col("delta")))


def matches(entities: DataFrame, queries: DataFrame, q: int = 3, pad: str = "both", raw_length: bool = False, index: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """x, word_id, name, score, description, ped of entities within delta. rank_order() ranks them."""
    return checked(entities, queries, q, pad, raw_length, index, complete).where("ped <= delta").select("x", "word_id", "name", "score", "description", "ped")


def rank_order() -> list:
    """Ascending distance, descending score, ascending id."""
    return [F.asc("ped"), F.desc("score"), F.asc("word_id")]
