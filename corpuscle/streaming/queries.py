"""An extension: a stream of queries against a stored index, the stream form of an interactive prompt.

The index is a static table; each query of a micro-batch is joined with it. Nothing is kept between
batches, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import terms


def search_stream(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """queries: a stream of query, text. postings: term, doc_id, score. Returns query, doc_id, term, score
    of every hit; scores are summed by the sink's batch, see `summed`."""
    asked = queries.select("query", F.explode(terms(F.col("text"))).alias("term"))
    return asked.join(postings.select("term", "doc_id", "score"), "term").select("query", "doc_id", "term", "score")


def summed(batch: DataFrame) -> DataFrame:
    """query, doc_id, score of one micro-batch, for use in foreachBatch."""
    return batch.groupBy("query", "doc_id").agg(F.sum("score").alias("score"))
