"""Vector space model: a sparse term-document matrix as rows, its norms, queries as sparse products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.index import with_term_values

NORMS = {"none": None, "col_l1": ("doc_id", 1), "col_l2": ("doc_id", 2), "row_l1": ("term", 1), "row_l2": ("term", 2)}


def normalised(matrix: DataFrame, norm: str = "none") -> DataFrame:
    """term, doc_id, v without zeros; columns (documents) or rows (terms) divided by their L1 or L2 norm.
    Norms are aggregates joined back, dealt out so that a frequent term's row does not meet in one task."""
    cells = matrix.select("term", "doc_id", F.col("score").alias("v") if "score" in matrix.columns else F.col("v")).where("v <> 0")
    if NORMS[norm] is None:
        return cells
    side, power = NORMS[norm]
    size = F.sum(F.abs("v")) if power == 1 else F.sqrt(F.sum(F.col("v") * F.col("v")))
    norms = cells.groupBy(side).agg(size.alias("norm_"))
    joined = with_term_values(cells, norms) if side == "term" else cells.join(norms, side)
    return joined.select("term", "doc_id", (F.col("v") / F.col("norm_")).alias("v"))


def query(matrix: DataFrame, asked: DataFrame) -> DataFrame:
    """query, doc_id, score: the product of each query's term frequencies (query, term, qtf) with the
    matrix; documents with score 0 are left out."""
    hit = matrix.join(asked, "term").groupBy("query", "doc_id").agg(F.sum(F.col("v") * F.col("qtf")).alias("score"))
    return hit.where("score <> 0")
