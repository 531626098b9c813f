"""Latent semantic indexing over a vocabulary of bounded size (its most frequent terms).

The terms' Gram matrix is one distributed aggregate; its eigenvectors are the left singular vectors. Only
that matrix (terms by terms) meets the driver. Scores in the concept space then need one more pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 2000
#: Columns that a task makes dense at once.
STEP = 512


def gram(columns: DataFrame, m: int) -> np.ndarray:
    """A * A^T of a matrix whose columns are rows here: doc_id, v (array of m values). Each task sums the
    products of its own columns; a matrix for each task meets in the last sum."""
    if m > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((m, m))
        for batch in batches:
            values = batch.column(0).values.to_numpy(zero_copy_only=False).reshape(-1, m).astype(float)
            total += values.T @ values
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "x"])

    rows = columns.select("v").mapInArrow(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((m, m))
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["x"].to_numpy()
    return out


def concepts(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and their left vectors (columns), from the Gram matrix."""
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0)), vectors[:, order]


def expansion(u: np.ndarray, threshold: float | None = None) -> np.ndarray:
    """U_k * U_k^T: the query expansion matrix; with a threshold its 0-1 form."""
    t = u @ u.T
    return t if threshold is None else (t >= threshold - 1e-9).astype(float)


def scores(columns: DataFrame, query: list[float], matrix: np.ndarray) -> DataFrame:
    """doc_id, score = (q^T * matrix) * d for every column d."""
    weights = F.array(*(F.lit(float(x)) for x in np.asarray(query, float) @ matrix))
    return columns.select("doc_id", F.aggregate(F.zip_with("v", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))


def concept_columns(columns: DataFrame, s: np.ndarray, u: np.ndarray) -> DataFrame:
    """doc_id, c: the documents in concept space, S^-1 * U^T * d for every column d."""
    rows = (u / np.where(s > 0, s, 1.0)).T
    product = lambda row: F.aggregate(F.zip_with("v", F.array(*(F.lit(float(x)) for x in row)), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return columns.select("doc_id", F.array(*map(product, rows)).alias("c"))


def concept_scores(concepts_: DataFrame, query: list[float], s: np.ndarray, u: np.ndarray) -> DataFrame:
    """doc_id, score from stored documents in concept space: the query is mapped there, (U^T * q) * S, and
    multiplied with each. The same scores as `scores` with the expansion matrix of u."""
    weights = F.array(*(F.lit(float(x)) for x in (np.asarray(query, float) @ u) * s))
    return concepts_.select("doc_id", F.aggregate(F.zip_with("c", weights, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x).alias("score"))


def sparse_columns(postings: DataFrame, terms: list[str], docs: DataFrame) -> DataFrame:
    """doc_id, at, x: the places in `terms` and the values of every document's terms that are among them."""
    places = docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, i int")
    found = postings.join(F.broadcast(places), "term").groupBy("doc_id", "i").agg(F.max("score").cast("double").alias("x"))
    wide = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))
    return docs.select("doc_id").join(wide, "doc_id", "left").select("doc_id", F.coalesce("c.i", F.array().cast("array<int>")).alias("at"), F.coalesce("c.x", F.array().cast("array<double>")).alias("x"))


def sparse_gram(columns: DataFrame, m: int) -> np.ndarray:
    """The Gram matrix of such columns. A task makes STEP columns dense at once; the rows of the tasks'
    matrices are dealt out and summed by their place."""
    if m > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((m, m))
        for batch in batches:
            for k in range(0, len(batch), STEP):
                at, x = (c.slice(k, STEP) for c in batch.columns)
                sizes = at.value_lengths().to_numpy()
                dense = np.zeros((len(at), m))
                dense[np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy()] = x.flatten().to_numpy()
                total += dense.T @ dense
        used = np.flatnonzero(total.any(axis=1))
        for k in range(0, len(used), 64):
            part = used[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([r.tobytes() for r in total[part]], pa.binary())], names=["i", "row"])

    def summed(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(row)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], names=["i", "row"])

    rows = columns.select("at", "x").mapInArrow(partial, "i int, row binary").repartition("i").mapInArrow(summed, "i int, row binary").toArrow()
    out = np.zeros((m, m))
    for i, row in zip(rows["i"].to_pylist(), rows["row"].to_pylist()):
        out[i] = np.frombuffer(row)
    return out


def sparse_scores(columns: DataFrame, query: list[float], matrix: np.ndarray) -> DataFrame:
    """`scores` for sparse columns."""
    weights = np.asarray(query, float) @ matrix
    kind = columns.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, at, x = batch.columns
            owner = np.repeat(np.arange(len(batch)), at.value_lengths().to_numpy())
            values = np.bincount(owner, x.flatten().to_numpy() * weights[at.flatten().to_numpy()], len(batch))
            yield pa.RecordBatch.from_arrays([ids, pa.array(values)], names=["doc_id", "score"])

    return columns.select("doc_id", "at", "x").mapInArrow(run, f"doc_id {kind}, score double")


def dense_columns(postings: DataFrame, terms: list[str], docs: DataFrame) -> DataFrame:
    """doc_id, v over the given terms, for every document."""
    values = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("score"))), F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(terms)]
    wide = postings.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(*values)
    return docs.select("doc_id").join(wide, "doc_id", "left").select("doc_id", F.array(*(F.coalesce(f"t{i}", F.lit(0.0)) for i in range(len(terms)))).alias("v"))
