"""k-means on dense vectors: assignment by the largest dot product, means, residual sum of squares.

The k centroids are a parameter-sized set on the driver; vectors stay distributed, and a step is one pass
with partial sums for each cluster and dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _centres(centroids: dict[int, list[float]]) -> Column:
    return F.array(*(F.struct(F.lit(int(k)).alias("cluster"), F.array(*(F.lit(float(x)) for x in v)).alias("v")) for k, v in sorted(centroids.items())))


def assign(vectors: DataFrame, centroids: dict[int, list[float]], places: int = 9) -> DataFrame:
    """vectors (vec_id, v) with cluster, sim: ties, after rounding, go to the higher cluster."""
    best = F.array_max(F.transform(_centres(centroids), lambda c: F.struct(F.round(dot(F.col("v"), c["v"]), places).alias("sim"), c["cluster"].alias("cluster"))))
    return vectors.withColumn("best_", best).select("*", F.col("best_.cluster").alias("cluster"), F.col("best_.sim").alias("sim")).drop("best_")


def means(assigned: DataFrame) -> DataFrame:
    """cluster, dim, x: the mean of each cluster."""
    rows = assigned.select("cluster", F.posexplode("v").alias("dim", "x"))
    return rows.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))


def collected(means_: DataFrame) -> dict[int, list[float]]:
    out: dict[int, list[float]] = {}
    for row in sorted(means_.collect(), key=lambda r: (r["cluster"], r["dim"])):
        out.setdefault(row["cluster"], []).append(row["x"])
    return out


def rss(assigned: DataFrame, centroids: dict[int, list[float]]) -> DataFrame:
    """rss: squared distances to the own centroid, summed."""
    centre = F.create_map(*(x for k, v in sorted(centroids.items()) for x in (F.lit(int(k)), F.array(*(F.lit(float(y)) for y in v)))))
    square = F.aggregate(F.zip_with("v", centre[F.col("cluster")], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return assigned.agg(F.sum(square).alias("rss"))


def kmeans(vectors: DataFrame, centroids: dict[int, list[float]], rounds: int = 20) -> Iterator[tuple[dict[int, list[float]], DataFrame]]:
    """The centroids of each round and the assignment by them, until they stay the same. Vectors are read
    anew each round; nothing of a round but its centroids is kept, so lineage does not grow."""
    for _ in range(rounds):
        assigned = assign(vectors, centroids)
        yield centroids, assigned
        after = centroids | collected(means(assigned))
        if after == centroids:
            return
        centroids = after


def best_k(costs: dict[int, float], penalty: float) -> int:
    """The number of clusters with the least rss + penalty * k."""
    return min(costs, key=lambda k: (costs[k] + penalty * k, k))
