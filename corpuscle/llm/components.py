"""Connected components by alternating large-star and small-star steps on an edge table.

Every step is an aggregate and a join on the node, so no node's neighbours meet in one task (a hot node's
rows are pre-aggregated, and its join partition can be split). Each step's edges are written to the shared
folder, which cuts lineage; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import release, stored


def _large(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours and itself to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges: u, v (long, not null); rows: a bound of their number, if one is known. Returns u, v: for each node but the smallest of its component, that
    smallest node. Self loops and repeated edges do no harm; no edges give no rows."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", rows)
    rows, seen = edges.count(), None
    while True:
        edges, before = stored(_small(_large(edges)), "edges", rows), edges
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges
        rows, seen = now[0], now
