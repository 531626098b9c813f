"""Numbering rows over the whole table without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.sources.storage import stored


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt out by ranges of the given order, with the range's number as part_. It is written, so that
    whatever is counted and numbered from it later sees the same ranges, even if an executor is lost."""
    return stored(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 0-based numbers in the given total order. Rows are dealt out by range; each range counts
    its own, and only the ranges' sizes (a number for each partition) meet."""
    rows, total = ranged(df, order), 0
    offsets = []
    for part, count in sorted((r["part_"], r["count"]) for r in rows.groupBy("part_").count().collect()):
        offsets.append((part, total))
        total += count
    starts = df.sparkSession.createDataFrame(offsets, "part_ int, start_ long")
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return rows.withColumn("within_", within).join(F.broadcast(starts), "part_").withColumn(name, F.col("start_") + F.col("within_") - 1).drop("part_", "start_", "within_")
