"""Loaders and writers of the text formats, with fixed schemas.

Where a format numbers its lines, the number comes from the place of a line in the file: line numbers need
an order, so such files are read with `lines`, which numbers ranges of a file in parallel. Tables with a key
of their own (Parquet) need none of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window


def lines(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """line (numbered from `first`, over the files in order of their names), value. Each block of a file
    numbers its own lines; only the blocks' sizes meet."""
    block = ["file_", "start_"]
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("start_"), F.monotonically_increasing_id().alias("at_"))
    offsets, total = [], first - 1
    for file, start, n in sorted(map(tuple, rows.groupBy(*block).count().collect())):
        offsets.append((file, start, total))
        total += n
    starts = spark.createDataFrame(offsets, "file_ string, start_ long, before_ long")
    placed = rows.withColumn("place_", F.row_number().over(Window.partitionBy(*block).orderBy("at_")))
    return placed.join(F.broadcast(starts), block).select((F.col("before_") + F.col("place_")).alias("line"), "value")


def _required(condition: Column, value: Column, message: str) -> Column:
    """value, or an error where the condition fails."""
    return F.when(condition, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("value"))))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (1-based line), text: one document a line, title TAB description."""
    return lines(spark, path).select(F.col("line").alias("doc_id"), F.col("value").alias("text"))


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    """The document of an id; the filter reaches the scan."""
    return docs.where(F.col("doc_id") == doc_id)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query, doc_id from lines `query TAB id id ...`; other lines are skipped, an id that is no number is
    an error, repeats count once."""
    rows = spark.read.text(path).withColumn("f", F.split("value", "\t")).where(F.size("f") == 2)
    ids = rows.select(F.get("f", F.lit(0)).alias("query"), F.explode(F.split(F.trim(F.get("f", F.lit(1))), r"\s+")).alias("value"))
    return ids.select("query", _required(F.col("value").rlike(r"^-?\d+$"), F.expr("try_cast(value AS BIGINT)"), "not an id").alias("doc_id")).distinct()


def write_qrels(qrels_: DataFrame, path: str, shift: int = -1) -> None:
    """Lines `query TAB id id ...` with ids moved by `shift`."""
    ids = F.transform(F.sort_array(F.collect_set("doc_id")), lambda x: (x + shift).cast("string"))
    qrels_.groupBy("query").agg(ids.alias("ids")).select(F.concat_ws("\t", "query", F.concat_ws(" ", "ids"))).write.text(path)


def posting_list(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, score: a first line with their number, then `id score` lines; anything else is an error."""
    rows = lines(spark, path).where("line > 1 AND trim(value) <> ''").withColumn("f", F.split(F.trim("value"), r"\s+"))
    ok = F.col("value").rlike(r"^\s*-?\d+\s+-?\d+\s*$")
    return rows.select(*(_required(ok, F.expr(f"try_cast(get(f, {i}) AS BIGINT)"), "not a posting").alias(n) for i, n in enumerate(("doc_id", "score"))))


def entities(spark: SparkSession, path: str) -> DataFrame:
    """word_id (1-based after the header), name, score, description; three columns at least, scores whole."""
    rows = lines(spark, path, 0).where("line > 0").withColumn("f", F.split("value", "\t"))
    ok = (F.size("f") >= 3) & F.coalesce(F.get("f", F.lit(1)).rlike(r"^\s*-?\d+\s*$"), F.lit(False))
    score = _required(ok, F.expr("try_cast(get(f, 1) AS BIGINT)"), "not an entity")
    return rows.select(F.col("line").alias("word_id"), F.get("f", F.lit(0)).alias("name"), score.alias("score"), F.get("f", F.lit(2)).alias("description"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (0-based), class, text from lines `label TAB text`; anything else is an error."""
    rows = lines(spark, path, 0).withColumn("value", F.trim("value")).withColumn("f", F.split("value", "\t"))
    return rows.select(F.col("line").alias("doc_id"), *(_required(F.size("f") == 2, F.get("f", F.lit(i)), "not a labelled line").alias(n) for i, n in enumerate(("class", "text"))))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word: lines that are not blank, once each."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def probabilities(spark: SparkSession, path: str, columns: tuple[str, str] = ("tag1", "tag2")) -> DataFrame:
    """Two names and p from lines of three fields; other lines are skipped; of equal names the last line
    counts."""
    rows = lines(spark, path).withColumn("f", F.split(F.trim("value"), r"\s+")).where(F.size("f") == 3)
    rows = rows.select("line", F.get("f", F.lit(0)).alias(columns[0]), F.get("f", F.lit(1)).alias(columns[1]), F.expr("try_cast(get(f, 2) AS DOUBLE)").alias("p")).where("p IS NOT NULL")
    return rows.groupBy(*columns).agg(F.max_by("p", "line").alias("p"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object of a file without a header."""
    schema = StructType([StructField(n, StringType()) for n in ("subject", "predicate", "object")])
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON array of strings, the form in which query results are printed."""
    return df.select(F.to_json(F.array(*(F.col(c).cast("string") for c in df.columns))).alias("json"))
