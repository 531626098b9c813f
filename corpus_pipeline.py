"""Corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; `run` writes it
as Parquet to the shared folder and rereads it as the next stage's docs. All stages but the last return the
columns of docs. Each begins by having the executors give back the heap that the one before has left.

Defined cases, for every stage: every row is decided by itself, whether or not it shares its id with others;
of rows with equal id and text stage 2 keeps one; stage 4 may return a row more than once; rows without an id
are treated like any other (stage 2 prefers rows that have one); an empty table passes through; columns of docs
beside doc_id and text pass through whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import copies, langid, mixing, packing, pii
from corpuscle.llm.shared import release, stored, trim_heaps, tucked, untucked


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin stay; a missing lang is filled in."""
    trim_heaps(spark)
    model = langid.fit(docs.select("doc_id", "lang", "text"))
    packed = docs.select(F.struct(*docs.columns).alias("row_"), F.col("text").alias("text_"))
    told = langid.predict(packed, model, "text_").where(~F.col("rejected"))
    lang = F.coalesce("row_.lang", "lang_pred").alias("lang")
    return told.select(*(lang if c == "lang" else F.col("row_")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8) the document with the smallest id
    stays, and of its rows the one whose text has the smallest digest."""
    trim_heaps(spark)
    groups = stored(copies.near_copies(docs).where("representative").select(F.col("doc_id").alias("id_"), "text_key"), "groups")
    trim_heaps(spark)
    rows, names = tucked(docs, "text", id_=F.col("doc_id"), text_key=copies.text_key(F.col("text")))
    other = groups.distinct().select(F.col("id_").alias("other"), F.col("text_key").alias("key"))
    kept = rows.join(other, F.col("id_").eqNullSafe(F.col("other")) & (F.col("text_key") == F.col("key")), "left_semi")
    if groups.count() > other.count():  # some rows are alike in id and text
        kept = kept.dropDuplicates(["id_", "text_key"])
    return untucked(kept, names, {"text": F.col("text")}).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    trim_heaps(spark)
    out = pii.redacted(pii.with_spans(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: once, if it wholly belongs to the first domain."""
    trim_heaps(spark)
    return mixing.taken(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. Workers of a pipeline have other stages to run: they
    keep nothing of a task."""
    import public_tokenizers

    trim_heaps(spark)
    return packing.packed(docs, public_tokenizers.path(packing.TOKENIZER), keep=False)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("PII", personal_data), ("mixing", mixed), ("packing", packed)]
#: Compression, bit counts over hashes and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            release(before)
        before = docs
    return docs
