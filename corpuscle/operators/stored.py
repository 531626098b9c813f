"""An index that is built once and serves many queries: postings, figures, words and q-grams as Parquet.

Postings are written in ranges of (term, doc_id), sorted, so that a query's terms reach the scan and only the
row groups whose statistics hold them are read. Scores are worked out from tf, dl and df when they are asked
for, so that one index serves every score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import terms
from corpuscle.operators import fuzzy, index
from corpuscle.operators.ranking import numbered
from corpuscle.sources.storage import stored

#: Postings that a file holds at least: small indexes have few files.
FILE_ROWS = 1 << 20


class Index:
    """A stored index at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def stats(self) -> index.Stats:
        row = self._table("stats").first()
        return index.Stats(row["n"], row["avdl"])

    def postings(self, kind: str = "bm25", b: float = 0.75, k: float = 1.75, only: list[str] | None = None) -> DataFrame:
        """term, doc_id, tf, dl, df, score; with `only`, of these terms, which reach the scan."""
        rows, at = self._table("postings"), self.stats()
        if only is not None:
            rows = rows.where(F.col("term").isin(*only) if only else F.lit(False))
        return rows.withColumn("score", index.score(kind, F.col("tf"), F.col("dl"), F.col("df"), at, b, k))

    def entries(self, only: list[str] | None = None) -> DataFrame:
        """doc_id, dl, term, tf."""
        rows = self._table("postings").select("doc_id", "dl", "term", "tf")
        return rows if only is None else rows.where(F.col("term").isin(*only) if only else F.lit(False))

    def lists(self, *terms: str) -> list[DataFrame]:
        """doc_id, score (tf) of each term."""
        rows = self._table("postings")
        return [rows.where(F.col("term") == t).select("doc_id", F.col("tf").alias("score")) for t in terms]

    def words(self) -> DataFrame:
        """word_id (in order of first occurrence), name, score (frequency), description (first language)."""
        return self._table("words")

    def qgrams(self) -> DataFrame:
        """qgram, word_id; a row for each occurrence, sorted by q-gram."""
        return self._table("qgrams")


def build(docs: DataFrame, path: str) -> Index:
    """docs: doc_id, text, perhaps lang. Texts are read twice: for the postings and for the words."""
    spark, base = docs.sparkSession, index.measured(docs)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    at = index.stats(base)
    spark.createDataFrame([(at.n, float(at.avdl))], "n long, avdl double").coalesce(1).write.parquet(f"{path}/stats")
    # both sides of the join are stored, so that a frequent term's partition can be split
    tf = stored(index.term_frequencies(base), "tf")
    df = stored(index.document_frequencies(tf), "df")
    rows = tf.join(df, "term").select("term", "doc_id", "tf", "dl", "df")
    files = max(1, tf.count() // FILE_ROWS)
    rows.repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
    seen = docs.select("doc_id", lang, F.posexplode(terms(F.col("text"))).alias("pos", "name")).groupBy("name").agg(F.count("*").alias("score"), F.min("lang").alias("description"), F.min(F.struct("doc_id", "pos")).alias("first"))
    seen = seen.select("name", "score", "description", F.col("first.doc_id").alias("d_"), F.col("first.pos").alias("p_"))
    numbered(seen, [F.col("d_"), F.col("p_")], "word_id").select("word_id", "name", "score", "description").write.parquet(f"{path}/words")
    out = Index(spark, path)
    grams = fuzzy.qgram_index(out.words())
    grams.repartitionByRange(files, "qgram").sortWithinPartitions("qgram").write.parquet(f"{path}/qgrams")
    return out
