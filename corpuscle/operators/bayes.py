"""Multinomial Naive Bayes on text: training, prediction, evaluation, top words.

The model is wide: one row for each word with an array over the classes, so that scoring joins a document's
words once, however many classes there are. Words that a class lacks get their smoothed value there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions.text import lowered_words
from corpuscle.operators.index import with_term_values

EPSILON = 0.1


def counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep..., word, cnt."""
    return docs.select(*keep, F.explode(lowered_words(F.col(text))).alias("word")).groupBy(*keep, "word").agg(F.count("*").alias("cnt"))


def priors(labelled: DataFrame) -> DataFrame:
    """class, p_c over all labelled documents, of which one without words is one too."""
    total = labelled.where("class IS NOT NULL").count()
    return labelled.where("class IS NOT NULL").groupBy("class").agg((F.count("*") / F.lit(float(total))).alias("p_c"))


def train(labelled: DataFrame, text: str = "text", epsilon: float = EPSILON) -> tuple[list, DataFrame]:
    """The classes in order, and word, p (array over the classes): (n_wc + eps) / (n_c + eps * |V|)."""
    known = labelled.where("class IS NOT NULL")
    classes = sorted(r["class"] for r in known.select("class").distinct().collect())
    by_class = [F.sum(F.when(F.col("class") == c, F.col("cnt")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(classes)]
    words = counts(known, ["class"], text).groupBy("word").agg(*by_class)
    totals = words.agg(F.count("*").alias("v"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(classes)))).first()
    p = [(F.col(f"c{i}") + epsilon) / F.lit((totals[f"c{i}"] or 0) + epsilon * totals["v"]) for i in range(len(classes))]
    return classes, words.select("word", F.array(*p).alias("p"))


def likelihood(classes: list, model: DataFrame) -> DataFrame:
    """class, word, p_wc: the model, a row for each pair."""
    return model.select("word", F.posexplode("p").alias("i", "p_wc")).select(F.get(F.lit(classes), F.col("i")).alias("class"), "word", "p_wc")


def predict(docs: DataFrame, classes: list, model: DataFrame, prior: dict | None = None, text: str = "text") -> DataFrame:
    """doc_id, class: the class of the largest sum of log2 likelihoods over a document's known words, the
    first of equals; without known words the first. With prior (class -> p) its logarithm is added."""
    words = with_term_values(counts(docs, ["doc_id"], text), model, on="word")
    sums = [F.sum(F.col("cnt") * F.log2(F.get("p", F.lit(i)))).alias(f"s{i}") for i in range(len(classes))]
    scores = docs.select("doc_id").distinct().join(words.groupBy("doc_id").agg(*sums), "doc_id", "left")
    value = [F.round(F.coalesce(f"s{i}", F.lit(0.0)) + (F.log2(F.lit(prior[c])) if prior else 0.0), 6) for i, c in enumerate(classes)]
    best = F.greatest(*value) if len(value) > 1 else value[0]
    return scores.select("doc_id", F.get(F.lit(classes), F.array_position(F.array(*value), best).cast("int") - 1).alias("class"))


def evaluate(predicted: DataFrame, truth: DataFrame, classes: list) -> DataFrame:
    """class, precision, recall, f1 for every class, from doc_id, class on both sides."""
    both = truth.select("doc_id", F.col("class").alias("true_")).join(predicted.select("doc_id", F.col("class").alias("said_")), "doc_id")
    row = both.agg(*(f for i, c in enumerate(classes) for f in (
        F.count(F.when((F.col("true_") == c) & (F.col("said_") == c), 1)).alias(f"tp{i}"), F.count(F.when(F.col("said_") == c, 1)).alias(f"s{i}"), F.count(F.when(F.col("true_") == c, 1)).alias(f"t{i}"),
    )))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"tp{i}").alias("tp"), F.col(f"s{i}").alias("s"), F.col(f"t{i}").alias("t")) for i, c in enumerate(classes))))
    tiny = 1e-7
    rates = row.select(each.alias("x")).select("x.class", (F.col("x.tp") / (F.col("x.s") + tiny)).alias("precision"), (F.col("x.tp") / (F.col("x.t") + tiny)).alias("recall"))
    return rates.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + tiny))


def top_words(classes: list, model: DataFrame, k: int = 20, stop: DataFrame | None = None) -> DataFrame:
    """class, rank, word, p_wc: the k likeliest words of each class, ties by word."""
    words = model.join(F.broadcast(stop), "word", "left_anti") if stop is not None else model
    order = Window.partitionBy("class").orderBy(F.desc("p_wc"), "word")
    return likelihood(classes, words).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
