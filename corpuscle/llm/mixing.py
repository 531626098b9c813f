"""Mixing sources to target weights by soft membership.

A classifier fitted on labelled rows gives each document posteriors over domains (by default those of the
labels table: toxic; low, if its quality is 0; high). Nonnegative document rates r are then fitted by
distributed projected gradient: least squares between the expected domain totals sum_d r_d n_d p_dk and
target_k * total, in the metric of the token counts n_d, from r = 1, with momentum. In that metric a
document's rate depends on its posteriors and the steps so far alone, so every step is one aggregate of the
small table (id, n, p), which yields a total for each domain, and nothing is written between steps; texts are read twice,
once for the classifier's bounded sample of labelled rows, once for the posteriors.

The classifier is a softmax regression on the presence of TERMS words and a few shape figures, fitted on at
most MAX_LABELLED labelled rows, those with the smallest hashes of their ids. The words are those of the
sample that tell its domains apart best, by the chi-square statistic of their presence. Tokens are words here:
runs of characters other than ASCII white space.

Defined cases: a null text is empty: no tokens; it has posteriors like any other and its rate does no
harm. Labels with a null or without a document are left out. Without any labelled row all posteriors are
equal. Repeated rows are rows of their own. A target domain that no document belongs to stays unmet; a first
domain that nothing is to be taken of leaves the rates as the steps have them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpuscle.llm.shared import documents, extended, map_texts, stored, tucked, untucked

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.88, "low": 0.10, "toxic": 0.02}
MAX_LABELLED = 4000
TERMS = 256
#: A term has so many bytes at most, and so many documents of the sample at least.
TERM_BYTES, TERM_DOCUMENTS = 64, 5
MARKS = b".,;:!?\"'()[]|#*$%&<>"
SHAPES = 5
STEPS = 150
#: Fitted when no domain's total is off by more than this share of all.
TOLERANCE = 0.0005


@dataclass(frozen=True)
class Classifier:
    """Words with their rows of `weights`, below which are those of the shape figures; columns are domains."""

    terms: dict[bytes, int]
    weights: np.ndarray


def features(data: bytes | None) -> tuple[set[bytes], list[float], int]:
    """Distinct words without marks around them, shape figures, number of words."""
    data = data or b""
    words = data.lower().split()
    distinct = set(words)
    n = max(1, len(words))
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">")))
    shape = [1.0, min(2.0, symbols / n), min(2.0, data.count(b"|") / n), 1 - len(distinct) / n, min(2.0, sum(map(data.count, (b"!", b"?"))) / n)]
    return {w.strip(MARKS) for w in distinct}, shape, len(words)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = MAX_LABELLED) -> DataFrame:
    """domain (place in DOMAINS), text of at most `rows` labelled documents, by hash of the id; a repeated id
    counts once, with its last domain and its first text."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    given = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", domain.alias("domain"))
    chosen = given.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("domain", "text")


def telling_terms(sample: DataFrame, domains: int, most: int = TERMS) -> dict[bytes, int]:
    """The words whose presence depends on the domain most, by chi-square; ties by the word."""
    words = map_texts(sample, lambda rows, texts: [*rows.columns, [[w for w in features(x)[0] if 0 < len(w) <= TERM_BYTES] for x in texts]], "domain int, words array<binary>")
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    n, seen = float(sum(sizes.values())), F.col("seen")
    counted = words.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("seen"), *(F.count(F.when(F.col("domain") == k, 1)).alias(f"c{k}") for k in range(domains)))
    chi = F.lit(0.0)
    for k, size in sizes.items():
        expected = seen * F.lit(size / n)
        chi = chi + (F.col(f"c{k}") - expected) ** 2 / expected
    chi = F.when(seen < n, chi / (1 - seen / F.lit(n))).otherwise(0.0)
    top = counted.where(seen >= TERM_DOCUMENTS).orderBy(F.round(chi, 6).desc(), "word").limit(most).select("word").collect()
    return {bytes(r["word"]): i for i, r in enumerate(top)}


def fit_classifier(sample: DataFrame, domains: int = len(DOMAINS), steps: int = 200) -> Classifier:
    """sample: domain, text."""
    sample = stored(sample, "sample")
    terms = telling_terms(sample, domains)

    def step(rows, texts):
        found = [features(x) for x in texts]
        return [*rows.columns, [sorted(terms[w] for w in x[0] if w in terms) for x in found], [x[1] for x in found]]

    rows = sorted(map(tuple, map_texts(sample, step, "domain int, at array<int>, shape array<double>").collect()))
    x = np.zeros((len(rows), len(terms) + SHAPES), np.float32)
    y = np.zeros((len(rows), domains), np.float32)
    for i, (domain, at, shape) in enumerate(rows):
        x[i, at] = 1
        x[i, len(terms) :] = shape
        y[i, domain] = 1
    weights = np.zeros((len(terms) + SHAPES, domains), np.float32)
    scale = np.full_like(weights, 1e-6)
    for _ in range(steps if rows else 0):  # AdaGrad over all rows
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gradient = x.T @ (p / p.sum(axis=1, keepdims=True) - y) / len(x) + 1e-3 * weights
        scale += gradient**2
        weights -= 0.1 * gradient / np.sqrt(scale)
    return Classifier(terms, weights)


def judged(texts: list[bytes | None], model: Classifier) -> tuple[list[int], np.ndarray]:
    """Numbers of words, and posteriors (rows)."""
    terms, weights = model.terms, model.weights
    counts, z = [], np.zeros((len(texts), weights.shape[1]))
    for i, x in enumerate(texts):
        words, shape, n = features(x)
        z[i] = weights[sorted(terms[w] for w in words if w in terms)].sum(axis=0) + np.array(shape) @ weights[len(terms) :]
        counts.append(n)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return counts, p / p.sum(axis=1, keepdims=True)


def posteriors(df: DataFrame, model: Classifier, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """The rows of df without text, with n_tokens and p_<domain>, in place of columns of these names."""

    def step(texts):
        counts, p = judged(texts, model)
        return [counts, *p.T]

    return extended(df, step, "n_tokens long, " + ", ".join(f"p_{d} double" for d in domains))


class Rates:
    """Fitted rates: a history of gradient steps, and a scale such that a document that wholly belongs to the
    first domain is taken once; a common factor leaves all shares as they are."""

    def __init__(self, names: list[str], history: list[tuple[float, np.ndarray]]):
        self.names, self.history = names, history
        first = rates_after(np.eye(1, len(names)), history)[0]
        self.scale = 1 / first if first > 0 else 1.0

    def of(self, p: np.ndarray) -> np.ndarray:
        return rates_after(p, self.history) * self.scale


def fit_rates(table: DataFrame, targets: dict[str, float] = TARGETS) -> Rates:
    """table (small, stored): n_tokens and p_<domain>. The total that the steps aim at is such that the first
    domain of `targets` keeps its tokens."""
    names = list(targets)
    p, n = [F.col(f"p_{k}") for k in names], F.col("n_tokens")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = table.agg(*(F.coalesce(F.sum(n * c), F.lit(0.0)) for c in p), *(F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)) for i, j in pairs)).first()
    now, square = np.array(moments[: len(names)]), np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, moments[len(names) :], strict=True):
        square[i, j] = square[j, i] = value
    if not now.sum():
        return Rates(names, [])
    total = now[0] / targets[names[0]]
    wanted, length = total * np.array([targets[k] for k in names]), 1 / np.linalg.eigvalsh(square)[-1]
    history: list[tuple[float, np.ndarray]] = []
    before, momentum = now, 1.0
    while len(history) < STEPS and np.abs(now - wanted).max() > TOLERANCE * total:
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        push, momentum = (momentum - 1) / following, following
        history.append((push, length * (now + push * (now - before) - wanted)))
        before, now = now, expected_totals(table, names, history)
        if np.linalg.norm(now - wanted) > np.linalg.norm(before - wanted):
            momentum = 1.0  # it went too far: start gathering speed anew
    return Rates(names, history)


def rates_after(p: np.ndarray, history: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """The rates of documents with posteriors p (rows) after the steps of a history: each is a push along
    the last change and a gradient in the domains, and the projection to rates of 0 and more."""
    rate = before = np.ones(len(p))
    for push, gradient in history:
        rate, before = np.maximum(0, rate + push * (rate - before) - p @ gradient), rate
    return rate


def _posterior_columns(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(f"p_{k}").to_numpy(zero_copy_only=False) for k in names], axis=1)


def expected_totals(table: DataFrame, names: list[str], history: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Expected tokens of each domain at the rates of a history: a partial sum from each task. The plan is
    the same for every step; the history goes with the function."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(len(names))
        for batch in batches:
            p = _posterior_columns(batch, names)
            total += (batch.column("n_tokens").to_numpy(zero_copy_only=False) * rates_after(p, history)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

    sums = table.mapInArrow(run, ", ".join(f"`{k}` double" for k in names)).agg(*(F.sum(k) for k in names)).first()
    return np.array(sums, float)


def with_rates(table: DataFrame, rates: Rates) -> DataFrame:
    """table with `rate`."""
    schema = StructType([*table.schema.fields, StructField("rate", DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates.of(_posterior_columns(batch, rates.names)))], names=[*batch.schema.names, "rate"])

    return table.mapInArrow(run, schema)


def copies(key: Column, rate: Column) -> Column:
    """How often a document is taken: its rate, rounded up or down by a hash of its key."""
    share = F.shiftrightunsigned(F.xxhash64(key, F.lit("mix")), 11) / float(1 << 53)
    return F.floor(F.round(rate, 9) + share).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate of each row of docs (doc_id, text)."""
    model = fit_classifier(labelled_sample(docs, labels))
    table = stored(posteriors(docs.select("doc_id", "text"), model), "posteriors")
    return with_rates(table, fit_rates(table, targets))


def taken(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as its rate says, so that the tokens of what is returned have the
    target shares. Every row is drawn by itself: its rate follows from its text once the steps are fitted, so
    nothing is joined back by a key that rows may share."""
    model = fit_classifier(labelled_sample(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels))
    rates = fit_rates(stored(posteriors(docs.select(F.col(text).alias("text")), model), "posteriors"), targets)
    rows, names = tucked(docs, text, draw=F.xxhash64(key, text))

    def step(rows, texts):
        return [*rows.columns, texts, rates.of(judged(texts, model)[1])]

    schema = StructType([rows.schema["in_"], rows.schema["draw"], StructField("whole", docs.schema[text].dataType), StructField("rate", DoubleType())])
    rated = map_texts(rows, step, schema)
    often = rated.withColumn("often", copies(F.col("draw"), F.col("rate"))).where("often > 0")
    each = often.withColumn("often", F.explode(F.sequence(F.lit(1).cast("long"), F.col("often"))))
    return untucked(each, names, {text: F.col("whole")}).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("copies", copies(F.col("doc_id"), F.col("rate")))
