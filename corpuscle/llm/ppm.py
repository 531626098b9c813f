"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ORDER bytes, pretrained on all training documents: a
distributed table of codes (a context of ORDER bytes and the byte that follows it, as one number) with their
counts, which grows with the corpus and is nowhere held as a whole. Each level above it is that table without
the contexts' first byte. In a context of t bytes of which d are distinct, a byte seen n times has n / (t + d),
the escape to the next shorter context d / (t + d) (method C); what the longer context has seen is excluded
there; below the empty context every byte left is equally likely. A document's code length is the sum over
its bytes and an end byte 0; ORDER bytes 0 stand before it.

Codes of high counts, FREQUENT at most (twelve bytes each: the proven size of what is broadcast), go to
every task with their probabilities. A document's other codes leave it as rows (code, how often), their
distinct values walk down the levels of the trie by joins, and the logarithms come back by a join and a sum
for each document. The word counts of the whole training corpus, for the add-one unigram score, are used the
same way: the most frequent words of at most WORD_BYTES bytes, TOP at most, go to every task, the rest is
joined; there no short training word can be hot, being rarer than those, and a long one has fewer rows than
the corpus has bytes / WORD_BYTES.

Defined cases: a null text is empty: one token, the end; a null id counts as a training id; no training
rows: N = V = 0 and uniform bytes; repeated rows are counted and scored each; a column named as a made one is
replaced by it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.langid import remainder
from corpuscle.llm.shared import documents, map_texts, release, stored, tucked, untucked

ORDER = 5
FREQUENT = 1 << 20
TOP = 1 << 17
WORD_BYTES = 64
#: Distinct words, and distinct codes, that a task holds before it passes their counts on.
HELD = 400_000
CODES = 1 << 21


def coded(texts: list[bytes | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all bytes of the texts and their end bytes, and the number of the text that each
    belongs to."""
    start = b"\0" * order
    buffer = np.frombuffer(b"".join(start + (x or b"") + b"\0" for x in texts), np.uint8)
    lengths = np.fromiter((len(x or b"") + 1 for x in texts), np.int64, len(texts))
    values = np.zeros(max(0, len(buffer) - order), np.int64)
    for k in range(order + 1):
        values = values << 8 | buffer[k : len(buffer) - order + k]
    of = np.repeat(np.arange(len(texts)), lengths)
    return values[np.arange(len(of)) + of * order], of


def summed(codes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(n), len(found)).astype(np.int64)


def counts(training: DataFrame, order: int = ORDER) -> DataFrame:
    """word or code, n: partial counts of each task. training: text."""
    words: Counter = Counter()
    codes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def rows(last: bool):
        found, n = np.empty(0, np.int64), np.empty(0, np.int64)
        if sum(map(len, codes)) > CODES or last:
            found, n = summed(codes, sizes)
            codes.clear()
            sizes.clear()
            if len(found) <= CODES // 2 and not last:  # few are new: they are held on
                codes.append(found)
                sizes.append(n)
                found = n = found[:0]
        given = dict(words) if last or len(words) > HELD else {}
        if given:
            words.clear()
        if not given and not len(found):
            return None
        return [[*given, *[None] * len(found)], [*[None] * len(given), *found.tolist()], [*given.values(), *n.tolist()]]

    def step(_, texts):
        found, n = np.unique(coded(texts, order)[0], return_counts=True)
        codes.append(found)
        sizes.append(n)
        for x in texts:
            words.update((x or b"").lower().split())
        return rows(False)

    return map_texts(training.select("text"), step, "word binary, code long, n long", finish=lambda: rows(True))


def _bound(size: int) -> int | None:
    """How many strings of so many bytes there are, where that is few."""
    return 256**size if size <= 2 else None


class Trie:
    """Levels 0 to `order` of the trie as stored tables: `codes[k]` (code, ctx, n, low: the count of the
    code without its first byte) and `contexts[k]` (ctx, t, d, u: the sum of low)."""

    def __init__(self, deepest: DataFrame, order: int = ORDER):
        """deepest: code, n."""
        self.order, self.codes, self.contexts = order, [], []
        below = None
        tables = [deepest]
        for k in range(order - 1, -1, -1):
            tables.append(stored(tables[-1].groupBy(self.tail(F.col("code"), k).alias("code")).agg(F.sum("n").alias("n")), f"level{k}", _bound(k + 1)))
        self.levels = tables[1:]
        for k, table in enumerate(reversed(tables)):
            rows = table.select("code", F.shiftright("code", 8).alias("ctx"), "n")
            if k:
                lower = below.select(F.col("code").alias("tail"), F.col("n").alias("low"))
                lower = F.broadcast(lower) if k <= 2 else lower  # at most 65,536 rows
                rows = rows.withColumn("tail", self.tail(F.col("code"), k - 1)).join(lower, "tail").drop("tail")
            else:
                rows = rows.withColumn("low", F.lit(0).cast("long"))
            below = rows if k == 0 else stored(rows, f"codes{k}", _bound(k + 1))
            self.codes.append(below)
            self.contexts.append(stored(below.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("low").alias("u")), f"contexts{k}", _bound(k)))

    def release(self) -> None:
        for table in [*self.levels, *self.codes[1:], *self.contexts]:
            release(table)

    @staticmethod
    def tail(code: Column, k: int) -> Column:
        """The last k + 1 bytes of a code: a code of level k."""
        return code.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))

    def seen(self, codes: DataFrame) -> DataFrame:
        """codes (code, n of the deepest level) with lp, their log10 probability."""
        both = codes.withColumn("ctx", F.shiftright("code", 8)).join(self.contexts[-1].select("ctx", "t", "d"), "ctx")
        return both.select("code", "n", F.log10(F.col("n") / self.below(F.col("t"), F.col("d"), F.col("d"))).alias("lp"))

    @staticmethod
    def below(t: Column, d: Column, distinct: Column) -> Column:
        """What counts are divided by: there is no escape from a context that has seen every byte."""
        return t + F.when(distinct < 256, d).otherwise(0)

    def walked(self, asked: DataFrame) -> DataFrame:
        """asked: distinct codes. code, lp of each: down the levels until one has seen it."""
        zero = F.lit(0).cast("long")
        rows = asked.select("code", F.lit(0.0).alias("w"), zero.alias("et"), zero.alias("ed"), F.lit(None).cast("double").alias("lp"))
        for k in range(self.order, -1, -1):
            mine, contexts = (x[k] for x in (self.codes, self.contexts))
            found = mine.select(F.col("code").alias("tail"), "n")
            contexts = contexts.select("ctx", "t", "d", "u")
            if k <= 2:  # at most 65,536 contexts; of codes, as many on the level above
                contexts = F.broadcast(contexts)
                found = F.broadcast(found) if k <= 1 else found
            rows = rows.withColumn("tail", self.tail(F.col("code"), k)).join(found, "tail", "left").withColumn("ctx", F.shiftright("tail", 8)).join(contexts, "ctx", "left")
            t, d = F.coalesce("t", zero) - F.col("et"), F.coalesce("d", zero) - F.col("ed")
            below = self.below(t, d, F.coalesce("d", zero))
            known = F.col("n").isNotNull()
            lp = F.coalesce("lp", F.when(known, F.col("w") + F.log10(F.col("n") / below)))
            w = F.col("w") + F.when(~known & (d > 0), F.log10(d / below)).otherwise(0.0)
            rows = rows.select("code", w.alias("w"), F.coalesce("u", zero).alias("et"), F.coalesce("d", zero).alias("ed"), lp.alias("lp"))
        return rows.select("code", F.coalesce("lp", F.col("w") - F.log10(256 - F.col("ed"))).alias("lp"))


def most_frequent(table: DataFrame, top: int, size: str = "n") -> DataFrame:
    """At most `top` of the rows with the highest `size`, without a sort: sizes fall into classes (twenty
    for a factor of e), whose numbers are all that the driver sees, and whole classes are taken from above."""
    level = F.floor(F.log(F.col(size)) * 20)
    taken, least = 0, None
    for row in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        if taken + row["count"] > top:
            break
        taken, least = taken + row["count"], row["level"]
    return table.where(level >= least) if least is not None else table.where(F.lit(False))


def _rest(values: np.ndarray, of: np.ndarray, missing: np.ndarray, n: int) -> list[list[dict]]:
    """For each text the codes at the places `missing`, and how often."""
    out: list[list[dict]] = [[] for _ in range(n)]
    codes, texts = values[missing], of[missing]
    order = np.lexsort((codes, texts))
    codes, texts = codes[order], texts[order]
    new = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (texts[1:] != texts[:-1])))) if len(codes) else np.empty(0, np.int64)
    for i, c, k in zip(texts[new].tolist(), codes[new].tolist(), np.diff(np.append(new, len(codes))).tolist(), strict=True):
        out[i].append({"c": c, "k": k})
    return out


def score(df: DataFrame, train: Column, top: int = TOP, frequent: int = FREQUENT, order: int = ORDER, text: str = "text") -> DataFrame:
    """train: true for the rows to learn from. Returns the rows of df without `text`, with n_tokens,
    n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    given, names = tucked(df, text, train_=F.coalesce(train, F.lit(True)))
    training = given.where("train_").select("text")
    partial = stored(counts(training, order), "counts")
    vocabulary = stored(partial.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    n_docs = training.count()
    size, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, distinct = total + n_docs, size + (n_docs > 0)
    deepest = stored(partial.where("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n")), "deepest")
    trie = Trie(deepest, order)
    held = trie.seen(most_frequent(deepest, frequent)).select("code", F.col("lp").cast("float").alias("lp")).toArrow()
    codes, logs = held["code"].to_numpy(), held["lp"].to_numpy()
    sort = np.argsort(codes)
    words = most_frequent(vocabulary.where(F.octet_length("word") <= WORD_BYTES), top, "c").toArrow()
    model = spark.sparkContext.broadcast((codes[sort], logs[sort], dict(zip(words["word"].to_pylist(), np.log10(np.array(words["c"], np.float64) + 1).tolist(), strict=True))))
    state: list = []

    def step(rows, texts):
        from pyspark import TaskContext

        codes, logs, known = model.value
        if not state:
            state.append(TaskContext.get().partitionId() << 33)
        values, of = coded(texts, order)
        found, at = np.unique(values, return_inverse=True)
        if len(codes):
            place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            hit, log = codes[place] == found, logs[place].astype(np.float64)
        else:
            hit, log = np.zeros(len(found), bool), np.zeros(len(found))
        missing = np.flatnonzero(~hit[at])
        scores = np.bincount(of, np.where(hit, log, 0.0)[at], len(texts))
        n_tokens, n_known, sums, rest = [], [], [], []
        for x in texts:
            words = (x or b"").lower().split()
            logs_ = [v for v in map(known.get, words) if v is not None]
            n_tokens.append(len(words) + 1)
            n_known.append(len(logs_))
            sums.append(math.fsum(logs_))
            rest.append([{"w": w, "k": k} for w, k in Counter([w for w in words if w not in known]).items()] if len(logs_) < len(words) else [])
        ids = range(state[0], state[0] + len(texts))
        state[0] += len(texts)
        return [*rows.columns, n_tokens, n_known, sums, scores, ids, rest, _rest(values, of, missing, len(texts))]

    kind = given.schema["in_"].dataType.simpleString()
    scored = stored(map_texts(given.drop("train_"), step, f"in_ {kind}, n_tokens long, top_known long, top_sum double, score double, row_ long, words_ array<struct<w: binary, k: long>>, codes_ array<struct<c: long, k: long>>"), "scored")
    other = scored.select("row_", F.explode("words_").alias("x")).select("row_", F.col("x.w").alias("word"), F.col("x.k").alias("k"))
    by_words = other.join(vocabulary, "word").groupBy("row_").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_sum"))
    rare = scored.select("row_", F.explode("codes_").alias("x")).select("row_", F.col("x.c").alias("code"), F.col("x.k").alias("k"))
    asked = stored(rare.select("code").distinct(), "asked")
    walked = stored(trie.walked(asked), "walked")
    trie.release()
    for table in (partial, deepest, asked):
        release(table)
    by_codes = rare.join(walked, "code").groupBy("row_").agg(F.sum(F.col("k") * F.col("lp")).alias("more_score"))
    zero = lambda name, kind: F.coalesce(F.col(name), F.lit(0).cast(kind))
    out = scored.drop("words_", "codes_").join(by_words, "row_", "left").join(by_codes, "row_", "left")
    base = F.col("top_sum") + zero("more_sum", "double") + F.lit(math.log10(n_docs + 1)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    made = {
        "n_tokens": F.col("n_tokens"), "n_known": F.col("top_known") + zero("more_known", "long") + int(n_docs > 0), "train_tokens": F.lit(total).cast("long"), "base_score": base,
        "score": F.round(F.col("score") + zero("more_score", "double"), 6),
    }
    return untucked(out, names, made)


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 7) == 2
    return score(documents(spark, sf_dir).select("doc_id", held.alias("held_out"), "text"), ~F.col("held_out"))
