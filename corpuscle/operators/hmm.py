"""Hidden Markov model: estimation by counts, Viterbi tagging in log2 space, runs of a tag.

Sentences are rows and are tagged within a row: `tagged` keeps the dictionary as a table and tags by an Arrow
UDF; `viterbi` takes a small model as literals, with built-in functions, whose paths are copied at every step, so
that it is for short sentences; `viterbi_udf` is the same as an Arrow UDF. Ties go to the larger tag.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, END = "BEG", "END"


@dataclass(frozen=True)
class Model:
    """tags in order; trans[(a, b)] and emit[(word, tag)] in log2; impossible pairs are missing."""

    tags: tuple[str, ...]
    trans: dict[tuple[str, str], float]
    emit: dict[tuple[str, str], float]


def model(transitions: DataFrame, emissions: DataFrame) -> Model:
    """From tag1, tag2, p and word, tag, p: model tables, of a size set by the tag set and the dictionary."""
    trans = {(r["tag1"], r["tag2"]): log2(r["p"]) for r in transitions.collect() if r["p"] and r["p"] > 0}
    emit = {(r["word"], r["tag"]): log2(r["p"]) for r in emissions.collect() if r["p"] and r["p"] > 0}
    tags = {t for pair in trans for t in pair} - {BEGIN, END, None}
    return Model(tuple(sorted(tags)), trans, emit)


def sequences(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, words: values of a key in order."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("v_")))).alias("w_")).select(key, F.transform("w_", lambda x: x["v_"]).alias("words"))


def transitions(tagged: DataFrame, key: str, order: list[str]) -> DataFrame:
    """tag1, tag2, p: relative frequencies of neighbours, the start and end of a sequence included."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = tagged.select(key, F.lag("tag", 1, BEGIN).over(w).alias("tag1"), F.col("tag").alias("tag2"), F.lead("tag").over(w).alias("next_"))
    pairs = steps.select("tag1", "tag2").unionByName(steps.where("next_ IS NULL").select(F.col("tag2").alias("tag1"), F.lit(END).alias("tag2")))
    counted = pairs.groupBy("tag1", "tag2").agg(F.count("*").alias("n"))
    return counted.join(counted.groupBy("tag1").agg(F.sum("n").alias("all_")), "tag1").select("tag1", "tag2", (F.col("n") / F.col("all_")).alias("p"))


def emissions(tagged: DataFrame) -> DataFrame:
    """word, tag, p: relative frequencies of words of a tag."""
    counted = tagged.groupBy("word", "tag").agg(F.count("*").alias("n"))
    return counted.join(counted.groupBy("tag").agg(F.sum("n").alias("all_")), "tag").select("word", "tag", (F.col("n") / F.col("all_")).alias("p"))


def _literal_map(pairs: dict[str, float]) -> Column:
    if not pairs:
        return F.lit(None).cast("map<string,double>")
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _likeliest(items: Column, m: Model, emitted) -> Column:
    """A fold over an array whose state is, for each tag that can be reached, the best path that ends there.
    emitted(item, tag): the log probability of an item, null if it is impossible."""
    state = "array<struct<lp:double,tag:string,path:array<string>>>"
    trans = {t: _literal_map({a: p for (a, b), p in m.trans.items() if b == t}) for t in (*m.tags, END)}

    def best(states: Column, to: str, bonus: Column) -> Column:
        reached = F.filter(F.transform(states, lambda s: F.struct((s["lp"] + trans[to][s["tag"]] + bonus).alias("lp"), s["tag"].alias("from_"), s["path"].alias("path"))), lambda x: x["lp"].isNotNull())
        return F.array_max(reached)

    def step(states: Column, item: Column) -> Column:
        def one(tag: str) -> Column:
            b = best(states, tag, emitted(item, tag))
            return F.struct(b["lp"].alias("lp"), F.lit(tag).alias("tag"), F.concat(b["path"], F.array(F.lit(tag))).alias("path"))

        return F.filter(F.array(*(one(t) for t in m.tags)), lambda s: s["lp"].isNotNull()).cast(state)

    start = F.array(F.struct(F.lit(0.0).alias("lp"), F.lit(BEGIN).alias("tag"), F.array().cast("array<string>").alias("path"))).cast(state)
    final = best(F.aggregate(items, start, step), END, F.lit(0.0))
    return F.when(final.isNotNull() & (F.size(items) > 0), F.struct(final["lp"].alias("lp"), final["path"].alias("tags")))


def viterbi(words: Column, m: Model) -> Column:
    """The likeliest tags of an array of words, as struct<lp double, tags array<string>>; null if no path
    has a probability. Built-in functions only; the model's emissions are literals, so the dictionary must be
    small."""
    emit = {t: _literal_map({w: p for (w, t_), p in m.emit.items() if t_ == t}) for t in m.tags}
    return _likeliest(words, m, lambda word, tag: emit[tag][word])


def tagged(rows: DataFrame, key: str, order: list[str], transitions_: DataFrame, emissions_: DataFrame) -> DataFrame:
    """key, words, v (struct<lp, tags>) of sentences (key, order..., word). The dictionary stays a table, a
    row for each word with its log probabilities by tag, and is joined to the words; only the transitions, of
    a size set by the tag set, meet the driver. v.tags is null where no path has a probability."""
    m = model(transitions_, emissions_.limit(0))
    by_tag = [F.max(F.when(F.col("tag") == t, F.col("p"))) for t in m.tags]
    wide = emissions_.groupBy("word").agg(F.array(*by_tag).alias("p_")).select("word", _logs()("p_").alias("e_"))
    items = rows.select(key, *order, "word").join(wide, "word", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "word", "e_"))).alias("w_"))
    return items.select(key, F.transform("w_", lambda x: x["word"]).alias("words"), _tagger(m)(F.transform("w_", lambda x: x["e_"])).alias("v"))


def _logs():
    """An Arrow UDF: binary logarithms of arrays of probabilities, null if impossible. They are those of the C
    library, as the transitions' are: the JVM's differ in the last bit, which decides between paths whose
    probabilities are equal."""
    @F.pandas_udf("array<double>")
    def logs(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda p: [log2(x) if x is not None and x > 0 else None for x in p])

    return logs


def _tagger(m: Model):
    """An Arrow UDF over arrays of emissions (log probabilities by tag, null if impossible)."""
    n = len(m.tags)
    trans = np.array([[m.trans.get((a, b), -np.inf) for b in m.tags] for a in m.tags]).reshape(n, n)
    first, last = (np.array([m.trans.get(p, -np.inf) for p in pairs]) for pairs in ([(BEGIN, t) for t in m.tags], [(t, END) for t in m.tags]))
    tags = m.tags

    @F.pandas_udf("struct<lp:double,tags:array<string>>")
    def tag(sentences: pd.Series) -> pd.DataFrame:
        out = []
        for sentence in sentences:
            emitted = [np.full(n, -np.inf) if e is None else np.array([-np.inf if x is None else x for x in e], float) for e in sentence]
            emitted = [np.where(np.isnan(e), -np.inf, e) for e in emitted]
            lp, back = first + emitted[0], []
            for e in emitted[1:]:
                reach = lp[:, None] + trans
                back.append(n - 1 - np.argmax(reach[::-1], axis=0))  # of equals the larger tag
                lp = reach.max(axis=0) + e
            at = n - 1 - int(np.argmax((lp + last)[::-1]))
            total, path = float((lp + last)[at]), [at]
            if not np.isfinite(total):
                out.append((None, None))
                continue
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            out.append((total, [tags[i] for i in reversed(path)]))
        return pd.DataFrame({"lp": pd.array([x[0] for x in out], "Float64").to_numpy(float, na_value=np.nan), "tags": [x[1] for x in out]})

    return tag


def named_entities(rows: DataFrame, key: str, order: list[str], transitions_: DataFrame, emissions_: DataFrame, tag: str = "NNP") -> DataFrame:
    """key, start (0-based place), text: sentences are tagged, and maximal runs of `tag` joined."""
    found = tagged(rows, key, order, transitions_, emissions_).where("v.tags IS NOT NULL")
    both = F.zip_with("words", "v.tags", lambda w, t: F.struct(w.alias("word"), t.alias("tag")))
    return runs(found.select(key, F.posexplode(both).alias("pos", "x")).select(key, "pos", "x.word", "x.tag"), tag, key)


def viterbi_udf(m: Model):
    """The same as an Arrow UDF with numpy, for tag sets of dozens."""
    @F.pandas_udf("struct<lp:double,tags:array<string>>")
    def tag(words: pd.Series) -> pd.DataFrame:
        n = len(m.tags)
        trans = np.array([[m.trans.get((a, b), -np.inf) for b in m.tags] for a in m.tags]).reshape(n, n)
        first, last = (np.array([m.trans.get(p, -np.inf) for p in pairs]) for pairs in ([(BEGIN, t) for t in m.tags], [(t, END) for t in m.tags]))
        emit: dict[str, np.ndarray] = {}
        for (w, t), p in m.emit.items():
            if t in m.tags:
                emit.setdefault(w, np.full(n, -np.inf))[m.tags.index(t)] = p
        nothing = np.full(n, -np.inf)

        def last_max(x: np.ndarray) -> np.ndarray:  # of equals the larger tag
            return x.shape[0] - 1 - np.argmax(x[::-1], axis=0)

        out = []
        for sentence in words:
            if sentence is None or not len(sentence):
                out.append((None, None))
                continue
            lp, back = first + emit.get(sentence[0], nothing), []
            for w in sentence[1:]:
                reach = lp[:, None] + trans
                back.append(last_max(reach))
                lp = reach.max(axis=0) + emit.get(w, nothing)
            at = int(last_max(lp + last))
            if not np.isfinite((lp + last)[at]):
                out.append((None, None))
                continue
            total, path = float((lp + last)[at]), [at]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            out.append((total, [m.tags[i] for i in reversed(path)]))
        return pd.DataFrame({"lp": pd.array([x[0] for x in out], "Float64").to_numpy(float, na_value=np.nan), "tags": [x[1] for x in out]})

    return tag


def runs(tagged: DataFrame, tag: str, key: str = "sent_id") -> DataFrame:
    """key, start, text: maximal runs of a tag in sent_id, pos, word, tag; words joined by blanks."""
    mine = tagged.where(F.col("tag") == tag)
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    grouped = mine.withColumn("island_", island).groupBy(key, "island_").agg(F.min("pos").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w_"))
    return grouped.select(key, "start", F.concat_ws(" ", F.transform("w_", lambda x: x["word"])).alias("text"))
