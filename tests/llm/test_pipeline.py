"""The pipeline against brute force, stage by stage, and what the operators share."""

import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscle.llm import copies, langid, mixing, shared
from tests.llm.test_contracts import luhn


def plain_language(text, model):
    """Sizes of all pieces under each dictionary, by the plain library."""
    sizes = []
    for content in model.values():
        p = zstandard.ZstdCompressionParameters(**langid.ZSTD, strategy=zstandard.STRATEGY_FAST, write_checksum=False, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        data = text.encode().lower()
        sizes.append(sum(len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE)))
    return sizes


def test_op8_by_the_plain_library(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(table.where(langid.remainder(F.col("doc_id"), 4) != 2).select("doc_id", "lang", "text"))
    for r in langid.op8_language_id(spark, sf).collect():
        text = docs[r["doc_id"]]
        if text and len(text) < 5000 and any(map(str.isalpha, text)):
            sizes = plain_language(text, model)
            low, high, *_ = sorted(sizes)
            assert (r["lang_pred"], r["score"]) == (list(model)[sizes.index(low)], 1 - low / high)


def plain_redaction(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("CARD", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out.append(text[at:start] + f"<{kinds[k][0]}>")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.select("doc_id", "lang", "text"))
    before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf).persist()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and (k == 3 or len(after) == docs.count()), name
        if k == 0:
            want = set()
            for i, t in before.items():
                if t and any(map(str.isalpha, t)):
                    low, high, *_ = sorted(plain_language(t, model))
                    if 1 - low / high >= langid.MIN_MARGIN:
                        want.add(i)
            assert set(after) == want and {r["lang"] for r in docs.collect()} <= {"en", "de"}
        if k == 1:
            words = {i: re.findall("[^\\x20\\x09-\\x0d]+", t.lower()) for i, t in before.items()}
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
            root = {i: i for i in before}
            for i in sorted(before):
                for j in sorted(before):
                    if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                        low, high = sorted((root[i], root[j]))
                        root = {x: low if r == high else r for x, r in root.items()}
            assert set(after) == set(root.values()) and len(after) < len(before)
        if k == 2:
            assert set(after) == set(before)
            for i, t in before.items():
                if "IBAN" not in t and "SSN" not in t:
                    assert after[i] == plain_redaction(t)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if k == 3:
            rates = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(list(before.items()), "doc_id long, text string"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rates.values()])
            n, got = np.array([r["n_tokens"] for r in rates.values()]), np.array([r["rate"] for r in rates.values()])
            # plain projected gradient, without momentum, to the same totals; then one copy of a sure document
            want = (n * p[:, 0]).sum() / 0.88 * np.array([0.88, 0.10, 0.02])
            sums, step = np.zeros(3), 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p)[-1]
            r, sure = np.ones(len(n)), 1.0
            for _ in range(100_000):
                off = (n * r) @ p - want
                if np.abs(off).max() < 1e-4 * want.sum():
                    break
                r, sure = np.maximum(0, r - step * p @ off), max(0, sure - step * off[0])
            shares = lambda x: (n * x) @ p / ((n * x) @ p).sum()
            assert shares(got) == pytest.approx([0.88, 0.10, 0.02], abs=0.003) and shares(r) == pytest.approx(shares(got), abs=0.003) and np.abs(got - r / sure).max() < 0.2
            often = Counter(r["doc_id"] for r in docs.collect())
            assert all(int(x["rate"] + 1e-9) <= often[i] <= int(x["rate"]) + 1 for i, x in rates.items())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    tokenizer, covered = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in after.items()}
    for r in pieces:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]] += r["length"]
    often = Counter(r["doc_id"] for r in docs.collect())
    assert covered == {i: often[i] * len(x) for i, x in ids.items()}


def test_no_row_is_lost_with_its_id(spark, tmp_path):
    long = lambda seed: " ".join(random.Random(seed).choices("one two three four five six seven eight".split(), k=80))
    a, b, c, d = map(long, range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (None, d), (None, d), (None, c), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"id_": F.lit(1), "key": F.lit("x")})
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, d), (4, "")], key=str)
    spark.createDataFrame([(2, 0, 1), (1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {(r["doc_id"], r["text"]) for r in mixed.collect()} <= set(rows)


def test_near_copies_of_similarity_080(spark, monkeypatch):
    """Copies with a few words replaced, whose fingerprints are far apart, fall; texts below 0.8 stay. A group of
    many copies is dealt out in parts."""
    monkeypatch.setattr(copies, "PART", 8)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(150, 600))]
        texts.append(base)
        for share in (0.01, 0.02, 0.03, 0.05) if k else (0.005,) * 64:
            made = list(base)
            for k in rng.sample(range(len(base)), max(1, int(share * len(base)))):
                made[k] = rng.choice(words)
            texts.append(made)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j - j % 5 if j > 64 else 0, j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(root)
    assert len(set(root)) > 40 and max(root.count(x) for x in set(root)) == 65


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, sf), "stage")
    got, want = corpus_pipeline.run(spark, sf), docs
    assert got.columns == want.columns
    total = lambda df: df.agg(F.count("*"), F.sum("length"), F.countDistinct("doc_id")).first()
    assert total(got) == total(want)


def test_slices():
    assert list(shared.slices([], 5)) == [] and list(shared.slices([9], 5)) == [(0, 1)]
    assert list(shared.slices([1, 2, 3, 9, 1], 5)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_stored_and_release(spark):
    df = shared.stored(spark.range(5), "five")
    file = df.inputFiles()[0]
    assert df.count() == 5 and shared.shared_dir(spark) in file
    shared.release(df)
    from pathlib import Path

    assert not Path(file.removeprefix("file://")).exists()
    shared.release(shared.stored(spark.range(5).where("id > 9"), "none"))


#: An executor of its own: its JVM's memory (MB, the largest seen) before any work, after some that leaves garbage, and after a stage.
HEAPS = """
from pyspark.sql import SparkSession, functions as F

import corpus_pipeline

conf = {"spark.executor.memory": "1200m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.master("local-cluster[1,2,1200]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")


def measured(batches):
    import os
    import re

    import pyarrow as pa

    status = lambda p: open(f"/proc/{p}/status").read()  # noqa: E731
    for _ in batches:
        jvm = int(re.search(r"PPid:\\s+(\\d+)", status(os.getppid()))[1])  # the worker's daemon's parent
        yield pa.RecordBatch.from_pydict({"mb": [int(re.search(r"RssAnon:\\s+(\\d+)", status(jvm))[1]) >> 10]})


look = lambda: spark.range(0, 2, 1, 2).mapInArrow(measured, "mb long").agg(F.max("mb")).first()[0]  # noqa: E731
found = [look()]
spark.range(0, 300_000, 1, 4).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(300)), lambda x: F.concat(x.cast("string"), F.col("id").cast("string"))), "").alias("x")).write.format("noop").mode("overwrite").save()
found.append(look())
corpus_pipeline.personal_data(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
print("MB:", *found, look(), flush=True)
"""


def test_a_stage_begins_with_small_heaps(tmp_path):
    home = tmp_path / "home"  # executors' logs go to work in Spark's home
    home.mkdir()
    for p in Path(os.path.dirname(sys.modules["pyspark"].__file__)).iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable}
    (tmp_path / "heaps.py").write_text(HEAPS)
    out = subprocess.run([sys.executable, tmp_path / "heaps.py"], env=env, capture_output=True, text=True, timeout=300)
    assert "MB:" in out.stdout, out.stderr[-2000:]
    start, grown, after = map(int, out.stdout.split("MB:")[1].split())
    assert grown > start + 100 and after < (start + grown) / 2


def test_links_in_buckets_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    sets, large = {}, []
    for bucket in range(6):
        base = rng.sample(range(-(1 << 31), 1 << 31), 60)
        for _ in range(25):
            kept = [x for x in base if rng.random() > rng.choice([0.02, 0.1, 0.2])]
            sets[len(sets)] = kept + rng.sample(range(-(1 << 31), 1 << 31), rng.choice([0, 2, 8]))
        large += [(bucket, k, len(sets[k]), k - k % 2 if bucket < 4 else 100 if k % 9 else k) for k in range(25 * bucket, 25 * bucket + 25)]
    root = {k: r for _, k, _, r in large}

    def joined(links):
        label = {r: r for r in root.values()}
        for u, v in links:
            a, b = label[root[u]], label[root[v]]
            label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
        return label

    alike = lambda a, b: len(set(a) & set(b)) * 5 >= len(set(a) | set(b)) * 4
    want = joined([(u, v) for b, u, _, _ in large for c, v, _, _ in large if b == c and u > v and alike(sets[u], sets[v])])
    rows = spark.createDataFrame(large, "bucket long, set long, n int, root long")
    hashes = spark.createDataFrame(list(sets.items()), "set long, hashes array<int>")
    for most in (1 << 20, 400):  # each bucket in one part, or both sides in several
        links = [tuple(r) for r in copies.linked_in_buckets(rows, hashes, most).collect()]
        assert joined(links) == want and all(u > v and alike(sets[u], sets[v]) for u, v in links)
        assert len(links) < 2 * len(sets) or most < 1 << 20
    assert len(set(want.values())) < len(want)
