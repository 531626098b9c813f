"""The operators' own interfaces, their inner parts and defined cases."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscle.llm import components, copies, langid, media, mixing, packing, pii, ppm, quality, repeats, simhash, tokens


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})


def test_quality_lines(spark):
    prose = " ".join(f"word{i} and more," for i in range(20)) + " the end."
    texts = [prose + "\nHome | About | Contact\nLicensed under the MIT License.", "\n".join(["no end of a sentence here"] * 3 + [prose[:60]]), None, prose, prose]
    got = quality.with_quality(frame(spark, texts, kept=1, n_words="clash", lines="x")).orderBy("doc_id").collect()
    assert got[0]["q_clean_text"] == prose and got[0]["q_kept"] and got[0]["kept"] == 1 and got[0]["n_words"] == "clash"
    assert not got[1]["q_kept"] and got[2]["q_clean_text"] == "" and not got[2]["q_kept"] and got[2]["q_n_words"] == 0
    assert got[3][4:] == got[4][4:] or got[3]["q_kept"] == got[4]["q_kept"]
    others = spark.createDataFrame([(x,) for x in ("Startseite | Über uns | Kontakt.", "Accueil · Connexion!", "Inicio » Ayuda.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.")], "l string")
    assert all(r[0] for r in others.select(quality.line_fails(F.col("l"))).collect())
    assert not any(r[0] for r in spark.createDataFrame([("Die Suche nach Hilfe war lang.",), ("Elle cherche de l'aide.",), ("El inicio fue bueno.",)], "l string").select(quality.line_fails(F.col("l"))).collect())
    fails = spark.createDataFrame([(x,) for x in ("Next", "cut off without a stop", 'She said "go."', "a. b c", "Tail of it %%% ### $$$.", "All rights reserved.", "x > y > z.")], "l string")
    assert [r[0] for r in fails.select(quality.line_fails(F.col("l"))).collect()] == [True, True, False, False, True, True, True]


def test_pii_redaction_and_validators(spark):
    texts = ["To a.b@c.de or +49 (30) 1234567, card 4111-1111-1111-1111.", "nothing", None, "", "a@b.c" + " x@y.zz" * 300]
    got = [r["text"] for r in pii.redacted(pii.with_spans(frame(spark, texts, spans=1))).orderBy("doc_id").collect()]
    assert got == ["To <EMAIL> or <PHONE>, card <CARD>.", "nothing", None, "", "<EMAIL>" + " <EMAIL>" * 300]
    checks = spark.createDataFrame([("DE89370400440532013000", True), ("GB82 WEST 1234 5698 7654 32", True), ("DE89370400440532013001", False)], "x string, ok boolean")
    assert all(r[0] == r[1] for r in checks.select("ok", pii.mod97(F.col("x"))).collect())
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    near = pii.with_spans(frame(spark, ["My SSN is 123-45-6789.", "Part 123-45-6789 fits.", f'token = "{key}"', f"commit {key}", f"api key or sha {key}", "IBAN DE89370400440532013000", "model DE89370400440532013000", "DE89370400440532013000", "Call +49 30 1234567"]))
    got = [[(pii.KINDS[x["kind"]].name, x["score"]) for x in r[0]] for r in near.orderBy("doc_id").select("pii_spans").collect()]
    assert got == [[("ssn", 80)], [], [("secret", 80)], [], [], [("iban", 100)], [], [("iban", 60)], [("phone", 100)]]


def test_pii_scan(spark):
    n = 1000
    got = spark.range(1).select(pii.scan(F.sequence(F.lit(1), F.lit(n)), lambda a, b: a + b), pii.scan(F.array().cast("array<int>"), lambda a, b: a + b)).first()
    assert got[0] == [k * (k + 1) // 2 for k in range(n)] and got[1] == []


def test_pii_long_runs(spark):
    long = "a" * 200_000 + " " + "1" * 50_000 + " " + "1.2." * 20_000 + "+1" + "(" * 50_000
    assert pii.with_spans(frame(spark, [long])).select(F.size("pii_spans")).first()[0] == 1 + len("1.2." * 20_000) // 8 - 1


def test_token_counts_of_chunks():
    tokenizer, rng = tokens.load(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    parts = ["the ", "hello", "'re", "'", " ", "  ", "\n", "\n\n  ", "123", "é", "日本語", "👍🏽", "<|endoftext|>", "<|endof", "text|>", "a" * 25, "!!!???", "Z" * 300, " " * 200, "\t", "x1y2"]
    for n in range(400):
        few = parts if n % 3 else rng.sample(parts, 3)
        text = "".join(rng.choice(few) for _ in range(rng.randint(1, 200)))
        assert tokens.count_long(text, tokenizer, rng.choice([40, 64, 100, 300]), rng.choice([34, 40, 60])) == len(tokenizer.encode(text, add_special_tokens=False))


def test_mixing_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 500), *(lambda a, b: (1 - a - b, a, b))(rng.random() / 2, rng.random() / 2)) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_a double, p_b double, p_c double")
    got = mixing.with_rates(table, mixing.fit_rates(table, {"a": 0.6, "b": 0.35, "c": 0.05})).toPandas()
    totals = (got[["p_a", "p_b", "p_c"]].to_numpy() * (got.n_tokens * got.rate).to_numpy()[:, None]).sum(axis=0)
    assert totals / totals.sum() == pytest.approx([0.6, 0.35, 0.05], abs=0.005) and (got.rate >= 0).all()
    copies = spark.range(20_000).select(mixing.copies(F.col("id"), F.lit(1.25)).alias("c")).groupBy().avg("c").first()[0]
    assert copies == pytest.approx(1.25, abs=0.02)


def test_mixing_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    weights = mixing.fit_classifier(mixing.labelled_sample(docs, labels.where(~held)))
    truth = labels.where(held).select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("high").alias("domain"))
    got = mixing.posteriors(docs.select("doc_id", "text"), weights).join(truth, "doc_id").toPandas()
    said = got[["p_high", "p_low", "p_toxic"]].to_numpy().argmax(axis=1)
    right = np.array(["high", "low", "toxic"])[said] == got.domain
    assert len(got) > 500 and right.mean() > 0.95 and right.groupby(got.domain).mean().min() > 0.7


def test_mixing_takes_target_shares(spark):
    """The rows that the pipeline's stage returns have the targets' shares, and no clean row is lost."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    weights = mixing.fit_classifier(mixing.labelled_sample(docs, labels))
    got = mixing.posteriors(corpus_pipeline.mixed(spark, docs, "/root/testdata/sf0.1"), weights).toPandas()
    totals = (got[["p_high", "p_low", "p_toxic"]].to_numpy() * got.n_tokens.to_numpy()[:, None]).sum(axis=0)
    assert totals / totals.sum() == pytest.approx([0.88, 0.10, 0.02], abs=0.004)
    clean = mixing.posteriors(docs, weights).where("p_high > 0.999").select("doc_id").toPandas()
    assert np.isin(clean.doc_id, got.doc_id).mean() > 0.998


def test_mixing_sample_under_repeated_ids(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1, 0)] * 500, "doc_id long, quality int, toxic int")
    assert mixing.labelled_sample(docs, labels, rows=5).count() == 1


def test_language_sample_under_repeated_ids(spark):
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert len(langid.fit(same, rows=5)["en"]) <= 5 * len("text 2999 ") and len(langid.fit(same.withColumn("text", F.lit("one text")), rows=5)["en"]) == 8
    long = spark.createDataFrame([(1, "en", "ab" * 5000), (2, "en", "cd" * 5000)], "doc_id long, lang string, text string")
    assert len(langid.fit(long, size=12_000)["en"]) <= 12_001


def test_mixing_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.mix(frame(spark, ["a b", None, "", "a b"]), none).toPandas()
    assert len(got) == 4 and (got.rate >= 0).all()


def plain_ppm(training, order):
    """log10 probability of a text by a plain model with dictionaries of contexts."""
    contexts = {}
    pad = b"\0" * order
    for text in training:
        data = pad + text + b"\0"
        for i in range(order, len(data)):
            for k in range(order + 1):
                row = contexts.setdefault(data[i - k : i], {})
                row[data[i]] = row.get(data[i], 0) + 1

    def one(context, byte):
        weight, out = 1.0, set()
        for k in range(len(context), -1, -1):
            seen = contexts.get(context[len(context) - k :], {})
            left = {b: n for b, n in seen.items() if b not in out}
            below = sum(left.values()) + (len(left) if len(seen) < 256 else 0)
            if byte in left:
                return weight * left[byte] / below
            if left:
                weight *= len(left) / below
                out |= left.keys()
        return weight / (256 - len(out))

    def log(text):
        data = pad + text + b"\0"
        return sum(math.log10(one(data[i - order : i], data[i])) for i in range(order, len(data)))

    return one, log


def test_ppm_scores_are_those_of_a_plain_model(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["zzz new bytes ÿ", None, "", "日本", "abcabcabc" * 30]
    every = bytes(range(1, 256)).decode("latin-1")  # many bytes after one context
    texts += [" ".join(every), " ".join(every)]
    df = frame(spark, texts).withColumn("train", F.col("doc_id") % 3 != 0)
    for order, frequent in ((5, 40), (2, 1 << 20)):
        _, log = plain_ppm([(t or "").encode() for i, t in enumerate(texts) if i % 3], order)
        got = {r["doc_id"]: r["score"] for r in ppm.score(df, F.col("train"), order=order, frequent=frequent, top=3).collect()}
        assert got == pytest.approx({i: log((t or "").encode()) for i, t in enumerate(texts)}, rel=1e-5)


def test_ppm_is_a_distribution(spark):
    one, _ = plain_ppm([b"abracadabra", b"abacus"], 3)
    for context in (b"abr", b"zzz", b"zab", b"\0\0\0"):
        assert sum(one(context, b) for b in range(256)) == pytest.approx(1)


def test_ppm_clashing_names_and_bounds(spark):
    df = frame(spark, ["a b", "a b", "c"], score="x", code=1, n="y", row_="z", in_=3)
    got = ppm.score(df, F.lit(True)).orderBy("doc_id")
    assert got.columns == ["doc_id", "code", "n", "row_", "in_", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and got.first()["n"] == "y"
    long = frame(spark, ["w" * 1000, "w" * 1000 + " v"])
    assert [r["n_known"] for r in ppm.score(long, F.lit(True)).orderBy("doc_id").collect()] == [2, 3]


def test_ppm_likes_what_it_has_seen(spark):
    df = frame(spark, ["the cat sat on the mat"] * 30 + ["zq xj qv kk", "the cat", None]).withColumn("train", F.col("doc_id") < 30)
    got = {r["doc_id"]: r for r in ppm.score(df, F.col("train"), top=2).collect()}
    assert got[31]["score"] / 7 > got[30]["score"] / 11 and got[30]["n_known"] == 1 and got[32]["n_tokens"] == 1
    assert {(got[i]["score"], got[i]["base_score"]) for i in range(30)} == {(got[0]["score"], got[0]["base_score"])}


def test_ppm_without_training(spark):
    got = ppm.score(frame(spark, ["abc"]), F.lit(False)).first()
    assert got["train_tokens"] == 0 and got["base_score"] == 0 and got["score"] == pytest.approx(-4 * np.log10(256), rel=1e-5)


def adpcm(block):
    """A plain decoder of one block."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value + (-move if code & 8 else move)))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_media():
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 256, (50, 64), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [adpcm(b.tobytes()) for b in blocks]
    assert media.MULAW_TABLE[[0, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW_TABLE[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    for codec in media.CODECS:
        assert media.parse(media.wav(codec, b"x" * 64))[::3] == (codec, b"x" * 64)
    assert media.twice(np.array([0, 10, -5], np.int16)).tolist() == [0, 5, 10, 2, -5, -5] and len(media.twice(np.array([], np.int16))) == 0
    assert [media.parse(x) for x in (None, b"", b"RIFF0000WAVE", b"not a file at all", media.wav(media.PCM, b"xx"))] == [None] * 5


def test_media_column(spark):
    rows = [(1, media.wav(media.MULAW, b"ab")), (2, None), (3, b"junk"), (4, media.wav(media.ADPCM, b"")), (1, media.wav(media.MULAW, b"ab"))]
    got = media.with_pcm(spark.createDataFrame(rows, "doc_id long, media binary").withColumn("text", F.lit("kept"))).orderBy("doc_id").collect()
    assert [r["codec"] for r in got] == ["mulaw", "mulaw", None, None, "adpcm"] and got[0] == got[1] and got[0]["rate"] == 16000 and got[0]["text"] == "kept"
    assert got[0]["pcm"][:4] == b"RIFF" and len(got[0]["pcm"]) == 44 + 8 and got[4]["feature"].startswith("adpcm:0:")


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    got = langid.predict(docs.where(held).where("n_chars > 100").select("doc_id", "lang", "text"), model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.rejected.mean() < 0.02
    assert list(model)[0] == "en"


def test_language_cases(spark):
    model = langid.fit(spark.createDataFrame([(i, "en", "the thing and the other") for i in range(9)] + [(20, None, "x"), (21, "de", None)], "doc_id long, lang string, text string"), rows=3)
    assert list(model) == ["en"]
    got = langid.predict(frame(spark, ["some", None, "12 !?", ""], lang="keep"), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["rejected"], r["lang"]) for r in got] == [("en", False, "keep")] + [("und", True, "keep")] * 3
    assert [r["lang_pred"] for r in langid.predict(frame(spark, ["some"]), {}).collect()] == ["und"]


def brute(values, ends):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i + 1, ends[i]):
            if (values[i] ^ values[j]).bit_count() <= 3 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 150), st.integers(1, 12))
def test_bit_sliced_forest(seed, n, spread):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    values = []
    for _ in range(n):
        v = rng.choice(centres)
        for _ in range(rng.randint(0, spread)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    ends, at = [], 0
    while at < n:
        stop = min(n, at + rng.choice([1, 3, 64, 100]))
        ends += [stop] * (stop - at)
        at = stop
    assert simhash.forest(np.array(values, np.uint64), np.array(ends)).tolist() == brute(values, ends)


def test_links_of_dense_groups_in_tiles(spark):
    rng = random.Random(6)
    values = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            v = centre
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values | {0, 1, 2**64 - 1})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    groups = {}
    for v, label in zip(signed, brute(values, [len(values)] * len(values))):
        groups.setdefault(label, []).append(v)
    want = {(v, min(g)) for g in groups.values() for v in g if v != min(g)}
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for tile in (16, 8192):
        assert {tuple(r) for r in components.components(simhash.links(df, tile)).collect()} == want


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (1000, 1001)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(i, 1000) for i in range(1001, 1300)}


def plain_windows(ahead, data, low, high):
    """For each context the distances at which another one has the same window."""
    at = lambda i, d: data[i][ahead[i] - d : ahead[i] - d + 200]
    mine = [[d for d in range(max(0, low[i]), min(ahead[i], high[i]) + 1) if len(at(i, d)) == 200] for i in range(len(data))]
    seen = {}
    for i, ds in enumerate(mine):
        for d in ds:
            seen[d, at(i, d)] = seen.get((d, at(i, d)), 0) + 1
    return [{d for d in ds if seen[d, at(i, d)] > 1} for i, ds in enumerate(mine)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_radix_passes_over_contexts(seed):
    rng = random.Random(seed)
    run = bytes(rng.choice(b"ab") for _ in range(40))
    sides = [bytes(rng.choice(b"ab\0") for _ in range(160)) for _ in range(4)]
    data, ahead, low, high = [], [], [], []
    for _ in range(rng.randint(1, 40)):
        left, right = bytearray(rng.choice(sides)), bytearray(rng.choice(sides))
        for side in (left, right):
            if rng.random() < 0.5:
                side[rng.randrange(160)] ^= 1
        a = rng.randint(0, 160)
        b = rng.randint(160 - a, 160)
        data.append(bytes(left[160 - a :]) + run + bytes(right[:b]))
        ahead.append(a)
        low.append(rng.choice([0, 0, 40]))
        high.append(rng.choice([160, 160, 100]))
    group = np.array([rng.choice([5, 5, -7]) for _ in data])
    for g in (5, -7):
        mine = [i for i in range(len(data)) if group[i] == g]
        want = plain_windows(*([x[i] for i in mine] for x in (ahead, data, low, high)))
        found = repeats.shared_windows(group, np.array(ahead), data, np.array(low), np.array(high))
        assert [{d for a, b in found[i] for d in range(a, b + 1)} for i in mine] == want


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_anchors(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"abcd ") for _ in range(900))
    data = [base, base[100:700] + b"x" + base[100:500], bytes(rng.choice(b"ab") for _ in range(400)), b"a" * 450, base[:150]]
    for x in data:
        whole = repeats.anchors(repeats._bytes(x))
        assert whole[2].tolist() == sorted(whole[2].tolist()) and (whole[3] - whole[2] + 1).sum() == max(0, len(x) - 199)
        parts = repeats.anchors(repeats._bytes(x), block=97)
        at = lambda f: {s: int(a) for _, a, lo, hi in zip(*f) for s in range(lo, hi + 1)}
        assert at(parts) == at(whole)  # a window's anchor does not depend on how the text is cut


def plain_removed(texts, n=200):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for x in data:
        for k in range(len(x) - n + 1):
            seen[x[k : k + n]] = seen.get(x[k : k + n], 0) + 1
    out = []
    for x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        out.append(bytes(c for c, g in zip(x, gone) if not g))
    return out


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_repeats_whatever_meets_in_a_task(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdef ") for _ in range(1500))
    texts = [base, base[:700] + "#" + base[700:], base[300:1200], "".join(rng.choice("abcdef ") for _ in range(900)), None, base[:199], "é" * 500, base] + [base[k : k + 400] + str(k) * 9 + base[k + 400 : k + 800] for k in range(0, 700, 50)]
    # texts whose polynomial digests agree: patterns of bytes and of their complements
    texts += [p + x + p for p in ("0123456789" * 7, "") for n in (128, 256, 512) for x in (thue_morse(n, "X", "Y"), thue_morse(n, "Y", "X"))]
    df = frame(spark, texts, n_bytes_="x")
    one, two = (repeats.without_repeats(df, local=n, with_text=True).toPandas().set_index("doc_id").sort_index() for n in (2048, 1))
    assert one.equals(two)
    assert [bytes(x) for x in one.kept_bytes] == plain_removed(texts)


def test_pack_pool():
    rng = random.Random(9)
    for last in (False, True):
        pieces = [(rng.choice([1, 5, 700, 2048, 5000, 2049, 300]), i, 0) for i in range(200)]
        sequences, left = packing.pack_pool(pieces, last=last)
        got = {}
        for size, doc, start in [x for s in sequences for x in s] + left:
            got.setdefault(doc, []).append((start, size))
        for size, doc, _ in pieces:
            at = 0
            for start, n in sorted(got[doc]):
                assert start == at
                at += n
            assert at == size
        sizes = [sum(x[0] for x in s) for s in sequences]
        assert all(n == 2048 or last and n & (n - 1) == 0 for n in sizes) and (not last or not left) and sum(x[0] for x in left) < 2048


def test_packing_interface(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(frame(spark, ["a b", None, "a b"], start="clash").drop("doc_id").withColumn("k", F.lit("key")), path, key="k", with_ids=True).collect()
    assert sorted(len(r["ids"]) for r in got) and sum(r["length"] for r in got) == 3 + 1 + 3 and {r["k"] for r in got} == {"key"}
    words = packing.text_ids(path)
    for text in ("it's we'll, end. x,y İstanbul ΑΣ a b <|endoftext|> <|EndOfText|>", "Ab. ab ab, ab.", " ", ""):
        assert np.frombuffer(words(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_capitals_beside_special_strings():
    words = packing.text_ids(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("Hello, World <|endoftext|> Licence", "<|im_start|>User\nPlease RETURN the Value. <|", "hello, Hello hello. HELLO, <|x"):
        assert np.frombuffer(words(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_pipeline_stages(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit(1)).withColumn("rate", F.lit("x"))
    table = table.unionByName(table.where("doc_id < 5")).unionByName(table.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long"))).persist()
    seen = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf).persist()
        assert after.columns == table.columns and after.dtypes == table.dtypes and 0 < after.count() and (name == "mixing" or after.count() <= seen.count()), name
        if name == "SimHash near-dedup":
            kept = [r["doc_id"] for r in after.collect()]
            want = [r["component_id"] for r in copies.near_copies(seen).where("representative").dropDuplicates(["set"]).collect()]
            assert sorted(map(str, kept)) == sorted(map(str, want))
        if name == "language ID":
            assert {r["doc_id"] for r in after.collect()} & {i for i, t in docs.items() if not any(map(str.isalpha, t or ""))} == set()
        if name == "PII":
            assert not any("@mail.example.com" in r["text"] for r in after.collect())
        seen = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in seen.collect()}


PIECES = st.sampled_from(["Hello", "WORLD", "İstanbul", "İ", ".", ",", "<|", "<|endoftext|>", "<|EndOfText|>", "é", "e\u0301", "\u0301", "ΑΣ", "ß", "K", "'s", "'LL", " ", "\n", "\u00a0", "\u2003", "\x0b", "\x1c", "\x85", "1", "日本", "👍🏽", "a" * 70, "ŉ", "ͅ", "\0"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES | st.text(max_size=3), max_size=12))
def test_word_ids_are_those_of_the_whole_text(parts):
    words, text = packing.text_ids(public_tokenizers.path("word_bpe_49k.json")), "".join(parts)
    assert isinstance(words, packing.WordIds)
    assert np.frombuffer(words(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_with_another_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = packing.text_ids(path)
    assert isinstance(whole, packing.TextIds) and len(packing.text_ids(public_tokenizers.path("word_bpe_49k.json"))(b"Hello World <|endoftext|> The End")) == 5 * 4
    got = packing.packed(frame(spark, ["Two words", None]), path, with_ids=True).collect()
    assert sorted(sum((list(r["ids"]) for r in got if r["doc_id"] == 0), [])) == sorted([*whole.tokenizer.encode("Two words").ids, 1])


def test_packing_balances_costs():
    rng = random.Random(12)
    pieces = [(min(2048, int(rng.paretovariate(0.8) * 40)), i, 0) for i in range(4000)]
    cost = lambda s: sum(n + packing.QUADRATIC * n * n for n, _, _ in s)
    sequences = packing.pack_pool(pieces)[0]
    in_order, room = [[]], 2048
    for size, doc, start in pieces:
        while size:
            part = min(size, room)
            in_order[-1].append((part, doc, start))
            size, start, room = size - part, start + part, room - part
            if not room:
                in_order.append([])
                room = 2048
    costs = lambda some: np.array([cost(s) for s in some if len(s) > 1 and sum(x[0] for x in s) == 2048])
    ours, theirs = costs(sequences), costs(in_order)
    assert ours.std() < 0.8 * theirs.std() and ours.max() <= theirs.max() and ours.mean() < theirs.mean()


MADE = {
    "tokens": (lambda df: tokens.with_counts(df, public_tokenizers.path("byte_bpe_50k.json")), ["n_bytes", "n_tokens", "over_limit"]),
    "langid": (lambda df: langid.predict(df, {"en": b"the and", "de": b"der und"}), ["lang_pred", "score", "rejected"]),
    "simhash": (simhash.fingerprints, ["fp"]),
    "posteriors": (lambda df: mixing.posteriors(df, mixing.Classifier({}, np.zeros((mixing.SHAPES, 3)))), ["n_tokens", "p_high"]),
    "ppm": (lambda df: ppm.score(df, F.lit(True), order=2), ["score", "n_tokens"]),
    "repeats": (repeats.without_repeats, ["n_bytes", "kept_sha256"]),
    "media": (lambda df: media.with_pcm(df.withColumnRenamed("text", "media")), ["codec", "pcm"]),
    "pii": (pii.with_spans, ["pii_spans"]),
    "quality": (quality.with_quality, ["q_kept"]),
}


@pytest.mark.parametrize("name", MADE)
def test_clashing_column_names(spark, name):
    """A made column replaces a given one of its name; columns with the names of inner ones pass through."""
    step, made = MADE[name]
    inner = {c: f"v{i}" for i, c in enumerate(["row", "k1", "k2", "sha", "code", "word", "n", "in_", "row_", "spans", "copied", "Label", "text_"])}
    got = step(frame(spark, ["some text and more", None, ""], **inner, **dict.fromkeys(made, "given"))).collect()
    names = [c.lower() for c in got[0].asDict()]
    assert len(names) == len(set(names)) == len(got[0]) and set(made) <= set(names)
    assert all(r[c] == v for r in got for c, v in inner.items()) and sorted(r["doc_id"] for r in got) == [0, 1, 2]
    assert not any(r[m] == "given" for r in got for m in made)
