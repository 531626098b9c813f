"""Every query over the hard table and an empty one, against brute force or its SQL twin."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscle.llm import media, registry
from tests.oracle import connect, same

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, sf, name):
    full = next(k for k in registry.queries() if k.startswith(name + "_"))
    return registry.queries()[full](spark, sf).toPandas().set_index("doc_id").sort_index()


@pytest.mark.parametrize("name", [*registry.queries(), "pipeline"])
def test_empty_table(spark, empty_sf, name):
    query = corpus_pipeline.run if name == "pipeline" else registry.queries()[name]
    assert query(spark, empty_sf).count() == 0


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), connect(sf).sql(registry.oracle_sql()[name]).df()
    assert same(got, want) == ""


def test_op1_by_hand(spark, sf, docs):
    got = run(spark, sf, "op1")
    for i, text in docs.items():
        words = SPACE.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + o for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for o in range(3)}
        lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
        want = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        row = got.loc[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, text
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row.base_failed and row.kept)


def test_op2(spark, sf, docs):
    got = run(spark, sf, "op2")
    data = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(x[k : k + 200] for x in data.values() for k in range(len(x) - 199))
    for i, x in data.items():
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert tuple(got.loc[i])[:4] == (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def luhn(d):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_op3(spark, sf, docs):
    got = run(spark, sf, "op3")
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    for i, text in docs.items():
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0]))
        row = got.loc[i]
        base = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (text, row.spans, base)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for _, x, _ in found) for k in range(4)]
        assert set(base.split(",")) - {""} <= set(row.spans.split(","))
    row = next(got.loc[i] for i, t in docs.items() if t and "IBAN" in t)
    assert "iban:" in row.spans and "ssn:" in row.spans


def test_op4(spark, sf, docs):
    got, tokenizer = run(spark, sf, "op4"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in docs.items():
        n = len(tokenizer.encode(text or "", add_special_tokens=False))
        assert tuple(got.loc[i]) == (len((text or "").encode()), n, n > 512)


def test_op5(spark, sf, docs):
    got = run(spark, sf, "op5")
    assert set(got.index) == set(docs) and (got.rate >= 0).all() and (got.copies >= np.floor(got.rate)).all() and (got.copies <= np.floor(got.rate) + 1).all()
    p = got[["p_high", "p_low", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    assert (got.n_tokens == [len(SPACE.findall(docs[i] or "")) for i in got.index]).all()
    totals = (p * (got.n_tokens * got.rate).to_numpy()[:, None]).sum(axis=0)
    assert totals / totals.sum() == pytest.approx([0.88, 0.10, 0.02], abs=0.01)


def test_op6(spark, sf, docs):
    got = run(spark, sf, "op6")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    tokens = {i: [*SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in docs.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total = sum(counts.values())
    for i, ws in tokens.items():
        row = got.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws), rel=1e-9)
        assert row.score < 0


def test_op7(spark, sf, docs):
    got = run(spark, sf, "op7")
    for i, text in docs.items():
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        row = got.loc[i]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert row.media_bytes > len(padded) and row.feature
    assert got.drop(columns=["n_bytes"]).groupby("payload_sha256").nunique().max().max() == 1


def plain_samples(codec, data):
    """Samples of a payload by plain decoders."""
    out = []
    if codec == "adpcm":
        for k in range(0, len(data), 64):
            block = data[k : k + 64]
            value, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
            out.append(value)
            for byte in block[4:]:
                for code in (byte & 15, byte >> 4):
                    step = int(media.STEPS[index])
                    move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                    value = max(-32768, min(32767, value + (-move if code & 8 else move)))
                    index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                    out.append(value)
        return out
    for byte in data:
        if codec == "mulaw":
            code = 255 - byte
            size = ((code % 16 * 8 + 132) * 2 ** (code // 16 % 8)) - 132
            out.append(-size if code >= 128 else size)
        else:
            code = byte ^ 0x55
            segment, low = code // 16 % 8, code % 16 * 16 + 8
            size = low if segment == 0 else (low + 256) * 2 ** (segment - 1)
            out.append(size if code >= 128 else -size)
    return out


def test_op7_features(spark, sf, docs):
    got = run(spark, sf, "op7")
    for i, text in docs.items():
        data = (text or "").encode()
        if len(data) > 20_000:
            continue
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        codec = ("mulaw", "alaw", "adpcm")[len(padded) // 64 % 3]
        x = plain_samples(codec, padded)
        wide = [v for a, b in zip(x, [*x[1:], x[-1]]) for v in (a, (a + b) // 2)]
        pcm = b"".join(v.to_bytes(2, "little", signed=True) for v in wide)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert got.loc[i].feature == f"{codec}:{len(x)}:{math.sqrt(sum(v * v for v in x) / len(x)):.3f}:{max(map(abs, x))}:{crossings}:{zlib.crc32(pcm):08x}"
        assert got.loc[i].pcm_bytes == 44 + len(pcm)


def test_op8(spark, sf, docs):
    got = run(spark, sf, "op8")
    for i, text in docs.items():
        row = got.loc[i]
        assert row.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= row.score <= 1
        assert (row.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    assert set(got.lang_pred) <= {"en", "de", "und"}


def fingerprint(text):
    words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_op9(spark, sf, docs):
    got = run(spark, sf, "op9")
    prints = {i: fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {i: got.loc[i].fingerprint for i in docs} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: got.loc[i].component_id for i in docs} == root
    assert len(set(root.values())) < len(docs) - 5


def test_op10(spark, sf, docs):
    query = next(q for k, q in registry.queries().items() if k.startswith("op10_"))
    got, tokenizer = query(spark, sf).toPandas(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    covered = Counter()
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(part.tobytes()) == r.ids_crc32
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert max(covered.values()) == 1 and len(covered) == sum(map(len, ids.values()))
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert list(group.offset) == [0, *np.cumsum(group.length)[:-1]]
        total = group.length.sum()
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two: no padding
