"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, other alphabets."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words):
    out = []
    for _ in range(n):
        out.append(rng.choice(words) + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def texts():
    rng = random.Random(5)
    en = ["".join(rng.choice(["th", "er", "an", "ing", "on", "sh", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    de = ["".join(rng.choice(["sch", "ung", "keit", "ei", "ü", "ver", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    shared = prose(rng, 80, en)
    some = [prose(rng, rng.randint(1, 400), en if i % 2 else de) for i in range(60)]
    some += [some[1], some[1], some[3] + " more", prose(rng, 60, en) + shared + prose(rng, 60, en), shared, prose(rng, 30, de) + "\n" + shared]
    some += [None, None, "", "", " ", "\n\n\t", "!!! ...", "a", "one two", "one two three", "x" * 5000, "ab" * 3000, "日本語のテキスト " * 60, "é́     👍🏽", "\x01\x02 sentinel", "\x00\x00"]
    some += ["Mail me: jane.doe@mail.example.com, or +1 (555) 555-7713 from 10.0.0.256 and 192.168.001.7. Card 4111 1111 1111 1111, not 4111 1111 1111 1112. IBAN DE89 3704 0044 0532 0130 00. SSN 078-05-1120."]
    some += ["a@b.c_d@e.f x@y @z.q a@b@c.d 1.2.3.4.5.6.7.8 +123456789012345678 1234-5678 9012-3456", "<|endoftext|> and <|startoftext|> and <|EndOfText|> it's we'll", "Home | About | Contact\nAll rights reserved.\n" + prose(rng, 80, en) + "."]
    some += [" ".join(["spam"] * 300), "\n".join(["Same line here."] * 40), prose(rng, 20_000, en + de)]
    return some


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """A folder with documents and labels of these texts."""
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, (None, "en", "de")[0 if i % 17 == 0 else 1 + (i % 2 == 0)], None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, (i % 5 != 0) * 1, (i % 11 == 0) * 1) for i in range(0, len(rows), 2)] + [(None, 1, 0), (3, None, 0), (5, 1, None), (10**6, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def docs(sf, spark):
    """{doc_id: text}"""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d
