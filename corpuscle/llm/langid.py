"""Language identification by compression: a text is compressed with one raw-content zstandard
dictionary per language, and the language with the smallest result wins; narrow margins are rejected.

Texts are compressed in independent pieces of PIECE bytes, so that a long text does not serve as its own
dictionary and the whole text counts. Fitting uses a bounded, deterministic sample: of each language at
most ROWS labelled rows, those with the smallest hashes of id and text. Their whole texts make the
dictionary until it has DICTIONARY bytes; only the text that no longer fits as a whole is thinned out, an
equal part of every KiB of it. The two bounds hold for the driver and each task.

Defined cases: null text, or a text without a letter: `und`, score 0, rejected. With no labelled row at
all every text is `und`. Equal sizes: the language with more labelled rows, then
the one that sorts first; score 0. Repeated rows give equal
results, and copies of a labelled row count once. Only text decides; other columns pass through, but
those named as a made one, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import documents, extended, map_texts

ROWS = 384
DICTIONARY = 248 << 10
PIECE = 1024
#: Short matches and a table that holds the whole dictionary: syllables and endings tell languages apart.
ZSTD = {"window_log": 18, "chain_log": 16, "hash_log": 17, "search_log": 3, "min_match": 4, "target_length": 16}
#: Below this share of the second smallest size, a margin is narrow.
MIN_MARGIN = 0.003
UNKNOWN = "und"


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def spread(data: bytes, most: int, piece: int = PIECE) -> bytes:
    """A text of more than `most` bytes, thinned out: an equal part of every piece of it."""
    if len(data) <= most:
        return data
    part = max(1, most * piece // len(data))
    return b"".join(data[i : i + part] for i in range(0, len(data), piece))[:most]


def fit(labelled: DataFrame, rows: int = ROWS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionary content by language, the most common first, from columns doc_id, lang, text. Rows are
    chosen by a hash of id and text: a first limit lets a few times `rows` of each language pass, and an
    aggregate keeps the `rows` smallest hashes, so that the driver never sees more however often an id or a
    text is repeated. Texts follow by a join with these hashes, thinned out in the tasks."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    given = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", place.alias("h"))
    common = {row["lang"]: row["count"] for row in given.groupBy("lang").count().collect()}
    if not common:
        return {}
    spark, share = labelled.sparkSession, 8
    while True:
        limits = spark.createDataFrame([(k, min((1 << 63) - 1, (1 << 63) // n * rows * share)) for k, n in common.items()], "lang string, most long")
        near = given.select("lang", "h", F.octet_length("text").alias("n")).join(F.broadcast(limits), "lang").where("h <= most").groupBy("lang", "h").agg(F.max("n").alias("n"), F.first("most").alias("most"))
        found = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "n"))), 1, rows).alias("rows"), F.first("most").alias("most")).collect()
        if common.keys() == {r["lang"] for r in found if len(r["rows"]) >= rows or r["most"] == (1 << 63) - 1}:
            break
        share *= 16
    chosen, order = [], {}
    for r in found:
        room = size
        for h, n in r["rows"]:
            if room > 0:
                chosen.append((r["lang"], h, min(n, room)))
                order[r["lang"], h] = len(order)
                room -= n + 1
    wanted = spark.createDataFrame(chosen, "lang string, h long, room int")
    texts = given.join(F.broadcast(wanted), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def step(kept, data):
        return [*kept.columns, [spread(x.lower(), n) for x, n in zip(data, kept.column("room").to_pylist(), strict=True)]]

    parts: dict[str, list[bytes]] = {}
    for row in sorted(map_texts(texts, step, "lang string, h long, room int, part binary").collect(), key=lambda r: order[r["lang"], r["h"]]):
        parts.setdefault(row["lang"], []).append(bytes(row["part"]))
    return {lang: b"\n".join(parts[lang]) for lang in sorted(parts, key=lambda x: (-common[x], x))}


def predict(df: DataFrame, model: dict[str, bytes], text: str = "text", piece: int = PIECE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of df without `text`, with lang_pred, score (margin as a share of the second smallest
    size; 1 where only one language is known) and rejected."""
    names = list(model)
    compressors: list = []

    def sizes(data: bytes) -> list[int]:
        data = data.lower()  # A-Z only, as in the dictionaries
        pieces = [data[i : i + piece] for i in range(0, len(data), piece)]
        return [sum(map(len, map(c.compress, pieces))) for c in compressors]

    def judge(data: bytes | None) -> tuple[str, float, bool]:
        if data is None or not names or not any(map(str.isalpha, data.decode())):
            return UNKNOWN, 0.0, True
        found = sizes(data)
        ordered = sorted(found)
        score = 1 - ordered[0] / ordered[1] if len(ordered) > 1 else 1.0
        return names[found.index(ordered[0])], score, score < min_margin

    def step(texts):
        import zstandard

        if not compressors:
            for content in model.values():
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters(**ZSTD, strategy=zstandard.STRATEGY_FAST, write_checksum=False, write_content_size=False, write_dict_id=False)
                d.precompute_compress(compression_params=p)
                compressors.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d))
        found = [judge(x) for x in texts]
        return [[x[i] for x in found] for i in range(3)]

    return extended(df, step, "lang_pred string, score double, rejected boolean", text)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "lang", "text"))
    return predict(docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), model)
