"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64 majority bits over the XXH64 of 3-word shingles. Two fingerprints link at RADIUS or
fewer differing bits. Equal fingerprints are grouped first. Of distinct ones, two that link differ in at most
three of six blocks, so that they agree in three at least: for each of the twenty choices of three blocks,
their 31 to 33 bits are a key, and a fingerprint is compared with those that share a key with it. Keys of that
many bits keep buckets small at billions of fingerprints; what is shuffled are twenty pairs of numbers for
each distinct fingerprint. Within a bucket the fingerprints are stored as 64 vertical bit planes, one fingerprint is held against 64 others at
once, differences are counted in carry-save counters of two bits and an overflow, and words of 64 whose
counters all have overflowed are abandoned. A bucket's links leave it as a forest (each member to the
smallest it reaches there), never as all pairs. Buckets beyond TILE are dealt out as pairs of tiles, every
pair of which is compared in a task of its own, so that hot buckets stay exact.

Defined cases: null, empty and wordless texts have fingerprint 0, linked like any other; texts of one or
two words have the fingerprint of the whole sequence; copies share a component; a component's id is its
smallest id that is not null (null where all are); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.components import components
from corpuscle.llm.shared import arrow_schema, documents, extended, stored, trimmed

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Widths of the blocks, and the choices of as many blocks as RADIUS differing bits leave alone.
BLOCKS = (11, 11, 11, 11, 10, 10)
TABLES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
TILE = 8192
#: Words of 64 candidates that are compared in one step.
STEP = 1 << 17
HASHES = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes | None, size: int = SHINGLE, seed: int = SEED):
    """Yields the hashes of a text's shingles in parts of at most HASHES; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    last = ends[size - 1 :]
    for k in range(0, len(first), HASHES):
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[k : k + HASHES].tolist(), last[k : k + HASHES].tolist())], "<u8")


def majority(parts) -> int:
    """The bits that more than half of the hashes have, unsigned."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text, unsigned."""
    return majority(shingles(text, size, seed))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df without `text`, with fp (the fingerprint's bits as a long), in place of a column of
    that name."""
    return extended(df, lambda texts: [np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)], "fp long", text)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words; bit k of word w in row b is bit b of value 64 * w + k."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    wide = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    wide[:, : len(values)] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def close_pairs(values: np.ndarray, ends: np.ndarray, step: int = STEP):
    """Yields index arrays (i, j), i < j: all pairs within RADIUS of which j lies before ends[i], the end
    of i's bucket."""
    planes, n = bit_planes(values), len(values)
    index = np.arange(n)
    low, high = (index + 1) >> 6, (ends - 1) >> 6
    counts = np.where(index + 1 < ends, high - low + 1, 0)
    limits = np.cumsum(counts)
    at = 0
    while at < n:
        done = limits[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(limits, done + step, side="right")))
        yield from _compare(values, ends, planes, np.arange(at, stop), counts[at:stop], low)
        at = stop


def _compare(values, ends, planes, queries, counts, low):
    query = np.repeat(queries, counts)
    if not len(query):
        return
    word = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts) + low[query]
    # candidates that lie before the query's successor or behind its bucket count as beyond the radius
    ahead = np.maximum(query + 1 - (word << 6), 0).astype(np.uint64)
    behind = np.minimum(ends[query] - (word << 6), 64)
    over = ~(ALL << ahead) | np.where(behind < 64, ALL << np.minimum(behind, 63).astype(np.uint64), np.uint64(0))
    one, two, value = np.zeros_like(over), np.zeros_like(over), values[query]
    for b in range(64):
        differ = planes[b][word] ^ (np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1)))
        carry = one & differ
        one ^= differ
        over |= two & carry
        two ^= carry
        if b % 8 == 7:
            alive = over != ALL
            if np.count_nonzero(alive) < 0.7 * len(alive):
                query, word, value, one, two, over = (x[alive] for x in (query, word, value, one, two, over))
                if not len(query):
                    return
    near = ~over
    hit = np.flatnonzero(near)
    for k in range(0, len(hit), 4096):
        part = hit[k : k + 4096]
        row, bit = np.nonzero(np.unpackbits(near[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield query[part][row], (word[part][row] << 6) + bit


def forest(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each value the index of the first one that it reaches over links within its bucket."""
    label = np.arange(len(values))
    for i, j in close_pairs(values, ends):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, deeper := label[label]):
                label = deeper
    return label


def _key(table: int) -> Column:
    """The number of a table and the bits of its blocks."""
    key = F.lit(table).cast("long")
    for b in TABLES[table]:
        bits = F.shiftrightunsigned("fp", sum(BLOCKS[:b])).bitwiseAND(F.lit((1 << BLOCKS[b]) - 1))
        key = F.shiftleft(key, BLOCKS[b]).bitwiseOR(bits)
    return key


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """distinct: fp (long). Edges u, v between distinct fingerprints whose components are those of all
    links within RADIUS."""
    rows = distinct.select("fp", F.explode(F.array(*map(_key, range(len(TABLES))))).alias("bucket"))
    large = rows.groupBy("bucket").count().where(F.col("count") > tile).select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    rows = rows.join(large, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("z"), "fp")
    rows = rows.repartition("bucket", "a", "z").sortWithinPartitions("bucket", "a", "z", "fp")
    out = arrow_schema("u long, v long")

    def edges(columns: list[np.ndarray]):
        import pyarrow as pa

        *key, fp = columns
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1
        bounds = np.concatenate((change, [len(fp)]))
        ends = np.repeat(bounds, np.diff(bounds, prepend=0))
        label = forest(fp.view(np.uint64), ends)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], schema=out)

    def run(batches):
        held: list[list[np.ndarray]] = []  # rows of the bucket that may go on

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append(new)
            if len(new[0]) and all(x[0] == x[-1] for x in new[:3]) and sum(len(h[0]) for h in held) < 4 * TILE:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero(np.any([x != x[-1] for x in columns[:3]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield edges([np.ascontiguousarray(x[:cut]) for x in columns])
            held = [[x[cut:] for x in columns]]
        if held and len(held[0][0]):
            yield edges([np.ascontiguousarray(np.concatenate(x)) for x in zip(*held, strict=True)])

    return rows.mapInArrow(trimmed(run), "u long, v long")


def with_components(prints: DataFrame, key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """prints: key and fp, a row for each document. Returns key, fp, component_id."""
    groups = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
    roots = components(links(groups.select("fp"), tile), len(TABLES) * groups.count()).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp, component_id of each row of df."""
    return with_components(stored(fingerprints(df.select(key, text), text), "prints"), key)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
