"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash alone does not reach that: at similarity 0.8 two fingerprints of 64 bits differ by about ten bits,
and a radius that catches such pairs has no blocks left to look them up by. Candidates are therefore pairs
whose fingerprints link (simhash, five words) and pairs that agree in one of BANDS bands of ROWS minima of
permuted hashes: at similarity 0.8 a pair is missed with a probability of (1 - 0.8 ** ROWS) ** BANDS, below
0.0001. Every candidate pair is confirmed by the sets themselves, so no link is without its similarity.

Texts of the same set are one node. The candidates are confirmed in three rounds, since one link for each
set makes most of the components and the sets of a pair are what costs: first each set with the one it shares
most bands with; then the other candidates (in a bucket, the first set and the NEAR before it) that are still
in different components; then, in buckets of more, every pair of sets of different components of which one is
outside the bucket's largest component. So a large group of copies does not make all of its pairs, and no pair
of a bucket that could join two components is left out. Sets are held as 32-bit hashes there, and only those
of candidates: for two sets of a thousand shingles a hash is shared by chance once in four thousand pairs.

Defined cases: texts without words (a null text too) are copies of each other; texts of fewer than five words are one
shingle; a component's id is its smallest id that is not null, its representative the row of that id whose
text has the smallest digest (rows of equal id and text are alike); repeated ids with different texts are
rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.components import components
from corpuscle.llm.shared import arrow_schema, bounded_batches, extended, release, stored, trim_heaps, trimmed
from corpuscle.llm.simhash import SEED, links, majority, shingles

WORDS = 5
BANDS, ROWS = 24, 5
NEAR = 4
#: Sets of a bucket that meet in one task, about.
PART = 4096
#: Hashes of sets that are held against others in one task, about.
TOGETHER = 1 << 20
#: Shingles that are permuted in one step.
PERMUTED = 4096
_random = np.random.default_rng(SEED)
FLIPS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A digest of each band's minima, as longs."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), PERMUTED):
        least = np.minimum(least, ((hashes[k : k + PERMUTED, None] ^ FLIPS) * FACTORS).min(axis=0))
    return np.array([xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def sets(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df without `text`, with text_key, set (a digest of the set of shingles), n (its size), fp
    and bands, in place of columns of these names."""

    def step(texts):
        from xxhash import xxh64_intdigest

        made = []
        for x in texts:
            parts = list(shingles(x, WORDS))
            found = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
            digest, fp = np.array([xxh64_intdigest(found.tobytes(), SEED), majority(parts)], np.uint64).view(np.int64).tolist()
            made.append((hashlib.sha256(x or b"").digest()[:16], digest, len(found), fp, bands(found)))
        return list(map(list, zip(*made)))

    return extended(df, step, "text_key binary, set long, n int, fp long, bands array<long>", text)


def _alike(n: str, m: str):
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def hashed(df: DataFrame, named: DataFrame, text: str = "text") -> DataFrame:
    """set, hashes (32 bits of each shingle's hash, once each) of the sets in named (set, text_key)."""
    texts = df.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["text_key"])

    def step(texts):
        found = [list(shingles(x, WORDS)) for x in texts]
        return [[np.unique(np.concatenate(x).astype(np.uint32)).view(np.int32) if x else [] for x in found]]

    return extended(texts.join(named, "text_key").select("set", "text"), step, "hashes array<int>")


def confirmed(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs u, v of sets that are similar enough, from their hashes."""
    x, y = (hashes.select(F.col("set").alias(c), F.col("hashes").alias(h)) for c, h in (("u", "x"), ("v", "y")))
    both = pairs.select("u", "v").join(x, "u").join(y, "v").where(_alike(F.size("x"), F.size("y"))).withColumn("common", F.size(F.array_intersect("x", "y")))
    return stored(both.where(F.col("common") * 5 >= (F.size("x") + F.size("y") - F.col("common")) * 4).select("u", "v"), "confirmed")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components."""
    for c in ("u", "v"):
        pairs = pairs.join(roots.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    return pairs.where("u_root <> v_root").drop("u_root", "v_root")


def forest(sets: np.ndarray, n: np.ndarray, root: np.ndarray, member: np.ndarray, outside: np.ndarray, hashes: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links u, v of each set outside with the members that are similar enough, as far as they join components."""
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while r in above:
            r = above[r]
        return r

    inner = np.flatnonzero(member)
    inner = inner[np.argsort(n[inner], kind="stable")]
    sizes, lengths = n[inner], np.array([len(hashes[i]) for i in inner], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    words = np.concatenate([hashes[i] for i in inner]) if len(inner) else np.empty(0, np.int32)
    known = np.unique(words)
    words = np.searchsorted(known, words).astype(np.int32)
    held, found = np.zeros(len(known), bool), []
    for i in np.flatnonzero(outside):
        a, b = np.searchsorted(5 * sizes, 4 * n[i], "left"), np.searchsorted(4 * sizes, 5 * n[i], "right")
        if a >= b:
            continue
        at = np.flatnonzero(np.isin(known, hashes[i]))
        held[at] = True
        common = np.add.reduceat(held[words[starts[a] : starts[b]]], starts[a:b] - starts[a], dtype=np.int64)
        held[at] = False
        near = inner[a:b][9 * common >= 4 * (lengths[a:b] + len(hashes[i]))]
        for j in near[root[near] != root[i]]:
            r, q = top(int(root[i])), top(int(root[j]))
            if r != q:
                above[max(r, q)] = min(r, q)
                found.append((int(max(sets[i], sets[j])), int(min(sets[i], sets[j]))))
    return found


def linked_in_buckets(large: DataFrame, hashes: DataFrame, most: int = TOGETHER) -> DataFrame:
    """Links u, v between sets of one bucket and different components (large: bucket, set, n, root), enough of
    them to join the components that any such pair joins. A bucket's sets outside its largest component meet
    all of its sets in a task, which returns links only, never the pairs; both are dealt out in parts of about
    `most` hashes, and each part of the one meets each of the other."""
    counted = large.groupBy("bucket", "root").agg(F.count("*").alias("count"), F.sum("n").alias("size"))
    mixed = counted.groupBy("bucket").agg(F.max(F.struct("count", "root", "size")).alias("top"), F.count("*").alias("roots"), F.sum("size").alias("all")).where("roots > 1")
    parts = lambda size: F.ceil(size / most).cast("int")
    mixed = mixed.select("bucket", F.col("top.root").alias("largest"), parts(F.col("all") - F.col("top.size")).alias("across"), parts(F.col("all")).alias("down"))
    rows = large.join(mixed, "bucket").withColumn("outside", F.col("root") != F.col("largest"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("set"), "down").cast("int")).withColumn("own", F.pmod(F.xxhash64("set", F.lit(1)), "across").cast("int"))
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    each = lambda end, made: F.transform(F.sequence(F.lit(0), F.col(end) - 1), made)
    across, down = each("across", lambda x: cell(x, F.col("mine"))), each("down", lambda y: cell(F.col("own"), y))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("outside"), F.array_union(across, down)).otherwise(across)))
    member, outside = F.col("cell.y") == F.col("mine"), F.col("outside") & (F.col("cell.x") == F.col("own"))
    rows = rows.select("bucket", "cell.x", "cell.y", "set", F.col("n").cast("long").alias("n"), "root", member.alias("member"), outside.alias("outer"))
    rows = rows.join(hashes, "set").select("bucket", "x", "y", "set", "n", "root", "member", "outer", "hashes")
    rows = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    out = arrow_schema("u long, v long")
    bounded_batches(large.sparkSession)

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def links():
            *columns, lists = zip(*held)
            found = forest(*map(np.array, columns), lists)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], schema=out)

        for batch in batches:
            *columns, lists = batch.columns
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, row in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                if row[:3] != key and held:
                    yield links()
                    held.clear()
                key = row[:3]
                held.append((*row[3:], values[ends[i] : ends[i + 1]].copy()))
        if held:
            yield links()

    return rows.mapInArrow(trimmed(run), "u long, v long")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_key, set, component_id, representative (boolean) of each row of df."""
    prints = stored(sets(df.select(key, text), text), "prints")
    me = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("text_key").alias("text_key"))
    nodes = stored(prints.groupBy("set").agg(F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("text_key").alias("text_key"), F.min(me).alias("least")), "nodes")
    # texts of one fingerprint, and the links of fingerprints
    first = stored(prints.groupBy("fp").agg(F.min("set").alias("first")), "fingerprints")
    pairs = prints.join(first, "fp").select(F.col("set").alias("u"), F.col("first").alias("v"))
    linked = links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    pairs = pairs.union(linked.select("a", "b"))
    # sets of one bucket; large buckets are dealt out in parts, in each of which neighbours are looked at
    node = F.struct("set", "n")
    rows = nodes.select(F.explode(F.array_distinct("bands")).alias("bucket"), "set", "n")
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min(node).alias("first")).where("members > 1"), "sizes")
    rows = rows.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("set"), F.ceil(F.col("members") / PART)))
    ordered = Window.partitionBy("bucket", "part").orderBy("set")
    others = F.array("first", *(F.lag(node, k).over(ordered) for k in range(1, NEAR + 1)))
    rows = stored(rows.select("bucket", "set", "n", others.alias("others"), "members"), "buckets")
    near = rows.select("set", "n", F.explode("others").alias("o")).where(F.col("o").isNotNull() & _alike("n", "o.n"))
    pairs = pairs.union(near.select("set", "o.set")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    pairs = stored(pairs.groupBy("u", "v").agg(F.count("*").alias("shared")), "pairs")
    named = pairs.select(F.col("u").alias("set")).union(pairs.select("v")).union(rows.where(F.col("members") > NEAR + 1).select("set")).distinct()
    hashes = stored(hashed(df.select(text), nodes.select("set", "text_key").join(named, "set", "left_semi"), text), "hashes")
    # the rounds
    trim_heaps(df.sparkSession)
    best = stored(pairs.groupBy("u").agg(F.max_by("v", F.struct("shared", "v")).alias("v")), "best")
    edges = confirmed(best, hashes)
    roots = components(edges)
    rest = stored(_apart(pairs.select("u", "v").join(best, ["u", "v"], "left_anti"), roots), "rest")
    edges = edges.union(confirmed(rest, hashes))
    roots = components(edges)
    trim_heaps(df.sparkSession)
    large = rows.where(F.col("members") > NEAR + 1).select("bucket", "set", "n").join(roots.select(F.col("u").alias("set"), F.col("v").alias("root")), "set", "left")
    large = stored(large.withColumn("root", F.coalesce("root", "set")), "large")
    more = stored(linked_in_buckets(large, hashes), "more")
    if not more.isEmpty():
        roots = components(edges.union(more))
    rooted = nodes.select("set", "least").join(roots.select(F.col("u").alias("set"), F.col("v").alias("root")), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    firsts = rooted.select("set", "root").join(named, "root").select("set", "first")
    release(hashes)
    return prints.select(key, "text_key", "set").join(firsts, "set").select(key, "text_key", "set", F.col("first.key").alias("component_id"), (me == F.col("first")).alias("representative"))
