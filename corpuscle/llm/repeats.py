"""Exact substring dedup: every byte covered by a LENGTH-byte string that also starts anywhere else.

A depth-limited radix sort of suffixes: they are ordered through their first LENGTH bytes only, by passes of
digits, the most significant first; groups of one drop out after every pass, and groups that are left at
depth LENGTH are exactly the repeated windows. A shuffle of every byte's suffix would move tens of times the
text, so suffixes travel in bundles behind a filter:

1. Candidates (a filter only: it decides nothing). Of the GRAM-byte runs in a window the one with the
   smallest hash (leftmost of equals) is its anchor. That depends on the window's bytes alone, so equal windows
   have equal anchors at equal distances; some 80 neighbouring windows share one. Anchors whose run (by its
   hash) occurs at one place only drop out.
2. Copies. The windows of an anchor span one run of bytes around it, its context. Contexts that occur twice,
   by a cryptographic digest of all their bytes (BLAKE2b, 128 bits), have repeated windows only.
3. Radix passes over bytes. The different contexts of a run are laid side by side at their anchors. The
   suffixes that start at the anchor are ordered by passes of eight-byte digits, groups of one dropping out;
   so are the reversed bytes before it. What neighbours have in common gives the groups at every depth, so
   that a window, `distance` bytes of which lie before its anchor, has two last digits: its group among the
   left parts at depth `distance` and among the right parts at depth LENGTH - distance. Windows alike in
   distance and both digits are equal byte by byte.

Runs with more than LOCAL different contexts are first split over the cluster by passes of their own: the
windows' distances are cut into ranges, finer in every pass; all windows of a range share the bytes around
the anchor that lie in each of them, which are the pass's digit, compared as bytes. At the finest pass the
digit is the whole window.

Equal texts (by SHA-256) are grouped first and stand for each other.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; copies of a text of LENGTH
bytes or more lose all; overlapping repeats within one text count (a run of equal bytes repeats itself at
the next place); repeated rows are copies; other columns pass through, but those named as a made one, which it
replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import arrow_schema, bounded_batches, documents, map_texts, release, stored, trimmed, tucked, untucked

LENGTH = 200
GRAM = 40
#: Contexts of a run that meet in one task, at most: some 6 MB of bytes and 100 MB of digits of their windows.
LOCAL = 16_384
#: Distances in a range, in each pass over the runs with more.
RANGES = (41, 10, 1)
#: Windows of a text that are worked on at once.
BLOCK = 1 << 20
#: Bytes of contexts that are compared at once.
COMPARED = 1 << 19
KEY = ["k1", "k2"]
U = np.uint64


class Digests:
    """Polynomial digests of runs of bytes, mod 2**64 over a random table of the 256 bytes: after one pass
    of sums, that of any run in constant time. They choose candidates; different runs may share one."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) << U(1) | U(1)
        self.up = np.cumprod(np.full(size, base, np.uint64))
        self.down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out


_made: dict[int, Digests] = {}


def digests(size: int) -> Digests:
    """Digests for data of up to `size` bytes; kept, in powers of two."""
    size = 1 << max(16, (size - 1).bit_length())
    if size not in _made:
        _made[size] = Digests(1, size)
    return _made[size]


def mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK):
    """Arrays over a text's anchors: digest of the run, its place, first and last window (by their start)
    that have it as their anchor."""
    found = [_anchors(data[s : s + block + length - 1], s, length, gram) for s in range(0, max(0, len(data) - length + 1), block)]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, t) for t in (np.uint64, *[np.int64] * 3)]


def _anchors(data: np.ndarray, base: int, length: int, gram: int):
    n, m, width = len(data) - length + 1, len(data) - gram + 1, length - gram + 1
    d = digests(len(data))
    sums = d.sums(data)
    runs = mixed((sums[gram:] - sums[:-gram]) * d.down[:m])
    # the smallest of each `width` neighbours: minima from the left and the right within blocks of `width`
    keyed = np.full(-(-m // width) * width, U(0xFFFFFFFFFFFFFFFF))
    keyed[:m] = runs >> U(24) << U(24) | np.arange(m, dtype=np.uint64)
    keyed = keyed.reshape(-1, width)
    left = np.minimum.accumulate(keyed, axis=1).ravel()
    right = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & U((1 << 24) - 1)).astype(np.int64)
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [n])) - 1
    at = place[first]
    return runs[at], at + base, first + base, last + base


def _bytes(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.uint8)


def _keyed(df: DataFrame, text: str) -> DataFrame:
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return df.withColumn("sha", sha).withColumn("k1", F.xxhash64("sha")).withColumn("k2", F.xxhash64(F.lit("second"), "sha"))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """texts: k1, k2, text. Rows run (the anchor's digest), k1, x (a digest of text and place)."""

    def step(rows, data):
        found = [anchors(_bytes(x)) for x in data]
        n = [len(f[0]) for f in found]
        k1, k2 = (np.repeat(c.to_numpy(zero_copy_only=False), n) for c in rows.columns)
        run, at = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        x = mixed(k1.view(np.uint64) ^ mixed(k2.view(np.uint64) ^ mixed(at.astype(np.uint64))))
        return [run.view(np.int64), k1, x.view(np.int64)]

    return map_texts(texts, step, "run long, k1 long, x long", most=1 << 20)


def _candidates(rows: DataFrame) -> DataFrame:
    """k1, runs: of each text (or of more that share k1, which does no harm) the anchor runs that occur at
    more than one place of different texts or of one text. Copies of a text count once. The runs are stored
    first, so that the join's two sides are plain shuffles, of which a hot run's partition can be split."""
    more = stored(rows.groupBy("run").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a <> b").select("run"), "runs", rows.count() // 2)
    return rows.select("run", "k1").join(more, "run").groupBy("k1").agg(F.collect_set("run").alias("runs"))


def _contexts(texts: DataFrame) -> DataFrame:
    """texts: k1, k2, runs, text. Rows k1, k2, run, c1, c2, place, first, last of the candidate anchors;
    c1 and c2 are the digest of the context and its anchor's distance."""

    def step(rows, data):
        out = []
        for x, k1, k2, runs in zip(data, rows.column("k1").to_pylist(), rows.column("k2").to_pylist(), rows.column("runs"), strict=True):
            run, at, first, last = anchors(_bytes(x))
            keep = np.isin(run.view(np.int64), runs.values.to_numpy(zero_copy_only=False))
            at, first, last = at[keep], first[keep], last[keep]
            joined = b"".join(hashlib.blake2b(x[a : b + LENGTH], digest_size=16, salt=bytes([p - a])).digest() for a, b, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True))
            context = np.frombuffer(joined, np.int64).reshape(-1, 2)
            out.append([np.full(len(at), k1), np.full(len(at), k2), run[keep].view(np.int64), context[:, 0], context[:, 1], at, first, last])
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    return map_texts(texts, step, "k1 long, k2 long, run long, c1 long, c2 long, place long, first long, last long", most=1 << 20)


def _cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of one copy of each context that is to be compared, with the distance of its anchor.
    wanted: run, c1, c2, copy (k1, k2, place, first, last)."""
    lists = wanted.groupBy(F.col("copy.k1").alias("k1"), F.col("copy.k2").alias("k2")).agg(F.collect_list(F.struct("run", "c1", "c2", "copy.place", "copy.first", "copy.last")).alias("cuts"))

    def step(rows, data):
        out = []
        for x, cuts in zip(data, rows.column("cuts").to_pylist(), strict=True):
            out += [(c["run"], c["c1"], c["c2"], c["place"] - c["first"], x[c["first"] : c["last"] + LENGTH]) for c in cuts]
        return list(zip(*out, strict=True)) or [[], [], [], [], []]

    return map_texts(texts.drop("runs").join(lists, KEY).drop(*KEY), step, "run long, c1 long, c2 long, ahead int, bytes binary", most=1 << 20)


def radix_order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders rows of bytes (of one width, a multiple of eight) within their groups, by passes of eight-byte
    digits, the most significant first, of the rows that are not alone in their group yet. Returns the order and,
    for each two neighbours in it, how many bytes they have in common (-1 for different groups)."""
    digits = rows.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    same = group[order[1:]] == group[order[:-1]]
    common = np.where(same, rows.shape[1], -1)
    for k in range(digits.shape[1]):
        live = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(live):
            break
        part = np.cumsum(np.concatenate(([0], ~same)))[live]
        digit = digits[order[live], k]
        sort = np.lexsort((digit, part))
        order[live], digit = order[live][sort], digit[sort]
        apart = np.flatnonzero((part[1:] == part[:-1]) & (digit[1:] != digit[:-1]))
        differ = digit[apart + 1] ^ digit[apart]
        equal = sum((differ >> U(8 * (8 - b)) == 0).astype(np.int64) for b in range(1, 8))
        common[live[apart]], same[live[apart]] = 8 * k + equal, False
    return order, common


def shared_windows(group: np.ndarray, ahead: np.ndarray, data: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """Whole groups of contexts. For each context the ranges of those of its windows, by distances from
    `low` to `high` of their start before the anchor, that another context of its group has at the same distance."""
    n, most = len(data), length - gram
    if not n:
        return []
    sizes = np.fromiter(map(len, data), np.int64, n)
    wide = -(-most // 8) * 8
    left, right = np.zeros((n, wide), np.uint8), np.zeros((n, -(-length // 8) * 8), np.uint8)
    joined, ends = _bytes(b"".join(data)), np.cumsum(sizes)
    for a in range(0, n, 1024):  # rows of bytes from one buffer
        at = (ends - sizes + ahead)[a : a + 1024, None]
        column = np.arange(wide)
        inside = column < ahead[a : a + 1024, None]
        left[a : a + 1024] = np.where(inside, joined[np.where(inside, at - 1 - column, 0)], 0)
        column = np.arange(right.shape[1])
        inside = column < (sizes - ahead)[a : a + 1024, None]
        right[a : a + 1024] = np.where(inside, joined[np.where(inside, at + column, 0)], 0)
    (by_left, left_common), (by_right, right_common) = radix_order(group, left), radix_order(group, right)
    least = np.maximum(ahead - (sizes - length), low)
    counts = np.maximum(np.minimum(ahead, high) - least + 1, 0)
    of = np.repeat(np.arange(n), counts)
    distance = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + least[of]
    one, two = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    sort = np.argsort(distance, kind="stable")
    bounds = np.searchsorted(distance[sort], np.arange(most + 2))
    place = np.empty(n, np.int64)
    for d in range(most + 1):
        if bounds[d] < bounds[d + 1]:
            mine = sort[bounds[d] : bounds[d + 1]]
            for out, order, common, depth in ((one, by_left, left_common, d), (two, by_right, right_common, length - d)):
                place[order] = np.concatenate(([0], np.cumsum(common < depth)))
                out[mine] = place[of[mine]]
    key = (distance * n + one) * n + two
    sort = np.argsort(key, kind="stable")
    same = key[sort[1:]] == key[sort[:-1]]
    hit = np.zeros(len(key), bool)
    hit[sort[1:][same]] = True
    hit[sort[:-1][same]] = True
    found: list[list[tuple[int, int]]] = [[] for _ in data]
    places = np.flatnonzero(hit)
    if len(places):
        cut = np.flatnonzero((np.diff(places) > 1) | (np.diff(of[places]) > 0)) + 1
        for a, b in zip(places[np.concatenate(([0], cut))], places[np.concatenate((cut, [len(places)])) - 1], strict=True):
            found[of[a]].append((int(distance[a]), int(distance[b])))
    return found


CONTEXT = ["c1", "c2"]


def _compared(rows: DataFrame) -> DataFrame:
    """rows: group, c1, c2, ahead, low, high, bytes: contexts with the group in which they are to be compared,
    and the distances of those of their windows that are. c1, c2, low, high: ranges of repeated windows, by comparison of a group's contexts in a
    task."""
    out = arrow_schema("c1 long, c2 long, low int, high int")
    bounded_batches(rows.sparkSession)
    # groups are dealt out by a hash and met in order; equal hashes of different groups do no harm
    rows = rows.repartition("group").sortWithinPartitions("group")

    def compare(held: list[tuple]):
        import pyarrow as pa

        group, c1, c2, ahead, low, high, data = zip(*held, strict=True)
        found = shared_windows(np.array(group, np.int64), np.array(ahead, np.int64), list(data), np.array(low, np.int64), np.array(high, np.int64))
        made = [(c1[i], c2[i], a, b) for i, x in enumerate(found) for a, b in x]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * 4, out)], schema=out)

    def run(batches) -> Iterator:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > COMPARED and row[0] != held[-1][0]:
                    yield compare(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield compare(held)

    return rows.mapInArrow(trimmed(run), "c1 long, c2 long, low int, high int")


def _split(rows: DataFrame, width: int) -> DataFrame:
    """rows: as for _compared. A row for each range of `width` distances that a context has windows in, with core: the
    bytes around the anchor that all windows of the range hold."""
    parts = F.sequence(F.floor(F.col("low") / width).cast("int"), F.floor(F.col("high") / width).cast("int"))
    first, last = F.col("part") * width, F.least(F.col("part") * width + width - 1, F.lit(LENGTH - GRAM))
    core = F.substring("bytes", F.col("ahead") - first + 1, first + LENGTH - last)
    rows = rows.withColumn("part", F.explode(parts))
    return rows.select("group", "part", core.alias("core"), *CONTEXT, "ahead", F.greatest("low", first).alias("low"), F.least("high", last).alias("high"), "bytes")


def _repeated_windows(rows: DataFrame, local: int, ranges: tuple[int, ...]) -> DataFrame:
    """rows: as for _compared, a group for each run. c1, c2, low, high of the repeated windows."""
    sizes = stored(rows.groupBy("group").agg(F.count("*").alias("g")).where("g > 1"), "groups")
    rows = stored(rows.join(sizes, "group"), "open")
    found = _compared(rows.where(F.col("g") <= local).drop("g"))
    hot = rows.where(F.col("g") > local).drop("g")
    for width in ranges:
        if hot.isEmpty():
            return found
        split = _split(hot, width)
        key = ["group", "part", "core"]
        sizes = stored(split.groupBy(*key).agg(F.count("*").alias("g")).where("g > 1").withColumn("id", F.xxhash64(*key)), "groups")
        split = stored(split.join(sizes, key).select(F.col("id").alias("group"), *CONTEXT, "ahead", "low", "high", "bytes", "g"), "open")
        if width == 1:  # the core is the window: all are repeated
            return found.unionByName(split.select("c1", "c2", "low", "high"))
        found = found.unionByName(_compared(split.where(F.col("g") <= local).drop("g")))
        hot = split.where(F.col("g") > local).drop("g")
    return found


def _repeated(texts: DataFrame, local: int, ranges: tuple[int, ...]) -> DataFrame:
    """texts: k1, k2, runs, text, distinct. k1, k2, spans: byte ranges covered by repeated windows."""
    contexts = stored(_contexts(texts), "contexts")
    copy = F.struct(*(F.col(c) for c in ("k1", "k2", "place", "first", "last")))
    distinct = stored(contexts.groupBy("run", *CONTEXT).agg(F.count("*").alias("n"), F.min(copy).alias("copy")), "distinct")
    several = stored(distinct.groupBy("run").agg(F.count("*").alias("g")).where("g > 1").select("run"), "several", distinct.count() // 2)
    open_ = stored(_cut(texts, distinct.join(several, "run").select("run", *CONTEXT, "copy")), "cuts")
    rows = open_.select(F.col("run").alias("group"), *CONTEXT, "ahead", F.greatest(F.lit(0), F.col("ahead") - (F.octet_length("bytes") - LENGTH)).alias("low"), F.col("ahead").alias("high"), "bytes")
    ranges_ = stored(_repeated_windows(rows, local, ranges), "ranges").groupBy(*CONTEXT).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    decided = distinct.select(*CONTEXT, (F.col("n") > 1).alias("all")).join(ranges_, CONTEXT, "left")
    decided = stored(decided.where("all OR ranges IS NOT NULL"), "decided")
    release(open_)
    release(distinct)
    covered = contexts.join(decided, CONTEXT)
    whole = F.array(F.struct(F.col("first").alias("low"), (F.col("last") + LENGTH).alias("high")))
    parts = F.transform("ranges", lambda r: F.struct((F.col("place") - r["high"]).alias("low"), (F.col("place") - r["low"] + LENGTH).alias("high")))
    return covered.select(*KEY, F.when(F.col("all"), whole).otherwise(parts).alias("spans")).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges: maximal runs in order."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate(([True], low[1:] > reach[:-1]))
    return low[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(low) - 1]))]


def _removed(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    schema = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text

    def step(rows, data):
        out = []
        for x, spans_ in zip(data, rows.column("spans"), strict=True):
            fields = spans_.values
            low, high = merged(*(fields.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            kept = b"".join(x[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(x)], strict=True))
            out.append((len(x) - len(kept), len(low), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return [rows.column("k1"), rows.column("k2"), *columns[: 4 if with_text else 3]]

    return map_texts(texts.drop("runs").join(spans, KEY), step, schema, most=1 << 20)


def without_repeats(df: DataFrame, text: str = "text", local: int = LOCAL, ranges: tuple[int, ...] = RANGES, with_text: bool = False) -> DataFrame:
    """The rows of df without `text`, with n_bytes, n_removed, n_spans, kept_sha256, and with `with_text`
    kept_bytes. local, ranges: how many contexts of a run meet in one task, and the passes over runs with more;
    the result does not depend on them. The last range must be 1."""
    rows, names = tucked(df, text)
    keyed = _keyed(rows, "text")
    texts = keyed.where(F.octet_length("text") >= LENGTH).select(*KEY, "text")
    anchored = stored(_anchor_rows(texts), "anchors")
    keys = stored(texts.groupBy(*KEY).count(), "keys")
    candidates = stored(_candidates(anchored).join(keys.select(*KEY), "k1"), "candidates")
    release(anchored)
    held = stored(texts.dropDuplicates(KEY).join(candidates, KEY), "texts")
    release(candidates)
    results = stored(_removed(held, stored(_repeated(held, local, ranges), "spans"), with_text), "results")
    release(held)
    copies = keys.where("count > 1").select(*KEY, F.lit(True).alias("copied"))
    given = F.coalesce(F.col("text"), F.lit(""))
    base = keyed.withColumn("n_bytes", F.octet_length(given).cast("long"))
    if with_text:
        base = base.withColumn("whole", given.cast("binary"))
    out = base.drop("text").join(copies, KEY, "left").join(results, KEY, "left")

    def pick(copied: Column, found: Column, otherwise: Column) -> Column:
        return F.when(F.col("copied"), copied).when(F.col("n_removed").isNotNull(), found).otherwise(otherwise)

    empty, zero = F.lit(hashlib.sha256().hexdigest()), F.lit(0).cast("long")
    made = {"n_bytes": F.col("n_bytes"), "n_removed": pick(F.col("n_bytes"), F.col("n_removed"), zero), "n_spans": pick(F.lit(1).cast("long"), F.col("n_spans"), zero), "kept_sha256": pick(empty, F.col("kept_sha256"), F.col("sha"))}
    if with_text:
        made["kept_bytes"] = pick(F.lit(b""), F.col("kept_bytes"), F.col("whole"))
    return untucked(out, names, made)


def op2_repeated_windows(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
