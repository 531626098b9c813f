"""Cost-balanced packing of documents into training sequences.

A document is its token ids and an end id. The cost of a piece of n tokens is n + QUADRATIC * n * n
(attention). Each task packs the documents of its own partition, without a shuffle, in pools of bounded
size: documents longer than a sequence first fill whole sequences, then the rest, in descending order of
cost, go each to the sequence of lowest cost that has room for it; a piece that has room nowhere is cut at
the room of the sequence of lowest cost. A pool opens as many sequences as its tokens fill, so that all are
full; what is left (less than a sequence) goes on to the next pool. At a partition's end that rest is cut
into sequences whose lengths are powers of two, which need no padding.

A sequence's number is the task's partition number times 2**33 plus a count: the same when a task is run
again over the same partition.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed each; ties
are taken in the order of reading; null ids of rows pass through; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from unicodedata import is_normalized, normalize

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from corpuscle.llm.shared import arrow_schema, bounded_batches, documents, trimmed
from corpuscle.llm.tokens import load

LENGTH = 2048
END_ID = 1
QUADRATIC = 1 / 4096
#: Tokens of a pool, beyond which it is packed.
POOL = 256 * LENGTH
#: Words of at most KEPT bytes of which a Python worker keeps the ids, in each of two generations.
CACHE = 150_000
KEPT = 64
TOKENIZER = "word_bpe_49k.json"
#: The first letter behind the Latin blocks.
LATIN = "\u0250"
#: Byte-level vocabularies spell a byte as the character of its number where that can be seen, else as one
#: of the characters from 256 on, in order.
SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SEEN)}


#: What WordIds takes for granted: letters, single digits and other characters are pre-tokens of their own,
#: whatever their case, and white space only divides them.
ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def divides_words(tokenizer) -> bool:
    """Whether a text's ids are its words' ids in a row: normalizer and pre-tokenizer are the ones that
    WordIds knows, and no added string holds white space or starts otherwise than with <|."""
    config = json.loads(tokenizer.to_str())
    added = config["added_tokens"]
    plain = all(t["content"].startswith("<|") and not t["content"].split()[1:] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
    return plain and all(config[k] == v for k, v in ASSUMED.items())


class TextIds:
    """Ids of texts for any vocabulary, each text encoded as a whole."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __call__(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()


class WordIds:
    """Ids of texts for a vocabulary whose pre-tokens are letters, single digits or other characters,
    without regard to case or white space: a text's ids are its words' ids in a row. The ids of frequent
    words are kept. A word of letters (in its normal form too: a letter may fall apart there) and a comma or
    full stop after it are two pre-tokens, looked up apart. A new word of lower-case Latin letters is one
    pre-token that normalization leaves as it is, so it goes to the library's model at once; any other word
    goes through the whole of the tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer, self.young, self.old = tokenizer, {}, {}

    def __call__(self, text: bytes) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        # special strings are told apart by case; texts that may hold them keep theirs
        words = (text if b"<|" in text else text.lower()).split()
        young, new, two = self.young, [], []
        for w in set(words):
            if w not in young and not self._known(w):
                if w[-1:] in (b",", b".") and _letters(w[:-1].decode()):
                    two.append(w)
                    if w[:-1] not in young and not self._known(w[:-1]):
                        new.append(w[:-1])
                else:
                    new.append(w)
        if new:
            self._learn(new)
        for w in two:
            young[w] = young[w[:-1]] + self._single(w[-1:])
        ids = b"".join(map(young.__getitem__, words))
        for w in [*new, *two]:
            if len(w) > KEPT:
                young.pop(w, None)
        if len(young) > CACHE:
            self.old, self.young = young, {}
        return ids

    def _known(self, word: bytes) -> bool:
        found = self.old.get(word)
        if found is not None:
            self.young[word] = found
        return found is not None

    def _single(self, word: bytes) -> bytes:
        if word not in self.young:
            self.young[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return self.young[word]

    def _learn(self, words: list[bytes]) -> None:
        tokenize, rest = self.tokenizer.model.tokenize, []
        for w in words:
            text = w.decode()
            if text.isalpha() and text == text.lower() and (text.isascii() or max(text) < LATIN and is_normalized("NFC", text)):
                found = tokenize(text if text.isascii() else w.decode("latin-1").translate(BYTES))
                self.young[w] = np.array([x.id for x in found], "<u4").tobytes()
            else:
                rest.append(text)
        self._each(rest)

    def _each(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.young[w.encode()] = np.array(e.ids, "<u4").tobytes()


def _letters(word: str) -> bool:
    """Whether a word is one pre-token of letters, as given and in its normal form."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


def new_ids(path: str) -> WordIds | TextIds:
    """For one task: what it has kept goes with it."""
    tokenizer = load.__wrapped__(path)
    return WordIds(tokenizer) if divides_words(tokenizer) else TextIds(tokenizer)


@functools.cache
def text_ids(path: str) -> WordIds | TextIds:
    """One for each worker process, whose tasks share what it has kept."""
    return new_ids(path)


def pack_pool(pieces: list[tuple], length: int = LENGTH, quadratic: float = QUADRATIC, last: bool = False):
    """pieces: (size, document, start). Returns sequences, lists of such pieces in order, and the pieces
    left over; with `last`, these fill sequences whose lengths are powers of two."""
    sequences: list[list[tuple]] = []
    rest: list[tuple[int, int, int]] = []
    for size, doc, start in pieces:
        whole = size // length
        sequences += [[(length, doc, start + k * length)] for k in range(whole)]
        if size % length:
            rest.append((size % length, doc, start + whole * length))
    n = sum(x[0] for x in rest) // length
    room, cost = np.full(n, length), np.zeros(n)
    opened: list[list[tuple]] = [[] for _ in range(n)]
    heap = [(-size, k, doc, start) for k, (size, doc, start) in enumerate(rest)]
    heapq.heapify(heap)
    order, filled = len(heap), 0
    while heap and filled < n:
        size, _, doc, start = heapq.heappop(heap)
        size = -size
        fits = room >= size
        at = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
        part = min(size, int(room[at]))
        opened[at].append((part, doc, start))
        room[at] -= part
        cost[at] += part + quadratic * part * part
        filled += room[at] == 0
        if part < size:
            order += 1
            heapq.heappush(heap, (part - size, order, doc, start + part))
    left = [(-size, doc, start) for size, _, doc, start in sorted(heap)]
    if last:
        total = sum(x[0] for x in left)
        for bit in range(total.bit_length() - 1, -1, -1):
            if need := total & (1 << bit):
                sequences.append([])
                while need:
                    size, doc, start = left.pop(0)
                    part = min(size, need)
                    sequences[-1].append((part, doc, start))
                    need -= part
                    if part < size:
                        left.insert(0, (size - part, doc, start + part))
    return sequences + opened, left


def packed(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, quadratic: float = QUADRATIC, with_ids: bool = False, keep: bool = True) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost
    (the estimated cost of its sequence), and with `with_ids` the ids themselves. keep: whether workers keep the
    ids of words from task to task, which saves time and takes memory."""
    made = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double" + ", ids array<int>" * with_ids
    schema = StructType([df.schema[key], *StructType.fromDDL(made).fields])
    out = arrow_schema(schema)
    bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = text_ids(path) if keep else new_ids(path), np.array([end_id], "<u4").tobytes()
        made = TaskContext.get().partitionId() << 33
        docs: dict[int, tuple] = {}  # number -> key, ids of those that a piece still needs
        left: list[tuple] = []
        tokens = count = 0

        def flush(last: bool):
            nonlocal made, left, tokens, docs
            sequences, left = pack_pool(left, length, quadratic, last)
            rows = []
            for pieces in sequences:
                offset, cost = 0, sum(size + quadratic * size * size for size, _, _ in pieces)
                for size, doc, start in pieces:
                    name, ids = docs[doc]
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((name, start, size, zlib.crc32(part), len(ids) // 4, made, offset, cost) + ((np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else ()))
                    offset += size
                made += 1
            docs = {d: docs[d] for d in {x[1] for x in left}}
            tokens = sum(x[0] for x in left)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)] if rows else [pa.array([], type=f.type) for f in out], schema=out)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for i, name in enumerate(names):
                ids = encode(texts[i].as_py() or b"") + end
                docs[count] = (name, ids)
                left.append((len(ids) // 4, count, 0))
                count += 1
                tokens += len(ids) // 4
                if tokens >= POOL:
                    yield flush(False)
        yield flush(True)

    return df.select(key, text).mapInArrow(trimmed(run), schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
