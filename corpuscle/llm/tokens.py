"""Token counts with overlap resynchronisation.

Short texts are encoded whole, in batches. A huge text is cut into chunks that overlap; each chunk is
encoded with offsets, and two neighbours are spliced at a boundary that both have in the overlap and that
is proven: the pre-tokenizer looks at most a few characters ahead and never behind, so that a boundary of
the left chunk that lies MARGIN or more characters before its end is a boundary of the whole text, and a
chunk that has a boundary there too agrees with the whole text from there on. MARGIN is longer than the
vocabulary's special strings and contractions. Where the overlap holds no common boundary (one word may be
megabytes long) it is widened, at last to the whole of both chunks.

Defined cases: null and empty texts have 0 tokens and 0 bytes; equal texts have equal counts; each row
gets one row; other columns pass through, but those named as a made one, which it replaces.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame

from corpuscle.llm.shared import documents, extended

CHUNK = 16_384
OVERLAP = 256
MARGIN = 32
LIMIT = 512
TOKENIZER = "byte_bpe_50k.json"


@functools.cache
def load(path: str):
    """The tokenizer of a file, one for each process, on one thread: executors have a task for each core
    already."""

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def starts(encoding, base: int, low: int, high: int, from_end: bool) -> dict[int, int]:
    """Places in [low, high] of the text where a pre-token of the chunk at `base` starts, with the
    number of the token that starts there."""
    found: dict[int, int] = {}
    n = len(encoding)
    for i in range(n - 1, -1, -1) if from_end else range(n):
        if i and encoding.token_to_word(i) == encoding.token_to_word(i - 1):
            continue
        at = base + encoding.token_to_chars(i)[0]
        if at < low and from_end or at > high and not from_end:
            break
        if low <= at <= high:
            found[at] = i
    return found


def count_long(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """The number of tokens of the whole text, from chunks of `chunk` characters."""
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    total, begin, end, skip = 0, 0, min(chunk, len(text)), 0
    left = encode(begin, end)  # counted from token `skip` on
    while end < len(text):
        wide = overlap
        while True:
            start = max(begin, end - wide)
            stop = min(len(text), end + max(chunk, end - begin if start == begin else 0))
            right = encode(start, stop)
            ours = starts(left, begin, start, end - margin, True)
            theirs = starts(right, start, start, end - margin, False)
            # a boundary at the very start of the right chunk shows nothing: every chunk has it
            common = [p for p in ours.keys() & theirs.keys() if p > start and ours[p] >= skip]
            if common or start == begin:
                break
            wide *= 4
        if common:
            p = max(common)
            total += ours[p] - skip
            skip = theirs[p]
            begin = start
        else:  # the right chunk holds all of the left one: it takes its place
            skip = 0 if begin == 0 or skip == 0 else _same_place(left, right, skip)
        left, end = right, stop
    return total + len(left) - skip


def _same_place(left, right, skip: int) -> int:
    """The right chunk starts where the left one starts, so that up to a proven boundary they agree."""
    at = left.token_to_chars(skip)[0]
    return next(i for i in range(len(right)) if right.token_to_chars(i)[0] == at)


def with_counts(df: DataFrame, path: str, text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows of df without `text`, with n_bytes, n_tokens, over_limit, which take the place of columns
    of these names."""

    def step(texts):
        tokenizer = load(path)
        strings = ["" if x is None else x.decode() for x in texts]
        short = [i for i, x in enumerate(strings) if len(x) <= chunk]
        counts = [0] * len(strings)
        for i, e in zip(short, tokenizer.encode_batch_fast([strings[i] for i in short], add_special_tokens=False), strict=True):
            counts[i] = len(e)
        for i, x in enumerate(strings):
            if len(x) > chunk:
                counts[i] = count_long(x, tokenizer, chunk, overlap)
        return [[len(x or b"") for x in texts], counts, [n > limit for n in counts]]

    return extended(df, step, "n_bytes long, n_tokens long, over_limit boolean", text, most=1 << 20)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_counts(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
