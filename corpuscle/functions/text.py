"""Column functions on text: terms, normal form, q-grams, prefix edit distance, code lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "[^a-zA-Z]+"
PAD = "$"

# The built-in stop words, most frequent first.
STOP_WORDS = ("the", "a", "and", "film", "by", "is", "of", "in", "directed", "to", "was", "s", "it", "on", "written", "as", "for", "with", "drama", "short")


def words(text: Column) -> Column:
    """Runs of ASCII letters, in their own case; null gives null."""
    return F.array_remove(F.split(text, SEPARATOR), "")


def terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of ASCII letters, without stop words. Lower case comes after the split, so that no
    other letter turns into an ASCII one."""
    found = F.transform(words(text), lambda w: F.lower(w))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def lowered_words(text: Column) -> Column:
    """Lower case first, then runs of letters: the form of the labelled corpora."""
    return F.array_remove(F.split(F.lower(text), "[^a-z]+"), "")


def normal(text: Column) -> Column:
    """Lower case without everything but ASCII letters, digits and underscores."""
    return F.regexp_replace(F.lower(text), r"\W", "")


def qgrams(text: Column, q: int = 3, pad: str = "both") -> Column:
    """All q-grams of the normal form, padded on both sides or on the left; duplicates stay."""
    side = PAD * (q - 1)
    padded = F.concat(F.lit(side), normal(text), F.lit(side if pad == "both" else ""))
    count = F.length(padded) - (q - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(padded, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def prefix_edit_distance(x: Column, y: Column, delta: Column) -> Column:
    """The least edit distance between x and a prefix of y of at most |x| + delta characters, or
    delta + 1 if that is more; 0 for an empty x."""
    reach = F.least(F.length(x) + delta, F.length(y))
    best = F.array_min(F.transform(F.sequence(F.lit(0), reach), lambda j: F.levenshtein(x, F.substring(y, F.lit(1), j))))
    return F.when(F.length(x) == 0, F.lit(0)).otherwise(F.least(best, (delta + 1).cast("int")))


def posting_string(pairs: Column) -> Column:
    """[(1, 9), (6, 5)] for an array of structs of doc_id and score."""
    one = lambda p: F.concat(F.lit("("), p["doc_id"].cast("string"), F.lit(", "), p["score"].cast("string"), F.lit(")"))
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(pairs, one)), F.lit("]"))


def _log2_floor(n: Column) -> Column:
    """Whole binary logarithm of a positive integer, from its binary digits: no rounding."""
    return F.length(F.bin(n)) - 1


def gamma_bits(gap: Column) -> Column:
    """Bits of the Elias gamma code."""
    return (2 * _log2_floor(gap) + 1).cast("long")


def delta_bits(gap: Column) -> Column:
    """Bits of the Elias delta code: the length of the number in gamma, then its other digits."""
    return (_log2_floor(gap) + gamma_bits(_log2_floor(gap) + 1)).cast("long")


def vbyte_bits(gap: Column) -> Column:
    """Bits of the variable-byte code: seven of the number in each byte."""
    return (8 * F.ceil((_log2_floor(gap) + 1) / 7)).cast("long")


def golomb_bits(gap: Column, p: Column) -> Column:
    """Bits of the Golomb code for gaps of probability (1 - p)**(gap - 1) * p: floor(gap * p / ln 2) + 1 +
    ceil(log2(ln 2 / p)), the latter 0 at least."""
    ln2 = F.log(F.lit(2.0))
    return (F.floor(gap * p / ln2) + 1 + F.greatest(F.ceil(F.log2(ln2 / p)), F.lit(0))).cast("long")
