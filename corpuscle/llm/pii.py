"""Personal data: regular expressions propose spans, checksum validators confirm them, nearby context
words adjust the score: some lift it, others sink it. Scores are whole percents. Spans of the base kinds count
at any score; the kinds that the method adds count from MIN_SCORE on, so that for each of them context decides in
one direction or both.

Main path: DataFrame functions only, no shuffle. A kind's matches are wrapped in a mark character by one
regexp_replace, the text is split at the marks, and running sums of the pieces' lengths give the places
(code points, end exclusive). Patterns are written so that each is linear on long runs (possessive
quantifiers, look-behind instead of retries inside a run) and matches what the plain pattern would.

Defined cases: a null text is empty and has no spans; repeated rows give equal results; ties (spans of
several kinds at one start) are ordered by the kinds' order in KINDS; further columns pass through, own
columns carry the prefix given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import documents

MARK, OTHER = "\x01", "\x02"
CONTEXT_CHARS = 48
MIN_SCORE = 50
CHUNK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    #: Cheap test that a text may hold a match at all.
    hint: str
    pattern: str
    valid: Callable[[Column], Column]
    #: Percents: of a confirmed span, what words like `context` before it add, what those like `against` take.
    score: int
    context: str
    bonus: int
    base: bool = True
    against: str = ""
    malus: int = 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit(text: Column, place: Column) -> Column:
    return F.ascii(F.substring(text, place, F.lit(1))) - 48


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _digit(digits, n - i + 1)
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """ISO 7064 mod 97-10 over an account number whose first four characters go to its end."""
    plain = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _octets(text: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.split(text, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))


def _between(text: Column, least: int, most: int) -> Column:
    return F.length(_digits(text)).between(least, most)


#: In the order in which spans that start together are listed.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x: F.lit(True), 90, r"e-?mail|mail|contact|kontakt|correo|courriel", 10),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _octets, 60, r"\bip\b|host|server|address|adresse", 30, against=r"version|section|chapter", malus=30),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++", lambda x: F.when(_between(x, 12, 19), luhn(_digits(x))).otherwise(F.lit(False)), 70, r"card|visa|master|amex|karte|carte|tarjeta|credit", 30, against=r"order|invoice|isbn|serial", malus=30),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: _between(x, 9, 15), 70, r"phone|tel|call|fax|mobile|handy|llam", 30),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda x: mod97(x), 60, r"iban|account|konto|compte|cuenta|bank", 40, False, r"serial|model|version|part no", 20),
    Kind("ssn", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])", lambda x: F.lit(True), 30, r"ssn|social security|tax(?:payer)? id", 50, False, r"serial|model|order|part no", 40),
    Kind("secret", r"[A-Za-z0-9+/_-]{32}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+", lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]"), 30, r"token|secret|api|key|passw|auth|credential|bearer", 50, False, r"sha|md5|commit|checksum|hash|digest", 40),
)


def scan(values: Column, step: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """For each item, `step` folded over the items before it. Two levels of chunks, so that the work
    stays near linear for long arrays."""
    first = F.array(F.lit(start)).cast("array<int>")
    push = lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x)))
    fold = lambda a: F.aggregate(a, F.lit(start).cast("int"), step)
    n = F.size(values)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    before = F.aggregate(F.transform(chunks, fold), first, push)
    inner = lambda chunk, c: F.slice(F.aggregate(chunk, F.array(F.get(before, c)).cast("array<int>"), push), F.lit(1), F.size(chunk))
    return F.when(n > 0, F.flatten(F.transform(chunks, inner))).otherwise(F.array().cast("array<int>"))


def _confirmed(kind: Kind, at: int, pieces: Column, lens: Column, starts: Column, min_score: int) -> Column:
    """Of the pieces with odd places, which are a kind's matches, those that its validator confirms."""

    def span(k: Column) -> Column:
        near = F.lower(F.substring(F.get(pieces, k - 1), -CONTEXT_CHARS, CONTEXT_CHARS))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), kind.bonus).otherwise(0)
        if kind.against:
            score = score - F.when(near.rlike(kind.against), kind.malus).otherwise(0)
        start = F.get(starts, k)
        return F.struct(start.alias("start"), F.lit(at).alias("kind"), (start + F.get(lens, k)).alias("end"), score.alias("score"), F.get(pieces, k).alias("text"))

    places = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
    spans = F.filter(F.transform(places, span), lambda s: kind.valid(s["text"]) & (F.lit(kind.base) | (s["score"] >= min_score)))
    return F.transform(spans, lambda s: F.struct(*(s[x].alias(x) for x in ("start", "kind", "end", "score"))))


def with_spans(df: DataFrame, text: str = "text", prefix: str = "pii_", kinds: tuple[Kind, ...] = KINDS, min_score: int = MIN_SCORE) -> DataFrame:
    """df with {prefix}spans: array<struct<start int, kind int (place in kinds), end int, score int>>
    in order of start, then kind."""
    c = lambda name: F.col(prefix + name)
    out = df.withColumn(prefix + "text", F.translate(F.coalesce(F.col(text), F.lit("")), MARK, OTHER))
    found = []
    for at, kind in enumerate(kinds):
        pieces, lens, starts = (f"{prefix}{x}_{kind.name}" for x in ("pieces", "lens", "starts"))
        may = c("text").contains(kind.hint) if kind.hint == "@" else c("text").rlike(kind.hint)
        out = out.withColumn(pieces, F.when(may, F.split(F.regexp_replace(c("text"), kind.pattern, f"{MARK}$0{MARK}"), MARK)))
        out = out.withColumn(lens, F.when(F.size(pieces) > 1, F.transform(pieces, lambda x: F.length(x))))
        out = out.withColumn(starts, F.when(F.col(lens).isNotNull(), scan(F.col(lens), lambda a, b: a + b)))
        found.append(F.coalesce(F.when(F.col(starts).isNotNull(), _confirmed(kind, at, F.col(pieces), F.col(lens), F.col(starts), min_score)), F.array().cast("array<struct<start:int,kind:int,end:int,score:int>>")))
    out = out.withColumn(prefix + "spans", F.sort_array(F.concat(*found)))
    return out.drop(prefix + "text", *(f"{prefix}{x}_{k.name}" for k in kinds for x in ("pieces", "lens", "starts")))


def listed(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(df: DataFrame, text: str = "text", spans: str = "pii_spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """df with `text` in which each union of overlapping spans is replaced by <KIND> of its first span.
    A text without spans (null too) stays as it is."""
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in kinds))
    s, t = F.col(spans), F.col(text)
    out = df.withColumn("pii_reached", F.when(F.size(s) > 0, scan(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))))
    reached = F.col("pii_reached")

    def piece(x: Column, i: Column) -> Column:
        done = F.get(reached, i)
        gap = F.substring(t, done + 1, F.greatest(x["start"] - done, F.lit(0)))
        return F.when(x["start"] >= done, F.concat(gap, F.get(names, x["kind"]))).otherwise("")

    last = F.greatest(F.array_max(reached), F.get(s, F.size(s) - 1)["end"])
    whole = F.concat(F.concat_ws("", F.transform(s, piece)), F.substring(t, last + 1, F.length(t)))
    return out.withColumn(text, F.when(reached.isNotNull(), whole).otherwise(t)).drop("pii_reached")


def _count(spans: Column, at: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == at)).cast("long")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    out = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["kind"] < 4)
    counts = [_count(spans, i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), F.concat_ws(",", F.transform(spans, lambda s: s["score"].cast("string"))).alias("scores"))
