"""Quality rules, line first: every line is held against punctuation, navigation and boilerplate rules,
failing lines are removed, and a document that loses too much of its text is rejected. The word lists of the rules are those of
English, German, French and Spanish.

Main path: DataFrame functions only, no shuffle; each document is judged within its row.

Defined cases: a null text counts as no words at all (base_failed, not kept, clean_text empty); an empty
text likewise; equal rows give equal results, one result per row; further columns pass through
`clean_lines` and `with_quality`, whose own columns carry the given prefix so that names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import SPACE, WORD, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when its removed lines hold more than this share of the characters of its lines.
MAX_LOST = 0.5
#: Ends a sentence: terminal punctuation, perhaps with closing quotes or brackets after it.
TERMINAL = r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""
#: A sentence that ends within a line: the line is prose even if its own end is cut off.
INNER_END = r"""\p{L}[.!?]["'”’»)\]]*[\x20\x09]"""
SYMBOL_RUN = r"[#*$%&|<>]{3}"
#: A line fails if more than one in this many of its words carries a run of symbols.
SYMBOL_SHARE = 4
MENU = r"""(?:^|[\x20\x09])[|»›•·>][\x20\x09].*[\x20\x09][|»›•·>](?:[\x20\x09]|$)"""
# Words of menus in English, German, French and Spanish; letters beyond ASCII in both cases.
LINKS = (
    "home", "about(?: us)?", "contact(?: us)?", "log ?in", "log ?out", "sign ?(?:in|up)", "register", "search", "menu", "next", "previous", "back to top", "read more", "skip to content", "share", "subscribe", "site ?map", "faq", "help",
    "startseite", "[üÜ]ber uns", "kontakt", "anmelden", "abmelden", "registrieren", "suche", "men[üÜ]", "weiter", "zur[üÜ]ck", "nach oben", "weiterlesen", "teilen", "abonnieren", "hilfe", "impressum",
    "accueil", "[àÀ] propos", "connexion", "d[éÉ]connexion", "inscription", "rechercher", "suivant", "pr[éÉ]c[éÉ]dent", "haut de page", "lire la suite", "partager", "plan du site", "aide",
    "inicio", "acerca de", "contacto", "iniciar sesi[óÓ]n", "cerrar sesi[óÓ]n", "registrarse", "buscar", "siguiente", "anterior", "volver arriba", "leer m[áÁ]s", "compartir", "suscribirse", "mapa del sitio", "ayuda",
)
NAVIGATION = rf"(?i)^\W*(?:{'|'.join(LINKS)})(?:\W+(?:{'|'.join(LINKS)}))*\W*$"
# Legal and technical notices in the same languages, by their first letter.
NOTICES = (
    "a(?:ll rights reserved|lle rechte vorbehalten|ctiv(?:er|ar|e) javascript)", "bajo (?:la )?licencia", "c(?:ookie policy|opyright (?:©|\\(c\\)|[0-9]{4})|ondi(?:tions d.utilisation|ciones de uso))",
    "datenschutzerkl[äÄ]rung", "enable javascript", "javascript aktivieren", "l(?:icen[sc]ed under|izenziert unter|orem ipsum)", "nutzungsbedingungen",
    "p(?:rivacy policy|olitique de confidentialit[éÉ]|ol[íÍ]tica de (?:privacidad|cookies))", "released under the", "s(?:ous licence|pdx-license-identifier)",
    "t(?:erms of (?:use|service)|ous droits r[éÉ]serv[éÉ]s|odos los derechos reservados|[éÉ]rminos (?:de uso|del? servicio))", "u(?:se of cookies|tilisation (?:de|des) cookies|so de cookies)", "ver(?:wendung von cookies|[öÖ]ffentlicht unter der)",
)
BOILERPLATE = rf"(?i)(?:{'|'.join(NOTICES)})"


def line_fails(line: Column) -> Column:
    """True if a line breaks one of the three rules."""
    symbols = F.regexp_count(line, F.lit(SYMBOL_RUN))
    n_words = F.regexp_count(line, F.lit(WORD))
    punctuation = ~(line.rlike(TERMINAL) | line.rlike(INNER_END)) | (symbols * SYMBOL_SHARE > n_words)
    return punctuation | line.rlike(MENU) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def with_lines(df: DataFrame, text: str = "text", prefix: str = "q_", max_lost: float = MAX_LOST) -> DataFrame:
    """df with {prefix}lines (lines that have a word), {prefix}clean (those that pass), {prefix}line_chars,
    {prefix}clean_chars and {prefix}lost (boolean: too much text lost, or none there)."""
    c = lambda name: F.col(prefix + name)
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return (
        df.withColumn(prefix + "lines", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(WORD)))
        .withColumn(prefix + "clean", F.filter(c("lines"), lambda x: ~line_fails(x)))
        .withColumn(prefix + "line_chars", chars(c("lines")))
        .withColumn(prefix + "clean_chars", chars(c("clean")))
        .withColumn(prefix + "lost", (c("line_chars") == 0) | (c("line_chars") - c("clean_chars") > F.lit(max_lost) * c("line_chars")))
    )


def repeated_words(array: Column, count: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. The windows' hashes are sorted with their
    places; equal neighbours give the places of repeated windows, whose union is then measured."""
    hashes = F.transform(F.sequence(F.lit(0), count - 3), lambda i: F.struct(F.xxhash64(F.get(array, i), F.get(array, i + 1), F.get(array, i + 2)).alias("h"), i.alias("i")))
    return F.when(count >= 4, F.sort_array(hashes))


def _places(ordered: Column) -> Column:
    same = lambda k, x: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(ordered, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))


def _covered(places: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    return F.coalesce(F.aggregate(places, start, step, lambda acc: acc["n"]), F.lit(0).cast("long"))


def with_quality(df: DataFrame, text: str = "text", prefix: str = "q_", max_lost: float = MAX_LOST) -> DataFrame:
    """df with the counts, {prefix}base_failed, {prefix}kept and {prefix}clean_text (the passing lines)."""
    c = lambda name: F.col(prefix + name)
    given = F.coalesce(F.col(text), F.lit(""))
    length = lambda a: F.size(a).cast("long")
    out = with_lines(df, text, prefix, max_lost)
    out = out.withColumn(prefix + "words", words(given)).withColumn(prefix + "count", F.size(c("words")))
    out = out.withColumn(prefix + "ordered", repeated_words(c("words"), c("count"))).withColumn(prefix + "places", _places(c("ordered")))
    out = (
        out.withColumn(prefix + "n_words", c("count").cast("long"))
        .withColumn(prefix + "word_chars", F.length(F.regexp_replace(given, SPACE, "")).cast("long"))
        .withColumn(prefix + "n_symbols", F.regexp_count(given, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn(prefix + "n_dup_lines", length(c("lines")) - length(F.array_distinct(c("lines"))))
        .withColumn(prefix + "n_repeat_words", _covered(c("places")))
        .withColumn(prefix + "n_lines", length(c("lines")))
        .withColumn(prefix + "n_lines_removed", length(c("lines")) - length(c("clean")))
        .withColumn(prefix + "clean_text", F.concat_ws("\n", c("clean")))
    )
    out = out.withColumn(prefix + "base_failed", (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")))
    out = out.withColumn(prefix + "kept", ~c("base_failed") & ~c("lost"))
    return out.drop(*(prefix + x for x in ("lines", "clean", "words", "count", "ordered", "places")))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from corpuscle.llm.shared import documents

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "line_chars", "clean_chars"]
    out = with_quality(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *(F.col("q_" + x).alias(x) for x in names), F.sha2("q_clean_text", 256).alias("clean_sha256"))
