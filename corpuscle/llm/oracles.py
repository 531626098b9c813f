"""DuckDB SQL of the queries that SQL can express, written independently of the DataFrame code."""

from __future__ import annotations

from corpuscle.llm import pii, quality

_TERMINAL, _INNER, _MENU, _NAV, _BOILER = (x.replace("'", "''") for x in (quality.TERMINAL, quality.INNER_END, quality.MENU, quality.NAVIGATION, quality.BOILERPLATE))

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS o FROM d),
lw AS (SELECT doc_id, o, line,
         NOT (regexp_matches(line, '{_TERMINAL}') OR regexp_matches(line, '{_INNER}'))
         OR len(regexp_extract_all(line, '[#*$%&|<>]{{3}}')) * {quality.SYMBOL_SHARE} > len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))
         OR regexp_matches(line, '{_MENU}') OR regexp_matches(line, '{_NAV}') OR regexp_matches(line, '{_BOILER}') AS fails
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
la AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups,
         CAST(sum(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS removed, CAST(sum(length(line)) AS BIGINT) AS chars,
         CAST(sum(CASE WHEN fails THEN 0 ELSE length(line) END) AS BIGINT) AS clean, string_agg(line, chr(10) ORDER BY o) FILTER (NOT fails) AS kept_lines FROM lw GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(removed, 0) AS n_lines_removed, coalesce(chars, 0) AS line_chars, coalesce(clean, 0) AS clean_chars, sha256(coalesce(kept_lines, '')) AS clean_sha256
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_chars > 0 AND line_chars - clean_chars <= {quality.MAX_LOST} * line_chars AS kept,
  n_lines, n_lines_removed, line_chars, clean_chars, clean_sha256
FROM r
"""



def _kind(at: int, pattern: str, valid: str) -> str:
    """Matches of one kind with their places: marks around the matches, then running lengths."""
    kind = pii.KINDS[at]
    near = "lower(right(before, 48))"
    score = f"{kind.score} + CASE WHEN regexp_matches({near}, '{kind.context}') THEN {kind.bonus} ELSE 0 END - CASE WHEN regexp_matches({near}, '{kind.against or '$^.'}') THEN {kind.malus} ELSE 0 END"
    return rf"""
SELECT * FROM (SELECT doc_id, {at} AS k, '{kind.name}' AS kind, start, start + length(p) AS stop, {score} AS score FROM (
  SELECT doc_id, p, o, CAST(coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    lag(p) OVER (PARTITION BY doc_id ORDER BY o) AS before, lead(p) OVER (PARTITION BY doc_id ORDER BY o) AS after
  FROM (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS o
        FROM (SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS s FROM d)))
WHERE o % 2 = 0 AND {valid}){'' if kind.base else f' WHERE score >= {pii.MIN_SCORE}'}"""


_DIGITS = "regexp_replace(p, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INT) WHEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INT) > 4 THEN 2 * CAST({_DIGITS}[length({_DIGITS}) - i] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[length({_DIGITS}) - i] AS INT) END)) % 10 = 0"
_PLAIN = "regexp_replace(p, '[^A-Za-z0-9]', '', 'g')"
_TURNED = f"({_PLAIN}[5:] || {_PLAIN}[1:4])"
_MOD97 = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({_TURNED}, ''), lambda c: CAST(CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS BIGINT))), lambda a, v: CASE WHEN v >= 10 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"

OP3 = rf"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
m AS ({" UNION ALL ".join([
    _kind(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _kind(1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(p, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"),
    _kind(2, r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    _kind(3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    _kind(4, r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97),
    _kind(5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(p, '^(000|666|9)|-00-|-0000$') AND before NOT LIKE '%-' AND after NOT LIKE '-%'"),
    _kind(6, r"[A-Za-z0-9+/_-]{32,}", "regexp_matches(p, '[0-9]') AND regexp_matches(p, '[A-Za-z]')"),
])}),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, count(*) FILTER (k = 4) AS n_iban, count(*) FILTER (k = 5) AS n_ssn, count(*) FILTER (k = 6) AS n_secret,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 4) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans, string_agg(score, ',' ORDER BY start, k) AS scores FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn, coalesce(n_secret, 0) AS n_secret, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN a USING (doc_id)
"""

#: Windows as hexadecimal text, cut from pieces of 512 bytes and what they need behind them.
OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, c, least(512, length(h) // 2 - 199 - 512 * c) AS size, h[1024 * c + 1:1024 * c + 1422] AS part FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 199 + 511) // 512)) AS c FROM d)),
w AS (SELECT doc_id, 512 * c + j AS i, md5(part[2 * j + 1:2 * j + 400]) AS m FROM (SELECT *, unnest(range(0, size)) AS j FROM p)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS low, max(i) + 200 AS high FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k),
g AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM s),
k AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, string_agg(h[2 * before + 1:2 * low], '' ORDER BY low) || any_value(h)[2 * max(high) + 1:] AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

SQL = {"op1_quality_rules": OP1, "op2_repeated_windows": OP2, "op3_pii": OP3}
