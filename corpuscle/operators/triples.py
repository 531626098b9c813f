"""Graph patterns: a small SPARQL dialect, compiled to joins over a table of triples.

SELECT ?a ?b WHERE { ?a "p" "o" . ?a ?q ?b } LIMIT n. Full stops between triples may be missing, a
semicolon may end the query. Variables are case-sensitive; those that are not selected still join; rows are
not made distinct; columns come in the order of SELECT.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = ("subject", "predicate", "object")
_TOKEN = re.compile(r'"(?P<text>[^"]*)"|(?P<var>\?\w+)|(?P<sign>[{}.;])|(?P<word>\w+)|(?P<bad>\S)')


@dataclass(frozen=True)
class Pattern:
    """Triples of terms, each ("var", name) or ("text", value); selected variables; limit."""

    triples: tuple[tuple[tuple[str, str], ...], ...]
    select: tuple[str, ...]
    limit: int | None = None


def parse(query: str) -> Pattern:
    """The pattern of a query; ValueError if it is none."""
    tokens = []
    for m in _TOKEN.finditer(query):
        if m.lastgroup == "bad":
            raise ValueError(f"unexpected {m.group()!r} at {m.start()}")
        tokens.append((m.lastgroup, m.group("text") if m.lastgroup == "text" else m.group()))
    at = 0

    def take(kind: str, value: str | None = None) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at][0] == kind and (value is None or tokens[at][1].upper() == value):
            at += 1
            return tokens[at - 1][1]
        return None

    def need(kind: str, value: str) -> None:
        if take(kind, value) is None:
            raise ValueError(f"expected {value}")

    need("word", "SELECT")
    select = []
    while (name := take("var")) is not None:
        select.append(name[1:])
    need("word", "WHERE")
    need("sign", "{")
    triples = []
    while take("sign", "}") is None:
        triple = []
        for _ in range(3):
            if at < len(tokens) and tokens[at][0] in ("var", "text"):
                kind, value = tokens[at]
                triple.append((kind, value[1:] if kind == "var" else value))
                at += 1
            else:
                raise ValueError("a triple has three terms")
        triples.append(tuple(triple))
        take("sign", ".")
    take("sign", ";")
    limit = None
    if take("word", "LIMIT"):
        if not (n := take("word") or "").isdigit():
            raise ValueError("LIMIT needs a number")
        limit = int(n)
    take("sign", ";")
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at][1]!r}")
    known = {v for t in triples for kind, v in t if kind == "var"}
    if not select or not set(select) <= known:
        raise ValueError("SELECT needs variables of the pattern")
    return Pattern(tuple(triples), tuple(select), limit)


def _literal(text: str) -> str:
    """A string literal of Spark SQL, in which a backslash escapes and a quote is doubled."""
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def conditions(pattern: Pattern) -> tuple[list[str], dict[str, str]]:
    """SQL conditions over aliases f0, f1, ..., and the column of each variable's first place."""
    out, first = [], {}
    for i, triple in enumerate(pattern.triples):
        out += [f"f{i}.{c}={_literal(v)}" for c, (kind, v) in zip(PLACES, triple, strict=True) if kind == "text"]
    for i, triple in enumerate(pattern.triples):
        for c, (kind, v) in zip(PLACES, triple, strict=True):
            if kind == "var" and first.setdefault(v, f"f{i}.{c}") != f"f{i}.{c}":
                out.append(f"f{i}.{c}={first[v]}")
    return out, first


def to_sql(query: str, table: str = "triples") -> str:
    """The query as SQL over a table of triples."""
    pattern = parse(query)
    where, first = conditions(pattern)
    columns = ", ".join(f"{first[v]} AS {v}" for v in pattern.select)
    tables = ", ".join(f"{table} AS f{i}" for i in range(len(pattern.triples)))
    limit = f" LIMIT {pattern.limit}" if pattern.limit is not None else ""
    return f"SELECT {columns} FROM {tables}" + (f" WHERE {' AND '.join(where)}" if where else "") + limit


def match(triples: DataFrame, query: str | Pattern) -> DataFrame:
    """The rows of a pattern. Each triple is a scan with its constants pushed down and its variables as
    columns; triples join on all variables they share, the most constant first, connected ones before
    others, so that no product arises where the pattern is connected."""
    pattern = parse(query) if isinstance(query, str) else query
    names: dict[str, str] = {}  # columns do not tell ?f from ?F
    parts = []
    for triple in pattern.triples:
        part, columns = triples, {}
        for c, (kind, v) in zip(PLACES, triple, strict=True):
            if kind == "text":
                part = part.where(F.col(c) == v)
            elif v in columns:
                part = part.where(F.col(c) == F.col(columns[v]))
            else:
                columns[v] = c
        constants = sum(kind == "text" for kind, _ in triple)
        parts.append((constants, part.select(*(F.col(c).alias(names.setdefault(v, f"v{len(names)}")) for v, c in columns.items()))))
    parts.sort(key=lambda x: -x[0])
    out = parts.pop(0)[1]
    while parts:
        at = next((i for i, (_, p) in enumerate(parts) if set(p.columns) & set(out.columns)), 0)
        part = parts.pop(at)[1]
        shared = [c for c in part.columns if c in out.columns]
        out = out.join(part, shared) if shared else out.crossJoin(part)
    out = out.select(*(F.col(names[v]).alias(v) for v in pattern.select))
    return out.limit(pattern.limit) if pattern.limit is not None else out
