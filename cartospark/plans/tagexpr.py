"""A small language of tag predicates and values, with two back ends.

Expressions are nested tuples. ``column`` compiles one to a Spark Column over a
map column; ``sql`` compiles it to SQL over a map column of the same content, so
the meaning can be checked on another engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Expr = tuple


def has(key: str) -> Expr:
    return ("has", key)


def isin(key: str, values) -> Expr:
    return ("in", key, tuple(values))


def eq(key: str, value: str) -> Expr:
    return ("in", key, (value,))


def prefix(text: str) -> Expr:
    return ("prefix", text)


def any_of(*parts: Expr) -> Expr:
    return ("or", *parts)


def all_of(*parts: Expr) -> Expr:
    return ("and", *parts)


def no(part: Expr) -> Expr:
    return ("not", part)


def tag(key: str) -> Expr:
    return ("tag", key)


def lit(value: str | None) -> Expr:
    return ("lit", value)


def first(*values: Expr) -> Expr:
    """The first value that is neither null nor empty."""
    return ("first", *values)


def case(*branches: tuple[Expr, Expr], default: Expr = ("lit", None)) -> Expr:
    return ("case", branches, default)


def category(key: str, groups: dict, default: str | None = "other") -> Expr:
    """The first group that holds the tag's value."""
    return case(*((isin(key, v), lit(k)) for k, v in groups.items()), default=lit(default))


def union(groups: dict) -> tuple[str, ...]:
    return tuple(dict.fromkeys(v for g in groups.values() for v in g))


def column(e: Expr, tags: Column) -> Column:
    """The Column of an expression over a tag map; predicates are never null."""
    kind = e[0]
    if kind == "has":
        return F.map_contains_key(tags, F.lit(e[1]))
    if kind == "in":
        return F.coalesce(tags[e[1]].isin(*e[2]), F.lit(False))
    if kind == "prefix":
        return F.exists(F.map_keys(tags), lambda k: k.startswith(e[1]))
    if kind in ("or", "and"):
        out = column(e[1], tags)
        for part in e[2:]:
            out = (out | column(part, tags)) if kind == "or" else (out & column(part, tags))
        return out
    if kind == "not":
        return ~column(e[1], tags)
    if kind == "tag":
        return tags[e[1]]
    if kind == "lit":
        return F.lit(e[1]).cast("string")
    if kind == "first":
        return F.coalesce(*(F.nullif(column(v, tags), F.lit("")) for v in e[1:]))
    if kind == "case":
        out = column(e[2], tags)
        for when, then in reversed(e[1]):
            out = F.when(column(when, tags), column(then, tags)).otherwise(out)
        return out
    raise ValueError(kind)


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def sql(e: Expr, tags: str = "tags") -> str:
    """The same in SQL, on DuckDB maps."""
    kind = e[0]
    if kind == "has":
        return f"map_contains({tags}, {_quoted(e[1])})"
    if kind == "in":
        return f"coalesce({tags}[{_quoted(e[1])}] IN ({', '.join(map(_quoted, e[2]))}), false)"
    if kind == "prefix":
        return f"len(list_filter(map_keys({tags}), lambda k: starts_with(k, {_quoted(e[1])}))) > 0"
    if kind in ("or", "and"):
        return "(" + f" {kind.upper()} ".join(sql(p, tags) for p in e[1:]) + ")"
    if kind == "not":
        return f"(NOT {sql(e[1], tags)})"
    if kind == "tag":
        return f"{tags}[{_quoted(e[1])}]"
    if kind == "lit":
        return f"CAST({_quoted(e[1])} AS VARCHAR)"
    if kind == "first":
        return "coalesce(" + ", ".join(f"nullif({sql(v, tags)}, '')" for v in e[1:]) + ")"
    if kind == "case":
        return "CASE " + " ".join(f"WHEN {sql(w, tags)} THEN {sql(t, tags)}" for w, t in e[1]) + f" ELSE {sql(e[2], tags)} END"
    raise ValueError(kind)
