"""Compilers from lookup tables and rules to column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import all_of, lookup
from tidemark.functions.lookups import (
    DEPARTMENT_PATTERNS,
    DRUG_CLASSES_3,
    DRUG_CLASSES_4,
    HOSPITALS,
    reverse,
)


def longest_prefix(code: Column, mapping: dict[str, object]) -> Column:
    """Value of the longest matching prefix, NULL when none fits. One map lookup per length."""
    by_length: dict[int, dict] = {}
    for prefix, value in mapping.items():
        by_length.setdefault(len(prefix), {})[prefix] = value
    return F.coalesce(*[lookup(F.substring(code, 1, n), by_length[n]) for n in sorted(by_length, reverse=True)])


def all_prefixes(code: Column, groups: dict[str, list[str]]) -> Column:
    """Array of all classes with a matching prefix, distinct."""
    by_length: dict[int, dict] = {}
    for prefix, name in reverse(groups).items():
        by_length.setdefault(len(prefix), {})[prefix] = name
    hits = [lookup(F.substring(code, 1, n), m) for n, m in sorted(by_length.items())]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def prefix_join(df: DataFrame, code: str, table: DataFrame, payload: list[str]) -> DataFrame:
    """Longest-prefix match against a big prefix table ``(prefix, payload…)``.

    Each code is expanded to its own prefixes (at most its length), matched by equality, and
    the longest hit kept; no theta join.
    """
    codes = df.select(code).distinct()
    cut = codes.withColumn("__n", F.explode(F.sequence(F.lit(1), F.length(code)))).withColumn(
        "prefix", F.substring(F.col(code), F.lit(1), F.col("__n"))
    )
    best = cut.join(table, "prefix").groupBy(code).agg(F.max_by(F.struct(*payload), F.col("__n")).alias("__m"))
    return df.join(best.select(code, *[F.col("__m").getField(p).alias(p) for p in payload]), code, "left")


def drug_classes(code: Column) -> Column:
    """Both levels of drug classes as an array (a code may belong to one of each)."""
    lvl3 = lookup(F.substring(code, 1, 3), reverse(DRUG_CLASSES_3))
    lvl4 = lookup(F.substring(code, 1, 4), reverse(DRUG_CLASSES_4))
    return F.array_distinct(F.array_compact(F.array(lvl3, lvl4)))


def drug_class(code: Column) -> Column:
    """First matching class, level 3 before level 4."""
    return F.coalesce(
        lookup(F.substring(code, 1, 3), reverse(DRUG_CLASSES_3)),
        lookup(F.substring(code, 1, 4), reverse(DRUG_CLASSES_4)),
    )


def ordered_patterns(text: Column, table) -> Column:
    """First label whose pattern is found; a list of patterns must all be found."""
    out = []
    for label, patterns in table:
        for pattern in patterns:
            parts = [pattern] if isinstance(pattern, str) else pattern
            # (?U) gives word characters and boundaries their Unicode meaning
            hit = all_of([text.rlike("(?iuU)" + p) for p in parts])
            out.append(F.when(hit, F.lit(label)))
    return F.coalesce(*out)


def department(name: Column) -> Column:
    return ordered_patterns(name, DEPARTMENT_PATTERNS)


def hospital(unit: Column) -> Column:
    """Hospital of a unit name: first word, or the first two after ``SJ``; else ``MISC``."""
    words = F.split(F.trim(F.regexp_replace(unit, ",", "")), r"\s+")
    first = F.get(words, F.lit(0))
    name = F.when(first == "SJ", F.array_join(F.slice(words, 1, 2), " ")).otherwise(first)
    name = F.upper(name)
    # Two places are known by their beginnings.
    out = F.when(name.startswith("SJ HOL"), "SJ HOLBÆK").when(name.startswith("SJ ROS"), "SJ ROSKILDE")
    out = out.when(name.isin(*HOSPITALS), name).otherwise("MISC")
    return F.when(F.length(F.trim(unit)) > 0, out)


_COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
}


def rule(column: str, op: str, value) -> Column:
    """``(column, op, value)`` as a condition; NULL counts as not met (``!=``/``not_in``: met)."""
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    missing = F.lit(op in ("!=", "not_in"))
    return F.coalesce(_COMPARE[op](F.col(column), F.lit(value) if not isinstance(value, (list, tuple)) else value), missing)
