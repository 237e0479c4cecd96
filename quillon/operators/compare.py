"""Two-valued comparisons: NULL is a value, equal to itself and smaller than all others; NaN equals and orders with nothing.

The plain Spark operator is used wherever it gives the same rows, because only that reaches the Parquet reader: a
comparison that is false for NULL anyway stays plain; the rest is the plain operator or a test for NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}


def _plain(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _ordered(op: str, a: Column, b: Column, a_null: bool, b_null: bool) -> Column:
    if op in ("<", "<="):
        return _ordered(MIRROR[op], b, a, b_null, a_null)
    plain = _plain(op, a, b)
    if not b_null:
        return plain  # NULL on the left: not true here, and not true in the dialect
    missing = (b.isNull() & a.isNotNull()) if op == ">" else b.isNull()
    if not a_null:
        missing = b.isNull()
    return plain | missing


def compare(op: str, a: Column, b: Column, a_null: bool, b_null: bool, a_nan: bool = False, b_nan: bool = False) -> Column:
    """a op b as a filter: true, or else false or NULL. *_null, *_nan: whether the side can be so.

    Callers that negate or show the result wrap it in decided().
    """
    if op == "==":
        out = a.eqNullSafe(b) if a_null and b_null else a == b
        return out & ~F.isnan(a) if a_nan and b_nan else out
    if op == "!=":
        if a_null and b_null:
            out = ~a.eqNullSafe(b)
        else:
            out = a != b
            out = out | a.isNull() if a_null else out | b.isNull() if b_null else out
        return out | F.isnan(a) if a_nan and b_nan else out
    out = _ordered(op, a, b, a_null, b_null)
    if a_nan and op in (">", ">="):
        out = out & ~F.isnan(a)
    if b_nan and op in ("<", "<="):
        out = out & ~F.isnan(b)
    if op == ">=" and b_nan or op == "<=" and a_nan:
        out = out & ~F.isnan(b if op == ">=" else a)
    return out


def decided(condition: Column) -> Column:
    """NULL becomes false."""
    return F.coalesce(condition, F.lit(False))


def like(value: Column, pattern: str) -> Column:
    """Wildcard match: `*` any run, `?` one character, all else itself, over the whole string.

    Equality, prefix, suffix and substring are stated as such, which the Parquet reader can use; the rest is SQL LIKE.
    """
    fixed = pattern.strip("*")
    if "?" not in pattern and "*" not in fixed:
        if pattern == fixed:
            return value == pattern
        if not fixed:
            return value.isNotNull()
        if not pattern.startswith("*"):
            return value.startswith(fixed)
        return value.contains(fixed) if pattern.endswith("*") else value.endswith(fixed)
    return value.like(re.sub(r"[%_\\]", r"\\\g<0>", pattern).replace("*", "%").replace("?", "_"))


def like_column(value: Column, pattern: Column) -> Column:
    """Wildcard match against a pattern of each row."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    body = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.call_function("rlike", value, F.concat(F.lit(r"(?s)\A"), body, F.lit(r"\z")))
