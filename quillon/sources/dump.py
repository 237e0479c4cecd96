"""Dump files: text with one INSERT a line."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sql import ast
from ..sql.parser import SqlError, parse


def statements(text: str) -> list[ast.Insert]:
    """All lines, or an error: nothing is inserted from a text with a line that is no INSERT."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                stmt = parse(line)
            except SqlError as e:
                raise SqlError(f"Batch Planning Failed: line {n}: {e}") from e
            if not isinstance(stmt, ast.Insert):
                raise SqlError(f"Batch Planning Failed: line {n} is no INSERT")
            out.append(stmt)
    return out


def read(spark: SparkSession, path: str) -> str:
    """A dump's text, from any file system that Spark reaches."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a script, not a table
