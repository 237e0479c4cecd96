"""INSERT, UPDATE, DELETE with the constraints of a table checked first: one job for each constraint, not for each row."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.select import matching
from .sources.catalog import Catalog, Conflict
from .sql import ast
from .sql.parser import SqlError
from .types import fits


#: Up to so many values of a batch are broadcast to the table that they are looked up in.
BROADCAST = 200_000


class ConstraintError(ValueError):
    """A row that its table does not take."""


def checked(columns: list[ast.ColumnDef], given: dict[str, Any]) -> dict[str, Any]:
    """The values as the columns hold them; raises for unknown columns, wrong types and NULLs that must not be."""
    known = {c.name: c for c in columns}
    out = {}
    for name, value in given.items():
        if name not in known:
            raise ConstraintError(f"{name} does not exist")
        try:
            out[name] = fits(value, known[name].type)
        except ValueError as e:
            raise ConstraintError(f"Wrong data type:{name}") from e
        if value is None and (known[name].not_null or known[name].primary_key):
            raise ConstraintError(f"{name} is NULL but NOT NULL Constraint")
    return out


def _present(catalog: Catalog, database: str, table: str, column: str, values: set) -> set:
    """Which of the values (None too) the column holds already: one scan and a join with the values of the batch."""
    t = catalog.table(database, table)
    field = t.schema[column]
    asked = catalog.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", field.dataType)]))
    if len(values) <= BROADCAST:
        asked = F.broadcast(asked)
    found = t.df.select(F.col(column).alias("have")).join(asked, F.col("have").eqNullSafe(F.col("v"))).select("v").distinct()
    return {r["v"] for r in found.collect()}


def _again(attempt: Callable[[], Any], tries: int = 5) -> Any:
    """attempt(), once more if another session changed a table that it had read."""
    for _ in range(tries - 1):
        try:
            return attempt()
        except Conflict:
            pass
    return attempt()


def insert(catalog: Catalog, database: str, stmts: list[ast.Insert]) -> tuple[int, list[str]]:
    """Number of rows inserted, and what was wrong with each of the others, in order.

    All statements are checked against their tables' types first, and one that fails there fails all. Then each row is
    taken if its constraints hold with the rows before it, and left out if not. The rows that are taken appear at once.
    """
    return _again(lambda: _insert(catalog, database, stmts))


def _insert(catalog: Catalog, database: str, stmts: list[ast.Insert]) -> tuple[int, list[str]]:
    planned = []
    for s in stmts:
        columns = catalog.columns(database, s.table)
        if len(set(s.columns)) < len(s.columns):
            raise SqlError("a column is given twice")
        row = checked(columns, dict(zip(s.columns, s.values, strict=True)))
        planned.append((s.table, checked(columns, {c.name: row.get(c.name) for c in columns})))
    tables = {t: catalog.columns(database, t) for t, _ in planned}
    held: dict[tuple[str, str], set] = {}
    wanted: dict[tuple[str, str], set] = {}
    for t, row in planned:
        for c in tables[t]:
            if c.unique or c.primary_key:
                wanted.setdefault((t, c.name), set()).add(row[c.name])
            if c.references and row[c.name] is not None:
                wanted.setdefault(c.references, set()).add(row[c.name])
    seen = {t: catalog.folders(database, t) for t, _ in wanted}  # what the constraints were checked against
    for (t, c), values in wanted.items():
        held[t, c] = _present(catalog, database, t, c, values)
    taken: dict[str, list[tuple]] = {}
    failures = []
    for t, row in planned:
        wrong = next((f"Duplicate Value : {c.name}" for c in tables[t] if (c.unique or c.primary_key) and row[c.name] in held[t, c.name]), None)
        wrong = wrong or next((f"Foreign Reference Not Found : ({c.references[0]}.{c.references[1]})" for c in tables[t] if c.references and row[c.name] is not None and row[c.name] not in held[c.references] and c.references != (t, c.name)), None)
        if wrong:
            failures.append(wrong)
            continue
        taken.setdefault(t, []).append(tuple(row[c.name] for c in tables[t]))
        for c in tables[t]:
            if (t, c.name) in held:
                held[t, c.name].add(row[c.name])
    if taken:
        frames = {t: catalog.spark.createDataFrame(rows, catalog.schema(database, t)) for t, rows in taken.items()}
        catalog.append_all(database, frames, seen)
    return sum(map(len, taken.values())), failures


def update(catalog: Catalog, database: str, stmt: ast.Update) -> int:
    """Number of rows changed. A value that would break a constraint raises, and nothing changes."""
    return _again(lambda: _update(catalog, database, stmt))


def _update(catalog: Catalog, database: str, stmt: ast.Update) -> int:
    seen = catalog.folders(database, stmt.table)
    columns = catalog.columns(database, stmt.table)
    values = checked(columns, stmt.values)
    table = catalog.table(database, stmt.table)
    hit = matching(stmt.where, table)
    df = table.df.alias(stmt.table)
    n = df.where(hit).count()
    for c in columns:
        if c.name not in values or not n:
            continue
        value = F.lit(values[c.name]).cast(table.schema[c.name].dataType)
        if (c.unique or c.primary_key) and (n > 1 or df.where(~hit & F.col(c.name).eqNullSafe(value)).limit(1).count()):
            raise ConstraintError(f"Duplicate Value : {c.name}")
        if c.references and values[c.name] is not None and not _present(catalog, database, *c.references, {values[c.name]}):
            raise ConstraintError(f"Foreign Reference Not Found : ({c.references[0]}.{c.references[1]})")
    if n:
        new = [F.when(hit, F.lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema.fields]
        catalog.replace(database, stmt.table, df.select(*new), seen)
    return n


def delete(catalog: Catalog, database: str, stmt: ast.Delete) -> int:
    """Number of rows deleted."""
    return _again(lambda: _delete(catalog, database, stmt))


def _delete(catalog: Catalog, database: str, stmt: ast.Delete) -> int:
    seen = catalog.folders(database, stmt.table)
    table = catalog.table(database, stmt.table)
    hit = matching(stmt.where, table)
    df = table.df.alias(stmt.table)
    n = df.where(hit).count()
    if n:
        catalog.replace(database, stmt.table, df.where(~hit), seen)
    return n
