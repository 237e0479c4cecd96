"""SELECT -> lazy DataFrame. Names are resolved here; no job runs.

Order of the plan: scan, joins, filter, grouping, HAVING, sort, projection, DISTINCT (which comes before the sort if
both are asked for). Catalyst pushes filters and column pruning into the scans from there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr.compile import comparison, wildcard
from ..expr.errors import ExpressionError
from ..expr.typed import Typed, constant, of_field
from ..operators.compare import MIRROR, decided
from ..sql import ast
from ..sql.parser import SqlError

_LABEL = re.compile(r"(COUNT|MIN|MAX|SUM|AVG)_(\w+)\Z")
#: Rows of a block of a theta join: as many rows are made at a time.
BLOCK = 512


@dataclass(frozen=True)
class Table:
    """A named frame with the schema that is known of it (the frame's own may call everything nullable)."""

    name: str
    df: DataFrame
    schema: T.StructType


@dataclass(frozen=True)
class Bound:
    """A column of a table in scope."""

    table: str
    field: T.StructField
    typed: Typed


class Scope:
    """The tables of a FROM clause."""

    def __init__(self):
        self.columns: list[Bound] = []

    def add(self, table: Table) -> DataFrame:
        if any(b.table == table.name for b in self.columns):
            raise SqlError(f"{table.name} stands twice in FROM, and tables have no aliases")
        self.columns += [Bound(table.name, f, of_field(f, F.col(f"{table.name}.`{f.name}`"))) for f in table.schema.fields]
        return table.df.alias(table.name)

    def loosen(self, tables: set[str]) -> None:
        """Columns of these tables can be NULL now."""
        self.columns = [replace(b, typed=replace(b.typed, nullable=True)) if b.table in tables else b for b in self.columns]

    def find(self, name: ast.Name) -> Bound:
        found = [b for b in self.columns if b.field.name == name.column and name.table in (None, b.table)]
        if len(found) != 1:
            raise SqlError(f"{'ambiguous' if found else 'unknown'} column {name}")
        return found[0]

    def label(self, bound: Bound) -> str:
        """The bare name, or table_name if several tables have it."""
        alone = sum(b.field.name == bound.field.name for b in self.columns) == 1
        return bound.field.name if alone else f"{bound.table}_{bound.field.name}"


def condition(node: ast.Condition, term: Callable[[ast.Name | ast.Aggregate], Typed]) -> Column:
    """A condition as a filter column: rows with true stay; false and NULL both mean no."""

    def side(x) -> Typed:
        return constant(x.value) if isinstance(x, ast.Literal) else term(x)

    if node.op in ("and", "or"):
        a, b = condition(node.left, term), condition(node.right, term)
        return a & b if node.op == "and" else a | b
    a, b = side(node.left), side(node.right)
    try:
        if node.op == "LIKE":
            return wildcard(a, b).column
        if node.op in ("IS", "IS NOT"):
            if "empty" in (a.kind, b.kind):
                one = a if b.kind == "empty" else b
                return one.column.isNull() if node.op == "IS" else one.column.isNotNull()
            return comparison("==" if node.op == "IS" else "!=", a, b).column
        return comparison(node.op, a, b).column
    except ExpressionError as e:
        raise SqlError(f"{type(e).__name__}: {e}") from e


def _terms(node: ast.Condition) -> list[ast.Condition]:
    """What AND holds together."""
    return _terms(node.left) + _terms(node.right) if node.op == "and" else [node]


def _mentioned(x) -> Iterator[str]:
    """The column names in a part of a statement, those in labels such as MAX_salary too."""
    if isinstance(x, ast.Name):
        yield x.column
        if m := _LABEL.match(x.column):
            yield m[2]
    elif isinstance(x, ast.Aggregate):
        yield from _mentioned(x.of)
    elif isinstance(x, ast.Condition):
        yield from (*_mentioned(x.left), *_mentioned(x.right))
    elif isinstance(x, (list, tuple)):
        for y in x:
            yield from _mentioned(y)


def _theta(df: DataFrame, right: DataFrame, scope: Scope, join: ast.Join, stmt: ast.Select) -> DataFrame | None:
    """An inner join on equal keys and an order between the sides; None if the condition is another one.

    Such keys are few and their pairs many, so neither the files of one side nor the keys may say how many tasks share
    the work. The rows so far are sorted within their key and cut into blocks; blocks and the rows of the table that is
    joined are dealt to all tasks, and a row meets the blocks whose largest (or smallest) value lets it match. Pairs are
    made from a block at a time and then held against the condition. The columns get names of their own.
    """

    def across(t: ast.Condition) -> tuple[Bound, Bound, str] | None:
        """Column so far, column of the joined table, operator between them."""
        if t.op not in MIRROR or not (isinstance(t.left, ast.Name) and isinstance(t.right, ast.Name)):
            return None
        a, b = scope.find(t.left), scope.find(t.right)
        if (a.table == join.table) == (b.table == join.table):
            return None
        return (a, b, t.op) if b.table == join.table else (b, a, MIRROR[t.op])

    terms = [(t, across(t)) for t in _terms(join.on)]
    keys = [x for _, x in terms if x and x[2] == "=="]
    ranges = [x for _, x in terms if x and x[2] not in ("==", "!=")]
    if join.how != "inner" or not keys or not ranges or not all(isinstance(a.field.dataType, T.AtomicType) for a, _, _ in keys + ranges):
        return None
    rest = [t for t, x in terms if not x or x[2] != "=="]
    used = set(_mentioned([stmt.items or [], stmt.where, stmt.group_by, stmt.having, stmt.order_by, [j.on for j in stmt.joins if j is not join], rest]))
    kept = [b for b in scope.columns if stmt.items is None or b.field.name in used]

    def name(b: Bound) -> str:
        return f"{b.table}.{b.field.name}"

    def col(b: Bound) -> Column:
        return F.col(f"`{name(b)}`")

    def bound(a: Bound, op: str) -> Column:
        """The value of a block that matches if any does: NaN matches nothing, NULL is the smallest."""
        x = F.when(~F.isnan(col(a)), col(a)) if a.typed.nan else col(a)
        return F.max(x) if op in (">", ">=") else F.when(~F.bool_or(col(a).isNull()), F.min(x))

    def reached(a: Bound, b: Bound, op: str) -> Callable[[Column], Column]:
        return lambda x: comparison(op, replace(a.typed, column=x, nullable=True), replace(b.typed, column=col(b))).column

    ours, theirs = [b for b in kept if b.table != join.table], [b for b in kept if b.table == join.table]
    key, bounds = [f"key{i}" for i in range(len(keys))], [f"bound{i}" for i in range(len(ranges))]
    rows = df.select(*(b.typed.column.alias(name(b)) for b in ours), *(a.typed.column.alias(k) for k, (a, _, _) in zip(key, keys, strict=True)))
    first, others = ranges[0][0], [b for b in ours if name(b) != name(ranges[0][0])]
    ties = [col(b) for b in others if isinstance(b.field.dataType, T.AtomicType)]  # a task that runs again makes the same blocks
    number = F.row_number().over(Window.partitionBy(*key).orderBy(col(first), *ties))
    blocks = rows.withColumn("block", F.floor((number - 1) / BLOCK)).groupBy(*key, "block")
    blocks = blocks.agg(F.collect_list(F.struct(*map(col, ours))).alias("rows"), *(bound(a, op).alias(n) for n, (a, _, op) in zip(bounds, ranges, strict=True)))
    blocks = blocks.select(*key, *bounds, *(F.col("rows").getField(name(b)).alias(name(b)) for b in ours))  # an array a column

    dealt = right.select(*(b.typed.column.alias(name(b)) for b in theirs), *(b.typed.column.alias(f"with_{k}") for k, (_, b, _) in zip(key, keys, strict=True)))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, dealt = blocks.repartition(tasks), dealt.repartition(tasks)
    on = F.lit(True)
    for k, (a, b, _) in zip(key, keys, strict=True):
        on &= comparison("==", replace(a.typed, column=F.col(k)), replace(b.typed, column=F.col(f"with_{k}"))).column
    for n, x in zip(bounds, ranges, strict=True):
        # exists() is not generated code, so the join hands its rows on one by one: else all pairs of a row are held at once
        on &= F.exists(F.array(n), reached(*x))
    pairs = blocks.join(dealt, on).select(*map(col, theirs), *map(col, others), F.posexplode(col(first)).alias("place", name(first)))
    pairs = pairs.select(*map(col, theirs), col(first), *(F.get(col(b), F.col("place")).alias(name(b)) for b in others))
    scope.columns = [replace(b, typed=replace(b.typed, column=col(b))) for b in scope.columns]
    for t in rest:
        pairs = pairs.where(condition(t, lambda x: _plain(scope, x)))
    return pairs


def _from(stmt: ast.Select, lookup: Callable[[str], Table]) -> tuple[DataFrame, Scope]:
    scope = Scope()
    df = scope.add(lookup(stmt.table))
    for join in stmt.joins:
        before = {b.table for b in scope.columns}
        right = scope.add(lookup(join.table))
        if join.on is None:
            df = df.crossJoin(right) if join.how == "inner" else df.join(right, F.lit(True), join.how)
        else:
            on = condition(join.on, lambda x: _plain(scope, x))
            pairs = _theta(df, right, scope, join, stmt)
            df = df.join(right, on, join.how) if pairs is None else pairs
        scope.loosen({"inner": set(), "left": {join.table}, "right": before, "full": before | {join.table}}[join.how])
    return df, scope


def _plain(scope: Scope, x: ast.Name | ast.Aggregate) -> Typed:
    if isinstance(x, ast.Aggregate):
        raise SqlError(f"{x.label}: no aggregate can stand here")
    return scope.find(x).typed


def _aggregate(x: ast.Aggregate, of: Typed) -> tuple[Column, Typed]:
    """COUNT counts rows, NULL or not; the others leave NULLs out."""
    if x.function == "COUNT":
        return F.count(F.lit(1)), Typed("int", F.lit(None))
    if x.function in ("SUM", "AVG") and of.kind not in ("int", "float"):
        raise SqlError(f"{x.function} of a {of.kind}")
    column = {"MIN": F.min, "MAX": F.max, "SUM": F.sum, "AVG": F.avg}[x.function](of.column)
    return column, Typed("float" if x.function == "AVG" else of.kind, F.lit(None), True)


def compile_select(stmt: ast.Select, lookup: Callable[[str], Table]) -> DataFrame:
    df, scope = _from(stmt, lookup)
    if stmt.where is not None:
        df = df.where(condition(stmt.where, lambda x: _plain(scope, x)))
    items = stmt.items if stmt.items is not None else [ast.Name(b.field.name, b.table) for b in scope.columns]
    grouped = bool(stmt.group_by) or any(isinstance(x, ast.Aggregate) for x in items)
    if not grouped:
        if any(isinstance(x, ast.Aggregate) for x, _ in stmt.order_by):
            raise SqlError("an aggregate in ORDER BY needs a grouping")
        chosen = {scope.label(b): b.typed.column for b in map(scope.find, items)}  # a column named twice is shown once
        keys = [(scope.label(b), b.typed.column, desc) for b, desc in ((scope.find(x), desc) for x, desc in stmt.order_by)]
        return _finish(df, chosen, keys, stmt.distinct)

    # grouping: the frame below has a column for each key and each aggregate, under names of its own
    keys_of = {(b := scope.find(n)).table + "." + b.field.name: (b, f"k{i}") for i, n in enumerate(stmt.group_by)}
    made: dict[str, tuple[Column, Typed, str]] = {}

    def aggregated(x: ast.Aggregate) -> tuple[str, Typed, str]:
        b = scope.find(x.of)
        known = f"{x.function}({b.table}.{b.field.name})"
        if known not in made:
            column, typed = _aggregate(x, b.typed)
            same = sum(c.field.name == b.field.name for c in scope.columns) > 1
            made[known] = (column, typed, f"{x.function}_{b.table}_{b.field.name}" if same else x.label)
        name = f"a{list(made).index(known)}"
        return name, replace(made[known][1], column=F.col(name)), made[known][2]

    def after(x: ast.Name | ast.Aggregate) -> tuple[str, Typed, str]:
        """Name in the grouped frame, typed column, label."""
        if isinstance(x, ast.Aggregate):
            return aggregated(x)
        known = [b for b in scope.columns if b.field.name == x.column and x.table in (None, b.table)]
        if not known and x.table is None and (m := _LABEL.match(x.column)):
            return aggregated(ast.Aggregate(m[1], ast.Name(m[2])))
        b = scope.find(x)
        if (found := keys_of.get(f"{b.table}.{b.field.name}")) is None:
            raise SqlError(f"{x} is neither grouped by nor aggregated")
        return found[1], replace(b.typed, column=F.col(found[1])), scope.label(b)

    shown = [after(x) for x in items]
    having = condition(stmt.having, lambda x: after(x)[1]) if stmt.having is not None else None
    order = [(after(x), desc) for x, desc in stmt.order_by]
    aggregates = [column.alias(f"a{i}") for i, (column, _, _) in enumerate(made.values())]
    by = df.groupBy(*(b.typed.column.alias(name) for b, name in keys_of.values()))
    df = by.agg(*aggregates) if aggregates else df.select(*(b.typed.column.alias(name) for b, name in keys_of.values())).distinct()
    if having is not None:
        df = df.where(having)
    return _finish(df, {label: F.col(name) for name, _, label in shown}, [(label, F.col(name), desc) for (name, _, label), desc in order], stmt.distinct)


def _finish(df: DataFrame, chosen: dict[str, Column], keys: list[tuple[str, Column, bool]], distinct: bool) -> DataFrame:
    """Sort (NULLs last, or first when descending), project, DISTINCT."""
    projection = [column.alias(label) for label, column in chosen.items()]

    def ordered(frame: DataFrame, own: Callable[[str, Column], Column]) -> DataFrame:
        sorts = [own(label, c).desc_nulls_first() if desc else own(label, c).asc_nulls_last() for label, c, desc in keys]
        return frame.orderBy(*sorts) if sorts else frame

    if not distinct:
        return ordered(df, lambda _, c: c).select(*projection)
    if missing := [label for label, _, _ in keys if label not in chosen]:
        raise SqlError(f"DISTINCT cannot be ordered by {missing[0]}, which is not selected")
    return ordered(df.select(*projection).distinct(), lambda label, _: F.col(f"`{label}`"))


def matching(where: ast.Condition | None, table: Table) -> Column:
    """The rows of a table that UPDATE or DELETE means: true or false, never NULL."""
    scope = Scope()
    scope.add(table)
    return F.lit(True) if where is None else decided(condition(where, lambda x: _plain(scope, x)))
