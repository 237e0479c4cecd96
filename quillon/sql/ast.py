"""Statements of the dialect, as parsed and before any name is resolved."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Name:
    """A column: name, or table.name."""

    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Aggregate:
    function: str  # COUNT, MIN, MAX, SUM, AVG
    of: Name

    @property
    def label(self) -> str:
        return f"{self.function}_{self.of.column}"


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Condition:
    """op: and, or, a comparison, LIKE, IS or IS NOT; the sides are conditions, names, aggregates or literals."""

    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Join:
    how: str  # inner, left, right, full
    table: str
    on: Condition | None


@dataclass(frozen=True)
class Select:
    items: list[Name | Aggregate] | None  # None: *
    table: str
    distinct: bool = False
    joins: list[Join] = field(default_factory=list)
    where: Condition | None = None
    group_by: list[Name] = field(default_factory=list)
    having: Condition | None = None
    order_by: list[tuple[Name | Aggregate, bool]] = field(default_factory=list)  # True: descending


@dataclass(frozen=True)
class Insert:
    table: str
    columns: list[str]
    values: list[Any]


@dataclass(frozen=True)
class Update:
    table: str
    values: dict[str, Any]
    where: Condition | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Condition | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary_key: bool = False
    unique: bool = False
    not_null: bool = False
    references: tuple[str, str] | None = None


@dataclass(frozen=True)
class IndexDef:
    name: str
    method: str  # hash, btree
    columns: list[str]


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: list[ColumnDef]
    indexes: list[IndexDef]


@dataclass(frozen=True)
class Command:
    """Of a session rather than a database: create db, connect db, exit db, sync."""

    verb: str
    name: str | None = None
