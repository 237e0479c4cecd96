"""A session: text in, a lazy DataFrame or a status out."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from . import dml
from .plans.select import Table, compile_select
from .sources import dump
from .sources.catalog import Catalog
from .sources.store import Store, shared_folder
from .sql import ast
from .sql.parser import SqlError, parse

BATCH = 50  # rows that results() gathers at a time
CATALOGUE = ("databases", "schemas", "indexes", "tables_files")


@dataclass(frozen=True)
class Status:
    message: str
    rows: int = 0
    failures: tuple[str, ...] = ()


class Session:
    """SQL over registered frames and over the tables of a database under root.

    root is a folder that executors share; left out, one is made in the shared checkpoint folder (or the warehouse) when
    it is first needed, and goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self._root, self._catalog = spark, root, None
        self.views: dict[str, Table | Callable[[], DataFrame]] = {}
        self.database: str | None = None

    @property
    def catalog(self) -> Catalog:
        if self._catalog is None:
            if self._root is None:
                self._root = f"{shared_folder(self.spark)}/quillon-{uuid.uuid4().hex}"
                Store(self.spark, self._root).delete_at_exit()
            self._catalog = Catalog(self.spark, self._root)
        return self._catalog

    def register(self, name: str, df: DataFrame, schema: T.StructType | None = None) -> None:
        """A frame as a table; schema may say more about NULLs than the frame does."""
        self.views[name] = Table(name, df, schema or df.schema)

    def register_later(self, name: str, make: Callable[[], DataFrame]) -> None:
        """A table whose frame is made when a statement first names it: finding a schema takes a look at its files."""
        self.views[name] = make

    def register_parquet(self, folder: str, *names: str) -> None:
        """folder/name.parquet as table name, opened when first named."""
        for name in names:
            self.register_later(name, functools.partial(self.spark.read.parquet, f"{folder}/{name}.parquet"))

    def table(self, name: str) -> Table:
        if name in self.views:
            found = self.views[name]
            if not isinstance(found, Table):
                df = found()
                found = self.views[name] = Table(name, df, df.schema)
            return found
        if self.database is not None and self.catalog.has(self.database, name):
            return self.catalog.table(self.database, name)
        if name in CATALOGUE and self._catalog is not None:
            df = self.catalog.frame(name)
            return Table(name, df, df.schema)
        raise SqlError(f"unknown table {name}")

    def _connected(self) -> str:
        if self.database is None:
            raise SqlError("no database is connected")
        return self.database

    def sql(self, text: str) -> DataFrame | Status:
        stmt = parse(text)
        if isinstance(stmt, ast.Select):
            return compile_select(stmt, self.table)
        if isinstance(stmt, ast.Command):
            return self._command(stmt)
        database = self._connected()
        if isinstance(stmt, ast.CreateTable):
            self.catalog.create_table(database, stmt)
            return Status(f"created table {stmt.table}")
        if isinstance(stmt, ast.Insert):
            n, failures = dml.insert(self.catalog, database, [stmt])
            if failures:
                raise dml.ConstraintError(failures[0])
            return Status("inserted", n)
        if isinstance(stmt, ast.Update):
            return Status("updated", dml.update(self.catalog, database, stmt))
        return Status("deleted", dml.delete(self.catalog, database, stmt))

    def _command(self, stmt: ast.Command) -> Status:
        if stmt.verb == "create":
            self.catalog.create_database(stmt.name)
            return Status(f"created database {stmt.name}")
        if stmt.verb == "connect":
            if stmt.name not in self.catalog.databases:
                raise SqlError(f"unknown database {stmt.name}")
            self.database = stmt.name
            return Status(f"connected to {stmt.name}")
        if stmt.verb == "exit":
            self.database = None
            return Status("left the database")
        return Status("all writes are durable")

    def batch(self, text: str) -> Status:
        """Many INSERTs, one a line: planned all or none, then each inserted or reported."""
        try:
            n, failures = dml.insert(self.catalog, self._connected(), dump.statements(text))
        except dml.ConstraintError as e:
            raise SqlError(f"Batch Planning Failed: {e}") from e
        return Status(f"Batch Success, Inserted: {n}", n, tuple(failures))

    def load_dump(self, path: str) -> Status:
        """batch() on the text of a file."""
        return self.batch(dump.read(self.spark, path))

    def vacuum(self, table: str) -> Status:
        """Join the files that single INSERTs left and delete old versions; see Catalog.vacuum()."""
        return Status(f"vacuumed {table}", self.catalog.vacuum(self._connected(), table))

    def results(self, df: DataFrame) -> Iterator[list[Row]]:
        """Rows in batches, a partition at a time on the driver."""
        held: list[Row] = []
        for row in df.toLocalIterator():
            held.append(row)
            if len(held) == BATCH:
                yield held
                held = []
        if held:
            yield held
