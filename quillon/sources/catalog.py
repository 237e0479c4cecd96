"""Databases, tables, constraints and indexes: numbered registry files beside the tables' folders.

A table's rows are Parquet files in the folders that its registry entry names. INSERT writes a further folder, UPDATE
and DELETE write all rows anew; then the next registry file is created, which fails if another session has created one
of that number: the change is then made again on top of the other's. Nothing that a registry file names is deleted
before vacuum(), so a frame that was made earlier still reads what it was made of, and a job that is lost half-way
changes nothing.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.select import Table
from ..sql import ast
from ..sql.parser import SqlError
from ..types import SPARK
from .store import Store

REGISTRY = "_catalog"


class Conflict(SqlError):
    """Another session changed a table between reading and writing it."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self._number, self._databases = 0, {}

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.store.names(REGISTRY) if n.endswith(".json") and n[:-5].isdigit())

    @property
    def databases(self) -> dict[str, dict]:
        """The newest registry."""
        numbers = self._numbers()
        if numbers and numbers[-1] != self._number:
            self._number, self._databases = numbers[-1], json.loads(self.store.read(f"{REGISTRY}/{numbers[-1]:08d}.json"))
        return self._databases

    def _change(self, change: Callable[[dict[str, dict]], None], tries: int = 50) -> None:
        """Write the next registry: a copy of the newest with the change, which may raise."""
        for _ in range(tries):
            new = copy.deepcopy(self.databases)
            change(new)
            if self.store.create(f"{REGISTRY}/{self._number + 1:08d}.json", json.dumps(new, indent=1)):
                return
        raise Conflict("the registry changes all the time")

    def create_database(self, name: str) -> None:
        def change(databases: dict[str, dict]) -> None:
            if name in databases:
                raise SqlError(f"database {name} already exists")
            databases[name] = {}

        self._change(change)

    @staticmethod
    def _find(databases: dict[str, dict], database: str, table: str) -> dict:
        if database not in databases:
            raise SqlError(f"unknown database {database}")
        if table not in databases[database]:
            raise SqlError(f"unknown table {table}")
        return databases[database][table]

    def entry(self, database: str, table: str) -> dict:
        return self._find(self.databases, database, table)

    def has(self, database: str, table: str) -> bool:
        return table in self.databases.get(database, {})

    def create_table(self, database: str, stmt: ast.CreateTable) -> None:
        names = [c.name for c in stmt.columns]
        if len(set(names)) < len(names):
            raise SqlError("a column is defined twice")
        for index in stmt.indexes:
            if unknown := [c for c in index.columns if c not in names]:
                raise SqlError(f"{unknown[0]} does not exist")
        new = {"columns": [asdict(c) for c in stmt.columns], "indexes": [asdict(i) for i in stmt.indexes], "folders": []}

        def change(databases: dict[str, dict]) -> None:
            if database not in databases:
                raise SqlError(f"unknown database {database}")
            if stmt.table in databases[database]:
                raise SqlError(f"table {stmt.table} already exists")
            for c in stmt.columns:
                if c.references and c.references != (stmt.table, c.name):
                    target = new if c.references[0] == stmt.table else self._find(databases, database, c.references[0])
                    if c.references[1] not in [x["name"] for x in target["columns"]]:
                        raise SqlError(f"{'.'.join(c.references)} does not exist")
            databases[database][stmt.table] = new

        self._change(change)

    def columns(self, database: str, table: str) -> list[ast.ColumnDef]:
        return [ast.ColumnDef(**(c | {"references": tuple(c["references"]) if c["references"] else None})) for c in self.entry(database, table)["columns"]]

    def schema(self, database: str, table: str) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK[c.type], not (c.not_null or c.primary_key)) for c in self.columns(database, table)])

    def folders(self, database: str, table: str) -> list[str]:
        return list(self.entry(database, table)["folders"])

    def table(self, database: str, table: str) -> Table:
        schema, folders = self.schema(database, table), self.folders(database, table)
        if not folders:
            return Table(table, self.spark.createDataFrame([], schema), schema)
        return Table(table, self.spark.read.schema(schema).parquet(*(f"{self.store.root}/{f}" for f in folders)), schema)

    def _written(self, database: str, table: str, rows: DataFrame) -> str:
        """Rows in a new folder: in the order of a btree index within each file, with Bloom filters for hash indexes."""
        indexes = self.entry(database, table)["indexes"]
        folder = f"{database}/{table}/{uuid.uuid4().hex}"
        sort = next((i["columns"] for i in indexes if i["method"] == "btree"), None)
        writer = (rows.sortWithinPartitions(*sort) if sort else rows).write
        for column in {c for i in indexes if i["method"] == "hash" for c in i["columns"]}:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.store.root}/{folder}")
        return folder

    def append(self, database: str, table: str, rows: DataFrame, seen: dict[str, list[str]] | None = None) -> None:
        self.append_all(database, {table: rows}, seen or {})

    def append_all(self, database: str, rows: dict[str, DataFrame], seen: dict[str, list[str]]) -> None:
        """Add rows to tables in one step; Conflict if a table in `seen` no longer has the folders given there."""
        new = {t: self._written(database, t, r) for t, r in rows.items()}

        def change(databases: dict[str, dict]) -> None:
            for t, folders in seen.items():
                if self._find(databases, database, t)["folders"] != folders:
                    raise Conflict(f"{t} was changed meanwhile")
            for t, folder in new.items():
                self._find(databases, database, t)["folders"].append(folder)

        self._change_or_drop(change, list(new.values()))

    def replace(self, database: str, table: str, rows: DataFrame, seen: list[str]) -> None:
        """All rows of a table that had the folders `seen` anew; Conflict if it has others by now."""
        folder = self._written(database, table, rows)

        def change(databases: dict[str, dict]) -> None:
            entry = self._find(databases, database, table)
            if entry["folders"] != seen:
                raise Conflict(f"{table} was changed meanwhile")
            entry["folders"] = [folder]

        self._change_or_drop(change, [folder])

    def _change_or_drop(self, change: Callable[[dict[str, dict]], None], written: list[str]) -> None:
        try:
            self._change(change)
        except SqlError:
            for folder in written:
                self.store.delete(folder)
            raise

    def vacuum(self, database: str, table: str) -> int:
        """Join a table's folders into one and delete what no longer belongs to it; how many folders went.

        Frames of the table that were made before can no longer be read, and sessions that write to it meanwhile lose
        what they have not registered: to be called while nobody else uses the table.
        """
        seen = self.folders(database, table)
        if len(seen) > 1:
            files = len(self.table(database, table).df.inputFiles())
            df = self.table(database, table).df
            self.replace(database, table, df.coalesce(max(1, files // len(seen))), seen)
        kept = {f.rsplit("/", 1)[-1] for f in self.folders(database, table)}
        gone = [n for n in self.store.names(f"{database}/{table}") if n not in kept]
        for n in gone:
            self.store.delete(f"{database}/{table}/{n}")
        for n in self._numbers()[:-1]:
            self.store.delete(f"{REGISTRY}/{n:08d}.json")
        return len(gone)

    def frame(self, name: str) -> DataFrame:
        """The catalogue as tables: databases, schemas, indexes, tables_files."""
        every = [(d, t, e) for d, tables in self.databases.items() for t, e in tables.items()]
        if name == "databases":
            return self.spark.createDataFrame([(d,) for d in self.databases], "database_name string")
        if name == "schemas":
            rows = [(t, c["name"], c["type"], c["primary_key"], not (c["not_null"] or c["primary_key"]), c["unique"] or c["primary_key"], *(c["references"] or (None, None))) for _, t, e in every for c in e["columns"]]
            return self.spark.createDataFrame(rows, "tablename string, fieldname string, fieldtype string, pkey_piece boolean, nullable boolean, unique boolean, foreign_table string, foreign_field string")
        if name == "indexes":
            rows = [(t, i["name"], c, f"{d}/{t}", f"{i['name']}.{i['method']}", i["method"]) for d, t, e in every for i in e["indexes"] for c in i["columns"]]
            return self.spark.createDataFrame(rows, "tablename string, index_name string, fieldname string, directory_file string, index_file string, index_type string")
        if name == "tables_files":
            return self.spark.createDataFrame([(t, f"{self.store.root}/{d}/{t}", "") for d, t, _ in every], "tablename string, filepath string, freemap string")
        raise SqlError(f"no catalogue table {name}")
