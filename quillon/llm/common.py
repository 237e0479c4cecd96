"""What the operators of this subpackage share: tables, checkpoints, Arrow batches and row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store, shared_folder

#: Bytes that bytes.split() and bytes.strip() treat as space: \x20 and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by this worker process for later tasks; what was kept under another key is let go.

    Workers outlive stages, and look-up tables of several operators together would outgrow an executor.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """A folder for this application in spark.checkpoint.dir (in the warehouse where that is unset), set for checkpoints.

    What is written there goes when the driver ends; Spark deletes it earlier if the session was made with
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if not given.isDefined():
        sc.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
        given = sc._jsc.sc().getCheckpointDir()
    folder = given.get()
    if folder not in _folders:
        Store(spark, folder).delete_at_exit()
        _folders.add(folder)
    return folder


_folders: set[str] = set()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table, where later reads want some of the columns only, or compression."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text of a documents table, whatever else it holds."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds few more than `most` bytes, so that long texts do not pile up."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows <= 1 or col.nbytes <= most:
            if batch.num_rows:
                yield batch
            continue
        lengths = col.cast(pa.large_binary()) if not pa.types.is_binary(col.type) else col
        start = size = 0
        for i, value in enumerate(lengths):
            n = len(value.as_buffer()) if value.is_valid else 0
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def without(docs: DataFrame, gone: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows of docs that have no equal (nulls being equal) in all columns of gone.

    gone is counted: up to `most` rows it is broadcast and docs stay where they are; beyond that both are shuffled.
    """
    gone = checkpointed(gone.distinct()).alias("gone")
    on = [docs[c].eqNullSafe(F.col(f"gone.{c}")) for c in gone.columns]
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, on, "left_anti")
