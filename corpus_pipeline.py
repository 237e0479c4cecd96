"""A training-data pipeline over the documents table: five stages, each an operator of quillon.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows as Parquet in the shared checkpoint folder and reads them again for the next, as a driver of
single stages would, so that a lost executor never costs more than the running stage. A stage's rows are deleted when
the next one's are written, the last when the driver ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, lines, quality, simhash
from quillon.llm.common import checkpoint_dir, table
from quillon.llm.queries import PATTERN, VOCABULARY
from quillon.sources.store import Store

#: Documents that score lower are rejected.
QUALITY = 0.3


def _named_apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with columns that are none of its business renamed meanwhile, so that none clashes with its own."""
    own = ("doc_id", "text", "n_chars")
    names = {c: c if c in own else f"column_{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Null and empty texts get the score of no evidence. Rows that repeat stay or go together, an empty table gives an
    empty one, columns of other names pass as they are; texts of any length are scored whole.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _named_apart(docs, lambda d: quality.score(d, model).where(F.col("score") >= QUALITY))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document with a smaller doc_id holds; n_chars follows the text.

    A null text becomes an empty one; rows without doc_id keep their lines. Repeated rows each stay, an empty table gives
    an empty one, columns of other names pass as they are; texts of any length are split whole.
    """
    kept = F.col("kept")
    return _named_apart(docs, lambda d: lines.dedup(d).withColumns({"text": kept, "n_chars": F.length(kept).cast("long")}))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: sets of five-word shingles of a Jaccard
    similarity of 0.8 or more.

    Null and empty texts are copies of one another; rows without doc_id stay; rows that repeat under one doc_id stay or
    go together; an empty table gives an empty one; columns of other names pass as they are.
    """
    return simhash.dedup(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item.

    Null and empty texts hold none, nor do null and empty items; rows that repeat stay or go together; an empty table
    gives an empty one; columns of other names pass as they are; texts of any length are looked at whole.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text in place of the text, with digests of the ids and of what they decode to.

    Null and empty texts have no ids; rows that repeat each give a row; an empty table gives an empty one; columns of
    other names pass as they are; texts of any length are encoded whole.
    """
    return bpe.round_trip(docs, VOCABULARY, PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", token_stage),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, on the documents of sf_dir."""
    folder = Store(spark, f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder.root}/{k}")
        docs = spark.read.parquet(f"{folder.root}/{k}")
        if k:
            folder.delete(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
