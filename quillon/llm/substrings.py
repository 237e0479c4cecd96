"""Substring dedup by level-wise doubling.

Word windows are found repeated at a short length first; only these are extended to twice the length, and so on up to
the length asked for. At the first level a window is looked at through the smallest of the hashes of its two-fold
shorter windows (equal windows have equal smallest hashes), so one short window in a dozen is shuffled; each further
level ships only windows whose parts were repeated in two different texts. Equal texts count as one: all but the first
are removed as wholes without shipping a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, slices

SHORTEST = 16  # first levels are not shorter, unless the windows are shorter than twice that


def levels(window: int) -> list[int]:
    """Lengths, each twice the one before (or one more)."""
    out = [window]
    while out[0] // 2 >= SHORTEST or len(out) == 1 and window > 1:
        out.insert(0, out[0] // 2)
    return out


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r = a * np.uint64(0x9E3779B97F4A7C15) + b
    r ^= r >> np.uint64(32)
    r *= np.uint64(0xD6E8FEB86659FD93)
    return r ^ (r >> np.uint64(29))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of each window of that many words, from the windows of half the length."""
    if len(h) < length:
        return h[:0]
    if length == 1:
        return h
    half = window_hashes(h, length // 2)
    out = _mix(half[: len(half) - length // 2], half[length // 2 :])
    return _mix(out[: len(h) - length + 1], h[length - 1 :]) if length % 2 else out[: len(h) - length + 1]


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    span, low = 1, h
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(h) - width + 1], low[width - span :]) if width > span else low


def _anchor(h: np.ndarray, short: int, long: int) -> np.ndarray:
    """For each window of the long length the smallest hash of the short windows in it."""
    return _smallest(window_hashes(h, short), long - short + 1)


def _second(h: np.ndarray) -> np.ndarray:
    """Another word hash, for windows that must be told apart beyond 64 bits."""
    return _mix(h, np.full(len(h), 0x27D4EB2F165667C5, np.uint64))


def _in(values: np.ndarray, some: list[int]) -> np.ndarray:
    known = np.sort(np.array(some, dtype=np.int64).view(np.uint64))
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _candidates(h: np.ndarray, some: list[int], chain: list[int], level: int) -> np.ndarray:
    """Starts of windows of chain[level] words whose parts, hashes in `some`, were repeated one level below."""
    short, long = chain[level - 1], chain[level]
    if level == 1:
        return np.flatnonzero(_in(_anchor(h, short, long), some))
    ok = _in(window_hashes(h, short), some)
    n = len(h) - long + 1
    return np.flatnonzero(ok[:n] & ok[long - short : long - short + n])


def _arrays(columns: list[list[np.ndarray]], kinds: list[str]) -> list[pa.Array]:
    return [pa.array(np.concatenate(c).astype(k) if c else np.zeros(0, k)) for c, k in zip(columns, kinds, strict=True)]


def _apart(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows that have a partner in shared on h (and g), a grouping of rows.

    The join is on the complement of h, so that the groups are dealt anew: were they joined where they were summed up,
    Spark could not split the partition of a window that very many documents hold.
    """
    g = [c for c in ("g",) if c in shared.columns]
    left, right = (x.withColumn("k", F.bitwise_not("h")).drop("h") for x in (rows, shared))
    return left.join(right, ["k", *g]).withColumn("h", F.bitwise_not("k"))


def repeated(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, version, hashes, whole: what to remove of each document. docs: doc_id (not null), version, text.

    version tells rows of one doc_id apart; documents are told apart by doc_id alone.

    hashes: of its windows that also start in a document with a smaller doc_id; whole: its text is one of those.
    """
    chain = levels(window)
    texts = docs.select("doc_id", "version", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    # written down, so that Spark can split the partition of a text that very many documents have
    first = checkpointed(texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"))
    copies = checkpointed(texts.join(first, "digest").where("doc_id > first").select("doc_id", "version").distinct())

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[], [], []]
            for doc, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = words(text)
                if len(tokens) >= window:
                    h = np.unique(_anchor(word_hashes(tokens), chain[0], chain[1]) if len(chain) > 1 else word_hashes(tokens))
                    out[0].append(h.view(np.int64))
                    out[1].append(np.full(len(h), doc))
                    out[2].append(np.full(len(h), version))
            yield pa.RecordBatch.from_arrays(_arrays(out, ["i8", "i8", "i8"]), ["h", "doc_id", "version"])

    def extend(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out: list[list[np.ndarray]] = [[], [], [], []]
                for doc, version, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    h = word_hashes(words(text))
                    at = _candidates(h, some, chain, level) if len(h) >= window else ()
                    if len(at):
                        every = window_hashes(h, chain[level])
                        where = at[np.unique(every[at], return_index=True)[1]]
                        out[0].append(every[where].view(np.int64))
                        out[1].append((window_hashes(_second(h), chain[level])[where] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                        out[2].append(np.full(len(where), doc))
                        out[3].append(np.full(len(where), version))
                yield pa.RecordBatch.from_arrays(_arrays(out, ["i8", "i4", "i8", "i8"]), ["h", "g", "doc_id", "version"])

        return run

    # written down, as they are looked at twice and take long to make; the later levels, of fewer texts, are made twice
    # rather, because their shuffle of the texts then serves every level and the end
    rows = checkpointed(docs.mapInArrow(anchors, "h long, doc_id long, version long"))
    shared = rows.groupBy("h").agg(F.min("version").alias("low"), F.max("version").alias("high")).where("low <> high").select("h")
    some = _apart(rows, shared).groupBy("doc_id", "version").agg(F.collect_set("h").alias("some"))
    for level in range(1, len(chain)):
        kept = some.join(copies, ["doc_id", "version"], "left_anti")
        rows = docs.join(kept.hint("shuffle_hash"), ["doc_id", "version"]).select("doc_id", "version", "text", "some").mapInArrow(extend(level), "h long, g int, doc_id long, version long")
        shared = rows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "g", "first")
        some = _apart(rows, shared).groupBy("doc_id", "version").agg(F.collect_set("h").alias("some"))
    removed = _apart(rows, shared).where("doc_id > first").select("doc_id", "version", "h", F.lit(False).alias("whole"))
    return removed.unionByName(copies.select("doc_id", "version", F.lit(None).cast("long").alias("h"), F.lit(True).alias("whole"))).groupBy("doc_id", "version").agg(F.collect_list("h").alias("hashes"), F.max("whole").alias("whole"))


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept: texts without the words of windows that an earlier document holds.

    An earlier document is one with a smaller doc_id; windows are judged on the input. kept has the other words, joined
    by one space. A null or empty text has no words. Rows that share a doc_id are one document in this. Rows without
    doc_id are no documents and keep all their words. Repeated rows each give a row, an empty table gives an empty one;
    further columns, of whatever names, are ignored; texts of any length are looked at whole.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    rows = documents(docs)
    named = rows.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    plan = repeated(named, window)
    joined = named.join(plan.hint("shuffle_hash"), ["doc_id", "version"], "left").select("doc_id", "text", "hashes", "whole")
    nameless = rows.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<long>").alias("hashes"), F.lit(None).cast("boolean").alias("whole"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            before, gone, kept = [], [], []
            for text, hashes, whole in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                tokens = words(text)
                n = len(tokens)
                if n >= window and whole:
                    left: list[bytes] = []
                elif n >= window and hashes:
                    starts = _in(window_hashes(word_hashes(tokens), window), hashes)
                    edge = np.zeros(n + 1, dtype=np.int32)
                    edge[: len(starts)] += starts
                    edge[window:] -= starts[: n + 1 - window]
                    left = [w for w, over in zip(tokens, np.cumsum(edge)[:n].tolist(), strict=True) if not over]
                else:
                    left = tokens
                before.append(n)
                gone.append(n - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    out = "doc_id long, n_words long, n_removed long, kept string"
    return joined.mapInArrow(remove, out).unionByName(nameless.mapInArrow(remove, out))
