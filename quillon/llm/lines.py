"""Line dedup with two Bloom filters.

A line's key goes into a filter of keys that were seen once; when its bits are all there already, it goes into a filter
of keys that were seen twice. Keys are dealt by ranges of their hash, and each task has the two filters of its range,
sized by the number of lines that it is to expect: they grow with the corpus, and none is sent anywhere. What travels of
a line is its hash, a digest and where it stands. Lines that pass the filter of twice-seen keys are the suspects; only
they are shuffled again, for exact confirmation on the digest and for the choice of the first document.

A key that very many documents hold would fill one range. A task that reads documents therefore sends at most two lines
of a key to its range: further ones are suspects already, and are dealt at random.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices

_STRIP = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Settings:
    """range_lines: about so many lines to a range; bits, probes: filter bits to a line and bits set for a key;
    remembered: keys that a reading task knows at a time."""

    least: int = 10
    range_lines: int = 1_000_000
    bits: int = 16
    probes: int = 3
    remembered: int = 500_000


def split(text: str | None) -> list[str]:
    return (text or "").split("\n")


def key(line: str) -> bytes:
    return line.strip(_STRIP).encode().lower()  # bytes.lower() changes A-Z only


def keys(text: str | None, least: int) -> dict[bytes, int]:
    """Each key of at least `least` code points and the number of its first line."""
    found: dict[bytes, int] = {}
    for i, line in enumerate(split(text)):
        if len(line) >= least and len(bare := line.strip(_STRIP)) >= least:
            found.setdefault(bare.encode().lower(), i)
    return found


class TwiceSeen:
    """The two filters of a range of keys."""

    def __init__(self, lines: int, s: Settings):
        self.bits, self.probes = 1 << max(6, (lines * s.bits - 1).bit_length()), s.probes
        self.once, self.twice = np.zeros(self.bits, dtype=bool), np.zeros(self.bits, dtype=bool)

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """A row of bit numbers for each 64-bit hash."""
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return ((low[:, None] + np.arange(self.probes, dtype=np.uint64) * high[:, None]) & np.uint64(self.bits - 1)).astype(np.int64)

    def see(self, hashes: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Whether each key was seen before, or is said to be (again); all are seen now."""
        at = self.positions(hashes)
        known = again | self.once[at].all(axis=1)
        first = np.zeros(len(hashes), dtype=bool)
        first[np.unique(hashes, return_index=True)[1]] = True
        known |= ~first
        self.once[at] = True
        self.twice[at[known]] = True
        return known

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        return self.twice[self.positions(hashes)].all(axis=1) if len(hashes) else np.zeros(0, dtype=bool)


_ROW = "place int, again boolean, h long, a long, b long, doc_id long, version long, line int"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def repeated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, version, line: documents that must drop the key of their line with that number. docs: doc_id, version, text.

    version tells rows of one doc_id apart; documents are told apart by doc_id alone.
    """
    own = docs.where(F.col("doc_id").isNotNull())
    n = own.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // s.range_lines))
    expected = -(-n // ranges)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}  # whether two lines of the key were sent to its range
        turn = 0
        for batch in slices(batches):
            digests, refs, again, sure = [], [], [], []
            for doc, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, line in keys(text, s.least).items():
                    digest = hashlib.blake2b(name, digest_size=24).digest()
                    known = seen.get(digest)
                    digests.append(digest)
                    refs.append((doc, version, line))
                    again.append(known is not None)
                    sure.append(known is True)
                    seen[digest] = known is not None
            if len(seen) > s.remembered:
                seen.clear()
            if digests:
                h, a, b = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 3).T
                place = (h.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                place[np.array(sure)] = (np.arange(turn, turn + sum(sure)) % ranges).astype(np.uint64)
                turn += sum(sure)
                columns = [place.astype(np.int32), np.array(again), h, a, b, *(np.array(c) for c in zip(*refs, strict=True))]
                kinds = [pa.int32(), pa.bool_(), *[pa.int64()] * 5, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: TwiceSeen | None = None
        waiting: list[pa.RecordBatch] = []  # first sights, as many as there are keys
        for batch in batches:
            if not batch.num_rows:
                continue
            filters = filters or TwiceSeen(expected, s)
            known = filters.see(batch.column(2).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(known))
            waiting.append(batch.filter(pa.array(~known)))
        for batch in waiting:
            yield batch.filter(pa.array(filters.repeated(batch.column(2).to_numpy().view(np.uint64))))

    sent = own.select("doc_id", "version", "text").mapInArrow(read, _ROW)
    found = checkpointed(sent.repartition(ranges, "place").mapInArrow(suspects, _ROW).select("h", "a", "b", "doc_id", "version", "line"))
    first = found.groupBy("h", "a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "a", "b", "first")
    # written down, so that both sides of the join are dealt anew and Spark can split a key that very many documents hold
    return found.join(checkpointed(first), ["h", "a", "b"]).where("doc_id > first").select("doc_id", "version", "line")


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs (doc_id, text and whatever else) with n_lines, n_dropped and kept, the text of the lines that stay.

    A null or empty text is one empty line; a text of any length is split whole. A key counts once for each doc_id,
    however many lines or rows hold it. A row without doc_id is no document: it keeps all its lines. Rows that repeat
    each give a row; an empty table gives an empty one. Columns of docs named n_lines, n_dropped or kept give way to the
    new ones; others may have any name. Keys are told apart by 192 bits of a cryptographic digest.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept")
    kept_columns, at = docs.columns, docs.columns.index("text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    drops = repeated(packed.select("doc_id", "version", "text"), s).groupBy("doc_id", "version").agg(F.collect_set("line").alias("lines"))
    joined = packed.join(drops.hint("shuffle_hash"), ["doc_id", "version"], "left").select("rest", "text", "lines")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            before, dropped, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = split(text)
                before.append(len(lines))
                if gone:
                    out = {key(lines[i]) for i in gone}
                    stay = [x for x in lines if key(x) not in out]
                    dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                else:
                    dropped.append(0)
                    kept.append(text or "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(before, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["rest", "text", "n_lines", "n_dropped", "kept"])

    schema = joined.schema
    out = joined.mapInArrow(drop, f"rest {schema['rest'].dataType.simpleString()}, text string, n_lines long, n_dropped long, kept string")
    rest = [F.col("text") if i == at else F.col(f"rest.`{c}`").alias(c) for i, c in enumerate(kept_columns)]
    return out.select(*rest, "n_lines", "n_dropped", "kept")
