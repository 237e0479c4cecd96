"""Token-id packing: best-fit-decreasing with a segment tree over capacities.

Each partition of the documents is tokenised and packed where it is read; nothing is shuffled. Documents longer than a
row are split without loss. A tree over the free capacities 0..length finds the fullest row that still takes a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, slices

SCHEMA = "shard int, row long, n_tokens int, doc_ids array<long>, doc_parts array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


class Capacities:
    """Which capacities some open row has; finds the smallest that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.full = bytearray(2 * self.leaves)  # 1: a row below has this capacity
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node and not self.full[node]:
            self.full[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The smallest capacity of at least `least` and a row that has it; the row is no longer listed."""
        full, node = self.full, self.leaves + least
        if not full[node]:
            while node > 1 and (node & 1 or not full[node + 1]):  # up, until a right sibling holds something
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if full[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            full[node] = 0
            node >>= 1
            while node and not (full[2 * node] or full[2 * node + 1]):
                full[node] = 0
                node >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """Rows of segment numbers; a segment goes to the fullest row that takes it. Equal lengths keep their order."""
    rows: list[list[int]] = []
    open_rows = Capacities(room)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[i])
        if found is None:
            rows.append([i])
            left, row = room - lengths[i], len(rows) - 1
        else:
            left, row = found[0] - lengths[i], found[1]
            rows[row].append(i)
        if left:
            open_rows.add(left, row)
    return rows


def pack(docs: DataFrame, tokenizer: Callable[[], Callable[[str], np.ndarray]], length: int = 2048, pad: int = 0, vocabulary: int = 1 << 16, buffer_tokens: int = 2_000_000) -> DataFrame:
    """Rows of `length` ids: shard, row, n_tokens, doc_ids, doc_parts, cu_seqlens, position_resets, input_ids.

    tokenizer() is called once in each task and gives text -> ids. input_ids is little-endian, of 16 bits if the
    vocabulary allows and else of 32, and padded to `length` with pad; the first n_tokens are real. cu_seqlens are the
    cumulative lengths of the segments from 0, position_resets where positions start again at 0 (padding included).
    doc_parts numbers a document's segments from 0, so that joining them in order gives its ids again. shard and row
    number the rows by input partition. Rows are packed in bunches of about buffer_tokens ids. Null and empty texts
    have no ids and are in no row; a null doc_id is carried as null; repeated rows are packed each; an empty table
    gives an empty one; further columns are ignored.
    """
    if length < 1 or pad >= vocabulary:
        raise ValueError("a row takes one id at least, and pad is an id of the vocabulary")
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        shard, done, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal done
            rows = best_fit_decreasing([len(ids) for _, _, ids in held], length)
            ids = np.full((len(rows), length), pad, dtype=kind)
            ends, resets = [], []
            for r, segments in enumerate(rows):
                end = np.cumsum([0, *(len(held[i][2]) for i in segments)])
                ids[r, : end[-1]] = np.concatenate([held[i][2] for i in segments])
                ends.append(end.tolist())
                resets.append(end.tolist() if end[-1] < length else end[:-1].tolist())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(rows), pa.int32()),
                    pa.array(range(done, done + len(rows)), pa.int64()),
                    pa.array([e[-1] for e in ends], pa.int32()),
                    pa.array([[held[i][0] for i in s] for s in rows], pa.list_(pa.int64())),
                    pa.array([[held[i][1] for i in s] for s in rows], pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array(resets, pa.list_(pa.int32())),
                    pa.array([row.tobytes() for row in ids], pa.binary()),
                ],
                ["shard", "row", "n_tokens", "doc_ids", "doc_parts", "cu_seqlens", "position_resets", "input_ids"],
            )
            done += len(rows)
            return out

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) if text else ()
                for part, at in enumerate(range(0, len(ids), length)):
                    segment = np.asarray(ids[at : at + length])
                    held.append((doc, part, segment.astype(kind)))
                    size += len(segment)
                    if size >= buffer_tokens:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return documents(docs).mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows, one Parquet file a shard and more for large ones, to a path that executors share."""
    packed.write.mode("overwrite").parquet(path)


def matrix(rows: list, length: int, vocabulary: int = 1 << 16) -> np.ndarray:
    """The id matrix of some packed rows, as a reader of the files would see it."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    return np.frombuffer(b"".join(bytes(r["input_ids"]) for r in rows), dtype=kind).reshape(-1, length)
