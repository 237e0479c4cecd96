"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words, of their character n-grams and of its word 2-grams, all
hashed into a fixed number of buckets; a softmax over two labels follows. Vectors and softmax are learned together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows. As the model is linear after averaging, each
bucket adds a fixed amount to the log odds; a word's amount (with its n-grams) is therefore kept, and scoring a text
costs a look-up a word and one a 2-gram.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, held, slices


@dataclass(frozen=True)
class Settings:
    """max_train_docs bounds the labelled rows that are gathered for fitting; the rest shapes the model.

    least and most: lengths of character n-grams (no n-grams if most is less); pairs: whether word 2-grams take part.
    """

    max_train_docs: int = 4000
    buckets: int = 1 << 17
    dim: int = 8
    least: int = 3
    most: int = 4
    pairs: bool = True
    epochs: int = 5
    rate: float = 0.5
    seed: int = 7


class Features:
    """Words -> buckets of each word and of the character n-grams (here, of UTF-8 bytes) of <word>."""

    def __init__(self, settings: Settings):
        self.s = settings

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All buckets, word by word within each kind, and the number of the word that each belongs to."""
        s = self.s
        raw = np.frombuffer(b"".join(b"<%b>" % w for w in words), dtype=np.uint8).astype(np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        room = np.repeat(ends, sizes) - np.arange(len(raw))
        ids = [np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % np.uint32(s.buckets)]
        of = [np.arange(len(words))]
        h = np.zeros(len(raw), dtype=np.uint32)
        for n in range(1, s.most + 1 if s.most >= s.least else 0):
            h = h[: max(len(raw) - n + 1, 0)] * np.uint32(0x01000193) + (raw[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            if n >= s.least:
                fits = np.flatnonzero(room[: len(h)] >= n)
                g = h[fits]
                ids.append(((g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(7)) % np.uint32(s.buckets))
                of.append(owner[fits])
        return np.concatenate(ids).astype(np.int64), np.concatenate(of)


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, tokens), np.uint32, len(tokens))


def pair_ids(first: np.ndarray, second: np.ndarray, settings: Settings) -> np.ndarray:
    """Buckets of word 2-grams, from the difference of their words' hashes: all repetitions of a word share a bucket."""
    h = (first - second) * np.uint32(0x9E3779B1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) % np.uint32(settings.buckets)).astype(np.int64)


def bag(text: str | None, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words, character n-grams and word 2-grams, and the share of each: a row of the average."""
    at, amounts = counted(text, features)
    return at, (amounts / max(amounts.sum(), 1)).astype(np.float32)


def counted(text: str | None, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text in order, and how often each occurs."""
    s, tokens = features.s, words(text)
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    counts = Counter(tokens)
    ids, of = features(list(counts))
    amounts = np.bincount(ids, np.fromiter(counts.values(), np.float64, len(counts))[of], s.buckets)
    if s.pairs:
        h = word_hashes(tokens)
        amounts += np.bincount(pair_ids(h[:-1], h[1:], s), minlength=s.buckets)
    at = np.flatnonzero(amounts)
    return at.astype(np.int32), amounts[at].astype(np.int32)


def packed(text: str | None, features: Features) -> bytes:
    """counted() in few bytes: the steps between buckets are small, and most occur once."""
    at, amounts = counted(text, features)
    return zlib.compress(np.concatenate((np.diff(at, prepend=0).astype("<i4"), amounts.astype("<i4"))).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """bag() from packed()."""
    steps, amounts = np.frombuffer(zlib.decompress(data), "<i4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), (amounts / max(amounts.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    """What each bucket adds to the log odds of label 1, and the constant. After fit() the parts that it comes from too:
    a vector for each bucket, the softmax's weights and bias."""

    settings: Settings
    odds: np.ndarray
    constant: float
    vectors: np.ndarray | None = None
    out: np.ndarray | None = None
    bias: np.ndarray | None = None

    def scorer(self, most: int = 250_000):
        """Texts -> scores; it remembers what each word adds, and forgets all when that gets too much."""
        s, features, odds = self.settings, Features(self.settings), self.odds
        known: dict[bytes, int] = {}
        amounts, numbers, hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint32)

        def score(texts: list[str | None]) -> list[float]:
            nonlocal amounts, numbers, hashes
            lists = [words(t) for t in texts]
            if len(known) > most:
                known.clear()
                amounts, numbers, hashes = amounts[:0], numbers[:0], hashes[:0]
            if new := list(set().union(*lists).difference(known)):
                ids, of = features(new)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                amounts = np.concatenate((amounts, np.bincount(of, odds[ids], len(new))))
                numbers = np.concatenate((numbers, np.bincount(of, minlength=len(new))))
                hashes = np.concatenate((hashes, word_hashes(new)))
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            at = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, sizes.sum())
            of = np.repeat(np.arange(len(lists)), sizes)
            total, n = np.bincount(of, amounts[at], len(lists)), np.bincount(of, numbers[at], len(lists))
            if s.pairs and len(at) > 1:
                h = hashes[at]
                together = np.flatnonzero(of[1:] == of[:-1])
                total += np.bincount(of[together], odds[pair_ids(h[together], h[together + 1], s)], len(lists))
                n += np.bincount(of[together], minlength=len(lists))
            logit = self.constant + np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
            return (1 / (1 + np.exp(-np.clip(logit, -60, 60)))).tolist()

        return score


def fit(texts: list[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """Learn from texts and 0/1 labels. With no rows, or with one label only, every score is that label's share."""
    features = Features(settings)
    return fit_bags([bag(t, features) for t in texts], labels, settings)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], settings: Settings) -> Model:
    """fit() on what bag() gives."""
    s = settings
    y = np.array(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(s, np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    share = y.mean()
    bias[:] = np.log([1 - share, share])
    steps, step = s.epochs * len(bags), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(bags)):
            at, weight = bags[i]
            rate = np.float32(s.rate * (1 - step / steps))
            step += 1
            hidden = weight @ vectors[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.05) * p
            if len(at):
                # averaging makes each bucket's share tiny; its step is scaled to the largest of the document
                vectors[at] -= (rate / weight.max()) * np.outer(weight, back)
    return Model(s, (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), vectors, out, bias)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the max_train_docs labelled rows with the smallest hash of doc_id, none of the held-out fifth.

    Labels that are null, not 0 or 1, or of no document are left out. A document with several labels counts each time,
    as do rows that repeat, but no more rows are gathered for that. Texts become bags where they are read: what travels
    of a row is a few bytes for each of its buckets, of which there are settings.buckets at most.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(settings.max_train_docs)
    )
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings)
        for batch in slices(batches):
            made = [packed(t, features) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], ["doc_id", "quality", "bag"])

    found = rows.mapInArrow(bags, "doc_id long, quality int, bag binary").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "bag").limit(settings.max_train_docs).toArrow()
    return fit_bags([unpacked(b.as_buffer()) for b in found["bag"]], found["quality"].to_pylist(), settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs and a column score; a null or empty text gets the score of no evidence. No column of docs but text counts.

    An own column score is replaced. Rows that repeat are each scored alike; an empty table gives an empty one; a text
    of any length is scored whole.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast((model.settings, model.odds, model.constant))  # buckets x 4 bytes
    at = docs.columns.index("text")
    name = ("quality", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(name, lambda: Model(*sent.value).scorer())
        for batch in slices(batches):
            scores = scorer(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
