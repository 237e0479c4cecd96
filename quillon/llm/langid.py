"""Language identification by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct character 1- to 3-grams that
both hold, over the geometric mean of their own numbers. Training texts serve as Nyström landmarks; one-versus-rest
kernel ridge regression is solved in the space that they span. Scoring is a product of matrices for each batch of
texts: presence of hashed n-grams times (landmark presence times weights), which is the kernel row times the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, slices

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """per_lang and rows bound what is gathered for fitting: 2 kB each of per_lang rows of a language, of fewer if the
    languages are so many that they would be more than `rows` together, but of some of every language. Landmarks are
    so many, or per_lang_landmarks of each language if that is more."""

    per_lang: int = 300
    rows: int = 12_000
    least_per_lang: int = 8
    landmarks: int = 160
    per_lang_landmarks: int = 4
    bits: int = 14
    ridge: float = 0.01
    longest: int = 3


def grams(text: str, settings: Settings) -> np.ndarray:
    """Hashes of all character n-grams of the lower-cased text, repeats included."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h, out = np.zeros(len(cp), dtype=np.uint32), []
    for n in range(1, settings.longest + 1):
        if len(cp) < n:
            break
        h = h[: len(cp) - n + 1] * np.uint32(0x01000193) + (cp[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - settings.bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def presence(texts: list[str], settings: Settings) -> np.ndarray:
    """One row a text: 1 / sqrt(number of distinct n-grams) where an n-gram occurs, so that products are kernels."""
    x = np.zeros((len(texts), 1 << settings.bits), dtype=np.float32)
    for row, text in zip(x, texts, strict=True):
        row[grams(text, settings)] = 1
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


@dataclass
class Model:
    settings: Settings
    langs: list[str]
    weights: np.ndarray  # one column a language

    def predict(self, texts: list[str | None], block: int = 64) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i in range(0, len(texts), block):
            part = texts[i : i + block]
            known = [bool(t) and any(map(str.isalpha, t)) for t in part]
            if not self.langs or not any(known):
                names += [UNDETERMINED] * len(part)
                scores += [0.0] * len(part)
                continue
            out = presence([t if k else "" for t, k in zip(part, known, strict=True)], self.settings) @ self.weights
            best = out.argmax(axis=1)
            top = np.clip((out[np.arange(len(part)), best].astype(np.float64) + 1) / 2, 0, 1)
            names += [self.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            scores += [float(s) if k else 0.0 for s, k in zip(top, known, strict=True)]
        return names, scores


def fit(texts: list[str | None], langs: list[str], settings: Settings = Settings()) -> Model:
    """Learn from texts and their languages; texts without a letter teach nothing."""
    rows = [(t, g) for t, g in zip(texts, langs, strict=True) if t and g is not None and any(map(str.isalpha, t))]
    return fit_packed([packed(t, settings) for t, _ in rows], [g for _, g in rows], settings)


def packed(text: str, settings: Settings) -> bytes:
    """A bit for each hashed n-gram: whether the text holds it."""
    bits = np.zeros(1 << settings.bits, dtype=bool)
    bits[grams(text, settings)] = True
    return np.packbits(bits).tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit_packed(rows: list[bytes], langs: list[str], settings: Settings) -> Model:
    """fit() on packed texts. Only the landmarks are unpacked together."""
    names = sorted(set(langs))
    if not names:
        return Model(settings, [], np.zeros((1 << settings.bits, 0), np.float32))
    y = np.searchsorted(names, langs)
    share = np.bincount(y, minlength=len(names))
    by_lang = np.argsort(y, kind="stable")
    turn = np.empty(len(y), np.int64)
    turn[by_lang] = np.arange(len(y)) - np.repeat(np.cumsum(share) - share, share)  # each language's first, second, ...
    chosen = np.lexsort((y, turn))[: max(settings.landmarks, settings.per_lang_landmarks * len(names))]
    z = _unpacked([rows[i] for i in chosen])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([(_unpacked(rows[i : i + 512]) @ z.T).astype(np.float64) @ whiten for i in range(0, len(rows), 512)])
    each = (len(y) / (len(names) * share))[y]  # languages weigh the same
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    solved = np.linalg.solve((phi * each[:, None]).T @ phi + settings.ridge * np.eye(phi.shape[1]), (phi * each[:, None]).T @ target)
    return Model(settings, names, (z.T @ (whiten @ solved).astype(np.float32)).astype(np.float32))


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on about per_lang documents of each language, by the hash of doc_id, none of the held-out fifth.

    Rows with a null doc_id, text or lang teach nothing, nor do texts without a letter. With fewer than two languages
    the answer is the only one. Texts are packed where they are read: their n-grams travel, 2 kB a row whatever the text
    is, and of doc_ids that repeat no more rows are gathered than of others.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    counts = usable.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return fit([], [], settings)
    wanted = min(settings.per_lang, max(settings.least_per_lang, settings.rows // len(counts)))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # twice the share that is wanted, so that a rank by hash can take the exact number; small languages whole
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2 * wanted + 50) / r["count"])))])
    some = usable.where(u < rate[F.col("lang")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = [packed(t, settings) if any(map(str.isalpha, t)) else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.binary())], ["doc_id", "lang", "bits"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "bits"))
    rows = some.mapInArrow(pack, "doc_id long, lang string, bits binary").where("bits IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= wanted)
    rows = rows.orderBy("doc_id", "lang", "bits").toArrow()  # at most max(rows, 8 a language), 2 kB each
    return fit_packed(rows["bits"].to_pylist(), rows["lang"].to_pylist(), settings)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row: `und` and 0 for a text that is null or has no letter.

    Rows that repeat each give a row; an empty table gives an empty one; other columns, of whatever name, are ignored;
    a text of any length is scored whole. Of languages that score the same the first by name is taken.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.settings, model.langs, model.weights))  # 64 kB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in slices(batches):
            names, scores = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
