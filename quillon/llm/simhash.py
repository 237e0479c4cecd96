"""SimHash near-duplicates by anchor-point covering.

A fingerprint is 64 bits. Anchors are the words of a covering code on 46 of them: the product of two binary Golay
codes of length 23, whose covering radius is 3 each, so every fingerprint has one home anchor within (3, 3). Another
fingerprint that differs in at most d bits lies within the radius plus its own differing bits of that anchor; it is
replicated to every anchor for which the excesses over the radii add up to at most d. Fingerprints are compared at the
home anchor of one of the two, on all 64 bits. Equal fingerprints are one row throughout.

A few differing bits mean nearly equal texts. Texts that share four fifths of their shingles differ in about ten bits of
64, and up to twenty, which no covering of the bits reaches at a bearable replication. similar() serves these: it takes
many fingerprints, with the corners of a cross-polytope as anchors of each, and checks candidates on the bits of some
fingerprints, then on their whole sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import chain, combinations, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, slices, without
from .components import components

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
LENGTH, RADIUS, CHECKS = 23, 3, 11


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of all shingles of words, repeats included; a text of fewer words is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit by bit the majority of the hashes of all shingles of words; 0 without a word."""
    ones, hashes = np.zeros(64, dtype=np.int64), shingle_hashes(text, shingle)
    for i in range(0, len(hashes), 1 << 13):
        bits = np.unpackbits(hashes[i : i + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


@cache
def _code() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The checks of each 12 low and 11 high bits, and for each excess e the error patterns by their checks.

    Adding an error pattern with the checks of a word gives a codeword; patterns of weight up to RADIUS are one for
    each value of the checks (the code is perfect), those of weight RADIUS + e lead to the anchors of excess e.
    """

    def checks(word: int) -> int:
        for i in range(LENGTH - 1, CHECKS - 1, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - CHECKS)
        return word

    low, high = (np.array([checks(w << shift) for w in range(1 << bits)], dtype=np.int64) for bits, shift in ((12, 0), (11, 12)))
    by_excess = []
    for weights in ([0, 1, 2, 3], [4], [5]):
        rows: list[list[int]] = [[] for _ in range(1 << CHECKS)]
        for w in weights:
            for at in combinations(range(LENGTH), w):
                word = sum(1 << i for i in at)
                rows[low[word & 0xFFF] ^ high[word >> 12]].append(word)
        by_excess.append(rows)
    # every value of the checks has as many patterns of weight 5, or of weight 4, give or take; pad with -1
    return low, high, [np.array([r + [-1] * (max(map(len, rows)) - len(r)) for r in rows], dtype=np.int64) for rows in by_excess]


def anchors(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: first each row's home anchor, then all further ones within the covering."""
    low, high, patterns = _code()
    halves = []
    for shift in (0, LENGTH):
        word = (fps >> np.uint64(shift)).astype(np.int64) & ((1 << LENGTH) - 1)
        value = low[word & 0xFFF] ^ high[word >> 12]
        halves.append([np.where(p[value] >= 0, word[:, None] ^ p[value], -1) for p in patterns])
    rows, out = [], []
    for e in range(distance + 1):
        for f in range(distance + 1 - e):
            a, b = halves[0][e][:, :, None], halves[1][f][:, None, :]
            both = np.where((a >= 0) & (b >= 0), a << LENGTH | b, -1).reshape(len(fps), -1)
            at = np.nonzero(both >= 0)
            rows.append(at[0])
            out.append(both[at])
    return np.concatenate(rows), np.concatenate(out)


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """a, b long, a < b as signed longs: all pairs of different fingerprints within the distance. distinct: fp, once each."""
    if not 0 <= distance <= 2:
        raise ValueError("this covering serves distances up to 2")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            _, out = anchors(fps.view(np.uint64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(0)], ["anchor", "a"])

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                fps = batch.column(0).slice(i, 2000).to_numpy(zero_copy_only=False)
                rows, out = anchors(fps.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(fps[rows])], ["anchor", "b"])

    home = distinct.mapInArrow(homes, "anchor long, a long")
    near = distinct.mapInArrow(replicas, "anchor long, b long")
    return home.hint("shuffle_hash").join(near, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp long, component_id: documents linked by chains of fingerprints at most `distance` bits apart.

    component_id is the smallest doc_id reachable. Texts without a word (null, empty) all have fingerprint 0 and are
    linked like others; a text of any length is taken whole. Rows that repeat each give a row; rows without doc_id are
    left out, since nothing names them; an empty table gives an empty one; further columns, of whatever names, are
    ignored.
    """
    rows = checkpointed(fingerprints(docs.where(F.col("doc_id").isNotNull()), shingle))
    least = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(least.select("fp"), distance))
    inside = checkpointed(linked.join(least, linked["node"] == least["fp"]).select("fp", "first", "component"))
    # written down before they are joined on what they were grouped or joined by: Spark can then split the partition of
    # a large component, or of a fingerprint that very many documents have
    smallest = checkpointed(inside.groupBy("component").agg(F.min("first").alias("component_id")))
    of = inside.join(smallest, "component").select("fp", "component_id")
    named = checkpointed(least.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


#: Further fingerprints of 64 bits, for near copies: so many; groups of three of them, which are met at.
WORDS, MEETINGS = 128, 128
#: Of these, as many as are kept whole to be compared bit by bit.
KEPT = 4
#: Who is near more than FEW others at a key, by two fingerprints, or is one of more than MANY there, is one of a crowd.
FEW, MANY = 2, 256


@cache
def _mixers() -> np.ndarray:
    """Two odd factors for each further fingerprint."""
    return np.random.default_rng(11).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _threes() -> np.ndarray:
    """Which three fingerprints each meeting takes; every one is taken as often as any other."""
    rng = np.random.default_rng(12)
    while True:
        dealt = np.concatenate([rng.permutation(WORDS) for _ in range(3 * MEETINGS // WORDS)]).reshape(MEETINGS, 3)
        if all(len(set(r)) == 3 for r in dealt.tolist()):
            return dealt


def ones(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the further fingerprints (a row each) how many of the hashes set it."""
    first, second = _mixers()
    total = np.zeros(64 * WORDS, np.int32)

    def count(words: np.ndarray, amount: int) -> None:
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
        np.add(total, amount * bits.sum(axis=0, dtype=np.uint8).astype(np.int32), out=total)

    for i in range(0, len(hashes), 504):
        x = hashes[i : i + 504, None] * first
        x ^= x >> np.uint64(32)
        x *= second
        x ^= x >> np.uint64(29)
        if k := len(x) // 7:  # seven words turn into the three digits of their sum, bit by bit
            a, b, c, d, e, f, g = (x[j * k : (j + 1) * k] for j in range(7))
            u, v = a ^ b, d ^ e
            left, right = u ^ c, v ^ f
            both = left ^ right
            twos = [(a & b) | (u & c), (d & e) | (v & f), (left & right) | (both & g)]
            w = twos[0] ^ twos[1]
            count(both ^ g, 1)
            count(w ^ twos[2], 2)
            count((twos[0] & twos[1]) | (w & twos[2]), 4)
        if len(x) > 7 * k:
            count(x[7 * k :], 1)
    return total.reshape(WORDS, 64)


def corners(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home anchor of each further fingerprint, and the first KEPT of these as signed longs.

    The anchors of a fingerprint are the 128 corners of a cross-polytope, one for each bit and value: home is the bit
    whose majority is clearest, which near copies share most often. 64 * value + bit.
    """
    lead = 2 * ones(hashes) - len(hashes)
    at = np.abs(lead).argmax(axis=1)
    home = at + 64 * (lead[np.arange(WORDS), at] > 0)
    return home.astype(np.uint8), np.packbits(lead[:KEPT] > 0, axis=1, bitorder="little").view(np.int64).ravel()


def meetings(home: np.ndarray) -> np.ndarray:
    """For rows of home anchors the keys at which they meet others, one for each meeting."""
    three = home[:, _threes()].astype(np.int64)
    return np.arange(MEETINGS) << 21 | three[:, :, 0] << 14 | three[:, :, 1] << 7 | three[:, :, 2]


def most_bits(bits: int, similarity: float) -> int:
    """How many of the bits differ at most between sets that are so similar: what is expected, a quarter more as small
    sets have, and five standard deviations."""
    p = min(0.5, 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return int(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, a, b (a digest of the set of shingles), n (its size), home (anchors), f0, f1 ... (fingerprints) of every row."""
    names = [f"f{i}" for i in range(KEPT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in made]).reshape(-1, 2)
            known = [corners(x) for x in made]
            kept = np.array([k for _, k in known]).reshape(-1, KEPT)
            longs = (pa.array(np.ascontiguousarray(c)) for c in (*digests.T, *kept.T))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, made), pa.int32()), pa.array([h.tobytes() for h, _ in known], pa.binary()), *longs], ["doc_id", "n", "home", "a", "b", *names])

    return docs.mapInArrow(run, "doc_id long, n int, home binary, a long, b long, " + ", ".join(f"{c} long" for c in names))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) whose sets have that similarity. sets: rep, set (sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left"):
            good = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(c.as_buffer(), np.uint64) for c in (one, other))
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both >= similarity * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("rep").alias(c), F.col("set").alias(n)) for c, n in (("x", "left"), ("y", "right")))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "left", "right").mapInArrow(run, "x long, y long")


def _pairs_and_crowds(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows key, rep, f0, f1 in the order of keys: x, y of those at one key whose bits differ in at most `limit`.

    Not all pairs are given where many meet: who is near more than FEW others at a key, those others, and everyone at a
    key of more than MANY, are given alone, with null for y.
    """

    def near(key: np.ndarray, rep: np.ndarray, *bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, y and the crowd of whole keys."""
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        full = np.repeat(sizes > MANY, sizes)
        at, found = np.flatnonzero(~full & np.repeat(sizes > 1, sizes)), []
        for d in range(1, MANY):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            apart = reduce(add, (np.bitwise_count((f[at] ^ f[at + d]).view(np.uint64)).astype(np.int32) for f in bits))
            good = at[(apart <= limit) & (rep[at] != rep[at + d])]
            found.append(np.stack((good, good + d)))
        one, other = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        others = np.bincount(one, minlength=len(key)) + np.bincount(other, minlength=len(key))
        crowded = (others[one] > FEW) | (others[other] > FEW)
        crowd = np.unique(np.concatenate((rep[full], rep[one[crowded]], rep[other[crowded]])))
        x, y = rep[one[~crowded]], rep[other[~crowded]]
        return np.minimum(x, y), np.maximum(x, y), crowd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, crowd = np.zeros((4, 0), np.int64), np.zeros(0, np.int64)
        for batch in chain(batches, [None]):
            if batch is None:
                rows, end = waiting, waiting.shape[1]
            else:
                rows = np.concatenate((waiting, [c.to_numpy(zero_copy_only=False) for c in batch.columns]), axis=1)
                end = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
            # the last key may go on in the next batch; of one that is full already, what shows this is kept
            whole, waiting = rows[:, :end], rows[:, end:]
            full, waiting = waiting[1, : -MANY - 1], waiting[:, -MANY - 1 :]
            x, y, more = near(*whole) if end else (full[:0],) * 3
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
            crowd = np.unique(np.concatenate((crowd, more, full)))
            if len(crowd) and (batch is None or len(crowd) > 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(crowd), pa.nulls(len(crowd), pa.int64())], ["x", "y"])
                crowd = crowd[:0]

    return run


def _meeting(pairs: DataFrame) -> DataFrame:
    """x, y of the pairs (x, y, x_home, y_home) that share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                one, other = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, WORDS) for k in (2, 3))
                meet = (one == other)[:, _threes()].all(axis=2).any(axis=1)
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["x", "y"]).filter(pa.array(meet))

    return pairs.select("x", "y", "x_home", "y_home").mapInArrow(run, "x long, y long")


def _rare(sets: DataFrame, similarity: float) -> DataFrame:
    """The rarest shingles of each of the sets, of which two sets that are so similar share one. sets: rep, set.

    h, rep, n (size), pos (how many of the set come up to this one, those of its own first), place (smallest for who
    shares most). Shingles that no other of the sets has bring none together, and of a set of which these are too many
    there is no row.
    """

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set"):
            made = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            of = pa.array(np.repeat(np.arange(len(made)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *made]))], ["rep", "key", "n", "h"])

    each = sets.select("rep", "set", F.xxhash64("set").alias("key")).mapInArrow(singly, "rep long, key long, n int, h long")
    holders = each.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    own_set = Window.partitionBy("rep", "key")
    shared = each.join(holders, "h").withColumns({"rank": F.row_number().over(own_set.orderBy("size", "h")), "s": F.count("*").over(own_set), "place": -F.sum("size").over(own_set)})
    rare = shared.where(F.col("rank") <= F.col("s") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    return rare.select("h", "rep", "n", (F.col("n") - F.col("s") + F.col("rank")).alias("pos"), "place")


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: documents linked by chains of texts whose sets of shingles have that Jaccard similarity.

    component_id is the smallest doc_id reachable. Equal sets count once: they are the copies of their smallest doc_id.
    The others are searched by SimHash: each has WORDS fingerprints, and meets those that share the home anchors of
    three of these; who meets is compared by the bits of KEPT fingerprints, and who is near by the whole sets. Sets of a
    similarity of 0.8 meet with a probability of about 0.9998 (see README), more similar ones more surely, less similar
    ones less so. Where many meet who are near by their bits, not all pairs are tried: such documents are compared if
    they meet and share one of their rarest shingles, as sets that are so similar always do, and what follows it can be
    enough. Among the holders of a shingle the one that shares most with the others is compared with all; those that are
    then in no component with it are compared with all in their turn, 32 of a group first, then 1,024 and so on, until
    all are in one component or have been compared. So a large group of near copies costs a few comparisons a member,
    and no link is lost of those who meet. Texts without a word (null, empty) are equal; texts of any length are taken
    whole; rows that repeat each give a row; rows without doc_id are left out; an empty table gives an empty one;
    further columns, of whatever names, are ignored.
    """
    own = documents(docs).where("doc_id IS NOT NULL")
    rows = checkpointed(_sets(own, shingle))
    kept = [f"f{i}" for i in range(KEPT)]
    least = checkpointed(rows.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "home", *kept))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                home = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, WORDS)
                of = pa.array(np.repeat(np.arange(len(home)), MEETINGS))
                yield pa.RecordBatch.from_arrays([pa.array(meetings(home).ravel()), *(part.column(k).take(of) for k in range(3))], ["key", "rep", "f0", "f1"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["rep", "set"])

    # a smaller set has no other one that is so similar: n of n + 1 is the most
    able = least.where(F.col("n") >= similarity * (F.col("n") + 1) - 1e-9)
    met = able.select("rep", "f0", "f1", "home").mapInArrow(meet, "key long, rep long, f0 long, f1 long").repartition("key").sortWithinPartitions("key")
    met = checkpointed(met.mapInArrow(_pairs_and_crowds(most_bits(128, similarity)), "x long, y long").distinct())
    wanted = checkpointed(met.select(F.explode(F.array("x", "y")).alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    sets = checkpointed(own.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(cut, "rep long, set binary").dropDuplicates())
    known = checkpointed(able.join(wanted, F.col("rep") == F.col("doc_id"), "left_semi").select("rep", "n", "home", *kept))
    crowd = met.where("y IS NULL").select(F.col("x").alias("rep"))
    now = checkpointed(_rare(sets.join(crowd, "rep", "left_semi"), similarity).withColumns({"c": F.col("rep"), "done": F.lit(False)}))
    main = now.groupBy("h").agg(F.min(F.struct("place", "rep", "c")).alias("main"))
    turn = checkpointed(now.join(main, "h").where("rep = main.rep").select("h", "rep", "n", "pos", "c"))
    of, tried, hubs = None, None, 32
    while True:
        hub = turn.select("h", *(F.col(c).alias(f"hub_{c}") for c in ("rep", "n", "pos", "c")))
        # if this shingle is the first that they share, no more than what follows it can be shared
        most = F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos")) + 1
        fits = (F.col("hub_c") != F.col("c")) & (most * (1 + similarity) >= similarity * (F.col("n") + F.col("hub_n")) - 1e-9)
        pairs = now.join(hub, "h").where(fits).select(F.least("rep", "hub_rep").alias("x"), F.greatest("rep", "hub_rep").alias("y"))
        pairs = pairs.unionByName(met.where("y IS NOT NULL")).distinct() if tried is None else pairs.distinct().join(tried, ["x", "y"], "left_anti")
        pairs = checkpointed(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        for c in ("x", "y"):
            pairs = pairs.join(known.select(F.col("rep").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in ("n", "home", *kept))), c)
        bits = reduce(add, (F.bit_count(F.col(f"x_{k}").bitwiseXOR(F.col(f"y_{k}"))) for k in kept))
        sizes = F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n") - 1e-9
        pairs = _meeting(pairs.where(sizes & (bits <= most_bits(64 * KEPT, similarity)))).distinct()
        links = checkpointed(_alike(pairs, sets, similarity)).toDF("a", "b")
        # what is linked already goes on as stars, which settle sooner than all links
        if of is None or not links.isEmpty():
            of = checkpointed(components(links if of is None else links.unionByName(of.where("node <> component").toDF("a", "b"))))
        # groups in which somebody waits; those who had their turn are done
        had = turn.select("h", "rep", F.lit(True).alias("had"))
        now = now.drop("c").join(had, ["h", "rep"], "left").join(of, F.col("rep") == F.col("node"), "left")
        now = checkpointed(now.select("h", "rep", "n", "pos", "place", F.coalesce("component", "rep").alias("c"), (F.col("done") | F.coalesce("had", F.lit(False))).alias("done")))
        main = now.groupBy("h").agg(F.min(F.struct("place", "rep", "c")).alias("main"))
        rank = F.row_number().over(Window.partitionBy("h").orderBy("place", "rep"))
        turn = now.join(main, "h").where("c <> main.c AND NOT done").withColumn("rank", rank).where(F.col("rank") <= hubs)
        turn = checkpointed(turn.select("h", "rep", "n", "pos", "c"))
        if turn.isEmpty():
            break
        now = now.join(turn.select("h").distinct(), "h", "left_semi")
        hubs *= 32
    named = least.select("a", "b", "rep").join(of, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("component", "rep").alias("rep"))
    return rows.select("doc_id", "a", "b").join(checkpointed(named), ["a", "b"]).select("doc_id", F.col("rep").alias("component_id"))


def dedup(docs: DataFrame, shingle: int = 3, distance: int = 2, similarity: float | None = None) -> DataFrame:
    """The rows of docs (all columns) but for the near copies of a document with a smaller doc_id.

    Near copies have fingerprints at most `distance` bits apart, or with a similarity sets of shingles that are so
    similar. Rows that share a doc_id are one document; rows without one are no copies of anything and stay. Nulls,
    empty and long texts, ties, repeated rows and empty tables are as in near_duplicates() and similar().
    """
    found = near_duplicates(docs, shingle, distance) if similarity is None else similar(docs, shingle, similarity)
    return without(docs, found.where("component_id < doc_id").select("doc_id"))
