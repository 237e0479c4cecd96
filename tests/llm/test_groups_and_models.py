"""SimHash, components, classifiers, top-k, quotation linking and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, components, langid, quality, queries, simhash, topk

from ..test_sql import same_as_sql
from .fixtures import SCHEMA, awkward, clashing, frame, sentence
from .test_text_operators import ENCODING, brute_hits, brute_lines

DATA = "/root/testdata/sf0.001"


def groups(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# components


@pytest.mark.parametrize("kind", ["chain", "star", "random", "cliques", "empty", "loops"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(7, i) for i in range(-200, 200)] + [(199, 1000), (1000, 1001)],
        "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)],
        "cliques": [(10 * g + i, 10 * g + j) for g in range(12) for i in range(10) for j in range(10)],
        "empty": [],
        "loops": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)],
    }[kind]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = groups(real, {x for e in real for x in e})
    got = [tuple(r) for r in components.components(df).collect()]
    assert dict(got) == want and len(got) == len(want)


# SimHash


def brute_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_code_covers_and_anchors_are_complete():
    low, high, patterns = simhash._code()
    assert (patterns[0] >= 0).sum() == 1 << 11 and (patterns[0] >= 0).all()  # perfect: one error pattern for each check
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 1 << 64, dtype=np.uint64)
        flips = rng.choice(64, rng.integers(0, 3), replace=False)
        y = x ^ np.uint64(sum(1 << int(f) for f in flips))
        home = simhash.anchors(np.array([x]), 0)[1]
        assert len(home) == 1
        near = simhash.anchors(np.array([y]), 2)[1]
        assert home[0] in near and len(set(near.tolist())) == len(near)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64).tolist() + [0, (1 << 64) - 1]
    fps = set(base)
    for x in base:
        for _ in range(12):
            y = x
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    signed = sorted(np.array(list(fps), dtype=np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for d in (0, 1, 2):
        want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= d}
        got = [tuple(r) for r in simhash.links(df, d).collect()]
        assert set(got) == want and len(got) == len(want)
    with pytest.raises(ValueError):
        simhash.links(df, 3)


@pytest.mark.parametrize("shingle", [3, 5])
def test_near_duplicates(spark, shingle):
    rows = [r for r in awkward() if r[0] is not None]
    out = [tuple(r) for r in simhash.near_duplicates(clashing(spark, awkward(), "fp", "component_id"), shingle, 2).collect()]
    fps = {i: brute_fingerprint(t, shingle) for i, t, *_ in rows}
    want = groups([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], fps)
    assert Counter((i, f & (1 << 64) - 1, c) for i, f, c in out) == Counter((r[0], fps[r[0]], want[r[0]]) for r in rows)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.dedup(clashing(spark, awkward(), "fp", "component_id"), shingle, 2)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "component_id"]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in awkward() if r[0] is None or want[r[0]] == r[0])


def brute_similar(rows, shingle, similarity):
    """doc_id -> smallest doc_id linked, by comparing all pairs of sets."""
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    ids = sorted(sets)
    edges = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= similarity * len(x | y):
                edges.append((a, b))
    return groups(edges, ids)


def near_copies(seed, n=220):
    """Documents with a few words changed, in chains, in one large group, and with a passage that all share."""
    rng = random.Random(seed)
    shared, base = sentence(rng, 45), sentence(rng, 150).split()
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            w = list(base)  # the large group: each copy has words of its own, so that not all pairs are alike
            for k in rng.sample(range(len(w)), rng.randint(0, 3)):
                w[k] = f"x{i}y{k}"
        elif kind == 1 and rows:
            w = rng.choice(rows)[1].split()  # a chain
            if w:
                w[rng.randrange(len(w))] = f"z{i}"
        else:
            w = (sentence(rng, rng.randint(10, 60)) + " " + shared).split()
        rows.append((i + 100, " ".join(w), "en", "s", 1))
    rows += [(1000, None, "en", "s", 1), (1001, " ", "en", "s", 1), (1002, "one two", "en", "s", 1), (1003, "ONE two", "en", "s", 1), (5, rows[0][1], "en", "s", 1), (None, rows[0][1], "en", "s", 1), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    want = brute_similar(rows, 5, 0.8)
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar(clashing(spark, rows, "rep", "band", "h", "set", "a"), 5, 0.8).collect())
    assert got == Counter((r[0], want[r[0]]) for r in rows if r[0] is not None)
    assert len(set(want.values())) < len(want) - 50
    kept = simhash.dedup(frame(spark, rows), 5, similarity=0.8)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if r[0] is None or want[r[0]] == r[0])
    assert simhash.similar(frame(spark, [])).count() == 0


def test_similar_on_awkward_rows(spark):
    want = brute_similar(awkward(), 5, 0.8)
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar(frame(spark)).collect())
    assert got == Counter((r[0], want[r[0]]) for r in awkward() if r[0] is not None)


@pytest.mark.parametrize("n", [1, 6, 7, 503, 505, 1300])
def test_ones_are_counted(n):
    hashes = np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
    words = hashes[:, None] * simhash._mixers()[0]
    words = (words ^ words >> np.uint64(32)) * simhash._mixers()[1]
    words ^= words >> np.uint64(29)
    want = [(words >> np.uint64(b) & np.uint64(1)).sum(axis=0) for b in range(64)]
    assert (simhash.ones(hashes) == np.array(want).T).all()
    home, kept = simhash.corners(hashes)
    lead = 2 * np.array(want).T.astype(int) - n
    assert all(abs(lead[w, a & 63]) == abs(lead[w]).max() and (lead[w, a & 63] > 0) == (a >= 64) for w, a in enumerate(home.tolist()))
    assert kept.view(np.uint64).tolist() == [sum(1 << b for b in range(64) if lead[w, b] > 0) for w in range(simhash.KEPT)]


@pytest.mark.parametrize("common, one, other", [(4, 0, 1), (40, 5, 5), (40, 0, 10), (160, 20, 20)])
def test_near_copies_meet_by_fingerprints(common, one, other):
    """Sets of a similarity of 0.8 share an anchor and are near by their bits; others hardly ever do."""
    rng, missed, strangers, last = np.random.default_rng(common), 0, 0, None
    for _ in range(150):
        h = rng.integers(0, 1 << 64, common + one + other, dtype=np.uint64)
        (a, f), (b, g) = simhash.corners(h[: common + one]), simhash.corners(np.concatenate((h[:common], h[common + one :])))
        bits = np.bitwise_count((f ^ g).view(np.uint64))
        x, y = simhash.meetings(np.array([a, b]))
        missed += not (x == y).any() or bits[0] > simhash.most_bits(64, 0.8) or bits.sum() > simhash.most_bits(256, 0.8)
        strangers += last is not None and np.bitwise_count((f ^ last).view(np.uint64)).sum() <= simhash.most_bits(256, 0.8)
        last = f
    assert missed <= 1 and strangers == 0


def test_pairs_and_crowds_equal_brute_force():
    """Also over batches that end within a key, and with a key of very many."""
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    sizes = [1, 2, 3, 4, 9, 1, 30, simhash.MANY + 1, 2, 1, simhash.MANY, 700, 2, 3]
    rows, rep = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            rep += 1
            rows.append((k - 3, rng.randrange(40) if k == 6 else rep, *(rng.choice(seeds) ^ 1 << rng.randrange(64) if size < 40 else rng.getrandbits(64) for _ in range(2))))
    want, crowd = set(), set()
    for k in range(len(sizes)):
        here = [r for r in rows if r[0] == k - 3]
        near = [(a, b) for a in range(len(here)) for b in range(a) if here[a][1] != here[b][1] and sum((here[a][c] ^ here[b][c]).bit_count() for c in (2, 3)) <= 46]
        others = Counter(x for p in near for x in p)
        full = [p for p in near if max(others[x] for x in p) > simhash.FEW]
        crowd |= {r[1] for r in here if len(here) > simhash.MANY} | {here[x][1] for p in full for x in p}
        if len(here) <= simhash.MANY:
            want |= {tuple(sorted(here[x][1] for x in p)) for p in near if p not in full}
    columns = [np.array(c, np.uint64).view(np.int64) if i > 1 else np.array(c, np.int64) for i, c in enumerate(zip(*rows, strict=True))]
    for step in (1, 7, 100, len(rows)):
        batches = (pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in columns], ["key", "rep", "f0", "f1"]) for i in range(0, len(rows), step))
        got = [(r["x"], r["y"]) for b in simhash._pairs_and_crowds(46)(batches) for r in b.to_pylist()]
        assert {p for p in got if p[1] is not None} == want and {x for x, y in got if y is None} == crowd
    assert want and list(simhash._pairs_and_crowds(46)(iter([]))) == []


def test_a_crowd_of_unlike_texts_is_not_compared_in_all_pairs(spark, monkeypatch):
    """Members that are near by their bits, and alike to the first or to nobody: a few comparisons for each."""
    rng = random.Random(6)
    base = sentence(rng, 200).split()
    rows = [(0, " ".join(base), "en", "s", 1)]
    for i in range(1, 160):
        w = list(base)
        for k in rng.sample(range(len(w)), 3 if i % 4 == 0 else 14):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w), "en", "s", 1))
    compared, alike = [], simhash._alike

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return alike(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "_alike", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame(spark, rows), 5, 0.8).collect()}
    want = brute_similar(rows, 5, 0.8)
    assert got == want and 35 < len(rows) - len(set(want.values())) < 60
    assert sum(compared) < 6 * len(rows)


def test_the_pipeline_finds_near_copies_by_simhash(spark, monkeypatch):
    """Without a fingerprint that two share, nothing is a near copy; equal texts still are."""
    text = " ".join(f"word{i}" for i in range(120))
    rows = [(1, text, "en", "s", 1), (2, f"{text} more", "en", "s", 1), (3, text, "en", "s", 1)]
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert [r["doc_id"] for r in stage(spark, frame(spark, rows), "").collect()] == [1]
    monkeypatch.setattr(simhash, "most_bits", lambda bits, similarity: -1)
    assert sorted(r["doc_id"] for r in stage(spark, frame(spark, rows), "").collect()) == [1, 2]


# classifiers


def labelled(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = sentence(rng, 40) if good else " ".join(w + rng.choice(["###", "%%%"]) for w in sentence(rng, 40).split()) if rng.random() < 0.5 else " ".join([sentence(rng, 1)] * 40)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), None))
    return docs, labels


def test_quality_held_out_accuracy(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame([*labels, (5, None, 1), (6, 7, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(frame(spark, docs), lab)
    out = quality.score(clashing(spark, [*docs, *((i + 10_000, *r[1:]) for i, r in enumerate(awkward()))], "score"), model)
    assert out.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "score"]
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert len(got) == len(docs) + len(awkward()) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.3) == (y == 1) for s, y in held) / len(held) > 0.95
    # the same rows in other partitions give the same model
    again = quality.train(frame(spark, docs, parts=1), lab.repartition(5))
    assert np.array_equal(again.odds, model.odds) and again.constant == model.constant


def test_quality_never_learns_from_the_held_out(spark):
    docs, labels = labelled(120)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(frame(spark, docs), lab).odds, quality.train(frame(spark, docs), flipped).odds)


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(frame(spark), empty)
    assert {round(r["score"], 6) for r in quality.score(frame(spark), model).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in quality.score(frame(spark), quality.train(frame(spark), one)).collect())
    assert quality.score(frame(spark, []), model).count() == 0
    a, b = quality.fit(["a b", "c d"], [0, 1]).scorer()(["", None])
    assert a == b


def brute_bag(text, s):
    """Every bucket of a text with its number: words, their character n-grams, word 2-grams, one at a time."""
    m = (1 << 32) - 1
    out, tokens = Counter(), (text or "").encode().lower().split()
    hashes = [xxhash.xxh32_intdigest(w) for w in tokens]
    for w, h in zip(tokens, hashes, strict=True):
        out[h % s.buckets] += 1
        raw = b"<" + w + b">"
        for n in range(s.least, s.most + 1):
            for i in range(len(raw) - n + 1):
                g = 0
                for b in raw[i : i + n]:
                    g = (g * 0x01000193 + (b + 1) * 0x9E3779B1) & m
                out[((((g ^ g >> 15) * 0x85EBCA6B) & m) >> 7) % s.buckets] += 1
    for a, b in zip(hashes, hashes[1:], strict=False):
        h = ((a - b) * 0x9E3779B1) & m
        h = ((h ^ h >> 15) * 0x85EBCA6B) & m
        out[(h ^ h >> 13) % s.buckets] += 1
    return out


def test_quality_scores_are_the_forward_pass(spark, tmp_path):
    """The registered query against averaging, softmax and rule by rule, for every document."""
    docs, labels = labelled(150)
    rows = [*docs, *((r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward() if len(r[1] or "") < 9000)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.train(frame(spark, rows), lab)

    def forward(text):
        bag = brute_bag(text, model.settings)
        hidden = sum((n / bag.total() * model.vectors[k].astype(np.float64) for k, n in bag.items()), np.zeros(model.settings.dim))
        z = hidden @ model.out.astype(np.float64) + model.bias
        e = np.exp(z - z.max())
        return e[1] / e.sum()

    want = sorted((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 0, forward(t)) for i, t, *_ in rows)
    got = sorted((str(r["doc_id"]), r["held_out"], r["score"], r["predicted"]) for r in queries.op4_quality(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[3] == (g[2] >= 0.3) for g in got)
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-3)
    # every kind of feature is a learned one
    assert not np.array_equal(quality.train(frame(spark, rows), lab, quality.Settings(pairs=False)).odds, model.odds)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pred = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(pred[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.9
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert np.array_equal(langid.train(docs).weights, langid.train(other).weights)


def test_language_edges(spark):
    model = langid.train(frame(spark))
    assert model.langs == ["en", "fr"]
    out = langid.predict(clashing(spark, awkward(), "lang_pred", "score"), model).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in awkward())
    nothing = {i for i, t, *_ in awkward() if not (t and any(map(str.isalpha, t)))}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in nothing) for r in out if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.predict(frame(spark, []), model).count() == 0
    none = langid.train(frame(spark, [(1, "abc", None, None, None)]))
    assert {r["lang_pred"] for r in langid.predict(frame(spark), none).collect()} == {"und"}
    a, b = langid.presence(["abc", "abd"], model.settings)
    grams = lambda s: {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    assert a @ b == pytest.approx(len(grams("abc") & grams("abd")) / len(grams("abc")), rel=1e-5)


# top-k


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.integers(1, 12), st.integers(1, 40))
def test_threshold_algorithm(seed, dim, k, n):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, dim)).astype(np.float64)
    ids, q = rng.permutation(n), rng.integers(-3, 4, dim).astype(np.float64)
    at, scores = topk.search(q, int(ids[0]), x, ids, np.argsort(x, axis=0, kind="stable"), k, step=1)
    want = sorted(((-s, i) for s, i in zip((x @ q).tolist(), ids.tolist(), strict=True) if i != ids[0]))[:k]
    assert list(zip((-scores).tolist(), ids[at].tolist(), strict=True)) == want


def test_threshold_algorithm_stops_early():
    class Counting(np.ndarray):
        rows = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Counting.rows += len(key)
            return super().__getitem__(key)

    x = np.zeros((20_000, 2))
    x[:, 0] = np.arange(20_000)
    topk.search(np.array([1.0, 0.0]), -1, x.view(Counting), np.arange(20_000), np.argsort(x, axis=0, kind="stable"), 10)
    assert Counting.rows < 200


def test_top_k(spark):
    rng = random.Random(6)
    vectors = [(i, [float(np.float32(rng.choice([-1, -0.3, 0, 0.2, 1]) * rng.random())) for _ in range(6)]) for i in range(150)]
    vectors += [(200 + i, vectors[5][1]) for i in range(40)]  # ties
    vectors += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1.0, 2.0]), (400, [3.0, 1.0]), (305, []), (306, [0.0] * 6), (None, [1.0] * 6), (7, vectors[7][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    real = [(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), query_block=2, block=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for i, q in real:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in real if j != i and len(v) == len(q))[:10]
            if scored:
                want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert dict(got) == want
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_top_k_repeated_rows_as_in_sql(spark, tmp_path):
    rng = random.Random(9)
    vectors = [(i, [rng.random() for _ in range(4)]) for i in range(0, 205)]
    vectors += [vectors[1], vectors[1], vectors[150], vectors[100], (200, vectors[3][1]), (2, vectors[9][1])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = Counter(map(tuple, queries.op1_topk(spark, str(tmp_path)).collect()))
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    out = con.execute(queries.OP1_SQL)
    names = [d[0] for d in out.description]
    want = Counter(tuple(r[names.index(c)] for c in ("query_id", "rank", "vec_id", "score")) for r in out.fetchall())
    assert got == want and sum(got.values()) == 30
    small = spark.createDataFrame([(i, [1.0 + i]) for i in (0, 1, 1, 2)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in topk.top_k(small, small.where("vec_id = 0")).orderBy("rank").collect()] == [2, 1, 1]


def test_top_k_start_prunes_nothing_that_counts():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (300, 6)).astype(np.float64)
    order, ids = np.argsort(x, axis=0, kind="stable"), np.arange(300)
    for q in rng.integers(-9, 9, (40, 6)).astype(np.float64):
        scores = np.sort(x @ q)[::-1]
        at, found = topk.search(q, -1, x, ids, order, 5, step=2, start=float(scores[9]))
        assert found.tolist() == scores[:5].tolist()
        assert len(topk.search(q, -1, x, ids, order, 5, start=float(np.abs(q).sum() * 51))[0]) == 0
        exact = topk.search(q.astype(int).astype(object), -1, x.astype(int).astype(object), ids, order, 5, step=2)
        assert exact[1].tolist() == scores[:5].tolist()


def test_top_k_huge_components(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, -1e9]), (2, [1e9, 1e9]), (3, [3e38, 3e38])], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(2, 2**63 - 1), (3, 2**63 - 1), (1, 0)]


# quotation linking


def test_parse_quotes():
    own, passages = chat.parse("Hello.\n\nOn Monday Ann wrote:\n> I think so.\n>\n> Do you?\n> > The question\n>> was this\n> Yes\n\nAgreed.\n> Late")
    assert own == "Hello.\n\nAgreed."
    assert passages == [(1, "I think so.\n\nDo you?"), (2, "The question\nwas this"), (1, "Yes"), (1, "Late")]
    assert chat.parse("no quote\n\n") == ("no quote\n\n", []) and chat.parse(None) == ("", []) and chat.parse("a > b") == ("a > b", [])


def test_conversations(spark):
    messages = [
        (1, 0, "user", "What is  the answer?\n\nAnd why?"),
        (1, 1, "assistant", "> what is the ANSWER?\nIt is 42."),
        (1, 2, "user", "> > And why?\n> It is 42.\nThanks"),
        (1, 3, "user", "> nobody said this\nOdd"),
        (2, 0, None, "As seen elsewhere:\n> It is 42.\nSo it is."),
        (3, 0, "user", "Thanks"),
        (3, 1, "user", "> Thanks\nand again"),
        (4, 0, "system", None),
        (4, 1, "user", ""),
        (4, 1, "user", ""),
        (5, 0, "user", "> It is 42.\n"),
        (None, 0, "user", "lost"),
        (6, None, "user", "lost"),
    ]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").withColumn("units", F.lit("mine")).repartition(3)
    out = [r.asDict() for r in chat.conversations(df, least=5).collect()]
    assert Counter((r["conv_id"], r["turn"]) for r in out) == Counter((c, t) for c, t, *_ in messages if c is not None and t is not None)
    by = {(r["conv_id"], r["turn"]): r for r in out}
    reply = {k: (r["reply_conv_id"], r["reply_turn"]) for k, r in by.items()}
    assert reply[1, 1] == (1, 0) and reply[1, 2] == (1, 1) and reply[1, 3] == (None, None) and reply[2, 0] == (1, 1)
    assert reply[3, 1] == (3, 0) and reply[5, 0] == (1, 1) and reply[1, 0] == (None, None)
    assert by[1, 1]["text"] == "It is 42." and by[1, 2]["text"] == "Thanks" and by[5, 0]["text"] == ""
    assert [by[k]["n_quotes"] for k in ((1, 2), (1, 3), (4, 0))] == [2, 1, 0] and [by[k]["n_linked"] for k in ((1, 2), (1, 3))] == [2, 0]
    assert {k: r["thread_id"] for k, r in by.items()} == {k: 1 if k[0] in (1, 2, 5) else k[0] for k in by}
    assert by[2, 0]["formatted"] == "<|user|>\nSo it is.\n<|end|>\n" or by[2, 0]["formatted"].startswith("<|user|>\n")
    assert chat.conversations(df.limit(0)).count() == 0


def test_self_quotes_link_to_another_conversation(spark):
    messages = [(1, 0, "user", "> the same words\nthe same words"), (2, 0, "user", "the same words"), (3, 0, "user", "the same words")]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["reply_conv_id"], r["reply_level"]) for r in chat.conversations(df, least=5).collect()}
    assert got == {1: (2, 1), 2: (None, 0), 3: (None, 0)}
    # too short to tell for another conversation
    assert {r["reply_conv_id"] for r in chat.conversations(df).collect()} == {None}


def brute_links(messages, least):
    """What each message replies to and how many of its passages are linked, by plain loops."""
    owns = {}
    for c, t, _, text in messages:
        owns.setdefault((c, t), set()).add(chat.parse(text)[0])

    def has(own, passage):
        norm = chat.normalised
        kept = {norm(p) for p in [own, *own.split("\n"), *re.split(r"\n[ \t]*\n", own)]}
        if norm(passage) in kept or len(norm(passage).split()) >= chat.RUN and f" {norm(passage)} " in f" {norm(own)} ":
            return True
        paragraphs = [[x for x in p.split("\n") if any(map(str.isalnum, x))] for p in re.split(r"\n[ \t]*\n", passage)]
        paragraphs = [p for p in paragraphs if p]
        return bool(paragraphs) and all(norm(" ".join(p)) in kept or all(norm(x) in kept for x in p) for p in paragraphs)

    out = {}
    for c, t, _, text in messages:
        links = []
        for n, (level, passage) in enumerate(chat.parse(text)[1]):
            holders = sorted(k for k, texts in owns.items() if any(has(o, passage) for o in texts))
            inside = [k for k in holders if k[0] == c and k[1] < t]
            outside = [k for k in holders if k[0] != c] if len(chat.normalised(passage)) >= least else []
            if inside or outside:
                links.append((level, n, (inside or outside)[0]))
        out[c, t] = (*(min(links)[2] if links else (None, None)), len(links))
    return out


def quoting(seed, conversations=14):
    """Messages that quote others whole, trimmed, wrapped anew, in part of a sentence, nested, or not rightly."""
    rng = random.Random(seed)
    messages = []
    for c in range(conversations):
        for t in range(rng.randint(1, 5)):
            own = "\n\n".join("\n".join(sentence(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
            if rng.random() < 0.15:
                own = rng.choice(["ok", "Thanks", "yes please"])
            quote = []
            if messages and rng.random() < 0.75:
                source = chat.parse(rng.choice(messages)[3])[0]
                lines, words = source.split("\n"), source.split()
                kind = rng.choice(["whole", "lines", "part", "nested", "gap", "wrong", "wrapped"])
                if kind == "lines":
                    a = rng.randrange(len(lines))
                    lines = lines[a : a + rng.randint(1, 3)]
                elif kind == "part" and len(words) > 8:
                    a = rng.randrange(len(words) - 6)
                    lines = [" ".join(words[a : a + 6]).upper()]
                elif kind == "gap":
                    lines = [lines[0], "[...]", lines[-1]]
                elif kind == "wrong":
                    lines = [*lines, sentence(rng, 4)]
                elif kind == "wrapped":
                    lines = [" ".join(words[i : i + 5]) for i in range(0, len(words), 5)]
                quote = [("> > " if kind == "nested" else "> ") + x for x in lines]
            messages.append((c, t, "user", "\n".join(rng.choice([[*quote, "", own], [own, *quote]]))))
    return messages


@pytest.mark.parametrize("seed", [1, 2])
def test_registered_conversations_equal_brute_force(spark, tmp_path, seed):
    messages = quoting(seed) + [(90, 0, "user", "x " * 60_000 + "\n> " + "very " * 50_000)]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    clash = {n: F.lit("mine") for n in ("own", "passages", "hash", "node", "runs", "level", "component")}
    df.withColumns(clash).write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op7_quotation_linking(spark, str(tmp_path)).collect()
    got = {(r["conv_id"], r["turn"]): (r["reply_conv_id"], r["reply_turn"], r["n_linked"]) for r in out}
    want = brute_links(messages, 20)
    assert got == want and sum(v[2] for v in want.values()) > 10
    # originals come before replies, but for rings
    order = {(r["conv_id"], r["turn"]): (r["reply_level"], r["conv_id"], r["turn"]) for r in out}
    edges = {(k[0], v[0]) for k, v in want.items() if v[0] is not None and v[0] != k[0]}
    assert {k[0]: o[0] for k, o in order.items()} == levels({k[0] for k in order}, edges)


def levels(nodes, edges):
    of, out, level = groups(edges, nodes), {}, 0
    while len(out) < len(nodes):
        left = {n for n in nodes if n not in out}
        waits = {a for a, b in edges if a in left and b in left}
        now = left - waits
        for c in {of[n] for n in left}:
            here = {n for n in left if of[n] == c}
            if not here & now:
                now |= {min(here)}
        out |= dict.fromkeys(now, level)
        level += 1
    return out


def test_replies_come_after_what_they_answer(spark):
    words = [sentence(random.Random(i), 8) for i in range(8)]
    rows = [(1, 0, "user", f"> {words[2]}\n\n{words[1]}"), (2, 0, "user", words[2]), (3, 0, "user", f"> {words[1]}\n\n{words[3]}")]
    rows += [(5, 0, "user", f"> {words[6]}\n\n{words[5]}"), (6, 0, "user", f"> {words[5]}\n\n{words[6]}"), (7, 0, "user", f"> {words[6]}\n\n{words[7]}")]  # a ring, and one more
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    in_order = [r["conv_id"] for r in out.orderBy("thread_id", "reply_level", "conv_id", "turn").collect()]
    assert in_order == [2, 1, 3, 5, 6, 7]


def test_long_attribution_goes_with_its_quote():
    own, passages = chat.parse(f"Yes.\n\nOn {'a very long day ' * 40}Ann wrote:\n> so")
    assert own == "Yes." and passages == [(1, "so")]


def test_language_learns_every_language(spark):
    rng = random.Random(12)
    docs = []
    for k in range(300):
        letters = [chr(0x4E00 + 20 * k + i) for i in range(12)]
        docs += [(1000 * k + i, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(6)), f"l{k:03}", "s", 1) for i in range(14)]
    model = langid.train(frame(spark, docs), langid.Settings(rows=3000))
    assert len(model.langs) == 300
    names, _ = model.predict([t for _, t, *_ in docs])
    assert sum(a == r[2] for a, r in zip(names, docs, strict=True)) / len(docs) > 0.95


def test_language_scores_are_kernel_rows_times_weights(spark):
    """Prediction against the plain kernel: presence sets, Nyström features and ridge regression by loops and solves."""
    rows = [r for r in awkward() if r[1] and any(map(str.isalpha, r[1]))]
    texts, langs = [r[1] for r in rows], ["en" if i % 3 else "fr" for i in range(len(rows))]
    s = langid.Settings(landmarks=10, per_lang_landmarks=1)
    model = langid.fit(texts, langs, s)
    sets = [set(langid.grams(t, s).tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    names = ["en", "fr"]
    seen, order = Counter(), []
    for i, g in enumerate(langs):
        order.append((seen[g], names.index(g), i))
        seen[g] += 1
    marks = [sets[i] for *_, i in sorted(order)[:10]]
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    keep = values > 1e-6 * values[-1]
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([[kernel(a, b) for b in marks] for a in sets]) @ half
    y = np.array([[1.0 if g == n else -1.0 for n in names] for g in langs])
    each = np.array([len(langs) / (2 * seen[g]) for g in langs])[:, None]
    weights = np.linalg.solve(phi.T @ (each * phi) + s.ridge * np.eye(phi.shape[1]), phi.T @ (each * y))
    want = phi @ weights
    got_names, got = model.predict(texts)
    assert got_names == [names[k] for k in want.argmax(axis=1)]
    assert np.allclose(got, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-3)


# registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, queries.queries()[name], queries.oracle_sql()[name])


def brute_pipeline(spark, rows, labels, items):
    """All stages but the classifier's fit, which is deterministic and tested on its own, by plain loops."""
    model = quality.train(spark.createDataFrame(rows, SCHEMA), labels)
    scores = model.scorer()([r[1] for r in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= corpus_pipeline.QUALITY]
    kept = []
    for r in rows:
        text = next(t for (i, _, _, t), _ in brute_lines_of(rows, r).items())
        kept.append((r[0], text, r[2], r[3], len(text)))
    of = brute_similar(kept, 5, 0.8)
    kept = [r for r in kept if r[0] is None or of[r[0]] == r[0]]
    clean = [r for r in kept if not any(x[5] for x in brute_hits([r], items, 10))]
    return Counter((r[0], r[2], r[3], r[4], tuple(ENCODING.encode_ordinary(r[1]))) for r in clean)


def brute_lines_of(rows, row):
    """brute_lines() of one row among all."""
    first = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            bare = x.strip(" \t\n\x0b\x0c\r")
            if i is not None and len(bare) >= 10:
                first[bare.encode().lower()].add(i)
    gone = {k: min(v) for k, v in first.items() if len(v) > 1}
    every = (row[1] or "").split("\n")
    stay = every if row[0] is None else [x for x in every if gone.get(x.strip(" \t\n\x0b\x0c\r").encode().lower(), row[0]) >= row[0]]
    return Counter({(row[0], len(every), len(every) - len(stay), "\n".join(stay)): 1})


def test_brute_lines_agree():
    rows = awkward()
    assert sum((brute_lines_of(rows, r) for r in rows), Counter()) == brute_lines(rows)


def _pipeline(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "lang", "source", "n_chars", "n_tokens", "ids"} <= set(out.columns)
    return Counter((r["doc_id"], r["lang"], r["source"], r["n_chars"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in out.collect())


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = labelled(60)
    rows = [*docs, *((r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward())]
    items = [(1, " ".join(docs[3][1].split()[4:18])), (2, "one two three four five six seven eight nine ten"), (3, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert _pipeline(spark, str(tmp_path)) == brute_pipeline(spark, rows, lab, items)


def test_pipeline_on_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert _pipeline(spark, DATA) == brute_pipeline(spark, rows, labels, items)


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, tmp_path, k):
    """Empty tables, and columns with the names of an operator's own."""
    docs, labels = labelled(40)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
    odd = clashing(spark, docs, "score", "kept", "n_lines", "fp", "version", "component_id")
    out = stage(spark, odd, str(tmp_path))
    assert out.where("score = 'mine' and kept = 'mine' and fp = 'mine' and version = 'mine'").count() == out.count() > 0
    if k < 4:
        assert out.columns == odd.columns


def test_trimmed_quotes_are_linked(spark):
    original = "First words here.\n\nSecond part, line one\nline two of it\nline three of it\n\nThe last words."
    quotes = [
        "> First words here.\n>\n> Second part, line one\n> line two of it\n> line three of it\n\nyes",  # two paragraphs of three
        "> line two of it\n> line three of it\n\nyes",  # two lines of three
        "> First words here.\n> [...]\n> line three of it\n\nyes",  # two parts in one block
        "> First words here.\n>\n> Second part, line one line two of it\n> line three of it\n\nyes",  # and wrapped anew
        "> First words here.\n> words that nobody wrote\n\nno",
    ]
    rows = [(1, 0, "user", original), (1, 1, "user", "line two of it"), *((1, 2 + i, "user", q) for i, q in enumerate(quotes)), (2, 0, "user", quotes[1])]
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): (r["reply_conv_id"], r["reply_turn"], r["n_linked"]) for r in out.collect()}
    assert [got[1, 2 + i] for i in range(5)] == [(1, 0, 1)] * 4 + [(None, None, 0)]
    assert got[2, 0] == (1, 0, 1)
