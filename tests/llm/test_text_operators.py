"""BPE, line dedup, substring dedup, decontamination and packing against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, lines, packing, substrings
from quillon.llm.queries import PATTERN, VOCABULARY, tokenizer

from .fixtures import awkward, clashing, frame, sentence

ENCODING = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(VOCABULARY, PATTERN)


# byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab \n'st1é漢🙂", max_size=80))
def test_bpe_equals_tiktoken(text):
    codec = bpe.Codec.of(VOCABULARY, PATTERN)
    ids = codec.encode(text)
    assert ids.tolist() == ENCODING.encode_ordinary(text)
    assert codec.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 70_000 + "zq" * 9_000, " " * 70_001 + "x", "漢字" * 50_000, "=-" * 40_000, "the" * 60_000])
def test_bpe_long_pieces(text):
    small = bpe.Codec(bpe.read_ranks(VOCABULARY), PATTERN, most_pieces=10)
    small.transducer.max_states = 50  # tables are forgotten in the midst of a piece
    assert small.encode(text).tolist() == ENCODING.encode_ordinary(text)


def test_bpe_other_vocabulary():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = bpe.Codec(ranks, PATTERN)
    other = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in (t for _, t, *_ in awkward() if t):
        assert own.encode(text).tolist() == other.encode_ordinary(text)
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Transducer({b"a": 0})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.lists(st.integers(1, 5), min_size=1))
def test_utf8_stream(text, cuts):
    data, stream, out, at, n = text.encode(), bpe.Utf8Stream(), [], 0, 0
    while at < len(data):
        step = cuts[n % len(cuts)]
        out.append(stream.feed(data[at : at + step]))
        at, n = at + step, n + 1
    assert "".join([*out, stream.finish()]) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 4))
def test_utf8_stream_broken_bytes(data, step):
    stream = bpe.Utf8Stream("replace")
    out = "".join([*(stream.feed(data[i : i + step]) for i in range(0, len(data), step)), stream.finish()])
    assert out == data.decode("utf-8", "replace")


def test_bpe_frames(spark):
    rows = awkward()
    got = Counter(map(tuple, bpe.round_trip(frame(spark).select("doc_id", "text"), VOCABULARY, PATTERN).collect()))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(ENCODING.encode_ordinary(t or ""), dtype="<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = bpe.decode(bpe.encode(frame(spark), VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t, *_ in rows)
    odd = bpe.round_trip(clashing(spark, rows, "ids", "n_tokens"), VOCABULARY, PATTERN, with_ids=True)
    assert odd.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert odd.where("n_tokens <> length(ids) / 4").count() == 0
    assert bpe.round_trip(frame(spark, []), VOCABULARY, PATTERN).count() == 0


# line dedup


def brute_lines(rows, least=10):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    for i, t, *_ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(x.strip(" \t\n\x0b\x0c\r")) >= least:
                    holders[key(x)].add(i)
    gone = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = Counter()
    for i, t, *_ in rows:
        every = (t or "").split("\n")
        stay = every if i is None else [x for x in every if gone.get(key(x), i) >= i]
        out[i, len(every), len(every) - len(stay), "\n".join(stay)] += 1
    return out


@pytest.mark.parametrize("settings", [lines.Settings(), lines.Settings(bits=1, probes=1, range_lines=7), lines.Settings(remembered=2)])
def test_line_dedup(spark, settings):
    """With few bits many are suspected, with a short memory hot keys go to their range more often: the result stays."""
    out = lines.dedup(frame(spark), settings).select("doc_id", "n_lines", "n_dropped", "kept")
    assert Counter(map(tuple, out.collect())) == brute_lines(awkward())


def test_line_dedup_hot_line(spark):
    """Of a line that all documents hold, two rows a reading task at most go to its range."""
    docs = [(i, f"a line that everybody has\n{i} is a line of its own", "en", "s", 1) for i in range(2000)]
    out = lines.dedup(frame(spark, docs, parts=3)).select("doc_id", "n_lines", "n_dropped", "kept")
    assert Counter(map(tuple, out.collect())) == brute_lines(docs)


def test_line_dedup_edges(spark):
    odd = lines.dedup(clashing(spark, awkward(), "kept", "lines", "version", "rest", "key"))
    assert odd.columns == ["doc_id", "text", "lang", "source", "n_chars", "lines", "version", "rest", "key", "n_lines", "n_dropped", "kept"]
    assert Counter(map(tuple, odd.select("doc_id", "n_lines", "n_dropped", "kept").collect())) == brute_lines(awkward())
    assert odd.where("rest = 'mine'").count() == len(awkward())
    assert lines.dedup(frame(spark, [])).count() == 0
    assert [tuple(r) for r in lines.dedup(frame(spark, [(1, None, None, None, None)])).select("n_lines", "n_dropped", "kept").collect()] == [(1, 0, "")]


def test_twice_filter_has_no_false_negatives():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    stream = rng.permutation(np.concatenate((hashes, hashes[:800], hashes[:50])))
    for lines_, least in ((3000, 2100), (10, 0)):
        filters, first, suspects = lines.TwiceSeen(lines_, lines.Settings()), [], []
        for i in range(0, len(stream), 500):
            part = stream[i : i + 500]
            known = filters.see(part, np.zeros(len(part), dtype=bool))
            suspects += part[known].tolist()
            first += part[~known].tolist()
        suspects += np.array(first, np.uint64)[filters.repeated(np.array(first, np.uint64))].tolist()
        found, every = Counter(suspects), Counter(stream.tolist())
        assert all(found[h] == n for h, n in every.items() if n > 1)
        assert sum(h not in found for h in every) >= least  # a filter of the right size lets most others through


# substring dedup


def brute_substrings(rows, window):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = Counter()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        over = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                over[k : k + window] = [True] * window
        left = [x for x, o in zip(w, over, strict=True) if not o]
        out[i, len(w), len(w) - len(left), b" ".join(left).decode()] += 1
    return out


@pytest.mark.parametrize("window", [2, 3, 10, 50, 70])
def test_substring_dedup(spark, window):
    out = substrings.dedup(frame(spark), window)
    assert Counter(map(tuple, out.collect())) == brute_substrings(awkward(), window)


def test_substring_edges(spark):
    assert substrings.levels(50) == [25, 50] and substrings.levels(200) == [25, 50, 100, 200] and substrings.levels(3) == [1, 3]
    assert substrings.dedup(frame(spark, [])).count() == 0
    odd = substrings.dedup(clashing(spark, awkward(), "h", "hashes", "whole", "some"), 50)
    assert Counter(map(tuple, odd.collect())) == brute_substrings(awkward(), 50)
    with pytest.raises(ValueError):
        substrings.dedup(frame(spark, []), 1)


# decontamination

ITEMS = [(1, "Copyright line of many"), (2, None), (3, ""), (10, "!!!"), (4, "x " * 12), (5, "one two"), (6, "ONE-Two"), (None, "for for for"), (20, "Straße äöü"), (7, "漢字")]


def _words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute_hits(rows, items, window):
    wins = defaultdict(set)
    for item, t in items:
        w = _words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k : k + window])].add(item)
    out = Counter()
    for i, t, *_ in rows:
        w = _words(t)
        over, found = [False] * len(w), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    over[k : k + n] = [True] * n
                    found |= wins[x]
        names = sorted(str(x) for x in found if x is not None)
        out[i, len(w), sum(over), len(found), ",".join(names), any(over)] += 1
    return out


def brute_near(text, items, window, slop):
    """Items without a window in the text, but with one whose words stand close together."""
    w, wins = _words(text), defaultdict(set)
    for item, t in items:
        x = _words(t)
        for k in range(max(1, len(x) - window + 1) if x else 0):
            wins[tuple(x[k : k + window])].add(item)
    near, hit = set(), set()
    for x, holders in wins.items():
        if any(tuple(w[k : k + len(x)]) == x for k in range(len(w) - len(x) + 1)):
            hit |= holders
        elif any(set(x) <= set(w[k : k + len(x) + slop]) for k in range(max(1, len(w) - len(x) - slop + 1))):
            near |= holders
    return len(near - hit)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("terms", F.lit("mine"))


@pytest.mark.parametrize(("window", "block"), [(10, 200_000), (3, 200_000), (3, 2)])
def test_decontamination(spark, window, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    items = [*ITEMS, (30, " ".join((awkward()[0][1] or "a b c d").split()[:14]))]
    long = max((t for _, t, *_ in awkward() if t), key=lambda t: len(t.split()))
    items.append((31, " ".join(long.split()[5:30]).upper()))
    out = decontaminate.report(clashing(spark, awkward(), "words", "term", "version", "d", "v"), _items(spark, items), window)
    got = Counter(map(tuple, out.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()))
    assert got == brute_hits(awkward(), items, window)


def test_decontamination_clean_and_empty(spark):
    clean = decontaminate.clean(clashing(spark, awkward(), "version", "terms"), _items(spark, ITEMS), 10)
    want = Counter({r: n for r, n in Counter(awkward()).items() if not any(x[5] for x in brute_hits([r], ITEMS, 10))})
    assert Counter(tuple(r)[:5] for r in clean.collect()) == want
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars", "version", "terms"]
    assert decontaminate.report(frame(spark, []), _items(spark, ITEMS)).count() == 0
    none = decontaminate.report(frame(spark), _items(spark, [(1, None)]))
    assert none.count() == len(awkward()) and none.where("contaminated or n_hit > 0 or items <> ''").count() == 0


def test_proximity_matches(spark):
    docs = decontaminate.prepared(spark.createDataFrame([(1, "the quick brown fox"), (2, "the brown and very quick fox"), (3, "quick the fox"), (4, "brown " + "filler " * 30 + "quick fox")], "doc_id long, text string"))
    wins, _ = decontaminate.windows(_items(spark, [(1, "quick brown fox")]), 3)
    got = {(r["doc_id"], r["kind"]) for r in decontaminate.matches(docs, wins, 3, slop=4).collect()}
    assert got == {(1, "phrase"), (2, "proximity")}
    assert {(r["doc_id"], r["start"]) for r in decontaminate.matches(docs, wins, 3).collect()} == {(1, 1)}


@pytest.mark.parametrize("block", [200_000, 3])
def test_near_items_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(14)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))) for i in range(12)] + [(None, "w1 w2 w3 w4"), (3, "w9 w8 w7 w6 w5")]
    out = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), _items(spark, items), 5, 3)
    got = {r["doc_id"]: r["n_near"] for r in out.collect()}
    want = {i: brute_near(t, items, 5, 3) for i, t in docs}
    assert got == want and sum(want.values()) > 30


def test_decontamination_plan_has_no_python(spark):
    plan = decontaminate.report(frame(spark), _items(spark, ITEMS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing(lengths):
    rows = packing.best_fit_decreasing(lengths, 20)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= 20 for r in rows)
    # the same by looking at all rows for the fullest that fits; only the number of rows and their fill must agree
    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in left if x >= n]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - n)
        else:
            left.append(20 - n)
    assert sorted(20 - sum(lengths[i] for i in r) for r in rows) == sorted(left)


@pytest.mark.parametrize("buffer_tokens", [2_000_000, 1000])
def test_packing_is_lossless(spark, buffer_tokens):
    length, pad = 128, 50256
    packed = packing.pack(clashing(spark, awkward(), "row", "shard"), tokenizer(VOCABULARY, PATTERN), length, pad, 50_257, buffer_tokens)
    rows = packed.collect()
    parts = defaultdict(list)
    for r, ids in zip(rows, packing.matrix(rows, length), strict=True):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= length and len(cu) == len(r["doc_ids"]) + 1 == len(r["doc_parts"]) + 1
        assert (ids[cu[-1] :] == pad).all()
        assert r["position_resets"] == (cu if cu[-1] < length else cu[:-1])
        for d, p, a, b in zip(r["doc_ids"], r["doc_parts"], cu, cu[1:], strict=False):
            parts[d].append((p, tuple(ids[a:b].tolist())))
    want = Counter()
    for i, t, *_ in awkward():
        ids = ENCODING.encode_ordinary(t or "")
        for p, a in enumerate(range(0, len(ids), length)):
            want[i, p, tuple(ids[a : a + length])] += 1
    assert Counter((d, *x) for d, xs in parts.items() for x in xs) == want
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows)
    assert packing.pack(frame(spark, []), tokenizer(VOCABULARY, PATTERN)).count() == 0


def test_packing_write(spark, tmp_path):
    packed = packing.pack(frame(spark), tokenizer(VOCABULARY, PATTERN), 64, 0, 1 << 20)
    packing.write(packed, str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert packing.matrix(rows, 64, 1 << 20).shape == (len(rows), 64) and len(rows) == packed.count()
    with pytest.raises(ValueError):
        packing.pack(frame(spark), tokenizer(VOCABULARY, PATTERN), 0)


def test_a_copy_spares_another_text_of_its_doc_id(spark):
    rng = random.Random(5)
    copied, unique, shared = sentence(rng, 60), sentence(rng, 70), sentence(rng, 50)
    rows = [(1, copied), (1, ""), (2, copied), (2, unique), (3, None), (3, f"{unique} more"), (4, copied), (4, f"{shared} x"), (5, f"y {shared}")]
    out = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["kept"]) for r in out.collect())
    assert got == Counter([(1, copied), (1, ""), (2, ""), (2, unique), (3, ""), (3, "more"), (4, ""), (4, f"{shared} x"), (5, "y")])
