"""Awkward rows that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    base = sentence(rng, 120)
    near = base.split()
    near[50] = "changed"
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "One  two",
        "a b c",
        shared + "\n" + sentence(rng, 30),
        sentence(rng, 20) + "\n" + shared + "\n" + sentence(rng, 5),
        base,
        base,
        base.upper(),
        " ".join(near),
        "x " * 4000 + "end",
        "For For For\n" * 300,
        "Straße ÄÖÜ 漢字 🙂 é  nbsp\x0bvt\x0cff\r\n crlf line one two three",
        "漢" * 3000,
        "a" * 30000,
        sentence(rng, 9000),
    ]
    texts += [sentence(rng, rng.randint(1, 80)) + rng.choice(["", "\n" + shared[:90], "\nCopyright line of many"]) for _ in range(30)]
    out = [(i, t, rng.choice(["en", "fr", None]), "src", 7) for i, t in enumerate(texts)]
    out += [out[8], out[8], (None, base, "en", None, None), (None, None, None, None, None), (10_000_000_000, "one", None, None, 1)]
    rng.shuffle(out)
    return out


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(parts)


def clashing(spark, rows, *names):
    """The rows with further columns of these names."""
    from pyspark.sql import functions as F

    return frame(spark, rows).withColumns({n: F.lit("mine") for n in names})
