"""Chat formatting by quotation linking.

A message's quoted lines start with `>`, once for each level. Runs of one level are passages; passages, and the
paragraphs and lines of what messages say themselves, are normalised and hashed. A message has a passage if one of these
is the passage, if it has every paragraph of a trimmed one, as a whole or line by line, or if the passage stands in it
from word to word (looked up by the passage's rarest run of words). A passage is linked to the earliest earlier message
of its conversation that has it, or else, unless it is too short to tell, to the first message of any other. Messages
then lose their quotes, conversations that quote one another form a thread, and each message knows what it replies to
and how far down the thread its conversation stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices
from .components import components

_QUOTE = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
#: The line before a quote that says whose it is ("On Monday X wrote:").
_ATTRIBUTION = re.compile(r"^[^\n>]*\b(?:wrote|writes|said|schrieb|a écrit|escribió) ?:\s*$", re.IGNORECASE)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """What the message says itself, and its passages as (level from 1, text), in order.

    A quote leaves one empty line behind, none at the ends, and empty lines in a row become one; a message without
    quotes stays as it is.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level_before = 0
    for line in (text or "").split("\n"):
        marks = _QUOTE.match(line)
        level = marks[1].count(">") if marks else 0
        if level == 0:
            if line.strip() or level_before == 0 and (not passages or own[-1:] != [""]):
                own.append(line)
        else:
            rest = line[marks.end() :]
            if level_before == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ATTRIBUTION.match(own[-1]):
                    own.pop()
                    while own and not own[-1].strip():
                        own.pop()
                own.append("")  # one empty line where the quote stood
            if level != level_before:
                passages.append((level, []))
            passages[-1][1].append(rest)
        level_before = level
    kept = "\n".join(own).strip("\n") if passages else (text or "")
    return kept, [(n, "\n".join(p)) for n, p in passages if normalised("\n".join(p))]


def _hash(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text)


def units(own: str) -> set[str]:
    """Hashes of the whole, of each paragraph and of each line."""
    parts = [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]
    return {_hash(n) for p in parts if (n := normalised(p))}


def parts(passage: str) -> list[dict]:
    """The hash of each paragraph of a passage and those of its lines; lines of marks only ("[...]") say nothing.

    Empty for a single line, which is its own only part.
    """
    out = []
    for paragraph in re.split(r"\n[ \t]*\n", passage):
        lines = [n for x in paragraph.split("\n") if any(map(str.isalnum, n := normalised(x)))]
        if lines:
            out.append({"whole": _hash(" ".join(lines)), "lines": [_hash(n) for n in lines]})
    return out if len(out) > 1 or out and (len(out[0]["lines"]) > 1 or out[0]["whole"] != _hash(normalised(passage))) else []


RUN = 4  # words of a run that passages inside a line are looked up by


def runs(text: str) -> list[int]:
    """Hashes of the distinct runs of words of a normalised text, as signed longs."""
    words = text.split()
    found = {xxhash.xxh3_64_intdigest(" ".join(words[i : i + RUN])) for i in range(len(words) - RUN + 1)}
    return sorted(h - (1 << 64) if h >> 63 else h for h in found)


_PASSAGES = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("key", pa.string()), ("parts", pa.list_(pa.struct([("whole", pa.string()), ("lines", pa.list_(pa.string()))]))), ("short", pa.bool_()), ("norm", pa.string()), ("runs", pa.list_(pa.int64()))]))
_PASSAGES_SQL = "array<struct<level:int,hash:string,key:string,parts:array<struct<whole:string,lines:array<string>>>,short:boolean,norm:string,runs:array<long>>>"


def parsed(messages: DataFrame, least: int) -> DataFrame:
    """conv_id, turn, role, own, passages, units, runs of every row with a conv_id and a turn."""

    def passage(level: int, text: str) -> dict:
        norm, split = normalised(text), parts(text)
        h, r = _hash(norm), runs(norm)
        return {"level": level, "hash": h, "key": _hash(repr((h, split))), "parts": split, "short": len(norm) < least, "norm": norm if r else None, "runs": r}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owns, quotes, hashes, longs = [], [], [], []
            for text in batch.column(3).to_pylist():
                own, found = parse(text)
                owns.append(own)
                quotes.append([passage(*p) for p in found])
                hashes.append(sorted(units(own)))
                longs.append(runs(normalised(own)))
            made = [pa.array(owns, pa.string()), pa.array(quotes, _PASSAGES), pa.array(hashes, pa.list_(pa.string())), pa.array(longs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["conv_id", "turn", "role", "own", "passages", "units", "runs"])

    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"conv_id long, turn long, role string, own string, passages {_PASSAGES_SQL}, units array<string>, runs array<long>")


def _contain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, hash: messages whose words hold those of a passage of RUN words or more, one after the other.

    Only messages with the passage's rarest run are looked at.
    """
    asked = checkpointed(rows.select(F.explode("passages").alias("p")).where("p.norm IS NOT NULL").select("p.hash", "p.norm", "p.runs").dropDuplicates(["hash"]))
    wanted = asked.select("hash", F.explode("runs").alias("run"))
    held = rows.select("conv_id", "turn", F.explode("runs").alias("run")).join(wanted.select("run").distinct(), "run", "left_semi")
    counts = checkpointed(held.groupBy("run").agg(F.count("*").alias("n")))
    rarest = checkpointed(wanted.join(counts, "run").groupBy("hash").agg(F.min(F.struct("n", "run")).alias("r")).select("hash", "r.run"))
    tried = held.join(rarest, "run").join(asked.select("hash", "norm"), "hash").join(rows.select("conv_id", "turn", "own").distinct(), ["conv_id", "turn"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own"):
            own, norm = (batch.column(i).to_pylist() for i in (3, 4))
            fits = [f" {n} " in f" {normalised(o)} " for o, n in zip(own, norm, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["conv_id", "turn", "hash"]).filter(pa.array(fits, pa.bool_()))

    return tried.select("conv_id", "turn", "hash", "own", "norm").mapInArrow(check, "conv_id long, turn long, hash string")


def reply_levels(edges: DataFrame, threads: DataFrame) -> DataFrame:
    """node, level: 0 for conversations that quote no other, else more than the level of each that they quote.

    edges: a quotes b; threads: node, component. Conversations that quote one another in a ring: the one with the
    smallest conv_id of those that wait in the thread is placed as if it quoted nobody, and so on. A round places a
    level, so there are as many rounds as the longest chain of conversations is long.
    """
    left = checkpointed(edges.where("a <> b").distinct())
    nodes = checkpointed(threads)
    placed = nodes.select("node", F.lit(0).alias("level")).limit(0)
    level = 0
    while not nodes.isEmpty():
        waits = left.select(F.col("a").alias("node")).distinct().withColumn("waits", F.lit(True))
        now = nodes.join(waits, "node", "left").select("node", "component", F.coalesce("waits", F.lit(False)).alias("waits"))
        ring = now.groupBy("component").agg(F.min("waits").alias("stuck"), F.min("node").alias("least"))
        now = checkpointed(now.join(ring, "component").select("node", "component", (~F.col("waits") | F.col("stuck") & (F.col("node") == F.col("least"))).alias("free")))
        free = now.where("free").select("node")
        placed = checkpointed(placed.unionByName(free.withColumn("level", F.lit(level))))
        nodes = now.where("NOT free").select("node", "component")
        gone = free.withColumnRenamed("node", "gone")
        left = checkpointed(left.join(gone, left["a"] == gone["gone"], "left_anti").join(gone, left["b"] == gone["gone"], "left_anti"))
        level += 1
    return placed


def _has_parts(rows: DataFrame, held: DataFrame) -> DataFrame:
    """conv_id, turn, hash: messages that have every part of a passage that somebody asks for. held: the messages' units.

    Only the holders of a passage's rarest paragraph (as a whole, or of its rarest line) are looked at.
    """
    asked = checkpointed(rows.select(F.explode("passages").alias("p")).where(F.size("p.parts") > 0).select("p.key", "p.hash", "p.parts").dropDuplicates(["key"]))
    each = asked.select("key", F.posexplode("parts").alias("j", "p")).select("key", "j", "p.whole", F.explode("p.lines").alias("line"))
    names = each.select(F.explode(F.array("whole", "line")).alias("hash")).distinct()
    counts = checkpointed(held.join(names, "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("holders")))
    of = lambda c: counts.select(F.col("hash").alias(c), F.col("holders").alias(f"n_{c}"))
    n = F.coalesce("n_line", F.lit(0))
    rare = each.join(of("line"), "line", "left").groupBy("key", "j", "whole").agg(F.min(F.struct(n.alias("n"), "line")).alias("rare"))
    cost = F.col("rare.n") + F.coalesce("n_whole", F.lit(0))
    best = rare.join(of("whole"), "whole", "left").groupBy("key").agg(F.min(F.struct(cost, "j", "whole", "rare.line")).alias("best"))
    tried = best.select("key", F.explode(F.array_distinct(F.array("best.whole", "best.line"))).alias("hash"))
    found = held.join(checkpointed(tried), "hash").select("conv_id", "turn", "key").distinct()
    whole = F.forall("parts", lambda p: F.array_contains("units", p["whole"]) | F.forall(p["lines"], lambda x: F.array_contains("units", x)))
    return found.join(asked, "key").join(rows.select("conv_id", "turn", "units"), ["conv_id", "turn"]).where(whole).select("conv_id", "turn", "hash")


def conversations(messages: DataFrame, least: int = 20) -> DataFrame:
    """conv_id, turn, role, text, formatted, thread_id, reply_level, reply_conv_id, reply_turn, n_quotes, n_linked.

    text is the message without its quotes; formatted wraps it for training. A thread_id's rows in the order of
    reply_level, conv_id and turn have every message after what it answers (but in rings, see reply_levels()). reply_*
    name the message that its first outermost passage links to, null if none does: a message without quotes follows the
    one before it. Passages of fewer than `least` characters are linked inside their conversation only: "ok" and
    "thanks" stand in very many. Rows without conv_id or turn are left out, since nothing can name or order them; a null
    role is `user`; a null text is empty, a text of any length is parsed whole. Rows that repeat each give a row and
    link alike; of messages that hold a passage alike the first by conv_id and turn is taken; an empty table gives an
    empty one; further columns, of whatever names, are ignored.
    """
    rows = checkpointed(parsed(messages, least))
    held = rows.select("conv_id", "turn", F.explode("units").alias("hash"))
    asked = rows.where(F.size("passages") > 0).select("conv_id", "turn", F.posexplode("passages").alias("n", "p")).select("conv_id", "turn", "n", "p.level", "p.hash", "p.short").distinct()
    wanted = checkpointed(asked)
    # only units that some passage asks for are grouped; the earliest holder is the original
    held = held.join(wanted.select("hash").distinct(), "hash", "left_semi").select("conv_id", "turn", "hash").unionByName(_has_parts(rows, held)).unionByName(_contain(rows))
    here = checkpointed(held.groupBy("conv_id", "hash").agg(F.min("turn").alias("turn_here")))
    holder = F.min(F.struct("conv_id", F.col("turn_here").alias("turn")))
    first = here.groupBy("hash").agg(holder.alias("first"))
    # for passages whose first holder is their own conversation, the first of the others
    second = here.join(first, "hash").where("conv_id <> first.conv_id").groupBy("hash").agg(holder.alias("second"))
    anywhere = checkpointed(first.join(second, "hash", "left"))
    inside = F.col("turn_here") < F.col("turn")
    outside = F.when(F.col("short"), F.lit(None)).when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    linked = (
        wanted.join(here, ["conv_id", "hash"], "left")
        .join(anywhere, "hash", "left")
        .select(
            "conv_id",
            "turn",
            "n",
            "level",
            F.when(inside, F.col("conv_id")).otherwise(outside["conv_id"]).alias("to_conv"),
            F.when(inside, F.col("turn_here")).otherwise(outside["turn"]).alias("to_turn"),
        )
    )
    found = F.col("to_conv").isNotNull()
    order = F.struct("level", "n", F.struct("to_conv", "to_turn").alias("to"))
    by_message = checkpointed(linked.groupBy("conv_id", "turn").agg(F.count(F.when(found, 1)).alias("n_linked"), F.min(F.when(found, order)).alias("reply")))
    edges = by_message.where("reply IS NOT NULL").select(F.col("conv_id").alias("a"), F.col("reply.to.to_conv").alias("b")).distinct()
    threads = checkpointed(components(edges))
    levels = checkpointed(threads.join(reply_levels(edges, threads), "node"))
    role = F.coalesce("role", F.lit("user"))
    return (
        rows.join(by_message, ["conv_id", "turn"], "left")
        .join(levels, rows["conv_id"] == levels["node"], "left")
        .select(
            "conv_id",
            "turn",
            role.alias("role"),
            F.col("own").alias("text"),
            F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>\n")).alias("formatted"),
            F.coalesce("component", "conv_id").alias("thread_id"),
            F.coalesce("level", F.lit(0)).alias("reply_level"),
            F.col("reply.to.to_conv").alias("reply_conv_id"),
            F.col("reply.to.to_turn").alias("reply_turn"),
            F.size("passages").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        )
    )
