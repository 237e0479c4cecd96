"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Each window of a benchmark item is looked up by its rarest term, by the number of times that terms occur in the whole
corpus. The index stores the postings of those terms: document, position and the slots around it. The lists of the
window's other terms, shifted by their offsets, are intersected with a posting in those slots: all there, at their
offsets, is an exact phrase; all there, within some further slots and in any order, is a proximity match.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, without, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, after lower-casing: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark terms or windows are broadcast up to so many rows and bytes; beyond that they meet the corpus by a shuffle.
BLOCK, BYTES = 200_000, 32 << 20
#: Further words among which a proximity match may be spread.
SLOP = 5


def words(text: Column) -> Column:
    """Array of words; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, version, n_words, words of each row: texts are cut into words once, and written down for all passes."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), words(F.col("text")).alias("words"))
    return written(cut.select("doc_id", "version", F.size("words").cast("long").alias("n_words"), "words"))


def windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """wid, terms, length of the distinct windows; wid, item_id of the items that hold them. Both are written down."""
    own = items.select("item_id", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))
    each = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("terms"))
    distinct = checkpointed(each.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()))
    held = checkpointed(each.join(distinct, "terms").select("wid", "item_id").distinct())
    return distinct.select("wid", "terms", F.size("terms").alias("length")), held


def _small(df: DataFrame, size: Column) -> bool:
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= BLOCK and size <= BYTES


def _beside(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if it is small; size: bytes of a row."""
    return F.broadcast(df) if _small(df, size) else df


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: how often each of the terms occurs in all documents; terms that do not occur have no row.

    docs: of prepared()."""
    every = docs.select(F.explode("words").alias("term"))
    if _small(terms, F.octet_length("term")):
        return every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    return every.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term")


def keyed(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """wins with term, its rarest, and offset, that term's first place in the window (from 0)."""
    placed = wins.select("wid", F.posexplode("terms").alias("offset", "term"))
    counts = document_counts(docs, checkpointed(placed.select("term").distinct()))
    rarest = placed.join(counts, "term", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "offset")).alias("r"))
    return checkpointed(wins.join(rarest, "wid").where("r.df > 0").select("wid", "terms", "length", "r.term", "r.offset"))


def index(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The stored postings of terms: term, doc_id, version, pos (from 0), slots and at, the place of the term in slots.

    slots has the words from `reach` before to `reach` after the posting, as far as the document goes. docs: of
    prepared().
    """
    each = docs.select("doc_id", "version", "words", F.posexplode("words").alias("pos", "term"))
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    if _small(terms, F.octet_length("term")):
        found = each.join(F.broadcast(terms), "term").select("term", "doc_id", "version", "pos", F.slice("words", first + 1, F.lit(2 * reach + 1)).alias("slots"), (F.col("pos") - first).alias("at"))
    else:  # the words around a posting are cut out before it travels
        found = each.select("term", "doc_id", "version", "pos", F.slice("words", first + 1, F.lit(2 * reach + 1)).alias("slots"), (F.col("pos") - first).alias("at")).join(terms, "term")
    return checkpointed(found)


def matches(docs: DataFrame, wins: DataFrame, window: int, slop: int | None = None) -> DataFrame:
    """doc_id, version, wid, start, length, kind: where windows occur. docs: of prepared().

    kind is phrase, or with a slop proximity: length + slop words in a row hold every term of the window, in any order,
    and the phrase is not there; start is then the place of the rarest term.
    """
    by = keyed(docs, wins)
    postings = index(docs, checkpointed(by.select("term").distinct()), window - 1 + (slop or 0))
    begin = F.col("at") - F.col("offset")
    phrase = (begin >= 0) & (F.slice("slots", F.greatest(begin, F.lit(0)) + 1, F.col("length")) == F.col("terms"))
    wanted = phrase
    if slop is not None:
        # a span of that many words holds the rarest term, so it lies within the slots of one of its postings
        span = F.col("length") + slop
        starts = F.sequence(F.lit(1), F.greatest(F.size("slots") - span + 1, F.lit(1)))
        near = F.exists(starts, lambda i: F.size(F.array_except("terms", F.slice("slots", i, span))) == 0)
        wanted = phrase | F.when(F.size(F.array_except("terms", "slots")) == 0, near).otherwise(False)
    start = F.when(phrase, F.col("pos") - F.col("offset")).otherwise(F.col("pos"))
    size = F.octet_length(F.array_join("terms", " ")) + 100
    on = (F.col("posting") == F.col("term")) & wanted
    return postings.withColumnRenamed("term", "posting").join(_beside(by, size), on).select("doc_id", "version", "wid", start.alias("start"), "length", F.when(phrase, "phrase").otherwise("proximity").alias("kind"))


def report(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as text, comma-joined), contaminated, version, n_near of each
    document.

    n_hit counts the words inside any occurrence of a window; an item of fewer words, but not none, is one window.
    n_near counts the items of which no window occurs, but the words of one stand close together: window + slop words in
    a row hold all of them, in any order. Null texts have no words and are not contaminated, as are all documents if
    there are no items; items without words are ignored, items that repeat a text are all named, an item whose item_id
    is null is counted but has no name. Rows that share doc_id and text have the same counts, each in its own row; a
    null doc_id is a value like any other; an empty table gives an empty one; further columns, of whatever names, are
    ignored; texts of any length are looked at whole.
    """
    rows = prepared(docs)
    wins, held = windows(items, window)
    hits = checkpointed(matches(rows, wins, window, slop).distinct())
    phrases = hits.where("kind = 'phrase'")
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.array_sort(F.collect_set(span)),
        zero,
        lambda t, s: F.struct(F.greatest(t["end"], s["b"]).alias("end"), (t["n"] + F.greatest(s["b"] - F.greatest(s["a"], t["end"]), F.lit(0))).alias("n")),
        lambda t: t["n"],
    )
    by_doc = phrases.groupBy("doc_id", "version").agg(covered.alias("n_hit"))
    # an item's windows in a document: whether one occurs, or one is close
    item = F.col("item_id").cast("string")
    named = hits.select("doc_id", "version", "wid", "kind").distinct().join(_beside(held, F.coalesce(F.octet_length(item), F.lit(0)) + 30), "wid")
    per_item = named.groupBy("doc_id", "version", item.alias("item")).agg(F.max(F.col("kind") == "phrase").alias("occurs"))
    names = F.collect_list(F.when(F.col("occurs"), F.col("item")))
    by_item = per_item.groupBy("doc_id", "version").agg(F.sort_array(names).alias("items"), F.count(F.when(F.col("occurs"), 1)).alias("n_items"), F.count(F.when(~F.col("occurs"), 1)).alias("n_near"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])
    found = by_item.join(by_doc, same(by_item, by_doc), "left").select(by_item["doc_id"].alias("d"), by_item["version"].alias("v"), "n_hit", "items", "n_items", "n_near")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = rows.select("doc_id", "version", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return out.select("doc_id", "version", "n_words", n_hit.alias("n_hit"), count("n_items"), F.coalesce(F.concat_ws(",", "items"), F.lit("")).alias("items"), (n_hit > 0).alias("contaminated"), count("n_near"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs (all columns) without a window of any item; nulls and empty tables as in report()."""
    wins, _ = windows(items, window)
    version = f"version_{uuid.uuid4().hex}"  # no column of docs has this name
    hits = matches(prepared(docs), wins, window).select("doc_id", F.col("version").alias(version))
    return without(docs.withColumn(version, F.xxhash64("text")), hits).drop(version)
