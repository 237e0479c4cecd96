"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, langid, lines, packing, quality, simhash, substrings, topk
from .common import documents, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text and decode the ids again: counts and digests of both."""
    return bpe.round_trip(documents(table(spark, sf_dir, "documents")), VOCABULARY, PATTERN)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole text and the group of near copies that it is in."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; learned from labelled rows outside the held-out fifth."""
    docs = documents(table(spark, sf_dir, "documents"))
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held_out(), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds; counts and a digest of what stays."""
    out = lines.dedup(documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words of 50-word windows that an earlier document holds; counts and a digest of what stays."""
    out = substrings.dedup(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, linked to what it quotes."""
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every whole text's language; learned from documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", _held_out(), "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that lie in a ten-word window of a benchmark item."""
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


def tokenizer(path: str, pattern: str):
    """A factory of text -> ids, for tasks to call."""

    def make():
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
        return lambda text: encoding.encode_to_numpy(text, disallowed_special=())

    return make


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's ids in rows of 2,048; 50,256 is free in the vocabulary and pads."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(VOCABULARY, PATTERN), length=2048, pad=50_256, vocabulary=50_257)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, f.first IS NOT NULL AND f.first < k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT t, min(doc_id) AS first FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT win.doc_id, i FROM win JOIN f USING (t) WHERE first < win.doc_id)),
ws AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT ws.doc_id, string_agg(word, ' ' ORDER BY ws.p) AS t FROM ws ANTI JOIN gone ON ws.doc_id = gone.doc_id AND ws.p = gone.p GROUP BY ws.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS t, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM dwin d JOIN win b ON d.t = b.t AND d.n = b.n),
wordhit AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM wordhit GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id),
wid AS (SELECT row_number() OVER () AS wid, t, n, list_distinct(string_split(t, ' ')) AS ts FROM (SELECT DISTINCT t, n FROM win)),
term AS (SELECT wid, n, len(ts) AS k, unnest(ts) AS term FROM wid),
pos AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM dw),
cand AS (SELECT doc_id, wid, n, k FROM (SELECT DISTINCT doc_id, term FROM pos) JOIN term USING (term) GROUP BY ALL HAVING count(*) = k),
post AS (SELECT cand.doc_id, wid, n, k, term, p FROM cand JOIN term USING (wid, n, k) JOIN pos USING (doc_id, term)),
near AS (SELECT doc_id, wid FROM (SELECT a.doc_id, a.wid, a.p FROM post a JOIN post b ON a.doc_id = b.doc_id AND a.wid = b.wid AND b.p BETWEEN a.p AND a.p + a.n + 4
  GROUP BY a.doc_id, a.wid, a.p, a.k HAVING count(DISTINCT b.term) = a.k) GROUP BY ALL),
nn AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, item_id FROM near JOIN wid USING (wid) JOIN win USING (t, n)) x
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = x.doc_id AND hit.item_id IS NOT DISTINCT FROM x.item_id) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id) LEFT JOIN nn USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_topk, op2_byte_bpe, op3_simhash, op4_quality, op5_line_dedup, op6_substring_dedup, op7_quotation_linking, op8_language, op9_decontaminate, op10_packing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op5_line_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op9_decontaminate": OP9_SQL}
