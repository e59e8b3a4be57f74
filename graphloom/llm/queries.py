"""The registered queries of the corpus operators: thin, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, ego, mixing, ngram_join, pii, secret_scan, slots, spelling, spotsigs, suffix_dedup, toxicity, window_dedup
from .common import hex_sha256, span_text, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, keep=["doc_id"], decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in pii.BASE),
        hex_sha256(span_text(F.col("base"))).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.fingerprint(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        hex_sha256(span_text(F.col("base"))).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op7_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard_documents(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "n", "form", "form_n", "root", "n_near")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversations.repair_damaged(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=13)
    return out.select("doc_id", "n_words", "n_removed", hex_sha256(F.col("kept")).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ego": op2_ego,
    "op3_pii": op3_pii,
    "op4_spotsigs": op4_spotsigs,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_slots": op7_slots,
    "op8_repeats": op8_repeats,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_spelling": op11_spelling,
    "op12_repair": op12_repair,
    "op13_windows": op13_windows,
}

#: All pairs that share an n-gram are compared; components by recursion.
NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(x) = 0 THEN []::VARCHAR[]
    WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
    ELSE list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i+4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n AS na ON na.doc_id = p.a JOIN n AS nb ON nb.doc_id = p.b
  WHERE p.k::DOUBLE / (na.c + nb.c - p.k) >= 0.8
), r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT d.doc_id, (SELECT min(r.c) FROM r WHERE r.doc_id = d.doc_id) AS class_id,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""

#: All pairs of one label are compared; components by recursion.
COSINE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93
), r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m
"""

#: The smallest id of every window, then the words that windows with a smaller one cover.
WINDOW_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13),
x AS (SELECT r, doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM g),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM x JOIN m USING (s) WHERE least < doc_id),
l AS (SELECT r, list(k) AS ks FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN l USING (r)
"""

#: Checksums byte by byte from a table; near words by their shapes with one letter out.
SPELLING_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tab),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
p AS (SELECT doc_id, w, count(*) AS c FROM o GROUP BY ALL),
b AS (SELECT *, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: unicode(x)) || flatten(list_transform(string_split(w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS bytes FROM p),
h AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, bytes::BIGINT[]), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, t),
m AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (
  SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.s = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.s = v.word),
k AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM e JOIN v ON v.word = e.b),
f AS (SELECT word, v.n, CASE WHEN k.n >= 2 * v.n THEN b END AS form, CASE WHEN k.n >= 2 * v.n THEN k.n END AS form_n, coalesce(n_near, 0) AS n_near FROM v LEFT JOIN k ON k.a = v.word AND k.r = 1),
z AS (SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT z.word, f.form, d + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, form, form_n, root, n_near FROM f JOIN (SELECT word, arg_max(root, d) AS root FROM z GROUP BY word) USING (word)
"""

ORACLE: dict[str, str] = {"op2_ego": COSINE_SQL, "op10_ngram_join": NGRAM_SQL, "op11_spelling": SPELLING_SQL, "op13_windows": WINDOW_SQL}
