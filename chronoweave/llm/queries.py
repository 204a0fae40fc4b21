"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, decontamination, langid, lines, quality, sentencepiece_codec, sharding, simhash, substrings, trie, vectors, warc, whitening
from chronoweave.llm.common import fold_remainder

QUALITY_CUT, SHARDS = 0.3, 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), stats=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def quality_train(ident):
    """Ids outside the held-out fifth."""
    return fold_remainder(ident, 5) != 0


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), quality_train)
    held = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality.with_score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, read = warc.archive_pages(_read(spark, sf_dir, "pages"))
    return warc.page_report(read)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trips(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), copies=True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(_read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_components(_read(spark, sf_dir, "embeddings"))


def language_train(ident):
    """Ids outside the held-out third."""
    return fold_remainder(ident, 3) != 1


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs, language_train)
    held = F.coalesce(fold_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return langid.with_language(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_read(spark, sf_dir, "documents"))
    left = F.expr("make_valid_utf8(cast(kept AS string))")  # a cut may split a character
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", left.alias("text"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_read(spark, sf_dir, "embeddings"))


def op12_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_50k.json")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = bpe.decoded(bpe.encoded(docs, file).drop("text"), file)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("text", 256).alias("decoded_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_line_dedup, op3_quality_classifier, op4_warc_normaliser, op5_sentencepiece, op6_decontamination,
    op7_sharding, op8_embedding_near_dedup, op9_language_id, op10_suffix_array_dedup, op11_embedding_whitening, op12_byte_pair_encoding, op13_conversation_trie)}

ORACLES = {
    "op2_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d),
k AS (SELECT r, doc_id, no, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
j AS (SELECT k.*, f.top IS NOT NULL AND f.top <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r""",
    "op4_warc_normaliser": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex, top FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM s""",
    "op13_conversation_trie": """
WITH c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
       lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT conv_id, base, xor(crc, 4294967295) % 6 AS h FROM c),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no,
       {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(m ORDER BY no) AS ms FROM o GROUP BY conv_id),
b AS (SELECT h.conv_id, list_concat(coalesce(list_slice(f.ms, 1, h.h), []), list_slice(l.ms, h.h + 1, len(l.ms))) AS ms FROM h JOIN l USING (conv_id) LEFT JOIN l f ON f.conv_id = h.base),
p AS (SELECT conv_id, ms, unnest(generate_series(0, len(ms))) AS d FROM b),
k AS (SELECT conv_id, d, list_slice(ms, 1, d) AS k, d = len(ms) AS fin FROM p),
n AS (SELECT k, any_value(d) AS d, min(conv_id) AS low, count(*) AS n, (count(*) - 1) * coalesce(length(any_value(k[d].t)), 0) AS own,
       sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (fin), '')) AS ends FROM k GROUP BY k),
q AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND list_slice(x.k, 1, n.d) = n.k) AS kids FROM n),
s AS (SELECT a.k, sum(u.own) AS saved, count(*) FILTER (u.kids = 0) AS leaves FROM q a JOIN q u ON u.d >= a.d AND list_slice(u.k, 1, a.d) = a.k GROUP BY a.k)
SELECT q.low AS conv_id, q.d::BIGINT AS depth, u.low AS parent_conv_id, q.n AS n_convs, q.kids AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, q.ends AS ends_sha256
FROM q JOIN s USING (k) LEFT JOIN q u ON u.d = q.d - 1 AND u.k = list_slice(q.k, 1, q.d - 1)""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.98 * a.n * b.n),
c(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.x, p.y FROM c JOIN p ON p.x = c.y)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, m.low AS component_id, v.vec_id = m.low AS kept
FROM v JOIN (SELECT x, min(y) AS low FROM c GROUP BY x) m ON m.x = v.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY x) l ON l.x = v.vec_id""",
}
