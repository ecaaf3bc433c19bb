"""The operators as queries over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, html_text, licenses, lm_score, media, mixing, negatives, packing, quality, simhash, tokens, warc
from .common import stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), spans=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.link_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(media.encode_texts(table(spark, sf_dir, "documents")), "media")
    return media.decode_media(files)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_archive(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.integer_vectors(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_structure(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_license_scan": op2_license_scan,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_html_text": op5_html_text,
    "op6_lm_score": op6_lm_score,
    "op7_warc": op7_warc,
    "op8_progressive_jpeg": op8_progressive_jpeg,
    "op9_mixing": op9_mixing,
    "op10_token_output": op10_token_output,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_packing": op13_packing,
}

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS original FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM d LEFT JOIN o USING (payload_digest)"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

# crc32 a byte at a time; then the layers of the pass as a recursion over the rows' numbers
OP12_SQL = """
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, generate_series(1, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) g(copy)),
e AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM d),
r AS (
  SELECT *, role[1] AS first, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(core[-1], '[.!?]') THEN 'truncated' END AS fault
  FROM e),
c AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
v AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': NULL::VARCHAR} AS n, {'c': 1000000000, 'a': '', 't': NULL::VARCHAR} AS s,
    {'c': 3, 'a': 'I', 't': 'user:'} AS u, {'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, i, n, s, u1, list_min([a, {'c': u1.c + 3, 'a': u1.a || 'I', 't': concat_ws(chr(10), u1.t, 'assistant:')}]) FROM (
    SELECT conv_id, i, n, s, a, list_min([u, {'c': n.c + 3, 'a': n.a || 'I', 't': 'user:'}, {'c': s.c + 3, 'a': s.a || 'I', 't': concat_ws(chr(10), s.t, 'user:')},
      {'c': a.c + 3, 'a': a.a || 'I', 't': concat_ws(chr(10), a.t, 'user:')}]) AS u1
    FROM (
      SELECT conv_id, i, {'c': n.c + 4, 'a': n.a || 'D', 't': n.t} AS n,
        list_min([{'c': s.c + 4, 'a': s.a || 'D', 't': s.t}, {'c': CASE WHEN free AND first = 's' THEN n.c + more ELSE 1000000000 END, 'a': n.a || 'K', 't': role || ':' || text}]) AS s,
        list_min([{'c': u.c + 4, 'a': u.a || 'D', 't': u.t}] || list_transform([n, s, a], lambda x: {'c': CASE WHEN free THEN x.c + 3 + more ELSE 1000000000 END, 'a': x.a || 'R', 't': concat_ws(chr(10), x.t, 'user:' || text)})
          || list_transform([n, s, a], lambda x: {'c': CASE WHEN free AND first = 'u' THEN x.c + more ELSE 1000000000 END, 'a': x.a || 'K', 't': concat_ws(chr(10), x.t, role || ':' || text)})) AS u,
        list_min([{'c': a.c + 4, 'a': a.a || 'D', 't': a.t}, {'c': CASE WHEN free THEN u.c + 3 + more ELSE 1000000000 END, 'a': u.a || 'R', 't': concat_ws(chr(10), u.t, 'assistant:' || text)},
          {'c': CASE WHEN free AND first = 'a' THEN u.c + more ELSE 1000000000 END, 'a': u.a || 'K', 't': concat_ws(chr(10), u.t, role || ':' || text)}]) AS a
      FROM (SELECT v.*  REPLACE (r.i AS i), r.role, r.text, r.first, coalesce(r.fault, '') NOT IN ('blank', 'duplicate') AS free, CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END AS more
        FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1)))),
w AS (SELECT conv_id, i, list_min([n, a]) AS best FROM v)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0)"""

ORACLE_SQL: dict[str, str] = {
    "op7_warc": OP7_SQL,
    "op9_mixing": mixing.mix_sql(),
    "op11_hard_negatives": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
