"""Queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import best_fit, conversations, exact_dedup, hard_negatives, language, licences, line_quality, mixing, packing, page_text, pii, simhash, site_lines
from docmill.plans.shared import spread_table, table


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(spread_table(spark, sf_dir, "pages"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(spread_table(spark, sf_dir, "documents")).drop("cleaned")


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.drop_site_lines(spread_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    profiles = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, profiles)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(spread_table(spark, sf_dir, "documents"))
    digits = F.lower(F.hex("fp"))
    return groups.select("doc_id", F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(spread_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(spread_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spread_table(spark, sf_dir, "documents")).drop("spans")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spread_table(spark, sf_dir, "documents")).drop("found")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"pipeline": corpus_pipeline.run, "op1_page_text": op1_page_text, "op10_pii": op10_pii, "op9_licences": op9_licences, "op2_line_quality": op2_line_quality, "op4_packing": op4_packing, "op5_language": op5_language, "op6_simhash": op6_simhash, "op3_site_lines": op3_site_lines, "op7_mixing": op7_mixing, "op8_exact_dedup": op8_exact_dedup,
           "op11_best_fit": op11_best_fit, "op12_hard_negatives": op12_hard_negatives, "op13_conversation_repair": op13_conversation_repair}

#: Queries that run no Python in tasks.
NATIVE = {"op3_site_lines", "op7_mixing", "op8_exact_dedup"}

ORACLES = {
    "op2_line_quality": """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, u.i AS i, words[u.i] AS a, words[u.i + 1] AS b, words[u.i + 2] AS c FROM d, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i) u),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM w), (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, text, u.i AS i, string_split(text, chr(10))[u.i] AS line FROM d, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) u),
k AS (SELECT *, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS key, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS line_words FROM l),
hosts AS (SELECT source, count(DISTINCT text) AS host_texts FROM d GROUP BY source),
first AS (SELECT source, text, min(doc_id) AS doc_id FROM d GROUP BY source, text),
often AS (SELECT k.source, k.key, arg_min(k.text, f.doc_id) AS owner FROM k JOIN first f ON k.source IS NOT DISTINCT FROM f.source AND k.text = f.text JOIN hosts h ON k.source IS NOT DISTINCT FROM h.source
          WHERE key <> '' GROUP BY k.source, k.key, host_texts HAVING count(DISTINCT k.text) >= 10 AND count(DISTINCT k.text) > host_texts * 0.05::DOUBLE),
m AS (SELECT k.doc_id, sum(line_words) AS removed_words FROM k JOIN often o ON k.source IS NOT DISTINCT FROM o.source AND k.key = o.key AND k.text <> o.owner GROUP BY k.doc_id),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k WHERE line_words > 0 GROUP BY doc_id),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM d),
t AS (SELECT s.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words FROM s LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= n_words * 0.5::DOUBLE AS kept FROM t""",
    "op3_site_lines": """
WITH l AS (SELECT doc_id, source, u.i AS i, string_split(text, chr(10))[u.i] AS line, trim(regexp_replace(lower(string_split(text, chr(10))[u.i]), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS key
           FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) u),
hosts AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
often AS (SELECT l.source, key FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE key <> '' GROUP BY l.source, key, host_pages
          HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) > host_pages * 0.1::DOUBLE),
cut AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL) AS text, count(*) AS n_lines, count(o.key) AS n_dropped
        FROM l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.key = o.key GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(c.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, host_pages
FROM documents d LEFT JOIN cut c USING (doc_id) JOIN hosts h ON d.source IS NOT DISTINCT FROM h.source""",
    "op7_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE k % 3 WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () AS everything FROM s),
r AS (SELECT *, (everything * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM r WHERE level * weight < cap) AS x FROM r),
q AS (SELECT source, source_size, CASE WHEN x IS NULL THEN cap ELSE least(cap, x * weight) END AS target FROM t),
m AS (SELECT d.doc_id, d.size, q.source_size, q.target, d.draw, CASE WHEN q.source_size > 0 THEN q.target / q.source_size ELSE 0.0 END AS rate FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken, (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies FROM m""",
    "op8_exact_dedup": """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER () AS row FROM v),
s AS (SELECT a.row AS a, b.row AS b, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
      FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
g AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM g WHERE rank <= 5""",
}
