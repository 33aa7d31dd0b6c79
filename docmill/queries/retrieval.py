"""Queries of indexing, retrieval and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.where import predicate
from docmill.operators import chunks, encoder, ranking, reports, retrieval, sparse_blocks, vectors
from docmill.operators.chunks import to_chunks
from docmill.functions.identity import doc_key
from docmill.plans.shared import materialise, spread_table, table

AS_OF = "2001-08-02"

_TERMS = """
terms AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[가-힣A-Za-z0-9]+'))) AS term FROM documents),
tok AS (SELECT * FROM terms WHERE length(term) >= 2),
vocab AS (SELECT term, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM tok GROUP BY term ORDER BY df DESC, term LIMIT 10000),
post AS (SELECT doc_id, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY doc_id)) AS weight FROM tok JOIN vocab USING (term)),
asks AS (SELECT DISTINCT item_id AS request, lower(unnest(regexp_extract_all(text, '[가-힣A-Za-z0-9]+'))) AS term FROM benchmark),
ask AS (SELECT request, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY request)) AS asked FROM asks JOIN vocab USING (term) WHERE length(term) >= 2),
sparse AS (SELECT request, doc_id, round(sum(weight * asked), 6) AS sparse_score FROM post JOIN ask USING (term) GROUP BY request, doc_id HAVING round(sum(weight * asked), 6) > 0)"""
_DENSE = """
dense AS (SELECT b.item_id AS request, v.vec_id AS doc_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dense_score
          FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id, embeddings v),
d15 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY dense_score DESC, doc_id) AS n FROM dense) WHERE n <= 15),
s15 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY sparse_score DESC, doc_id) AS n FROM sparse) WHERE n <= 15),
both_sides AS (SELECT coalesce(d.request, s.request) AS request, coalesce(d.doc_id, s.doc_id) AS doc_id, greatest(coalesce(dense_score, 0), 0) AS vector_score, coalesce(sparse_score, 0) AS sparse_score
          FROM d15 d FULL JOIN s15 s ON d.request = s.request AND d.doc_id = s.doc_id)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), F.col("text").alias("query"))


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    terms = retrieval.tokenised(spread_table(spark, sf_dir, "documents"), "doc_id")
    return terms, materialise(retrieval.vocabulary(terms), "vocabulary")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sparse = retrieval.sparse_topk(_queries(spark, sf_dir), *_terms(spark, sf_dir), "request", "doc_id", 15)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = _queries(spark, sf_dir).join(vectors, F.col("request") == F.col("doc_id")).select("request", "embedding")
    return table(spark, sf_dir, "documents"), sparse, retrieval.dense_scores(asked, vectors, "request", "doc_id", 15)


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select(doc_key(F.col("doc_id"), F.col("source")).alias("doc_id"), F.col("doc_id").alias("row_id"), "text")
    return to_chunks(docs, 300, 80).select("chunk_id", "doc_id", "row_id", "position", F.sha1(F.col("chunk_text").cast("binary")).alias("text_sha1"))


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks.chunks_in_context(spread_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("title")), 300, 80, "title")
    return made.select("doc_id", "position", F.length("context").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return chunks.pack_context(ranked, "source", "doc_id", "text").select("source", "n_parts", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    line = chunks.citation(F.concat(F.lit("["), title, F.lit("]\n\nbody")), F.when(F.col("page_id") % 2 == 0, "2024-01-02"), F.when(F.col("page_id") % 3 > 0, F.col("url")))
    return pages.select("page_id", line.alias("line"))


def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.recent_history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vocabulary(retrieval.tokenised(spread_table(spark, sf_dir, "documents"), "doc_id")).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sparse_index(spread_table(spark, sf_dir, "documents"), "doc_id")[1].select("doc_id", "term", F.round("weight", 6).alias("weight"))


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.sparse_topk(_queries(spark, sf_dir), *_terms(spark, sf_dir), "request", "doc_id", 5)
    return retrieval.ranked(best, "request", "sparse_score", "doc_id", 5)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("request"), "embedding")
    hits = retrieval.dense_scores(asked, vectors, "request", "vec_id", 15)
    return hits.withColumn("similarity", retrieval.similarity(1 - F.col("dense_score"))).select("request", "vec_id", "dense_score", F.round("similarity", 6).alias("similarity"))


def sparse_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents by an index in blocks, written and searched."""
    index = sparse_blocks.temporary(spread_table(spark, sf_dir, "documents"), "doc_id")
    best = sparse_blocks.search(index, _queries(spark, sf_dir), "request", 5)
    return retrieval.ranked(best, "request", "sparse_score", "doc_id", 5)


def _vector_index(spark: SparkSession, sf_dir: str) -> tuple[vectors.VectorIndex, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("request"), F.col("embedding").alias("asked"))
    return vectors.temporary(rows, "vec_id", "embedding"), asked


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors in the lists that each query probes, with the share of the true nearest among them."""
    index, asked = _vector_index(spark, sf_dir)
    found = vectors.search(index, asked, "request", "asked", 15)
    true = retrieval.dense_scores(asked.withColumnRenamed("asked", "embedding"), table(spark, sf_dir, "embeddings"), "request", "vec_id", 15)
    recall = F.round(F.avg((F.col("true_score").isNotNull()).cast("double")).over(Window.partitionBy("request")), 6)
    both = found.join(true.withColumnRenamed("dense_score", "true_score"), ["request", "vec_id"], "left")
    return both.select("request", "vec_id", "dense_score", recall.alias("recall"))


def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of all, by the index: lists that can't hold one aren't read."""
    index, asked = _vector_index(spark, sf_dir)
    return vectors.search(index, asked, "request", "asked", 15, probes=max(1, index.probes // 2), exact=True)


def vector_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of some labels: the filter comes before the ranking."""
    index, asked = _vector_index(spark, sf_dir)
    return vectors.search(index, asked, "request", "asked", 15, keep=predicate({"label": {"$in": [1, 4]}}, ["label"]), exact=True)


def encoded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest documents of each question by vectors that are learned from the documents, through the index."""
    docs = spread_table(spark, sf_dir, "documents")
    model = encoder.fit_encoder(docs, "doc_id")
    index = vectors.temporary(materialise(encoder.encode(model, docs, "doc_id"), "encoded"), "doc_id", "embedding")
    asked = encoder.encode(model, _queries(spark, sf_dir), "request", "query")
    return vectors.search(index, asked, "request", "embedding", 5, exact=True)


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sparse, dense = _sides(spark, sf_dir)
    return retrieval.hybrid(dense, sparse, docs.select("doc_id", "source", "lang"), "request", "doc_id").select("request", "doc_id", "vector_score", "sparse_score", "hybrid_score", "rank", "source", "lang")


def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sparse, dense = _sides(spark, sf_dir)
    where = predicate({"$or": [{"lang": {"$in": ["de", "fr"]}}, {"$and": [{"lang": "en"}, {"source": {"$ne": "src0"}}]}]}, docs.columns)
    return retrieval.hybrid(dense, sparse, docs.select("doc_id", "source", "lang"), "request", "doc_id", keep=where).select("request", "doc_id", "hybrid_score", "rank", "source", "lang")


def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of three queries each (benchmark items by item_id div 3), merged by document."""
    docs, sparse, dense = _sides(spark, sf_dir)
    hits = retrieval.hybrid(dense, sparse, docs.select("doc_id", "source"), "request", "doc_id").withColumns({"matched_query": F.col("request").cast("string"), "arrival": F.col("request") * 100 + F.col("rank"), "request": F.expr("request div 3")})
    return retrieval.merged(hits, "request", "doc_id", "arrival", ["source"]).select("request", "doc_id", "hybrid_score", "vector_score", "sparse_score", "source", F.array_join("matched_queries", ",").alias("matched_queries"), F.col("matched_query_count").cast("long").alias("matched_query_count"))


def date_filter_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of their priority; urgent ones without date."""
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("request"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 > 0, F.to_date("o_orderdate")).alias("day"), F.lit("1998-01-01").cast("date").alias("start"), F.when(F.col("o_orderpriority").startswith("1"), F.lit("1997-12-31")).otherwise(F.lit("1998-01-02")).cast("date").alias("end"))
    return retrieval.date_filtered(hits, "request", ["id"], "day", "start", "end", 5).select("request", "id", "date_unknown_auxiliary", "eliminated")


def date_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    out = retrieval.relaxed(hits, "request", F.col("day").between(F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date")), F.col("day").between(F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    return out.select("request", "id", "date_filter_relaxed")


def deadline_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by deadline in one range per priority; their price stands for the sparse score."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.to_date("o_orderdate").alias("deadline"), F.col("o_orderpriority").alias("own"), "o_totalprice")
    ranges = orders.select(F.col("o_orderpriority").alias("request")).distinct().select("request", F.lit("1998-01-01").cast("date").alias("start"), F.date_add(F.lit("1998-01-01").cast("date"), F.substring("request", 1, 1).cast("int") - 1).alias("end"))
    sparse = rows.select(F.col("own").alias("request"), "o_orderkey", F.round(F.pmod(F.col("o_totalprice"), F.lit(1.0)), 2).alias("sparse_score"))
    out = retrieval.deadline_first(rows, sparse, ranges, "request", "o_orderkey", "deadline")
    return out.select("request", "o_orderkey", "sparse_score", "hybrid_score", "rank")


def _merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as merged hits of their customer."""
    datasets = F.element_at(F.array(*(F.lit(d) for d in ("notices", "schedule", "rules", "meals", "courses"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("id"), datasets.alias("dataset"), F.round(F.pmod(F.col("o_totalprice") / 1000, F.lit(1.0)), 6).alias("hybrid_score"), F.col("o_orderdate").alias("sort_date"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("matched_query_count"), (F.col("o_orderkey") % 11 == 0).cast("int").alias("date_unknown_auxiliary"), (F.col("o_orderkey") % 13 == 0).alias("is_closed"),
        F.when(F.col("o_orderstatus") == "F", "entry_year_guide_pdf").alias("source_type"), F.year("o_orderdate").alias("entry_year"), (F.col("o_orderkey") % 5 == 0).alias("own_major"), F.lit(True).alias("guide_intent"),
        F.when(F.col("o_custkey") % 2 == 0, 1997).alias("asked_year"),
    )


def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.final_scores(_merged_orders(spark, sf_dir), "request", F.lit(AS_OF).cast("timestamp_ntz"))
    nth = F.row_number().over(Window.partitionBy("request").orderBy(*ranking.default_order("id")))
    return scored.select("request", "id", "final_score", nth.alias("rank"))


def rerank_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.final_scores(_merged_orders(spark, sf_dir), "request", F.lit(AS_OF).cast("timestamp_ntz"))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(*ranking.default_order("id")))).withColumn("rerank_score", F.when(F.col("request") % 4 > 0, (F.col("id") % 17).cast("double")))
    return ranking.reranked(scored, "request", "id", 6).select("request", "id", "rank")


def recent_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.final_scores(_merged_orders(spark, sf_dir), "request", F.lit(AS_OF).cast("timestamp_ntz"))
    scored = scored.withColumns({"notice_topic_match": ((F.col("dataset") == "notices") & (F.col("id") % 2 == 0)).cast("int"), "recent_notice_priority": (F.col("dataset") == "notices").cast("int")})
    return scored.select("request", "id", F.row_number().over(Window.partitionBy("request").orderBy(*ranking.recent_order("id"))).alias("rank"))


def fallback_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.sparse_summary(_queries(spark, sf_dir), *_terms(spark, sf_dir), "request", "doc_id")
    own = _queries(spark, sf_dir).select("request").join(top, "request", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    reason = ranking.fallback_reason(F.col("n_hits"), F.col("top_score"), F.lit(0.3), F.col("request") % 3 == 0, F.col("request") % 5 == 0, F.col("request") % 2 == 0, F.col("request") % 4 == 0)
    return own.select("request", "n_hits", "top_score", reason.alias("reason"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("request"), "embedding", F.col("label").alias("wanted"))
    hits = retrieval.dense_scores(asked, vectors, "request", "vec_id", 40)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("dense_score"), "vec_id")))
    hits = hits.join(asked.select("request", "wanted"), "request").join(vectors.select("vec_id", "label"), "vec_id").withColumn("relevant", F.col("wanted") == F.col("label"))
    totals = asked.select("request", "wanted").join(vectors.groupBy(F.col("label").alias("wanted")).agg(F.count(F.lit(1)).alias("n_relevant")), "wanted").select("request", "n_relevant")
    return reports.recall_at(hits, totals, "request")


_SCORED = f"""
h AS (SELECT o_custkey AS request, o_orderkey AS id, ['notices', 'schedule', 'rules', 'meals', 'courses'][substr(o_orderpriority, 1, 1)::INT] AS dataset, round((o_totalprice / 1000) % 1.0::DOUBLE, 6) AS hybrid_score, o_orderdate AS d,
             (o_orderkey % 3 + 1)::INT AS m, o_orderkey % 11 = 0 AS unknown, o_orderkey % 13 = 0 AS closed, o_orderstatus = 'F' AS guide, year(o_orderdate) AS y, o_orderkey % 5 = 0 AS own, CASE WHEN o_custkey % 2 = 0 THEN 1997 END AS asked FROM orders),
n AS (SELECT *, min(hybrid_score) OVER p AS lo, max(hybrid_score) OVER p AS hi, max(CASE WHEN guide THEN y END) OVER p AS latest, CASE dataset WHEN 'notices' THEN 90.0::DOUBLE WHEN 'schedule' THEN 180 WHEN 'rules' THEN 1095 WHEN 'meals' THEN 4 END AS decay FROM h WINDOW p AS (PARTITION BY request)),
s AS (SELECT *, CASE WHEN decay IS NULL THEN 1.0::DOUBLE ELSE exp(-greatest(0, epoch(TIMESTAMP '{AS_OF}') - epoch(d)) / 86400.0::DOUBLE / decay) END AS rec, CASE WHEN hi > lo THEN (hybrid_score - lo) / (hi - lo) ELSE hybrid_score END AS norm FROM n),
scored AS (SELECT *, round(0.6::DOUBLE * norm + 0.4::DOUBLE * rec + CASE WHEN unknown THEN -0.2 ELSE 0 END::DOUBLE + (m - 1) * 0.03::DOUBLE + CASE WHEN closed THEN -0.25 ELSE 0 END::DOUBLE + CASE WHEN guide AND asked IS NOT NULL AND y = asked THEN 0.12 ELSE 0 END::DOUBLE
           + CASE WHEN guide AND asked IS NULL AND y = latest THEN 0.06 ELSE 0 END::DOUBLE + CASE WHEN dataset = 'courses' AND own THEN 0.1 ELSE 0 END::DOUBLE, 6) AS final_score FROM s),
placed AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY m DESC, final_score DESC, hybrid_score DESC, id) AS rank FROM scored)"""

QUERIES = {f.__name__: f for f in (chunk_fixed, neighbour_context, context_pack, citations, history_tail, tfidf_vocabulary, tfidf_postings, sparse_topk, sparse_index_topk, dense_topk, vector_index_topk, vector_index_exact, vector_index_filtered, encoded_topk, hybrid_topk, hybrid_filtered, multi_query_merge, date_filter_aux, date_relaxation, deadline_rank, recency_rank, rerank_head, recent_order, fallback_decision, recall_at_k)}
_CHUNKS = """
c AS (SELECT doc_id, source, text, unnest(range(0, greatest(1, ceil((length(text) - 300) / 220.0)::INT + 1))) AS position FROM documents),
k AS (SELECT doc_id, source, position, regexp_replace(substr(text, position * 220 + 1, 300), '^\\s+|\\s+$', '', 'g') AS segment FROM c)"""
ORACLES = {
    "chunk_fixed": f"""WITH {_CHUNKS}
SELECT sha1(key || '|' || position) AS chunk_id, key AS doc_id, doc_id AS row_id, position::INT AS position, sha1(segment) AS text_sha1
FROM (SELECT *, sha1(CASE WHEN doc_id = 0 THEN '' ELSE doc_id || '|' END || source) AS key FROM k) WHERE segment <> ''""",
    "neighbour_context": f"""WITH {_CHUNKS},
w AS (SELECT doc_id, position, '[' || source || ']' || chr(10) || chr(10) || segment AS own, lag(segment) OVER p AS before, lag(position) OVER p AS bp, lead(segment) OVER p AS after, lead(position) OVER p AS ap FROM k WHERE segment <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY position)),
t AS (SELECT doc_id, position, concat_ws(chr(10), CASE WHEN bp = position - 1 THEN before END, own, CASE WHEN ap = position + 1 THEN after END) AS context FROM w)
SELECT doc_id, position::INT AS position, length(context)::INT AS n_chars, md5(context) AS context_md5 FROM t""",
    "context_pack": """WITH s AS (SELECT source, doc_id, text, row_number() OVER w AS n, sum(length(text)) OVER w + 7 * (row_number() OVER w - 1) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, count(*) AS n_parts, md5(substr(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n), 1, 4000)) AS context_md5 FROM s WHERE n = 1 OR used <= 4000 GROUP BY source""",
    "citations": """WITH t AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url END AS url, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS raw, CASE WHEN page_id % 2 = 0 THEN '2024-01-02' END AS day FROM pages),
u AS (SELECT *, CASE WHEN raw LIKE '%]%' THEN trim(split_part(raw, ']', 1)) ELSE raw END AS title FROM t)
SELECT page_id, CASE WHEN url IS NOT NULL AND day IS NOT NULL THEN '- ' || title || ' (' || day || ') — ' || url WHEN url IS NOT NULL THEN '- ' || title || ' — ' || url ELSE '- ' || title END AS line FROM u""",
    "history_tail": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '사용자: ' || trim(text) WHEN length(trim(text)) > 200 THEN '답변: ' || substr(trim(text), 1, 200) || '…' ELSE '답변: ' || trim(text) END, chr(10) ORDER BY turn) AS history FROM n WHERE n <= 6 GROUP BY conv_id""",
    "tfidf_vocabulary": f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_postings": f"WITH {_TERMS} SELECT doc_id, term, round(weight, 6) AS weight FROM post",
    "sparse_topk": f"WITH {_TERMS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY sparse_score DESC, doc_id)::INT AS rank FROM sparse) WHERE rank <= 5",
    "sparse_index_topk": f"WITH {_TERMS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY sparse_score DESC, doc_id)::INT AS rank FROM sparse) WHERE rank <= 5",
    "vector_index_exact": """WITH d AS (SELECT q.vec_id AS request, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dense_score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT request, vec_id, dense_score FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY dense_score DESC, vec_id) AS n FROM d) WHERE n <= 15""",
    "vector_index_filtered": """WITH d AS (SELECT q.vec_id AS request, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dense_score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label IN (1, 4))
SELECT request, vec_id, dense_score FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY dense_score DESC, vec_id) AS n FROM d) WHERE n <= 15""",
    "dense_topk": """WITH d AS (SELECT q.vec_id AS request, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dense_score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT request, vec_id, dense_score, round(greatest(0, dense_score), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY dense_score DESC, vec_id) AS n FROM d) WHERE n <= 15""",
    "hybrid_topk": f"""WITH {_TERMS}, {_DENSE},
f AS (SELECT *, round(vector_score * 0.4::DOUBLE + sparse_score * 0.6::DOUBLE, 6) AS hybrid_score FROM both_sides), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY hybrid_score DESC, doc_id)::INT AS rank FROM f)
SELECT request, doc_id, vector_score, r.sparse_score, hybrid_score, rank, source, lang FROM r JOIN documents USING (doc_id) WHERE rank <= 5""",
    "hybrid_filtered": f"""WITH {_TERMS}, {_DENSE},
f AS (SELECT b.*, source, lang, round(vector_score * 0.4::DOUBLE + sparse_score * 0.6::DOUBLE, 6) AS hybrid_score FROM both_sides b JOIN documents USING (doc_id) WHERE lang IN ('de', 'fr') OR (lang = 'en' AND source <> 'src0'))
SELECT request, doc_id, hybrid_score, rank, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY hybrid_score DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 5""",
    "multi_query_merge": f"""WITH {_TERMS}, {_DENSE},
f AS (SELECT *, round(vector_score * 0.4::DOUBLE + sparse_score * 0.6::DOUBLE, 6) AS hybrid_score FROM both_sides), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY hybrid_score DESC, doc_id) AS rank FROM f)
SELECT request // 3 AS request, doc_id, max(hybrid_score) AS hybrid_score, max(vector_score) AS vector_score, max(r.sparse_score) AS sparse_score, any_value(source) AS source, string_agg(request::VARCHAR, ',' ORDER BY request) AS matched_queries, count(*) AS matched_query_count
FROM r JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY request // 3, doc_id""",
    "date_filter_aux": """WITH h AS (SELECT o_orderpriority AS request, o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE END AS day, CASE WHEN o_orderpriority LIKE '1%' THEN DATE '1997-12-31' ELSE DATE '1998-01-02' END AS stop FROM orders),
c AS (SELECT *, coalesce(day BETWEEN DATE '1998-01-01' AND stop, false) AS inside, row_number() OVER (PARTITION BY request, day IS NULL ORDER BY id) AS n FROM h),
w AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY request) AS n_in, least(5, count(*) OVER (PARTITION BY request)) AS want FROM c)
SELECT request, id, (NOT inside)::INT AS date_unknown_auxiliary, n_in = 0 AS eliminated FROM w WHERE inside OR (day IS NULL AND n <= want - n_in)""",
    "date_relaxation": """WITH h AS (SELECT o_custkey AS request, o_orderkey AS id, o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AS s, o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AS w FROM orders)
SELECT request, id, r AS date_filter_relaxed FROM (SELECT *, NOT bool_or(s) OVER (PARTITION BY request) AS r FROM h) WHERE s OR (r AND w)""",
    "deadline_rank": """WITH r AS (SELECT DISTINCT o_orderpriority AS request, DATE '1998-01-01' AS start, DATE '1998-01-01' + (substr(o_orderpriority, 1, 1)::INT - 1) AS stop FROM orders),
h AS (SELECT request, o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderpriority = request THEN round(o_totalprice % 1.0::DOUBLE, 2) ELSE 0 END::DOUBLE AS sparse_score, start, stop FROM orders, r WHERE o_orderdate::DATE BETWEEN start AND stop),
s AS (SELECT *, round(least(1.0::DOUBLE, 0.12::DOUBLE + 0.85::DOUBLE * sparse_score + 0.15::DOUBLE * CASE WHEN stop > start THEN 1 - least(1.0::DOUBLE, (d - start) / (stop - start)::DOUBLE) ELSE 1.0::DOUBLE END), 6) AS hybrid_score FROM h)
SELECT request, o_orderkey, sparse_score, hybrid_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY hybrid_score DESC, sparse_score DESC, d, o_orderkey)::INT AS rank FROM s) WHERE rank <= 50""",
    "recency_rank": f"WITH {_SCORED} SELECT request, id, final_score, rank::INT AS rank FROM placed",
    "rerank_head": f"""WITH {_SCORED},
q AS (SELECT *, rank <= 6 AS top, CASE WHEN request % 4 > 0 THEN id % 17 END AS z FROM placed),
b AS (SELECT *, min(z) OVER p AS zl, max(z) OVER p AS zh FROM q WINDOW p AS (PARTITION BY request, top)),
e AS (SELECT *, top AND z IS NOT NULL AS moved, CASE WHEN top AND z IS NOT NULL THEN round(0.6::DOUBLE * CASE WHEN zh > zl THEN (z - zl) / (zh - zl)::DOUBLE ELSE 0.5 END + 0.4::DOUBLE * rec, 6) END AS g FROM b)
SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY NOT top, -g, CASE WHEN moved THEN -hybrid_score END, CASE WHEN NOT moved THEN rank END, id)::INT AS rank FROM e""",
    "recent_order": f"WITH {_SCORED} SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY (dataset = 'notices' AND id % 2 = 0) DESC, m DESC, dataset = 'notices' DESC, d DESC, final_score DESC, hybrid_score DESC, id)::INT AS rank FROM scored",
    "fallback_decision": f"""WITH {_TERMS}, t AS (SELECT request, count(*) AS n_hits, max(sparse_score) AS top_score FROM sparse GROUP BY request), o AS (SELECT item_id AS request, coalesce(n_hits, 0) AS n_hits, top_score FROM benchmark LEFT JOIN t ON item_id = request)
SELECT *, CASE WHEN n_hits = 0 THEN CASE WHEN request % 3 = 0 THEN 'dataset_unavailable' WHEN request % 5 = 0 THEN 'date_filter_eliminated_all' ELSE 'no_results' END WHEN top_score < 0.3::DOUBLE AND NOT (request % 2 = 0 AND request % 4 = 0) THEN 'score_below_threshold' END AS reason FROM o""",
    "recall_at_k": """WITH d AS (SELECT q.vec_id AS request, q.label = v.label AS good, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS n FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT request, count(*) FILTER (good) AS n_relevant, round(count(*) FILTER (good AND n <= 5) / count(*) FILTER (good)::DOUBLE, 6) AS recall_at_5, round(count(*) FILTER (good AND n <= 10) / count(*) FILTER (good)::DOUBLE, 6) AS recall_at_10,
round(count(*) FILTER (good AND n <= 20) / count(*) FILTER (good)::DOUBLE, 6) AS recall_at_20, round(count(*) FILTER (good AND n <= 40) / count(*) FILTER (good)::DOUBLE, 6) AS recall_at_40 FROM d GROUP BY request""",
}
