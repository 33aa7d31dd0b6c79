"""Queries of routing over datasets, index upkeep, approvals, evaluation reports and reply rules, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import text
from docmill.functions.dates import sort_date
from docmill.functions.fixed import RUN_MODES, SECTION_BOILERPLATE, SECTION_IGNORED, SECTION_SIGNALS, SENTENCE_MARKS
from docmill.operators import admin, approval, ranking, reports, retrieval, sync
from docmill.operators import understanding as ask
from docmill.plans.shared import materialise, scratch, spread_table, table
from docmill.queries.reports import _DIFF, _RES, _incoming, _results, _snapshot
from docmill.queries.retrieval import _TERMS, _merged_orders
from docmill.sources import buckets, pages, versions
from docmill.streaming import jobs


def sort_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' dates as times of publication; some are missing, some no date."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    published = F.when(key % 5 == 0, "no date").when(key % 3 > 0, day)
    return table(spark, sf_dir, "orders").select("o_orderkey", sort_date(published, F.date_format(F.date_add("o_orderdate", 7), "yyyy-MM-dd")).alias("sort_date"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests with a route, and why their first try gave no answer."""
    route = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("meals"), F.lit("notices"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("courses"))).otherwise(F.array(F.lit("rules"), F.lit("meals"), F.lit("staff")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), route.alias("route"), F.when(F.col("c_custkey") % 4 == 0, "no_results").alias("reason"))


def dataset_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _merged_orders(spark, sf_dir).select("request", "dataset", "id", "hybrid_score")
    return retrieval.by_dataset(_requests(spark, sf_dir), hits, "request", "route", "id", 1).select("request", "dataset", "id", "rank")


def unavailable_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("request", F.array_join(retrieval.unavailable(F.col("route"), ["meals", "notices", "courses"]), ",").alias("unavailable"))


def second_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _merged_orders(spark, sf_dir).select("request", "dataset", "id")
    of = lambda name: hits.filter(F.col("dataset") == name)
    return retrieval.with_second_chance(_requests(spark, sf_dir), of("courses"), of("rules"), "request", "route", "reason")


def index_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written sparse index: what its metadata says, and whether its version fits."""
    path = scratch(spark, "index")
    retrieval.write_index(*retrieval.sparse_index(spread_table(spark, sf_dir, "documents"), "doc_id"), path, "documents", "2026-01-01")
    about = retrieval.read_index(spark, path, ["vocabulary", "postings", "metadata"])[2]
    return about.select("dataset", "n_postings", retrieval.index_state(F.col("version")).alias("state"))


def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("n_nationkey") % 3 == 1, "1").when(F.col("n_nationkey") % 3 == 2, "0")
    return table(spark, sf_dir, "nation").select("n_nationkey", retrieval.index_state(version).alias("state"))


def sync_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = materialise(sync.diff(_snapshot(spark, sf_dir), _incoming(spark, sf_dir)), "changes")
    every = reduce(DataFrame.unionByName, (sync.run_actions(changes, m).withColumn("mode", F.lit(m)) for m in RUN_MODES))
    return every.groupBy("mode", "change", "normalise", "index", "refresh").agg(F.count(F.lit(1)).alias("n"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), "doc_id")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks rows of one dataset and has one that the table lacks."""
    docs = _chunks(spark, sf_dir)
    return docs.filter("not (dataset = 'src1' and doc_id % 5 = 1)").unionByName(docs.filter("doc_id % 9 = 0").select(F.lit("gone").alias("dataset"), "doc_id"))


def index_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.index_repairs(_chunks(spark, sf_dir), _indexed(spark, sf_dir))


def index_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    repairs = materialise(index_repairs(spark, sf_dir), "repairs")
    return sync.repaired(_chunks(spark, sf_dir), _indexed(spark, sf_dir), repairs)


def index_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of customers and parts as chunks of suppliers."""
    notices = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("chunk_text"), (F.col("o_orderkey") % 5).cast("int").alias("position"))
    people = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"))
    rules = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("chunk_id"), (F.col("p_partkey") % 50).alias("doc_id"), F.col("p_name").alias("chunk_text"), F.lit(0).alias("position"))
    makers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("topics"))
    return sync.index_frame({"notices": (notices, people), "rules": (rules, makers)}, "doc_id", ["title", "topics"])


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items whose lines are the steps of their approval."""
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linenumber").alias("step"), (F.col("l_quantity") <= 45).alias("ok")).withColumnRenamed("l_orderkey", "o_orderkey")
    return sync.settled(table(spark, sf_dir, "orders"), steps, "o_orderkey", "l_linenumber").select("o_orderkey", "status", F.array_join("undo", ",").alias("undo"))


def approved_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' submissions, of which some are approved and some of these then rejected, with their notices and chunks."""
    tables, key = versions.TableSet(spark, scratch(spark, "tables")), F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("custom_knowledge", "event", "announcement", "other"))), (key % 4 + 1).cast("int"))
    data = F.concat(F.lit('{"question": "q'), key, F.lit('", "answer": "a", "title": "t'), key, F.lit('", "start_date": "2026-05-01", "content": "c", "date": "2026-01-02"}'))
    as_of, items = F.lit("2026-03-04").cast("date"), table(spark, sf_dir, "customer").select(key.alias("item_id"), kind.alias("kind"), data.alias("data"), F.lit("pending").alias("status"))
    with tables.change() as change:
        items = change.write("items", items)
        notices = change.write("notices", approval.notices_of(items.limit(0), as_of))
        change.write("chunks", approval.chunks_of(notices, 300, 80))
    approval.settle(tables, items.filter("item_id % 5 in (1, 2)").select("item_id", F.lit(True).alias("approve")), as_of)
    approval.settle(tables, items.filter("item_id % 5 = 2").select("item_id", F.lit(False).alias("approve")), as_of)
    n = tables.read("chunks").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return tables.read("items").select("item_id", "status").join(tables.read("notices").select("item_id", "board", "title"), "item_id", "left").join(n, "item_id", "left").na.fill("", ["board", "title"]).na.fill(0, ["n_chunks"])


def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in buckets, the large ones upserted."""
    path, parts = scratch(spark, "buckets"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.lit(-1).alias("extra"))
    buckets.write_buckets(parts, path, ["p_partkey"], 16)
    buckets.upsert_buckets(spark, path, parts.filter("p_size > 25").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(-1).alias("p_size"), F.lit(1).alias("extra")))
    return buckets.read_buckets(spark, path).drop("bucket")


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as questions: the first of a user and type is answered, later ones are hits."""
    nth = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), F.col("user_id").alias("question"), F.col("value").alias("answer"), (nth > 1).alias("hit"))
    return jobs.cache_statistics(asked)


def recent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label against those cached in the last half hour."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("label").alias("namespace"), F.col("vec_id").alias("asked_id"), "embedding")
    created = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("vec_id").cast("int") % 60)
    cached = vectors.filter("vec_id % 20 > 0").select(F.col("label").alias("namespace"), F.col("vec_id").alias("cached_id"), "embedding", created.alias("created"))
    return jobs.recent_answers(asked, cached, F.lit("2026-01-01 00:59:00").cast("timestamp_ntz"), least=0.2)


def collection_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    department = lambda c: F.concat(F.lit("d"), F.col(c) % 40).alias("department_name")
    sources = table(spark, sf_dir, "customer").filter("c_custkey % 40 < 35").select(department("c_custkey"), F.when((F.col("c_custkey") % 3 > 0) & (F.col("c_custkey") % 40 != 7), "found").otherwise("not_found").alias("status"))
    kind = F.when(F.col("o_orderkey") % 40 % 9 == 0, "crawl_error").otherwise(F.element_at(F.array(F.lit("table_row"), F.lit("section"), F.lit("crawl_error")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    records = table(spark, sf_dir, "orders").filter("o_orderkey % 40 > 3").select(department("o_orderkey"), kind.alias("record_type"), F.when(F.col("o_orderkey") % 2 == 0, "ABC1234").alias("course_code"), F.when(F.col("o_orderkey") % 5 == 0, "1").otherwise(" ").alias("grade"))
    return reports.collection_diagnosis(sources, records)


def verdict_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "unsure").when(F.col("quality") == 1, "correct").when(F.col("doc_id") % 2 == 0, "partial").otherwise("wrong")
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", verdict.alias("verdict"), F.when(F.col("doc_id") % 3 > 0, F.col("quality") == 1).alias("grounded"))
    return reports.verdict_shares(judged, ["source"]).na.fill(-1.0, ["grounded"])


def console_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return reports.console(rows.select(F.col("source").alias("dataset"), F.col("quality").alias("hit")), "dataset")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    metrics = materialise(reports.evaluation(results), "metrics")
    return reports.report_lines(metrics, reports.evaluation(results, "dataset"), reports.gates(metrics))


def last_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 7 == 0, "2999-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", day.alias("day"))
    return reports.last_published(rows, "day", ["o_orderpriority"]).select("o_orderpriority", F.col("last_published").cast("string").alias("last_published"))


def clamped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest page of a log that is asked for with too high a number."""
    return reports.page(table(spark, sf_dir, "events").select("event_id", "user_id"), [F.desc("event_id")], 5000, "logs")


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by role; the last one of a role may not leave it."""
    roles = reports.counted(table(spark, sf_dir, "supplier"), F.concat(F.lit("r"), F.col("s_nationkey")), "role")
    return roles.withColumn("last_one", F.col("n") <= 1)


def usage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies that tell their tokens in different ways."""
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    message = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"usage_metadata": {"input_tokens": '), u, F.lit(', "output_tokens": '), e, F.lit("}}")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"response_metadata": {"token_usage": {"prompt_tokens": '), u, F.lit(', "completion_tokens": 7, "total_tokens": '), e, F.lit("}}}")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"usage_metadata": null, "response_metadata": {"usage": {"total_tokens": '), u, F.lit(".0}}}")))
        .otherwise('{"response_metadata": {}}')
    )
    own = table(spark, sf_dir, "events").select("event_id", text.usage(message).alias("u"))
    return own.select("event_id", *(F.coalesce(f"u.{c}", F.lit(-1).cast("long")).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")))


def useful_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ["", " 학점 3", " Portal 학점", " 사이트맵 다.", " 개설된다."])), (F.col("doc_id") % 5 + 1).cast("int"))
    head = F.when(F.col("doc_id") % 11 == 0, "Popup  Zone").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.useful_section(head, F.concat("text", tail), F.lit("es")).alias("useful"))


MENU_CELLS = ["석 식", "A코너 6,500 원", "B 코너\n7,000원", "특별 코너", "일반 뚝배기 5,000원", "중\n식 1,000원", "그 밖", "석식 B코너 8,000원"]


def menu_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.element_at(F.array(*map(F.lit, MENU_CELLS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.menu_section(cell).alias("label"))


def marked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    markup = F.concat(F.lit("<![DATA-hwpjson "), n, F.lit("]>"), "url", F.lit("<![CDATA "), n, F.lit("]>tail<![ open"))
    return table(spark, sf_dir, "pages").select("page_id", text.without_marked_sections(markup).alias("without"), text.neutral_sections(markup).alias("neutral"))


def html_strip_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes of pages; SQL has no parser."""
    return spread_table(spark, sf_dir, "pages").select("page_id", text.parsed_text(F.col("html")).alias("text"))


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(text.tokens_by("word", F.col("text"))).alias("t"))
    return own.select("conv_id", "turn", F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def schedule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as lines of a calendar page."""
    key = F.col("o_orderkey")
    line = F.when(key % 4 == 0, F.concat(F.lit("Mar 2026.03.0"), key % 9 + 1, F.lit(". ~ 2026.04.1"), key % 9, F.lit(". Event  "), key)).when(key % 4 == 1, F.concat(F.lit("more "), key)).when(key % 4 == 2, F.concat(F.lit("(주관부서 : D"), key, F.lit(" )"))).otherwise("2026")
    lines = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("line"))
    first = lines.select("o_custkey").distinct().select("o_custkey", F.lit(-1).cast("long").alias("o_orderkey"), F.lit("2026학년도 교내일정").alias("line"))
    return pages.schedule_lines(lines.unionByName(first), "o_custkey", "o_orderkey", "line")


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x\n 목차 \n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.repeat(F.lit("part 1 \n"), 5), "text", F.lit(" 9"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", pages.contents_page(own).alias("contents"))


def merged_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, routed datasets and a sub-query's dataset of each message, merged."""
    at = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    turn, conv = F.col("turn"), F.col("conv_id")
    route = ask.merged_route(at(["courses", "smalltalk", "meals"], turn), F.array(at(["notices", "courses"], conv)), F.array(at(["staff", "notices"], conv + turn)), F.concat("text", at([" 졸업", ""], turn)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(route, ",").alias("route"))


def scope_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of courses of the asked major or its college; other datasets pass."""
    hits = _merged_orders(spark, sf_dir).select("request", "id", "dataset", (F.col("id") % 5).cast("string").alias("major"), (F.col("id") % 3).cast("string").alias("college"))
    asked_major, asked_college = F.when(F.col("request") % 4 > 0, (F.col("request") % 5).cast("string")), (F.col("request") % 3).cast("string")
    return hits.filter(ask.scope_filter(F.col("dataset"), F.col("major"), F.col("college"), asked_major, asked_college)).select("request", "id")


def cache_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("request")
    ok = ask.cacheable(F.col("route"), F.col("reason").isNotNull(), key % 5 == 0, F.when(key % 7 > 0, key % 7 > 2), F.when(key % 11 > 0, "answer").otherwise(" "))
    return _requests(spark, sf_dir).select("request", ok.alias("cacheable"))


def guide_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _merged_orders(spark, sf_dir).withColumn("courses", F.col("request") % 3 == 0)
    return admin.guide_prefix(hits, "request", "asked_year", "courses")


def topics_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _merged_orders(spark, sf_dir).withColumn("body", F.when(F.col("id") % 4 == 0, "장학 안내").otherwise("그 밖"))
    return ranking.topic_aligned(hits, "request", "id", "body", ["장학", "입학"], 2)


def reply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as judges' replies and lists of further questions, some in code fences, some broken."""
    key, u = F.col("event_id"), F.col("user_id").cast("string")
    reply = F.when(key % 3 == 0, F.concat(F.lit('```json\n{"score": '), (key % 150) / 100, F.lit("}\n```"))).when(key % 3 == 1, '{"score": "0.75"}').otherwise("no JSON")
    more = F.when(key % 2 == 0, F.concat(F.lit('["a'), u, F.lit('", " q ", "", "a'), u, F.lit('", "b", "c", "d"]'))).otherwise("broken")
    own = table(spark, sf_dir, "events").select("event_id", admin.grounding(reply, 0.7).alias("g"), F.array_join(admin.followups(more, F.lit("q")), ",").alias("followups"))
    return own.select("event_id", "g.checked", "g.grounded", F.coalesce("g.score", F.lit(-1.0)).alias("score"), "followups")


QUERIES = {f.__name__: f for f in (sort_dates, dataset_topk, unavailable_datasets, second_chance, index_artifact, index_states, sync_modes, index_repairs, index_repaired, index_rebuilt, approvals, approved_set, upsert_buckets, cache_stats, recent_answers, collection_diagnosis, verdict_shares, console_rollup, report_lines, last_published, clamped_page, role_counts, usage_tokens, useful_sections, menu_labels, marked_sections, html_strip_parser, word_tokens, schedule_text, contents_pages, merged_routes, scope_filtered, cache_eligible, guide_years, topics_aligned, reply_rules)}


def _any(words: list[str], q: str) -> str:
    return "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"


_HITS = "h AS (SELECT o_custkey AS request, o_orderkey AS id, ['notices', 'schedule', 'rules', 'meals', 'courses'][substr(o_orderpriority, 1, 1)::INT] AS dataset, round((o_totalprice / 1000) % 1.0::DOUBLE, 6) AS hybrid_score, o_orderstatus = 'F' AS guide, year(o_orderdate) AS y FROM orders)"
_ROUTES = "r AS (SELECT c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN ['meals', 'notices'] WHEN 1 THEN ['courses'] ELSE ['rules', 'meals', 'staff'] END AS route, CASE WHEN c_custkey % 4 = 0 THEN 'no_results' END AS reason FROM customer)"
_INDEXED = "c AS (SELECT source AS dataset, doc_id FROM documents), i AS (SELECT * FROM c WHERE NOT (dataset = 'src1' AND doc_id % 5 = 1) UNION ALL SELECT 'gone', doc_id FROM c WHERE doc_id % 9 = 0)"
_REPAIRS = "p AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(n, 0) AS n_chunks, coalesce(m, 0) AS n_indexed FROM (SELECT dataset, count(*) AS n FROM c GROUP BY dataset) a FULL JOIN (SELECT dataset, count(*) AS m FROM i GROUP BY dataset) b ON a.dataset = b.dataset), q AS (SELECT *, CASE WHEN n_chunks = 0 THEN 'reset' WHEN n_chunks = n_indexed THEN 'keep' ELSE 'rebuild' END AS action FROM p)"
_PCT = "coalesce(printf('%.2f%%', {0} * 100), 'n/a')"
_METRICS = ["route_hit_rate", "context_recall_proxy", "answer_relevancy_proxy", "fallback_rate"]
_MEANS = "count(*) AS count, round(avg(quality), 6) AS route_hit_rate, round(avg(quality), 6) AS context_recall_proxy, round(avg(ks), 6) AS answer_relevancy_proxy, round(avg(toxic), 6) AS fallback_rate FROM res"
_GATES = [("route_hit_rate", ">=", 0.8), ("context_recall_proxy", ">=", 0.7), ("answer_relevancy_proxy", ">=", 0.7), ("fallback_rate", "<=", 0.35)]
ORACLES = {
    "sort_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE::TIMESTAMP ELSE (o_orderdate::DATE + 7)::TIMESTAMP END AS sort_date FROM orders",
    "dataset_topk": f"WITH {_HITS}, {_ROUTES}, n AS (SELECT h.request, dataset, id, row_number() OVER (PARTITION BY h.request, dataset ORDER BY hybrid_score DESC, id)::INT AS rank FROM h JOIN r ON h.request = r.request AND list_contains(route, dataset)) SELECT * FROM n WHERE rank <= CASE WHEN dataset = 'meals' THEN 40 ELSE 2 END",
    "unavailable_datasets": f"WITH {_ROUTES} SELECT request, array_to_string(list_filter(route, lambda x: x NOT IN ('meals', 'notices', 'courses')), ',') AS unavailable FROM r",
    "second_chance": f"WITH {_HITS}, {_ROUTES} SELECT request, dataset, id FROM h WHERE dataset = 'courses' UNION ALL SELECT h.request, dataset, id FROM h JOIN r ON h.request = r.request WHERE dataset = 'rules' AND reason IS NOT NULL AND list_contains(route, 'courses') AND NOT list_contains(route, 'rules')",
    "index_artifact": f"WITH {_TERMS} SELECT 'documents' AS dataset, count(*) AS n_postings, 'ok' AS state FROM post",
    "index_states": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'legacy' WHEN 1 THEN 'ok' ELSE 'mismatch' END AS state FROM nation",
    "sync_modes": f"WITH {_DIFF}, m AS (SELECT unnest(['collect-only', 'normalize-only', 'index-only', 'full-sync']) AS mode, unnest([0, 1, 2, 3]) AS level) SELECT mode, change, level >= 1 AS normalise, level >= 2 AS \"index\", level >= 2 AS refresh, count(*) AS n FROM d, m WHERE change IN ('new', 'updated', 'hidden', 'parse_failed') GROUP BY ALL",
    "index_repairs": f"WITH {_INDEXED}, {_REPAIRS} SELECT * FROM q",
    "index_repaired": f"WITH {_INDEXED}, {_REPAIRS} SELECT dataset, doc_id FROM i WHERE dataset IN (SELECT dataset FROM q WHERE action = 'keep') UNION ALL SELECT dataset, doc_id FROM c WHERE dataset IN (SELECT dataset FROM q WHERE action = 'rebuild')",
    "index_rebuilt": """SELECT 'o' || o_orderkey AS chunk_id, o_custkey AS doc_id, o_orderpriority AS chunk_text, (o_orderkey % 5)::INT AS position, c_name AS title, '' AS topics, 'notices' AS dataset FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 > 0
UNION ALL SELECT 'p' || p_partkey, p_partkey % 50, p_name, 0, s_name, s_nationkey::VARCHAR, 'rules' FROM part JOIN supplier ON p_partkey % 50 = s_suppkey""",
    "approvals": """WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity > 45) AS failed FROM lineitem GROUP BY l_orderkey),
u AS (SELECT l.l_orderkey, any_value(failed) AS failed, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_linenumber DESC, l_returnflag DESC) FILTER (l_linenumber < failed) AS undo FROM lineitem l JOIN f ON l.l_orderkey = f.l_orderkey GROUP BY l.l_orderkey)
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL OR failed IS NOT NULL THEN 'pending' ELSE 'approved' END AS status, coalesce(undo, '') AS undo FROM orders LEFT JOIN u ON o_orderkey = l_orderkey""",
    "approved_set": """WITH i AS (SELECT c_custkey AS k, c_custkey % 4 AS t, c_custkey % 5 AS d FROM customer)
SELECT k AS item_id, CASE WHEN d = 2 THEN 'rejected' WHEN d = 1 AND t = 3 THEN 'approved_manually' WHEN d = 1 THEN 'approved' ELSE 'pending' END AS status,
CASE WHEN d = 1 AND t < 3 THEN ['학과지식', '학과행사', '학과공지'][t + 1] ELSE '' END AS board, CASE WHEN d = 1 AND t < 3 THEN CASE t WHEN 0 THEN 'q' ELSE 't' END || k ELSE '' END AS title, CASE WHEN d = 1 AND t < 3 THEN 1 ELSE 0 END AS n_chunks FROM i""",
    "upsert_buckets": "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size <= 25 THEN p_size ELSE -1 END AS p_size, CASE WHEN p_size > 25 THEN 1 ELSE -1 END AS extra FROM part",
    "cache_stats": "SELECT count(DISTINCT event_type) AS namespaces, count(DISTINCT (event_type, user_id)) AS size, count(*) - count(DISTINCT (event_type, user_id)) AS hits, count(DISTINCT (event_type, user_id)) AS misses FROM events",
    "recent_answers": """WITH c AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id % 60 DESC, vec_id) AS n FROM embeddings WHERE vec_id % 20 > 0 AND vec_id % 60 >= 29),
s AS (SELECT a.label, a.vec_id AS asked_id, c.vec_id AS cached_id, round(list_dot_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN c ON a.label = c.label WHERE a.vec_id % 20 = 0 AND n <= 500),
r AS (SELECT *, row_number() OVER (PARTITION BY label, asked_id ORDER BY score DESC, cached_id) AS k FROM s WHERE score >= 0.2) SELECT label AS namespace, asked_id, cached_id, score FROM r WHERE k = 1""",
    "collection_diagnosis": """WITH s AS (SELECT 'd' || (c_custkey % 40) AS d, c_custkey % 3 > 0 AND c_custkey % 40 <> 7 AS f FROM customer WHERE c_custkey % 40 < 35),
o AS (SELECT 'd' || (o_orderkey % 40) AS d, CASE WHEN o_orderkey % 40 % 9 = 0 THEN 'crawl_error' ELSE ['table_row', 'section', 'crawl_error'][o_orderkey % 3 + 1] END AS t, o_orderkey AS k FROM orders WHERE o_orderkey % 40 > 3),
a AS (SELECT d, count(*) FILTER (f) AS found_sources, count(*) FILTER (NOT f) AS not_found_sources FROM s GROUP BY d),
b AS (SELECT d, count(*) AS total_records, count(*) FILTER (t = 'table_row') AS table_rows, count(*) FILTER (t = 'section') AS section_rows, count(*) FILTER (t = 'crawl_error') AS crawl_errors, count(*) FILTER (k % 2 = 0) AS rows_with_course_code, count(*) FILTER (k % 5 = 0) AS rows_with_grade FROM o GROUP BY d),
j AS (SELECT coalesce(a.d, b.d) AS department_name, coalesce(found_sources, 0) AS found_sources, coalesce(not_found_sources, 0) AS not_found_sources, coalesce(total_records, 0) AS total_records, coalesce(table_rows, 0) AS table_rows, coalesce(section_rows, 0) AS section_rows, coalesce(crawl_errors, 0) AS crawl_errors, coalesce(rows_with_course_code, 0) AS rows_with_course_code, coalesce(rows_with_grade, 0) AS rows_with_grade FROM a FULL JOIN b ON a.d = b.d)
SELECT *, CASE WHEN found_sources = 0 THEN 'no_source' WHEN total_records = crawl_errors THEN 'crawl_failed' WHEN crawl_errors > 0 THEN 'partial' ELSE 'ok' END AS status FROM j""",
    "verdict_shares": """WITH j AS (SELECT source, CASE WHEN toxic = 1 THEN 'unsure' WHEN quality = 1 THEN 'correct' WHEN doc_id % 2 = 0 THEN 'partial' ELSE 'wrong' END AS v, CASE WHEN doc_id % 3 > 0 THEN quality = 1 END AS g FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) AS judged, round(avg((v = 'correct')::INT), 6) AS correct, round(avg((v = 'partial')::INT), 6) AS partial, round(avg((v = 'wrong')::INT), 6) AS wrong, coalesce(round(avg(g::INT), 6), -1) AS grounded FROM j WHERE v <> 'unsure' GROUP BY source""",
    "console_rollup": "WITH g AS (SELECT source AS dataset, count(*) AS count, round(avg(quality), 6) AS hit_rate, count(*) FILTER (quality = 0) AS misses FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT *, row_number() OVER (ORDER BY hit_rate DESC, dataset)::INT AS place FROM g",
    "report_lines": f"WITH {_RES}, m AS (SELECT {_MEANS}), b AS (SELECT dataset, {_MEANS} GROUP BY dataset) " + " UNION ALL ".join(
        [f"SELECT '1 {i}' AS part, '- {n}: ' || {_PCT.format(n)} AS line FROM m" for i, n in enumerate(_METRICS)]
        + ["SELECT '2 ' || coalesce(dataset, 'unknown'), '| ' || concat_ws(' | ', coalesce(dataset, 'unknown'), count::VARCHAR, " + ", ".join(_PCT.format(n) for n in _METRICS) + ") || ' |' FROM b"]
        + [f"SELECT '3 {n}', '- {n} ' || printf('%.4f', {n}) || ' misses {t:.2f}' FROM m WHERE NOT {n} {op} {t}" for n, op, t in _GATES]
    ),
    "last_published": "SELECT o_orderpriority, max(o_orderdate::DATE) FILTER (o_orderkey % 7 > 0)::VARCHAR AS last_published FROM orders GROUP BY 1",
    "clamped_page": "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 1000",
    "role_counts": "SELECT 'r' || s_nationkey AS role, count(*) AS n, count(*) <= 1 AS last_one FROM supplier GROUP BY 1",
    "usage_tokens": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN 0 ELSE -1 END AS input_tokens, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN 7 WHEN 2 THEN 0 ELSE -1 END AS output_tokens,
CASE event_id % 4 WHEN 0 THEN user_id + event_id WHEN 1 THEN event_id WHEN 2 THEN user_id ELSE -1 END AS total_tokens FROM events""",
    "useful_sections": f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Popup Zone' ELSE lang END AS head, trim(regexp_replace(text || ['', ' 학점 3', ' Portal 학점', ' 사이트맵 다.', ' 개설된다.'][doc_id % 5 + 1], '\\s+', ' ', 'g')) AS body FROM documents)
SELECT doc_id, body <> '' AND NOT ({_any(SECTION_BOILERPLATE, 'lower(body)')} OR head = 'Popup Zone' OR head = 'es' OR {_any(SECTION_IGNORED, 'body')}) AND ({_any(SECTION_SIGNALS, 'body')} OR {_any(SENTENCE_MARKS, 'body')}) AS useful FROM s""",
    "menu_labels": "SELECT p_partkey, ['석식', '중식 A코너 6,500원', '중식 B코너 7,000원', '중식 특별코너', '일반(뚝배기)', '중식 1,000원', '', '석식 8,000원'][p_partkey % 8 + 1] AS label FROM part",
    "marked_sections": "SELECT page_id, url || '<![CDATA ' || page_id || ']>tail<![ open' AS without, '<!--[DATA-hwpjson ' || page_id || ']-->' || url || '<!--[CDATA ' || page_id || ']-->tail<![ open' AS neutral FROM pages",
    "word_tokens": "WITH t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS t FROM conversations), g AS (SELECT conv_id, turn, md5(string_agg(t, ' ' ORDER BY t)) AS m FROM t GROUP BY conv_id, turn) SELECT c.conv_id, c.turn, coalesce(m, md5('')) AS tokens_md5 FROM conversations c LEFT JOIN g ON c.conv_id = g.conv_id AND c.turn = g.turn",
    "schedule_text": """WITH n AS (SELECT o_custkey, o_orderkey AS k, sum((o_orderkey % 4 = 0)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders)
SELECT o_custkey, '2026' AS year, string_agg(CASE k % 4 WHEN 0 THEN 'Event ' || k ELSE 'more ' || k END, ' ' ORDER BY k) FILTER (k % 4 < 2) AS content, coalesce('D' || max(k) FILTER (k % 4 = 2), '') AS department,
'2026-03-0' || (max(k) FILTER (k % 4 = 0) % 9 + 1) AS start, '2026-04-1' || (max(k) FILTER (k % 4 = 0) % 9) AS "end" FROM n WHERE n > 0 GROUP BY o_custkey, n""",
    "contents_pages": """WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'x' || chr(10) || ' 목차 ' || chr(10) || text WHEN 1 THEN repeat('part 1 ' || chr(10), 5) || text || ' 9' ELSE text END AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM t)
SELECT doc_id, list_contains(l[:5], '목차') OR (len(list_filter(l[:20], lambda x: regexp_matches(x, '[0-9]\\s*$'))) >= 6 AND len(list_filter(l[:20], lambda x: length(x) <= 40)) >= 6) AS contents FROM l""",
    "merged_routes": """WITH m AS (SELECT conv_id, turn, list_filter([CASE turn % 3 WHEN 0 THEN 'courses' WHEN 2 THEN 'meals' END, ['notices', 'courses'][conv_id % 2 + 1], ['staff', 'notices'][(conv_id + turn) % 2 + 1]], lambda x: x IS NOT NULL) AS l FROM conversations),
d AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM m) SELECT conv_id, turn, array_to_string(CASE WHEN list_contains(l, 'courses') AND turn % 2 = 0 THEN list_append(l, 'rules') ELSE l END, ',') AS route FROM d""",
    "scope_filtered": f"WITH {_HITS} SELECT request, id FROM h WHERE dataset <> 'courses' OR request % 4 = 0 OR id % 5 = request % 5 OR id % 3 = request % 3",
    "cache_eligible": f"WITH {_ROUTES} SELECT request, reason IS NULL AND NOT list_contains(route, 'meals') AND request % 5 <> 0 AND (request % 7 = 0 OR request % 7 > 2) AND request % 11 > 0 AS cacheable FROM r",
    "guide_years": f"WITH {_HITS}, g AS (SELECT request, max(y) AS latest FROM h WHERE guide GROUP BY request) SELECT request, CASE WHEN request % 2 = 0 THEN CASE WHEN request % 3 = 0 THEN 1997 END ELSE latest END::INT AS year FROM g",
    "topics_aligned": f"WITH {_HITS}, n AS (SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY id) AS n FROM h WHERE dataset = 'notices') SELECT request, coalesce((SELECT bool_or(id % 4 = 0) FROM n WHERE n.request = h.request AND n <= 2), false) AS aligned FROM h GROUP BY request",
    "reply_rules": """SELECT event_id, event_id % 3 < 2 AS checked, CASE event_id % 3 WHEN 0 THEN least(1.0::DOUBLE, (event_id % 150) / 100.0::DOUBLE) >= 0.7 ELSE true END AS grounded, CASE event_id % 3 WHEN 0 THEN least(1.0::DOUBLE, (event_id % 150) / 100.0::DOUBLE) WHEN 1 THEN 0.75 ELSE -1 END::DOUBLE AS score,
CASE WHEN event_id % 2 = 0 THEN 'a' || user_id || ',b,c' ELSE '' END AS followups FROM events""",
}
