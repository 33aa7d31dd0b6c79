"""Queries of catalogue rules, submissions, prompt parts and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import catalogue
from docmill.functions.fixed import NAME_BOILERPLATE, NOT_DEPARTMENT_NAMES, NOT_DEPARTMENTS
from docmill.operators import admin
from docmill.plans.shared import table

NAMES = ["통계학과", "국어교육과 바로가기", "대학원 통계학과", "과", "학과소개", "Department of X", "행사", "#학과", "이과대학 홈페이지", "한국음악과", "의예과 센터", "Major in Y", "ab", "컴퓨터공학전공"]
LINKS = [("총괄표", "https://a.uni.edu/x.pdf"), ("교육과정", "https://a.uni.edu/article/1"), ("교과목 해설", "https://b.org/c?d=1"), ("이수체계도", "https://a.uni.edu"), ("교육과정", "https://a.uni.edu/"), ("수강신청", "https://a.uni.edu/c"), ("전공과목", "https://A.uni.edu/list/")]
SUBMITTED = [
    (1, "event", '{"title": "t", "start_date": "2026-05-01", "end_date": "2026-05-02", "department": "통계학과"}'), (2, "custom_knowledge", '{"question": "q", "answer": "a", "category": "수학과", "department": "x"}'),
    (3, "announcement", '{"title": "t", "content": " "}'), (4, "other", "{}"), (5, "event", '{"title": "only"}'), (6, "announcement", '{"title": "n", "content": "c", "category": "일반", "date": "2026-01-02"}'),
]


def _pick(values: list, by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def department_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with one of the names."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", _pick(NAMES, "c_custkey").alias("name"))
    return rows.select("c_custkey", catalogue.clean_name(F.col("name")).alias("clean"), catalogue.department_like(F.col("name")).alias("is_department"), catalogue.college_like(F.col("name")).alias("is_college"))


def curriculum_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as links with their number in the path of those that have one."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick([a for a, _ in LINKS], "p_partkey").alias("anchor"), F.replace(_pick([u for _, u in LINKS], "p_partkey"), F.lit("x"), F.concat(F.lit("x"), "p_partkey")).alias("url"))
    base = F.lit("https://a.uni.edu/")
    score = catalogue.candidate_score(base, F.col("anchor"), F.col("url"))
    return rows.select("p_partkey", catalogue.source_type(F.col("anchor"), F.col("url")).alias("kind"), catalogue.internal_url(base, F.col("url"), ".uni.edu").alias("internal"), catalogue.same_page(base, F.col("url")).alias("same_page"), score["score"].alias("score"))


def submission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as submissions of one of the kinds."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", _pick([x[1] for x in SUBMITTED], "c_custkey").alias("kind"), _pick([x[2] for x in SUBMITTED], "c_custkey").alias("data"))
    return rows.select("c_custkey", admin.submission_problem(F.col("kind"), F.col("data")).alias("problem"), admin.department(F.col("kind"), F.col("data")).alias("department"), admin.in_scope(F.col("data"), F.lit("통계학과")).alias("in_scope"))


def context_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('[{"name": "f", "url": "'), "url", F.lit('"}]')))
    part = admin.context_part(F.col("page_id"), F.lit("pages"), F.when(F.col("page_id") % 3 > 0, F.lit("t")), F.when(F.col("page_id") % 5 > 0, F.lit("nan")).otherwise("2024-01-01"), F.col("url"), F.substring("html", 1, 200), files)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(part.cast("binary")).alias("part_md5"))


def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decoded stream parts of their user's answer."""
    payload = F.to_json(F.struct(F.when(F.col("event_type") == "purchase", "error").otherwise("text").alias("type"), F.concat(F.substring("event_type", 1, 2), F.col("event_id") % 10).alias("content")))
    out = admin.replayed(table(spark, sf_dir, "events").select("user_id", "event_id", payload.alias("p")), "user_id", "event_id", "p")
    return out.select("user_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "error")


def log_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log whose price is the newest line's, if there is one."""
    log = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    updates = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("at"), F.col("l_extendedprice").alias("price"))
    return admin.with_updates(log, updates, "o_orderkey", "at", ["price"])


QUERIES = {f.__name__: f for f in (department_names, curriculum_links, submission_checks, context_parts, session_replay, log_updates)}


def _any(words: list[str], q: str) -> str:
    return "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"


def _list(values: list, by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{by} % {len(values)} + 1]"


_CLEAN = "trim(name)"
for _word in NAME_BOILERPLATE:
    _CLEAN = f"replace({_CLEAN}, '{_word}', '')"
_MISSING = "concat_ws(', ', CASE WHEN coalesce(trim(data ->> '{0}'), '') = '' THEN '{0}' END, CASE WHEN coalesce(trim(data ->> '{1}'), '') = '' THEN '{1}' END)"
ORACLES = {
    "department_names": f"""WITH m AS (SELECT c_custkey, {_list(NAMES, 'c_custkey')} AS name FROM customer), n AS (SELECT *, trim({_CLEAN}) AS clean FROM m)
SELECT c_custkey, clean, NOT (length(trim(name)) < 2 OR lower(trim(name)) IN ({', '.join(repr(x) for x in NOT_DEPARTMENT_NAMES)}) OR name LIKE '#%' OR {_any(NOT_DEPARTMENTS, 'name')}) AND ({_any(['학과', '전공', '학부'], 'name')} OR {_any(['department', 'major'], 'lower(name)')} OR (length(clean) >= 3 AND clean LIKE '%과')) AS is_department,
length(trim(name)) >= 2 AND ({_any(['대학', '학부'], 'name')} OR {_any(['college', 'school', 'faculty'], 'lower(name)')}) AS is_college FROM n""",
    "curriculum_links": f"""WITH k AS (SELECT p_partkey, {_list([a for a, _ in LINKS], 'p_partkey')} AS anchor, replace({_list([u for _, u in LINKS], 'p_partkey')}, 'x', 'x' || p_partkey) AS url FROM part),
l AS (SELECT p_partkey, anchor, url, lower(regexp_extract(url, '://([^/?]*)', 1)) AS h, rtrim(regexp_extract(url, '://[^/?]*([^?]*)', 1), '/') AS p, regexp_extract(url, '://([^/?]*)', 1) AS raw, contains(url, '?') AS q FROM k),
s AS (SELECT *, raw = 'a.uni.edu' AND p = '' AND NOT q AS same_page FROM l)
SELECT p_partkey, CASE WHEN contains(lower(anchor || ' ' || url), 'pdf') THEN 'pdf_curriculum' WHEN contains(url, '/article/') OR contains(url, '/reference/detail/') THEN 'reference_article' WHEN contains(anchor, '해설') OR contains(lower(url), 'description') THEN 'course_description' WHEN {_any(['총괄표', '이수체계도', '개설'], 'anchor')} THEN 'curriculum_table' ELSE 'curriculum_page' END AS kind,
h = 'a.uni.edu' OR h LIKE '%.uni.edu' AS internal, same_page, (CASE WHEN same_page THEN 0 ELSE 3 END + CASE WHEN {_any(['총괄표', '이수체계도'], 'anchor')} THEN 3 ELSE 0 END + CASE WHEN contains(anchor, '해설') THEN 2 ELSE 0 END + CASE WHEN {_any(['학부과정', '전공과목'], 'anchor')} THEN 1 ELSE 0 END)::INT AS score FROM s""",
    "submission_checks": f"""WITH k AS (SELECT c_custkey, {_list([x[1] for x in SUBMITTED], 'c_custkey')} AS kind, {_list([x[2] for x in SUBMITTED], 'c_custkey')} AS data FROM customer),
s AS (SELECT c_custkey, kind, data, CASE kind WHEN 'custom_knowledge' THEN {_MISSING.format('question', 'answer')} WHEN 'event' THEN {_MISSING.format('title', 'start_date')} WHEN 'announcement' THEN {_MISSING.format('title', 'content')} END AS missing FROM k)
SELECT c_custkey, CASE WHEN missing IS NULL THEN 'unknown type' WHEN missing <> '' THEN 'missing: ' || missing END AS problem, coalesce(CASE WHEN kind = 'custom_knowledge' THEN coalesce(data ->> 'category', data ->> 'department') ELSE coalesce(data ->> 'department', data ->> 'category') END, '') AS department, coalesce(coalesce(data ->> 'department', data ->> 'category') = '통계학과', false) AS in_scope FROM s""",
    "context_parts": """SELECT page_id, md5('문서 ' || page_id || ' [출처: pages]:' || chr(10) || CASE WHEN page_id % 3 > 0 THEN '제목: t' || chr(10) ELSE '' END || CASE WHEN page_id % 5 > 0 THEN '' ELSE '게시일: 2024-01-01' || chr(10) END || 'URL: ' || url || chr(10) || '내용:' || chr(10) || substr(html, 1, 200) || chr(10)
|| CASE WHEN page_id % 2 = 0 THEN chr(10) || '첨부파일:' || chr(10) || '- [f](' || url || ')' || chr(10) ELSE '' END) AS part_md5 FROM pages""",
    "session_replay": """SELECT user_id, md5(coalesce(string_agg(substr(event_type, 1, 2) || event_id % 10, '' ORDER BY event_id) FILTER (event_type <> 'purchase'), '')) AS answer_md5, arg_min(substr(event_type, 1, 2) || event_id % 10, event_id) FILTER (event_type = 'purchase') AS error FROM events GROUP BY user_id""",
    "log_updates": """WITH u AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS n FROM lineitem WHERE l_quantity > 40)
SELECT o_orderkey, coalesce(l_extendedprice, o_totalprice) AS price FROM orders LEFT JOIN u ON o_orderkey = l_orderkey AND n = 1""",
}
