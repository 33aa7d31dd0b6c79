"""Queries of cleaning, dates, filters and question understanding, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import dates, text
from docmill.functions.fixed import BOARDS, BODY_DEADLINE, DEADLINE_WORDS, MIN_SCORE, RECENT_PHRASES, RECENT_TOPICS, RECENT_WORDS, ROUTES, STAFF_WORDS, SYNONYMS
from docmill.functions.identity import doc_key
from docmill.functions.where import predicate
from docmill.operators import understanding as ask
from docmill.operators.chunks import keep_first
from docmill.plans.shared import materialise, spread_table, table

QUESTIONS = [
    "오늘 올라온 장학 공지 알려줘", "이번 주 학사일정 알려줘", "컴퓨터공학과 사무실 전화번호", "2024학번 통계학과 교양 교과목", "수강신청 취소는 어떻게 해?", "오늘 학식 메뉴", "마감 임박한 장학금 모집", "어제 일반 공지",
    "내일 시험 기간", "최근 입학공지", "지난 주 행사", "다음주 개강", "지난달 소식", "이번 달 계획", "다음달 일정", "2025년 11월 20일 발표", "2025년 2월 공지", "6월 안에 신청해야 하는 것", "2025년 13월 40일", "그냥 질문",
    "드랍 학고 과목 교양과목 도서관", "23학번 졸업 이수 학점", "재수강 전과 규정", "D-Flex 메뉴", "장학공지 최신", "교수 연락처 번호",
]
#: How an order's date is written: as Spark and as DuckDB format it.
WRITTEN = [("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy.MM.dd.", "%Y.%m.%d."), ("yyyy. M. d", "%Y. %-m. %-d"), ("yyyy'년' M'월' d'일'", "%Y년 %-m월 %-d일"), ("'등록일' yyyy.MM.dd.", "등록일 %Y.%m.%d."), ("yyyy/M/d", "%Y/%-m/%-d"), ("yyyy'.13.'dd", "%Y.13.%d"), ("'없음' MM-dd", "없음 %m-%d")]
MONTH_DAY = ("M'월' d'일'", "%-m월 %-d일")
#: Title and body of a notice: text, and the first or second of its two dates in a form.
NOTICES = [
    (["공지"], ["서류 제출 기한: ", (0, WRITTEN[3]), "(금)까지 제출"]), (["장학 신청 마감 ", (0, MONTH_DAY), " 안내"], ["본문"]), (["안내"], ["수강신청 기간: ", (0, ("yyyy. MM. dd.", "%Y. %m. %d.")), "(화) 10:00 ~ ", (1, ("MM. dd.", "%m. %d.")), "(목)"]),
    (["모집 ~ ", (0, MONTH_DAY)], ["x"]), (["제목"], ["접수기간 ", (0, MONTH_DAY), " - ", (1, MONTH_DAY)]), (["제목"], ["신청 기간: ", (0, WRITTEN[1]), " ~ ", (1, WRITTEN[1])]), (["제목"], ["날짜 없음"]), (["마감 2월 30일"], ["기한 ", (0, ("M/d", "%-m/%-d"))]), (None, None),
]


def _spark_text(parts: list | None, days: list[Column]) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else F.date_format(days[x[0]], x[1][0]) for x in parts)) if parts else F.lit(None).cast("string")


def _sql_text(parts: list | None, days: list[str]) -> str:
    return " || ".join(f"'{x}'" if isinstance(x, str) else f"strftime({days[x[0]]}, '{x[1][1]}')" for x in parts) if parts else "NULL"


def _by(key: Column, values: list[Column]) -> Column:
    """One of values by the key's remainder."""
    out = values[-1]
    for i, v in enumerate(values[:-1]):
        out = F.when(key % len(values) == i, v).otherwise(out)
    return out


def _sql_by(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _pick(values: list, by: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (by % len(values) + 1).cast("int"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message behind one of the questions, asked on some day."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", _pick(QUESTIONS, conv + turn), "text").alias("q"), F.date_add(F.lit("2024-02-20").cast("date"), ((conv * 17 + turn) % 900).cast("int")).alias("as_of"))


def doc_identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("key"))
    return keep_first(docs, ["key"], ["doc_id"])


def doc_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty parts and zeros drop out of a key."""
    return table(spark, sf_dir, "documents").select("doc_id", doc_key(F.col("source"), F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), F.col("doc_id")).alias("key"))


def html_strip_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_markup(F.col("html")).cast("binary")).alias("text_md5"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character references decoded as well; SQL has no function for them."""
    return spread_table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))


def whitespace_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text")).cast("binary")).alias("text_md5"))


def unicode_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").select("doc_id", F.length(text.normalize_unicode(F.col("text"))).alias("n_chars"))


def tokens_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.tokens(F.col("text"))).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def standard_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' dates as written in several ways, two of them no dates, with a later one behind some."""
    key = F.col("o_orderkey")
    raw = _by(key, [F.date_format("o_orderdate", f) for f, _ in WRITTEN])
    later = F.when(key % 5 == 0, F.date_format(F.date_add(F.to_date("o_orderdate"), (key % 90).cast("int")), "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.standard_date(F.concat_ws(" ", raw, later)).alias("day"))


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices of their day, with dates some weeks from it in title or body."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    days = [F.date_add(day, (key % 40 + 1).cast("int")), F.date_add(day, (key % 40 + 8).cast("int"))]
    title, body = (_by(key, [_spark_text(n[i], days) for n in NOTICES]) for i in (0, 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.apply_deadline(title, body, F.when(key % 11 > 0, day)).alias("deadline"))


def date_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _questions(spark, sf_dir).select("conv_id", "turn", "as_of", dates.date_filter(F.col("q"), F.col("as_of")).alias("f"))
    return out.select("conv_id", "turn", F.col("as_of").cast("string").alias("as_of"), F.col("f.start").cast("string").alias("start"), F.col("f.end").cast("string").alias("stop"), F.col("f.label").alias("label"), F.coalesce("f.is_relative", F.lit(False)).alias("is_relative"), F.col("f.relaxed_start").cast("string").alias("relaxed_start"), F.col("f.kind").alias("kind"))


def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", text.expand_synonyms(F.col("q")).alias("expanded"))


def keyword_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(ask.keyword_route(F.col("q")), ",").alias("route"))


def conversation_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message routed; Latin text falls to notices but for the one Latin pattern."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(ask.keyword_route(F.col("text")), ",").alias("route"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _questions(spark, sf_dir).withColumn("route", ask.keyword_route(F.col("q")))
    own = own.select("conv_id", "turn", "route", ask.policy(F.col("q"), F.col("route")).alias("p"), ask.board(F.col("q"), F.col("route")).alias("board"), ask.entry_year(F.col("q")).alias("entry_year"))
    return own.select("conv_id", "turn", F.col("p.name").alias("policy"), F.col("p.min_score").alias("min_score"), F.col("p.allow_recency_override").alias("recency"), "board", F.coalesce("entry_year", F.lit(0)).alias("entry_year"))


def query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First messages of conversations with their expansion and later user messages as searches."""
    talks = table(spark, sf_dir, "conversations").filter("role = 'user'")
    searches = ask.ordered_distinct(talks, "conv_id", "turn", "text")
    first = talks.groupBy("conv_id").agg(F.min_by("text", "turn").alias("raw"))
    out = first.join(searches, "conv_id").select("conv_id", ask.retrieval_queries(F.col("raw"), F.lower("raw"), F.col("values"), F.lit(None).cast("array<string>"), F.concat("raw", F.lit(" please")), F.array(F.lit("extra"))).alias("q"))
    return out.select("conv_id", F.size("q").alias("n"), F.md5(F.array_join("q", "|").cast("binary")).alias("queries_md5"))


def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest nation name inside each part name and type, as one text."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("x"), "c_mktsegment", F.lit(" of "), "c_name").alias("txt"))
    names = table(spark, sf_dir, "customer").select(F.substring("c_mktsegment", 1, 4).alias("name"), F.col("c_mktsegment").alias("value")).union(table(spark, sf_dir, "customer").select("c_mktsegment", F.lit("whole"))).distinct()
    return ask.longest_match(rows, "id", "txt", materialise(names, "names"), "name", "value").select("id", "name", "value")


def where_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"))
    rules = {"a": {"source": "None"}, "b": {"$and": [{"lang": {"$in": ["de", "fr"]}}, {"source": {"$ne": "src1"}}]}, "c": {"$or": [{"nothing": "None"}, {"lang": "xx"}]}, "d": {"lang": {"$gt": "a"}}, "e": {"doc_id": 5}}
    return docs.select("doc_id", *(predicate(r, docs.columns).alias(k) for k, r in rules.items()))


def json_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"name": "'), F.col("event_type"), F.lit('", "url": "u'), F.col("user_id"), F.lit('"}]'))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("")
    files, failed = text.attachments(props)
    return table(spark, sf_dir, "events").select("event_id", F.size(files).alias("n"), F.get(files["url"], F.lit(0)).alias("url"), failed.alias("failed"))


def chunk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), F.col("source"), F.lit("]\n\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.chunk_title(raw).alias("title"))


QUERIES = {f.__name__: f for f in (doc_identity_dedupe, doc_keys, html_strip_regex, html_clean, whitespace_norm, unicode_nfkc, tokens_of_documents, standard_dates, deadlines, date_phrases, synonym_expand, keyword_route, conversation_routes, policies, query_lists, longest_match, where_filter, json_attachments, chunk_titles)}


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


_ASKED = f"(SELECT conv_id, turn, concat_ws(' ', {_list(QUESTIONS)}[(conv_id + turn) % {len(QUESTIONS)} + 1], text) AS q, DATE '2024-02-20' + ((conv_id * 17 + turn) % 900)::INT AS d FROM conversations)"


def _route_sql(q: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower({q}), '{p}') THEN '{n}' END" for n, p in ROUTES)
    return f"coalesce(nullif(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ','), ''), 'notices')"


def _any(words: list[str], q: str = "q") -> str:
    return "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"


def _replaced(q: str) -> str:
    for a, b in SYNONYMS.items():
        q = f"replace({q}, '{a}', '{b}')"
    return q


_D = r"([0-9]{4})\s*[.\-/년]\s*([0-9]{1,2})\s*[.\-/월]\s*([0-9]{1,2})"
_END = r"(?:~|-|–|—|∼|〜)\s*"
_MD = r"([0-9]{1,2})\s*[\-/월]\s*([0-9]{1,2})"
_MD_END = r"([0-9]{1,2})\s*[.\-/월]\s*([0-9]{1,2})"


def _day(y: str, m: str, d: str) -> str:
    return f"try_strptime(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d')::DATE"


def _g(t: str, p: str, i: int) -> str:
    return f"nullif(regexp_extract({t}, '{p}', {i}), '')"


def _later(d: str) -> str:
    return f"CASE WHEN {d} < p THEN try_strptime((year({d}) + 1)::VARCHAR || strftime({d}, '-%m-%d'), '%Y-%m-%d')::DATE ELSE {d} END"

_TITLE = r"(?:~|마감|기한|까지)\s*(?:([0-9]{4})\s*[.\-/년]\s*)?([0-9]{1,2})\s*(?:[.\-/월])\s*([0-9]{1,2})"
_SQ = [
    (r"[ \t\x{00A0}]+", " "), (r"([0-9])\n([가-힣])", r"\1\2"), (r"([가-힣])\n([0-9])", r"\1 \2"), (r"\n([()])", r"\1"), (r"([()])\n", r"\1"), (r"\n([.,!?·])", r"\1"), (r"\n{2,}", r"\x01"), (r"\n", " "), (r"\x01", r"\n"),
    (r"\s*([()])\s*", r"\1"), (r"\s*([.,!?·:/])\s*", r"\1 "), (r"\s{2,}", " "), (r"\s+''|''\s+", "''"), (r"([.!?])\s+([가-힣A-Z0-9])", r"\1\n\2"), (r"^\s+|\s+$", ""),
]


def _squeezed() -> str:
    out = "text"
    for p, r in _SQ:
        by = "chr(10)" if r == r"\n" else "chr(1)" if r == r"\x01" else "'\\1' || chr(10) || '\\2'" if r == r"\1\n\2" else f"'{r}'"
        out = f"regexp_replace({out}, '{p}', {by}, 'g')"
    return out


ORACLES = {
    "doc_identity_dedupe": "SELECT min(doc_id) AS doc_id, sha1(text) AS key FROM documents GROUP BY sha1(text)",
    "doc_keys": "SELECT doc_id, sha1(concat_ws('|', source, CASE WHEN lang <> 'en' THEN lang END, CASE WHEN doc_id <> 0 THEN doc_id END)) AS key FROM documents",
    "html_strip_regex": r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<br\s*/?>', chr(10), 'gi'), '</(p|div|li|tr|h[1-6])>', chr(10), 'gi'), '<[^>]*>', ' ', 'g')) AS text_md5 FROM pages""",
    "whitespace_norm": f"SELECT doc_id, md5({_squeezed()}) AS text_md5 FROM documents",
    "tokens_of_documents": """WITH t AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[가-힣A-Za-z0-9]+'))) AS t FROM documents), g AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, ' ' ORDER BY t)) AS m FROM t WHERE length(t) >= 2 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::INT AS n_tokens, coalesce(m, md5('')) AS tokens_md5 FROM documents d LEFT JOIN g USING (doc_id)""",
    "standard_dates": f"SELECT o_orderkey, strftime({_day(_g('raw', _D, 1), _g('raw', _D, 2), _g('raw', _D, 3))}, '%Y-%m-%d') AS day FROM (SELECT o_orderkey, concat_ws(' ', {_sql_by('o_orderkey', [f"strftime(o_orderdate, '{f}')" for _, f in WRITTEN])}, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate::DATE + (o_orderkey % 90)::INT, '%Y-%m-%d') END) AS raw FROM orders)",
    "deadlines": f"""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate::DATE + (o_orderkey % 40 + 1)::INT AS d1, o_orderdate::DATE + (o_orderkey % 40 + 8)::INT AS d2 FROM orders),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN day END AS p, {_sql_by('o_orderkey', [_sql_text(n[0], ['d1', 'd2']) for n in NOTICES])} AS title, {_sql_by('o_orderkey', [_sql_text(n[1], ['d1', 'd2']) for n in NOTICES])} AS body FROM d),
n AS (SELECT *, regexp_extract(body, '({BODY_DEADLINE})(.*)', 0, 's') AS hit, regexp_extract(body, '(?:{BODY_DEADLINE})((?s).{{0,180}})', 1) AS w FROM o),
c AS (SELECT *, CASE WHEN p IS NOT NULL THEN {_day(f"coalesce({_g('title', _TITLE, 1)}, year(p)::VARCHAR)", _g('title', _TITLE, 2), _g('title', _TITLE, 3))} END AS t,
{_day(_g('w', _END + _D, 1), _g('w', _END + _D, 2), _g('w', _END + _D, 3))} AS e1, {_g('w', _END + _D, 1)} AS e1s, {_day('year(p)::VARCHAR', _g('w', _END + _MD_END, 1), _g('w', _END + _MD_END, 2))} AS e2, {_g('w', _END + _MD_END, 1)} AS e2s,
{_day(_g('w', _D, 1), _g('w', _D, 2), _g('w', _D, 3))} AS s1, {_g('w', _D, 1)} AS s1s, {_day('year(p)::VARCHAR', _g('w', _MD, 1), _g('w', _MD, 2))} AS s2, {_g('w', _MD, 1)} AS s2s FROM n)
SELECT o_orderkey, strftime(coalesce({_later('t')}, CASE WHEN e1s IS NOT NULL THEN e1 WHEN e2s IS NOT NULL AND p IS NOT NULL THEN {_later('e2')} WHEN s1s IS NOT NULL THEN s1 WHEN s2s IS NOT NULL AND p IS NOT NULL THEN {_later('s2')} END), '%Y-%m-%d') AS deadline FROM c""",
    "date_phrases": f"""WITH x AS (SELECT conv_id, turn, q, d::DATE AS a, {_any(DEADLINE_WORDS)} AS dl, date_trunc('week', d::DATE)::DATE AS w, date_trunc('month', d::DATE)::DATE AS m, nullif(regexp_extract(q, '([0-9]{{4}})년\\s*([0-9]{{1,2}})월\\s*([0-9]{{1,2}})일', 1), '') AS fy,
  {_day(_g('q', '([0-9]{4})년' + chr(92) + 's*([0-9]{1,2})월' + chr(92) + 's*([0-9]{1,2})일', 1), _g('q', '([0-9]{4})년' + chr(92) + 's*([0-9]{1,2})월' + chr(92) + 's*([0-9]{1,2})일', 2), _g('q', '([0-9]{4})년' + chr(92) + 's*([0-9]{1,2})월' + chr(92) + 's*([0-9]{1,2})일', 3))} AS f1,
  {_day(_g('q', '([0-9]{4})년' + chr(92) + 's*([0-9]{1,2})월', 1), _g('q', '([0-9]{4})년' + chr(92) + 's*([0-9]{1,2})월', 2), "'1'")} AS f2,
  {_day("year(d::DATE)::VARCHAR", "CASE WHEN NOT regexp_matches(q, '[0-9]월" + chr(92) + "s*[0-9]{1,2}일') THEN " + _g('q', '(?:^|[^0-9])([0-9]{1,2})월', 1) + " END", "'1'")} AS f3 FROM {_ASKED}),
y AS (SELECT *, CASE WHEN dl AND contains(q, '마감') AND contains(q, '임박') THEN 'deadline_imminent' WHEN contains(q, '오늘') THEN 'today' WHEN contains(q, '어제') THEN 'yesterday' WHEN contains(q, '내일') THEN 'tomorrow' WHEN {_any(RECENT_PHRASES)} THEN 'recent'
  WHEN {_any(['지난주', '지난 주'])} THEN 'last_week' WHEN {_any(['이번주', '이번 주'])} THEN 'this_week' WHEN {_any(['다음주', '다음 주'])} THEN 'next_week' WHEN {_any(['지난달', '지난 달'])} THEN 'last_month' WHEN {_any(['이번달', '이번 달'])} THEN 'this_month' WHEN {_any(['다음달', '다음 달'])} THEN 'next_month'
  WHEN f1 IS NOT NULL THEN 'specific_day' WHEN f2 IS NOT NULL OR f3 IS NOT NULL THEN 'specific_month' END AS label FROM x)
SELECT conv_id, turn, a::VARCHAR AS as_of, (CASE label WHEN 'deadline_imminent' THEN a WHEN 'today' THEN a WHEN 'yesterday' THEN a - 1 WHEN 'tomorrow' THEN a + 1 WHEN 'recent' THEN a - 6 WHEN 'last_week' THEN w - 7 WHEN 'this_week' THEN w WHEN 'next_week' THEN w + 7
  WHEN 'last_month' THEN (m - INTERVAL 1 MONTH)::DATE WHEN 'this_month' THEN m WHEN 'next_month' THEN (m + INTERVAL 1 MONTH)::DATE WHEN 'specific_day' THEN f1 WHEN 'specific_month' THEN coalesce(f2, f3) END)::VARCHAR AS start,
(CASE label WHEN 'deadline_imminent' THEN a + 7 WHEN 'today' THEN a WHEN 'yesterday' THEN a - 1 WHEN 'tomorrow' THEN a + 1 WHEN 'recent' THEN a WHEN 'last_week' THEN w - 1 WHEN 'this_week' THEN w + 6 WHEN 'next_week' THEN w + 13
  WHEN 'last_month' THEN m - 1 WHEN 'this_month' THEN last_day(a) WHEN 'next_month' THEN last_day(m + INTERVAL 1 MONTH) WHEN 'specific_day' THEN f1 WHEN 'specific_month' THEN last_day(coalesce(f2, f3)) END)::VARCHAR AS stop,
label, coalesce(label NOT LIKE 'specific%', false) AS is_relative, (CASE label WHEN 'deadline_imminent' THEN a WHEN 'today' THEN a - 2 WHEN 'recent' THEN a - 29 END)::VARCHAR AS relaxed_start, CASE WHEN label IS NOT NULL THEN CASE WHEN dl THEN 'deadline' ELSE 'published' END END AS kind FROM y""",
    "synonym_expand": f"SELECT conv_id, turn, {_replaced('q')} AS expanded FROM {_ASKED}",
    "keyword_route": f"SELECT conv_id, turn, {_route_sql('q')} AS route FROM {_ASKED}",
    "conversation_routes": f"SELECT conv_id, turn, {_route_sql('text')} AS route FROM conversations",
    "policies": f"""WITH r AS (SELECT conv_id, turn, q, string_split({_route_sql('q')}, ',') AS r FROM {_ASKED}),
p AS (SELECT *, CASE WHEN list_contains(r, 'notices') AND {_any(RECENT_TOPICS)} AND {_any(RECENT_WORDS)} THEN 'recent_notices' WHEN list_contains(r, 'staff') AND {_any(STAFF_WORDS)} THEN 'staff_lookup' WHEN list_contains(r, 'courses') AND len(list_filter(r, lambda x: x NOT IN ('courses', 'rules'))) = 0 THEN 'courses'
  WHEN (list_contains(r, 'rules') OR list_contains(r, 'schedule')) AND NOT list_contains(r, 'notices') THEN 'rules_schedule' WHEN list_contains(r, 'notices') THEN 'general_notices' ELSE 'default' END AS policy FROM r)
SELECT conv_id, turn, policy, CASE policy WHEN 'recent_notices' THEN 0.08 WHEN 'staff_lookup' THEN 0.09 WHEN 'courses' THEN 0.05 ELSE {MIN_SCORE} END::DOUBLE AS min_score, policy = 'recent_notices' AS recency,
CASE WHEN list_contains(r, 'notices') THEN CASE {' '.join(f"WHEN contains(q, '{b}') OR contains(q, '{b[:-2]} 공지') THEN '{b}'" for b in BOARDS)} END END AS board,
coalesce(nullif(regexp_extract(q, '(?:^|[^0-9A-Za-z가-힣_])(20[0-9]{{2}})', 1), '')::INT, nullif(regexp_extract(q, '(?:^|[^0-9A-Za-z가-힣_])([0-9]{{2}})\\s*학번', 1), '')::INT + 2000, 0) AS entry_year FROM p""",
    "query_lists": """WITH u AS (SELECT conv_id, text, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id, text), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM u),
a AS (SELECT conv_id, n * 10 AS o, trim(text) AS q FROM n WHERE n <= 3 UNION ALL SELECT conv_id, 1, trim(text) FROM n WHERE n = 1 UNION ALL SELECT conv_id, 2, trim(lower(text)) FROM n WHERE n = 1),
d AS (SELECT conv_id, q, min(o) AS o FROM a WHERE q <> '' GROUP BY conv_id, q), k AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c FROM d),
e AS (SELECT conv_id, q, o FROM k UNION ALL SELECT DISTINCT n.conv_id, trim(text || ' please'), 1000 FROM n JOIN k ON n.conv_id = k.conv_id AND c < 3 WHERE n.n = 1),
f AS (SELECT conv_id, q, min(o) AS o FROM e GROUP BY conv_id, q), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS n FROM f), h AS (SELECT conv_id, q, n FROM g WHERE n <= 3 UNION ALL SELECT DISTINCT conv_id, 'extra', 9 FROM g)
SELECT conv_id, count(*)::INT AS n, md5(string_agg(q, '|' ORDER BY n)) AS queries_md5 FROM h GROUP BY conv_id""",
    "longest_match": """WITH names AS (SELECT DISTINCT substr(c_mktsegment, 1, 4) AS name, c_mktsegment AS value FROM customer UNION SELECT c_mktsegment, 'whole' FROM customer),
m AS (SELECT c_custkey AS id, name, value, row_number() OVER (PARTITION BY c_custkey ORDER BY length(name) DESC, name, value) AS n FROM customer JOIN names ON contains('x' || c_mktsegment || ' of ' || c_name, name))
SELECT c_custkey AS id, name, value FROM customer LEFT JOIN m ON c_custkey = id AND n = 1""",
    "where_filter": """WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 > 0 THEN source END AS source FROM documents)
SELECT doc_id, source IS NULL AS a, lang IN ('de', 'fr') AND coalesce(source, 'None') <> 'src1' AS b, true AS c, false AS d, doc_id = 5 AS e FROM d""",
    "json_attachments": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id END AS url, event_id % 3 = 1 AS failed FROM events""",
    "chunk_titles": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source WHEN text LIKE '[%' AND contains(text, ']') THEN trim(split_part(substr(text, 2), ']', 1)) ELSE substr(trim(split_part(text, chr(10), 1)), 1, 120) END AS title FROM documents""",
}
