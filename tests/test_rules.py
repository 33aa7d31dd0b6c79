"""Golden values of the scalar rules and operators."""

import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from docmill.functions import dates, identity, text
from docmill.functions.where import predicate
from docmill.operators import chunks, ranking, reports, retrieval, understanding
from docmill.plans.shared import table
from docmill.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw", ["2026-06-05", "2026.06.05", "2026.06.05.", "2026.6.5", "2026. 06. 05", "2026년 6월 5일"])
def test_standard_date(spark, raw):
    assert one(spark, dates.standard_date(F.lit(raw))) == "2026-06-05"


@pytest.mark.parametrize("raw", ["2026.13.45", "없음", None, ""])
def test_no_date(spark, raw):
    assert one(spark, dates.standard_date(F.lit(raw).cast("string"))) is None


@pytest.mark.parametrize(
    "title, body, published, want",
    [
        ("공지", "서류 제출 기한: 2026년 7월 5일(금)까지", "2026-06-19", "2026-07-05"),
        ("신청 마감 6월 21일 안내", "", "2026-06-10", "2026-06-21"),
        ("안내", "수강신청 기간: 2026. 05. 14.(화) 10:00 ~ 05. 16.(목)", "2026-05-01", "2026-05-16"),
        ("모집 ~ 1월 5일", "", "2026-12-20", "2027-01-05"),
    ],
)
def test_deadline(spark, title, body, published, want):
    assert one(spark, dates.apply_deadline(F.lit(title), F.lit(body), F.lit(published).cast("date"))) == want


def test_markup_and_unicode(spark):
    got = one(spark, text.clean_text(F.lit("<p>공지</p><script>alert(1)</script><style>a{color:red}</style>본문")))
    assert "공지" in got and "본문" in got and "alert" not in got and "color" not in got
    got = one(spark, text.clean_text(F.lit("<p>A&nbsp;&amp;&lt;B&gt;</p>")))
    assert "&nbsp;" not in got and "&amp;" not in got and "&" in got
    raw = "（１２３）​끝"
    assert one(spark, text.normalize_unicode(F.lit(raw))) == unicodedata.normalize("NFKC", raw).replace("​", "")
    assert one(spark, text.normalize_whitespace(F.lit("10:30 http://a"))) == "10: 30 http: / / a"
    assert one(spark, text.normalize_whitespace(F.lit("끝났다. 다음"))) == "끝났다.\n다음"


def test_identity(spark):
    import hashlib

    key = lambda *p: one(spark, identity.doc_key(*map(F.lit, p)))
    assert key("a", "", "b") == key("a", "b") == hashlib.sha1(b"a|b").hexdigest()
    assert key("a", 0) == key("a")
    assert one(spark, identity.chunk_key(F.lit("d"), F.lit(3))) == hashlib.sha1(b"d|3").hexdigest()


def test_tokens(spark):
    got = one(spark, text.tokens(F.lit("졸업요건은 Hello 장학금을")))
    assert got == ["졸업요건은", "졸업요건", "졸업", "업요", "요건", "졸업요", "업요건", "hello", "장학금을", "장학금"]
    assert one(spark, text.tokens(F.lit("a b"))) == []


def test_small_rules(spark):
    assert one(spark, text.expand_synonyms(F.lit("교과목 교양과목"))) == "교교과목 교양과목교과목"
    assert one(spark, text.first_filled(F.lit(" "), F.lit("nan"), F.lit(" x "))) == "x"
    assert [one(spark, text.truthy(F.lit(v))) for v in ("Y", "고정", "no")] == [True, True, False] and one(spark, text.truthy(F.lit(None).cast("string"))) is False
    assert one(spark, text.article_id(F.lit("/x/detail/77?y"))) == 77 and one(spark, text.article_id(F.lit("/x"))) is None
    assert [one(spark, text.grade_label(F.lit(v))) for v in ("학사2년", "학사1, 2년", "전체")] == ["2학년", "1학년, 2학년", "전체"]
    assert [one(spark, text.phone_like(F.lit(v))) for v in ("02-770-2773", "770-2773", "12")] == [True, True, False]
    assert one(spark, text.chunk_title(F.lit("[장학 공지]\n\n본문"))) == "장학 공지" and one(spark, text.chunk_title(F.lit("첫 줄\n둘"))) == "첫 줄"
    assert one(spark, text.money_per_million(F.lit(1000), F.lit(500), 1.0, 2.0)) == 0.002 and one(spark, text.money_per_million(F.lit(1), F.lit(1), None, 2.0)) is None
    assert one(spark, text.unfenced(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.homepage_url(F.lit("https://Stat.Uni.edu/x"), ".uni.edu", ["www.uni.edu"])) is True
    assert one(spark, text.homepage_url(F.lit("ftp://stat.uni.edu"), ".uni.edu", [])) is False
    assert one(spark, text.slug(F.lit(" 통계 학과! "))) == "통계-학과" and one(spark, text.slug(F.lit("!"))) == "unknown"


@pytest.mark.parametrize(
    "rule, want",
    [({"a": {"$eq": "x"}}, True), ({"a": {"$eq": "y"}}, False), ({"b": {"$eq": "x"}}, False), ({"a": {"$in": ["x", "z"]}}, True), ({"a": {"$in": ["z"]}}, False), ({"a": {"$ne": "y"}}, True),
     ({"$and": [{"a": "x"}, {"n": 1}]}, True), ({"$and": [{"a": "x"}, {"n": 2}]}, False), ({"$or": [{"a": "y"}, {"n": 1}]}, True), ({"$or": [{"a": "y"}]}, False), ({"a": {"$gt": "a"}}, False), ({}, True), (None, True)],
)
def test_where(spark, rule, want):
    df = spark.createDataFrame([("x", 1)], "a string, n int")
    assert (df.filter(predicate(rule, df.columns)).count() == 1) is want


def test_chunks(spark):
    body = " ".join(f"문장 {i}입니다." for i in range(100))
    df = spark.createDataFrame([("d", "장학 공지", body), ("e", None, "short"), ("f", "t", None), ("g", "t", "  ")], "doc_id string, title string, text string")
    got = chunks.to_chunks(df, 200, 50, "title").collect()
    own = [r for r in got if r.doc_id == "d"]
    assert len(own) > 1 and all(len(r.chunk_text) <= 220 and r.chunk_text.startswith("[장학 공지]\n\n") for r in own)
    assert [r.position for r in own] == list(range(len(own))) and {r.doc_id for r in got} == {"d", "e"}
    assert [r.chunk_text for r in got if r.doc_id == "e"] == ["short"]
    wide = {r.position: r.context for r in chunks.with_neighbours(chunks.to_chunks(df, 200, 50, "title")).filter("doc_id = 'd'").collect()}
    assert wide[1].count("[장학 공지]") == 1 and len(wide[1]) > 500


def test_dataset_documents(spark):
    notices = spark.createDataFrame([("제목", "", "2026.06.05", "장학공지", "http://x", None), ("신청 마감 6월 21일", "<p>본문</p>", "2026-06-10", "", "", "[]"), (None, None, None, None, None, None)], "title string, content string, date string, board string, url string, attachments string")
    got = chunks.notice_documents(notices).collect()
    assert len(got) == 2 and "공지 제목: 제목" in got[0].text and "http://x" in got[0].text and got[0].attachments == "[]"
    assert got[1].apply_deadline == "2026-06-21" and got[1].text.startswith("[게시일: 2026-06-10]")
    rows = spark.createDataFrame([("A1", "통계", "", "3")], "code string, title string, note string, credit string")
    assert chunks.labelled_documents(rows, ["code"], ["title"], "courses").first().text == "code: A1\n통계\ncredit: 3"
    events = spark.createDataFrame([("2026", "학사", "개강", "학사팀", "2026-03-02", "2026-03-02")], "year string, division string, content string, department string, start string, end string")
    assert chunks.schedule_documents(events).first().text == "일정: 개강\n기간: 2026-03-02\n주관부서: 학사팀"
    meals = spark.createDataFrame([(datetime.date(2026, 6, 10), "r", "b", "0"), (datetime.date(2026, 6, 10), "r", "a", "0"), (datetime.date(2026, 6, 10), "s", "x", "true")], "date date, restaurant string, menu_text string, is_closed string")
    assert sorted((r.title, r.text, r.is_closed) for r in chunks.meal_documents(meals).collect()) == [("r", "2026-06-10 r\na", 0), ("s", "2026-06-10 s\n휴무", 1)]
    rules = spark.createDataFrame([("a/b", "f.hwp", "<b>규정</b>", 2024, "졸업", None)], "relative_dir string, filename string, text string, entry_year int, section string, college_name string")
    assert tuple(chunks.rule_documents(rules).first())[1:] == ("졸업", "규정", "a/b", "2024", "rules")
    assert chunks.dataset_chunks(chunks.meal_documents(meals), "meals").count() == 2


def test_retrieval_small(spark):
    docs = spark.createDataFrame([("c1", "졸업 요건 변경 안내"), ("c2", "장학금 신청 안내")], "id string, text string")
    vocab, index = retrieval.sparse_index(docs, "id")
    asked = spark.createDataFrame([(1, "졸업요건은")], "request int, query string")
    got = {r.id: r.sparse_score for r in retrieval.sparse_scores(asked, vocab, index, "request", "id").collect()}
    assert got["c1"] > 0 and "c2" not in got
    vectors = spark.createDataFrame([("c1", [0.0, 1.0]), ("c2", [1.0, 0.0])], "id string, embedding array<float>")
    near = spark.createDataFrame([(1, [0.0, 1.0])], "request int, embedding array<float>")
    dense = retrieval.dense_scores(near, vectors, "request", "id", 1)
    assert [tuple(r) for r in dense.collect()] == [(1, "c1", 1.0)]
    twice = docs.union(docs).withColumn("major", F.col("id"))
    hits = retrieval.hybrid(dense, retrieval.sparse_scores(asked, vocab, index, "request", "id"), twice, "request", "id").collect()
    assert [r.id for r in hits] == ["c1"] and hits[0].vector_score == 1.0 and hits[0].sparse_score > 0
    none = retrieval.hybrid(dense, retrieval.sparse_scores(asked, vocab, index, "request", "id"), twice, "request", "id", keep=predicate({"major": "zz"}, twice.columns))
    assert none.count() == 0
    assert [one(spark, retrieval.similarity(F.lit(d), s)) for d, s in ((0.4, "cosine"), (0.4, "l2"), (1.5, "cosine"))] == [0.6, 0.8, 0.0]


def test_dense_blocks_equal_one_block(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(50, 8))
    rows = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    asked = rows.select(F.col("id").alias("request"), "embedding")
    want = sorted(map(tuple, retrieval.dense_scores(asked, rows, "request", "id", 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, retrieval.dense_scores(asked, rows, "request", "id", 3).collect())) == want and len(want) == 150


def test_date_filter(spark):
    d = datetime.date
    hits = spark.createDataFrame([(1, "in", d(2026, 6, 19), 3), (1, "undated", None, 2), (1, "old", d(2026, 5, 1), 1), (2, "u", None, 1), (2, "old", d(2026, 5, 1), 2)], "r int, id string, day date, s int").withColumns({"a": F.lit("2026-06-18").cast("date"), "b": F.lit("2026-06-20").cast("date")})
    got = retrieval.date_filtered(hits, "r", [F.desc("s")], "day", "a", "b", 5).collect()
    assert sorted((r.r, r.id, r.date_unknown_auxiliary, r.eliminated) for r in got) == [(1, "in", 0, False), (1, "undated", 1, False), (2, "u", 1, True)]


def test_ranking(spark):
    now = F.lit("2026-06-10").cast("timestamp_ntz")
    base = "request int, id string, dataset string, hybrid_score double, sort_date string, matched_query_count int, date_unknown_auxiliary int, is_closed int, source_type string, entry_year string, own_major boolean, guide_intent boolean, asked_year int"
    rows = [(1, "n", "notices", 0.5, "2024-01-01", 1, 0, 0, None, None, False, False, None), (1, "c", "courses", 0.5, None, 1, 0, 0, None, None, False, False, None), (2, "x", "notices", 0.2, None, 1, 0, 0, None, None, False, False, None)]
    got = ranking.final_scores(spark.createDataFrame(rows, base).withColumn("sort_date", F.col("sort_date").cast("timestamp_ntz")), "request", now)
    by = {r.id: r for r in got.collect()}
    assert by["c"].final_score > by["n"].final_score and by["x"].norm_hybrid == 0.2 and by["x"].final_score < 1
    hits = spark.createDataFrame([(1, 1, "notices", "학사 안내"), (1, 2, "notices", "장학 안내"), (2, 1, "rules", "장학")], "r int, n int, dataset string, t string")
    assert {r.r: r.aligned for r in ranking.topic_aligned(hits, "r", "n", "t", ["장학"]).collect()} == {1: True, 2: False}


def test_understanding(spark):
    college = understanding.department_map(spark.createDataFrame([("통계학과", "이과대학"), ("학과", "대학"), ("국어국문 통계학과", "문과대학"), ("", "x")], "department_name string, college_name string"))
    asked = spark.createDataFrame([(1, "국어국문 통계학과 졸업"), (2, "통계학과"), (3, "없음")], "id int, q string")
    got = {r.id: r.college for r in understanding.longest_match(asked, "id", "q", college, "department", "college").collect()}
    assert got == {1: "문과대학", 2: "이과대학", 3: None}
    scope = lambda q, m, o, n: one(spark, understanding.scope_queries(*(F.lit(x).cast("string") for x in (q, m, o, n))))
    assert scope("졸업요건", "통계학과", "이과대학", None) == ["통계학과 졸업기준", "이과대학 졸업기준"]
    assert scope("통계학과 장학", None, None, "이과대학") == ["이과대학"] and scope("날씨", "Default", "이과대학", None) == []
    route = lambda i, r, s, q: one(spark, understanding.merged_route(F.lit(i), F.array(*map(F.lit, r)), F.array(*map(F.lit, s)) if s else F.lit(None).cast("array<string>"), F.lit(q)))
    assert route("courses", ["notices"], ["staff"], "졸업 이수") == ["courses", "notices", "staff", "rules"]
    assert route("unknown", ["schedule"], [], "x") == ["schedule"]
    assert one(spark, understanding.school_info(F.lit("장 학 금"))) is True and one(spark, understanding.scope_label(F.lit("a"), F.lit("b"))) == "a (b)"
    assert one(spark, understanding.cacheable(F.array(F.lit("rules")), F.lit(False), F.lit(False), F.lit(None).cast("boolean"), F.lit("x"))) is True
    assert one(spark, understanding.scope_filter(F.lit("courses"), F.lit("m"), F.lit("c"), F.lit("z"), F.lit("c"))) is True


def test_evaluation(spark):
    rows = spark.createDataFrame([("notices", "1", "1", "0.5", "0", "0.5"), (None, "0", "0", "x", "1", None)], "dataset string, hit string, context_recall_proxy string, keyword_score string, fallback string, top_hybrid_score string")
    all_of = reports.evaluation(rows).first()
    assert (all_of.route_hit_rate, all_of.answer_relevancy_proxy, all_of.fallback_rate, all_of.avg_top_hybrid_score) == (0.5, 0.5, 0.5, 0.5)
    assert {r.dataset for r in reports.evaluation(rows, "dataset").collect()} == {"notices", None}
    gates = {r.metric: r.passed for r in reports.gates(reports.evaluation(rows), {"route_hit_rate": 0.8, "fallback_rate": 0.2, "answer_relevancy_proxy": 0.2}).collect()}
    assert gates == {"route_hit_rate": False, "fallback_rate": False, "answer_relevancy_proxy": True}


def test_parsed_text(spark):
    html = "<html><head><title>t</title></head><body><p>공지 <b>A</b>&amp;B</p><!-- c --><script>alert(1)</script>tail<noscript>n</noscript></body></html>"
    got = [r[0] for r in spark.createDataFrame([(html,), ("plain",), ("  ",), (None,), ("a &lt; b",)], "h string").select(text.parsed_text(F.col("h"))).collect()]
    assert got == ["공지 \nA\n&B\ntail", "plain", "", "", "a < b"]


def test_many_names_and_few_give_the_same_match(spark):
    rows = spark.createDataFrame([(1, "the 통계학과 office"), (2, "통계 and 학과"), (3, None), (4, "")], "id long, t string")
    names = spark.createDataFrame([("통계학과", "b"), ("통계학과", "a"), ("통계", "c"), ("학과", "d"), ("", "e")], "name string, value string")
    few = {tuple(r) for r in understanding.longest_match(rows, "id", "t", names, "name", "value").collect()}
    many = {tuple(r) for r in understanding.longest_by_parts(rows, "id", "t", names.filter("name != ''"), "name", "value").collect()}
    assert few == many == {(1, "the 통계학과 office", "통계학과", "a"), (2, "통계 and 학과", "통계", "c"), (3, None, None, None), (4, "", None, None)}


def test_contexts_without_shuffle_equal_windows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("title"))
    want = chunks.with_neighbours(chunks.to_chunks(docs, 200, 50, "title")).select("doc_id", "position", "chunk_text", "context")
    assert sorted(map(tuple, chunks.chunks_in_context(docs, 200, 50, "title").collect())) == sorted(map(tuple, want.collect()))


def test_versioned_table(spark, tmp_path):
    path, cache = str(tmp_path / "t"), {}
    spark.range(3).write.parquet(path)
    first = files.read_versioned(spark, path, cache)
    assert files.read_versioned(spark, path, cache) is first and first.count() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert files.read_versioned(spark, path, cache).count() == 5


def test_index_folder_needs_its_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        retrieval.read_index(spark, str(tmp_path), ["metadata"])
    vocab = spark.createDataFrame([("a", 1, 1.0)], "term string, df long, idf double")
    retrieval.write_index(vocab, vocab, str(tmp_path), "d", "2026-01-01")
    assert retrieval.read_index(spark, str(tmp_path), ["vocabulary", "postings"])[2].count() == 0
    assert [r.version for r in retrieval.read_index(spark, str(tmp_path), ["vocabulary", "postings", "metadata"])[2].collect()] == [retrieval.INDEX_VERSION]
