import datetime

from pyspark.sql import functions as F

from docmill.functions import catalogue
from docmill.operators import admin


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_catalogue_rules(spark):
    like = lambda t: one(spark, catalogue.department_like(F.lit(t)))
    assert [like(t) for t in ("통계학과", "국어교육과 바로가기", "대학원 통계학과", "과", "학과소개", "Department of X", "행사")] == [True, True, False, False, False, True, False]
    assert one(spark, catalogue.college_like(F.lit("이과대학"))) is True and one(spark, catalogue.clean_name(F.lit(" 통계 학과  홈페이지 바로가기"))) == "통계 학과"
    u = lambda *a: [F.lit(x) for x in a]
    assert one(spark, catalogue.valid_row(*u("통계학과", "https://stat.uni.edu", "이과대학"), ["www.uni.edu"])) is True
    assert one(spark, catalogue.valid_row(*u("통계학과", "https://www.uni.edu", "이과대학"), ["www.uni.edu"])) is False
    assert one(spark, catalogue.internal_url(*u("https://a.x.org", "https://b.uni.edu/p"), ".uni.edu")) is True
    same = lambda a, b: one(spark, catalogue.same_page(*u(a, b)))
    assert same("https://a.org/x/", "https://a.org/x") is True and same("https://a.org/x", "https://a.org/x?q=1") is False
    kind = lambda a, b: one(spark, catalogue.source_type(*u(a, b)))
    assert [kind("총괄표", "https://a/x.pdf"), kind("a", "https://a/article/1"), kind("교과목 해설", "u"), kind("총괄표", "u"), kind("a", "u")] == ["pdf_curriculum", "reference_article", "course_description", "curriculum_table", "curriculum_page"]
    usable = lambda a, b: one(spark, catalogue.usable_candidate(F.lit("https://a.org/"), *u(a, b)))
    assert [usable("교육과정", "https://a.org/c"), usable("수강신청", "https://a.org/c"), usable("교육과정", "https://a.org"), usable("이수체계도", "https://a.org"), usable("x", "https://a.org/notice/1")] == [True, False, False, True, False]
    assert tuple(one(spark, catalogue.candidate_score(F.lit("https://a.org/"), *u("이수체계도 해설", "https://a.org/cur")))) == (8, 4, -8)


def test_submissions(spark):
    rows = [(1, "event", '{"title": "t", "start_date": "2026-05-01", "end_date": "2026-05-02", "location": "홀", "department": "통계학과"}'), (2, "custom_knowledge", '{"question": "q", "answer": "a", "category": "수학과", "department": "x"}'), (3, "announcement", '{"title": "t", "content": " "}'), (4, "other", "{}"), (5, "event", "nope"), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, kind string, data string")
    bad = {r.id: r.p for r in df.select("id", admin.submission_problem(F.col("kind"), F.col("data")).alias("p")).collect()}
    assert bad == {1: None, 2: None, 3: "missing: content", 4: "unknown type", 5: "not a JSON object", 6: "unknown type"}
    got = {r.id: r for r in admin.submission_notices(df.filter("id < 3"), F.lit(datetime.date(2026, 6, 1))).collect()}
    assert got[1].content == "일시: 2026-05-01 ~ 2026-05-02\n\n장소: 홀\n\n주관: 통계학과" and got[1].date == "2026-05-01"
    assert (got[2].board, got[2].title, got[2].content, got[2].date) == ("학과지식", "q", "a\n\n주관: 수학과", "2026-06-01")
    scope = {r.id: r.s for r in df.select("id", admin.in_scope(F.col("data"), F.lit("통계학과")).alias("s")).collect()}
    assert scope == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_replies(spark):
    assert tuple(one(spark, admin.grounding(F.lit('```json\n{"score": 1.7}\n```'), 0.5))) == (True, True, 1.0)
    assert tuple(one(spark, admin.grounding(F.lit("broken"), 0.5))) == (False, True, None)
    assert one(spark, admin.followups(F.lit('["a", " a ", "q", "", "b", "c", "d"]'), F.lit("q"))) == ["a", "b", "c"] and one(spark, admin.followups(F.lit("x"), F.lit("q"))) == []
    part = one(spark, admin.context_part(F.lit(1), F.lit("notices"), F.lit("t"), F.lit("nan"), F.lit("u"), F.lit("body"), F.lit('[{"name": "f", "url": "l"}]')))
    assert part == "문서 1 [출처: notices]:\n제목: t\nURL: u\n내용:\nbody\n\n첨부파일:\n- [f](l)\n"


def test_grouping(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["머리말", "바이오대학", "a", "공과대학 (2260-1)", "b", "[공과대학]", "c", "공과대학 안내"])], "d int, i int, t string")
    assert [tuple(r)[1:] for r in admin.grouped_sections(lines, "d", "i", "t", ["공과대학", "바이오대학"]).orderBy("body").collect()] == [("공과대학", "[공과대학]\nc\n공과대학 안내"), ("공과대학", "공과대학 (2260-1)\nb"), ("", "머리말"), ("바이오대학", "바이오대학\na")]
    rows = spark.createDataFrame([(1, 1, "STA2001", "통계", "Stat", "첫"), (1, 2, "", "", "", "둘"), (1, 3, "선수", "", "", ""), (1, 4, "STA2002", "b", "", "x"), (1, 5, "", "무코드", "", "y")], "g int, i int, code string, title string, en string, txt string")
    got = [(r.code, r.title, r.txt) for r in admin.merged_descriptions(rows, "g", "i", "code", "title", "en", "txt").orderBy("txt").collect()]
    assert sorted(got) == sorted([("STA2001", "통계", "첫 둘 (선수)"), ("STA2002", "b", "x"), ("", "무코드", "y")])
    events = spark.createDataFrame([("s", 1, '{"type": "text", "content": "he"}'), ("s", 3, '{"type": "error", "message": "bad"}'), ("s", 2, '{"type": "text", "content": "llo"}'), ("t", 1, '{"type": "text", "content": "x"}')], "s string, i int, p string")
    assert sorted(map(tuple, admin.replayed(events, "s", "i", "p").collect())) == [("s", "hello", "bad"), ("t", "x", None)]


def test_logs(spark):
    answers, hits = spark.createDataFrame([("r", "q"), ("n", "q")], "request string, question string"), spark.createDataFrame([("r", 2, 0.1), ("r", 1, 0.4)], "request string, place int, hybrid_score double")
    log, rows = admin.log_rows(answers, hits, "request", "place")
    assert sorted((r.request, r.top_hybrid_score, r.source_count) for r in log.collect()) == [("n", None, 0), ("r", 0.4, 2)] and rows.count() == 2
    updates = spark.createDataFrame([("r", 1, 0.2), ("r", 2, 0.9)], "request string, at int, grounding_score double")
    assert {r.request: r.grounding_score for r in admin.with_updates(log, updates, "request", "at", ["grounding_score"]).collect()} == {"r": 0.9, "n": None}
    guide = spark.createDataFrame([("r", "entry_year_guide_pdf", "2023", None, True), ("r", "entry_year_guide_pdf", "2024", None, True), ("n", "x", "2025", None, True)], "request string, source_type string, entry_year string, asked int, courses boolean")
    assert [tuple(r) for r in admin.guide_prefix(guide, "request", "asked", "courses").collect()] == [("r", 2024)]
