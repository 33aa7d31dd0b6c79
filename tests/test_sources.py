import hashlib

from pyspark.sql import functions as F

from docmill.sources import files, pages


def test_csv_with_mark_and_nulls(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿학수번호,교과목명\nA1,"x\ny"\nA2,\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["학수번호", "교과목명"] and sorted(map(tuple, got.collect())) == [("A1", "x\ny"), ("A2", "")]
    assert [tuple(r)[:2] for r in files.load_courses(spark, str(tmp_path / "a.csv")).orderBy("course_code").collect()] == [("A1", "x\ny"), ("A2", "")]


def test_records_and_manifest(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"title": "t"}\nbroken\n')
    got = files.read_records(spark, str(tmp_path / "j"), "title string").cache()
    assert sorted((r.title or "", r._corrupt or "") for r in got.collect()) == [("", "broken"), ("t", "")]
    hashes = files.file_hashes(spark, str(tmp_path / "j"))
    good = hashlib.sha256((tmp_path / "j" / "a.json").read_bytes()).hexdigest()
    listed = lambda h: spark.createDataFrame([("a.json", h)], "name string, sha256 string")
    none = listed("x").filter("false")
    accepted = lambda m, strict=False: [r.accepted for r in files.verified(hashes, m, strict).collect()]
    assert accepted(listed(good)) == [True] and accepted(listed("bad")) == [False]
    assert accepted(none) == [True] and accepted(none, True) == [False]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("notices", "1", "2024-03-01", "active", "notices:a/b"), ("rules", "2", "", "hidden", "k")], "dataset string, source_id string, published_at string, status string, document_key string")
    files.write_chunks(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("dataset = 'rules'").count() == 1
    files.write_raw(df, str(tmp_path / "r"), F.lit("2020-02-02"))
    assert {(r.year, r.month) for r in spark.read.json(str(tmp_path / "r")).collect()} == {(2024, 3), (2020, 2)}
    files.export_active(df, str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 1
    assert files.non_empty_columns(df.withColumn("empty", F.lit(" "))) == df.columns
    kept = files.refresh_dataset(df, df.filter("source_id = '2'").withColumn("more", F.lit(1)), F.col("dataset") == "notices")
    assert sorted((r.source_id, r.more) for r in kept.collect()) == [("1", None), ("2", 1)]


PAGE = """<h2>Term <b>1</b></h2><table><caption>2026학년도</caption><tr><th>기간</th><th>내용</th></tr>
<tr><td>2026.03.02 ~ 2026. 3. 9</td><td>개강 (주관부서 : 학사팀) 바로가기</td></tr><tr><td>x</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>
<strong>B</strong><table><tr><td>only</td></tr></table>"""


def test_tables_and_schedule(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>")], "id long, html string")
    got = [tuple(r) for r in pages.tables(df, "id").collect()]
    assert got[0] == (1, "1", "Term 1", "2026학년도", ["기간", "내용"], ["2026.03.02 ~ 2026. 3. 9", "개강 (주관부서 : 학사팀) 바로가기"])
    assert got[1][-1] == ["x", ""] and got[2][-1] == ["1", "2"] and got[3] == (1, "2", "B", "", ["col_1"], ["only"])
    assert [tuple(r) for r in pages.schedule_rows(df, "id").collect()] == [(1, "2026", "개강", "학사팀", "2026-03-02", "2026-03-09")]
    score = pages.relevance(F.col("header"), F.array_join("cells", " "), ["내용", "only"])
    assert [r[0] for r in pages.tables(df, "id").select(score).collect()] == [3, 3, 3, 1]
    assert spark.range(1).select(pages.canonical(F.lit("국문 교과목명"), {"title": ["교과목명"], "x": ["국문"]})).first()[0] == "title"


def test_meals(spark):
    df = spark.createDataFrame([(1, "6/10 식당가 (본관)\n중식 비빔밥 5,500원\n식당나 휴무\n※ 안내 5,000")], "id long, t string")
    got = [tuple(r) for r in pages.meal_blocks(df, "id", "t", ["식당나", "식당가"]).collect()]
    assert got == [(1, "식당가", "중식 비빔밥 5,500원", False), (1, "식당나", "휴무", True)]


def listing(*items):
    rows = "".join(f'<li><a onclick="goDetail({i})"><div class="mark">{"<span class=fix>x</span>" if pin else ""}</div><div class="top"><em>c</em></div><p class="tit">T {i}</p><div class="info"><span>{d}.</span><span>9</span></div></a></li>' for i, d, pin in items)
    return f'<div class="board_list"><ul>{rows}</ul></div>'


def test_board(spark):
    first = listing((1, "2020.01.01", True), (10, "2026.06.01", False), (11, "2026.05.30", False), (10, "2026.06.01", False))
    second = listing(*((20 + i, "2021.01.01", False) for i in range(5)), (30, "2026.01.01", False))
    df = spark.createDataFrame([("b", 1, first), ("b", 2, second)], "board string, page int, html string")
    items = pages.board_list(df, "board", "page")
    assert [r.posted_at for r in items.filter("page = 1").orderBy("place").collect()] == ["2020-01-01", "2026-06-01", "2026-05-30", "2026-06-01"]
    known = spark.createDataFrame([("b", 11)], "board string, article_id long")
    assert [r.article_id for r in pages.collected(items, known, "board", 2023).collect()] == [10]
    assert sorted(r.article_id for r in pages.collected(items, known.filter("false"), "board", 2023, 99).collect()) == [10, 11, 30]
    details = spark.createDataFrame([("b", 11, "text")], "board string, article_id long, content string")
    assert {(r.article_id, r.content) for r in pages.with_details(items.filter("article_id in (10, 11)"), details, ["board", "article_id"]).collect()} == {(10, ""), (11, "text")}


def test_reshaping(spark):
    week = spark.createDataFrame([("m", "a", "b")], "k string, mon string, tue string")
    assert [tuple(map(str, r)) for r in pages.unpivot_days(week, ["k"], {"mon": "2026-06-08", "tue": "2026-06-09"}).select("k", "date", "menu").collect()] == [("m", "2026-06-08", "a"), ("m", "2026-06-09", "b")]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["intro", "# A", "x", "y", "# B", "z"])], "d long, i long, t string")
    assert sorted(map(tuple, pages.sections(lines, "d", "i", "t", "^#").collect())) == [(1, "# A", "x\ny"), (1, "# B", "z")]
    assert spark.range(1).select(pages.without_repeats(F.lit("a\na\n12\nb\na"), ["^[0-9]+$"])).first()[0] == "a\nb\na"


def test_last_homepage_of_several_files(spark, tmp_path):
    for name, rows in (("b.csv", ["d1,u3,c3", "d2,u4,c4"]), ("a.csv", ["d1,u1,c1", "d1,u2,c2", " d3 ,u5,c5"])):
        (tmp_path / name).write_text("department_name,department_url,college_name\n" + "\n".join(rows) + "\n")
    got = sorted(tuple(r) for r in files.homepages(spark, str(tmp_path)).collect())
    assert got == [("d1", "u3", "c3"), ("d2", "u4", "c4"), ("d3", "u5", "c5")]


def test_detail_pages(spark):
    from docmill.sources import details

    post = "<div class='board_view x'><div class=tit><p>A <i>b</i></p><div class=info><span>등록일 2026.02.30.</span><span>조회수 12회</span></div></div><div class=view_cont>one<br> two <script>no</script></div></div>"
    df = spark.createDataFrame([(1, post), (2, None), (3, "<p>no post</p>"), (4, "<div class=board_view>"), (1, post)], "k long, html string")
    got = sorted((r["k"], r["title"], r["posted_at"], r["views"], r["content"], len(r["attachments"]), r["parsed"]) for r in details.detail_pages(df, "k", "https://x.example").collect())
    assert got == [(1, "A b", None, 12, "one\ntwo", 0, True)] * 2 + [(2, None, None, None, "", 0, False), (3, None, None, None, "", 0, False), (4, "", None, None, "", 0, True)]
