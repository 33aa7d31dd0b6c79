"""Course pages: which kind of records a page gives."""

from html.parser import HTMLParser

from docmill.sources import cascade

TABLE = "<table><tr><th>교과목명</th><th>학점</th></tr><tr><td>Algebra</td><td>3</td></tr><tr><td></td><td> </td></tr><tr><td></td><td>2</td><td>cut</td></tr></table>"
HEADS = "<div id=content><h3>Aims</h3>loose<p>학점 one</p><span>no</span><ul><li>two</li></ul><h4>Next</h4><p>three. four</p><h3>Popup Zone</h3><p>학점</p><h3>Empty</h3></div>"


def records(spark, html, department=None):
    df = spark.createDataFrame([(1, html, department, "x")], "k long, html string, dept string, title string")
    rows = cascade.course_records(df, "k", department="dept").orderBy("place").collect()
    return {r["record_type"] for r in rows}, [(r["section"], r["title"], r["text"]) for r in rows]


def test_priority(spark):
    kind, rows = records(spark, f"<h2>Courses</h2>{TABLE}{HEADS}")
    assert kind == {"table_row"} and rows == [("Courses", "Algebra", "title: Algebra\ncredit: 3"), ("Courses", "2", "credit: 2")]
    kind, rows = records(spark, f"<p>학점 outside</p>{HEADS}<table><tr><td>menu</td></tr></table>")
    assert kind == {"heading_paragraph"} and rows == [("Aims", "Aims", "학점 one two"), ("Next", "Next", "three. four")]
    kind, rows = records(spark, "<main><p>학점 first</p><h1>T</h1><p>x <strong>B</strong></p><li>menu</li><p>과목명 y</p></main>")
    assert kind == {"section_text"} and rows == [("교과과정", "교과과정", "학점 first"), ("B", "B", "menu 과목명 y")]


def test_pages_without_records(spark):
    for html in (None, "", "no markup", f"<title>우리 대학원과정</title>{TABLE}", "<p>menu</p>", "<table></table>", "<h3>D</h3><p>학점</p>"):
        assert records(spark, html, "D") == (set(), [])


def test_broken_markup(spark):
    kind, rows = records(spark, "<div class=cont><h3>A<h3>B</h3><p>학점</div></p></i><p>after")
    assert kind <= {"heading_paragraph", "section_text"} and any("학점" in r[2] for r in rows)
    deep = "<div>" * 20_000 + "<h3>A</h3><p>학점 x</p>"
    assert cascade.outline(deep)[2] == [{"title": "A", "text": "학점 x"}]


def test_course_tables(spark):
    html = f"{TABLE}<strong>트랙별 이수체계도</strong><table><tr><th>이수</th></tr><tr><td>a</td></tr></table><table><tr><td>other</td></tr></table>"
    rows = cascade.course_tables(spark.createDataFrame([(1, html), (2, None)], "k long, html string"), "k").collect()
    assert [(r["k"], r["section"], r["frame"], r["cells"]) for r in rows if r["section"] != "미분류"] == [(1, "트랙별 이수체계도", "career", ["a"])]
    assert len([r for r in rows if r["section"] == "미분류" and r["frame"] is None]) == 3


def test_a_page_is_parsed_once(monkeypatch):
    fed = []
    feed = HTMLParser.feed
    monkeypatch.setattr(HTMLParser, "feed", lambda self, data: (fed.append(data) if data else None, feed(self, data))[1])
    html = "<title>T</title><div id=content><h2>H</h2><table><tr><th>a</th></tr><tr><td>1</td></tr><tr><td/></tr></table><h3>S</h3><p>x<br/>y</p></div>tail"
    title, tables, headings, sections = cascade.outline(html)
    assert fed == [html]
    assert (title, tables) == ("T", [{"section": "H", "header": ["a"], "rows": [["1"], [""]]}])
    assert headings == [{"title": "S", "text": "x y"}] and sections == [{"title": "S", "text": "x y"}]


def test_course_tables_need_no_tree(spark):
    assert [f.name for f in cascade.page_tables(spark.createDataFrame([(1, "")], "k long, html string"), "k").schema] == ["k", "tables"]
