"""Queries of sources, sinks and documents of the six datasets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import dates, text
from docmill.operators import admin, chunks, sync
from docmill.operators import understanding as ask
from docmill.plans.shared import scratch, table
from docmill.sources import boards, cascade, details, files, pages


def _pick(by: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible customers exported as CSV and read back: all text, nulls empty."""
    path = scratch(spark, "csv")
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(key.alias("source_id"), F.when(key % 4 > 0, F.col("c_name")).alias("title"), F.concat(F.lit("2026-01-1"), key % 9).alias("published_at"), _pick(key, "active", "updated", "hidden").alias("status"))
    files.export_active(own, path)
    return files.read_csv(spark, path)


def raw_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON under year and month, read back; those without a date lie under that of the run."""
    path = scratch(spark, "raw")
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("notices:"), "o_orderkey").alias("document_key"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 6 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published_at"))
    files.write_raw(own, path, F.lit("2026-02-03"))
    return files.read_records(spark, path, "document_key string, title string, file string, year int, month int").select("document_key", "title", "file", "year", "month")


def chunk_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written by dataset, of which two are read."""
    path = scratch(spark, "chunks")
    files.write_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("dataset"), "n_chars"), path)
    return files.read_chunks(spark, path).filter(F.col("dataset").isin("src1", "src3"))


def refreshed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full refresh of parts: manual rows stay, loaded ones replace the rest."""
    old = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return files.refresh_dataset(old, old.select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), F.lit(0).alias("p_size")), F.col("p_size") % 7 == 0)


def appended_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' and assistants' turns appended to a history one after the other."""
    path = scratch(spark, "history")
    for role in ("user", "assistant"):
        table(spark, sf_dir, "conversations").filter(F.col("role") == role).select("conv_id", "turn", "role").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def refresh_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that a collection without rows leaves as it was."""
    path = scratch(spark, "index")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sync.refresh(path, rows)
    sync.refresh(path, rows.filter("n_nationkey < 0"))
    return spark.read.parquet(path)


def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files against a manifest that lacks some and has another hash for others."""
    hashes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    listed = hashes.filter("name % 3 > 0").withColumn("sha256", F.when(F.col("name") % 7 == 0, "other").otherwise(F.col("sha256")))
    strict = files.verified(hashes, listed, True).select("name", F.col("accepted").alias("strict"))
    return files.verified(hashes, listed).select("name", "accepted").join(strict, "name")


def homepage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a list of homepages in several files, the last row of each department by its number."""
    path, key = scratch(spark, "homepages"), F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit(" d"), F.col("c_nationkey")).alias("department_name"), F.concat(F.lit("https://d"), key, F.lit(".uni.edu")).alias("department_url"), F.col("c_name").alias("college_name"), key.alias("number"))
    own.repartition(3).write.option("header", True).csv(path)
    return files.homepages(spark, path, "number")


def department_colleges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last filled college of each department, by a number."""
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(key, F.concat(F.lit("d"), F.col("c_nationkey"), F.lit(" ")).alias("department_name"), F.when(key % 3 == 0, "대학").when(key % 3 == 1, "").otherwise(F.col("c_name")).alias("college_name"))
    return ask.department_map(own, "c_custkey")


def courses_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as courses with columns of several names."""
    key = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(F.when(key % 2 == 0, F.concat(F.lit("C"), key)).otherwise(" ").alias("학수번호"), F.concat(F.lit("X"), key).alias("과목코드"), F.when(key % 3 == 0, "nan").otherwise(F.col("p_name")).alias("교과목명"), F.col("p_type").alias("과목명"), F.col("p_size").alias("학점"))
    return files.coalesced(own, files.COURSES)


def filled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(" ").alias("blank"), F.lit("nan").alias("none"), F.when(F.col("s_suppkey") == 1, "x").alias("once"))
    return spark.createDataFrame([(c,) for c in files.non_empty_columns(own)], "name string")


def _row(*cells: str | Column, tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), F.lit(c) if isinstance(c, str) else c, F.lit(f"</{tag}>")) for c in cells), F.lit("</tr>"))


def _order_pages(spark: SparkSession, sf_dir: str, caption: str, head: Column, row: Column) -> DataFrame:
    """A page per customer with a table of their orders, under a heading."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))  # a customer's orders
    return rows.select("o_custkey", F.concat(F.lit("<h2>Customer <b>"), F.col("o_custkey"), F.lit(f"</b></h2><table><caption>{caption}</caption>"), head, "rows", F.lit("</table>")).alias("html"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables with their relevance to courses and the canonical name of their first column; a row too long is cut, one too short filled."""
    key, name = F.col("o_orderkey"), F.col("o_orderpriority")
    row = F.when(key % 3 == 0, _row(name, key.cast("string"), "more")).when(key % 3 == 1, _row(name)).otherwise(_row(F.concat(name, F.lit(" &amp; <i>co</i>")), F.lit("학점")))
    found = pages.tables(_order_pages(spark, sf_dir, "c", _row("국문 교과목명", "n", tag="th"), row), "o_custkey")
    score = pages.relevance(F.col("header"), F.array_join("cells", " "), ["교과목명", "학점", "URGENT"])
    return found.select("o_custkey", "table", "heading", "caption", F.array_join("header", "|").alias("header"), F.array_join("cells", "|").alias("cells"), score.alias("score"), pages.canonical(F.get("header", F.lit(0)), {"title": ["교과목명"], "code": ["학수번호"]}).alias("first"))


def _course_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer of five kinds: courses in a table, headings with paragraphs, lines below bold words, a graduate school, nothing of use."""
    k, t = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 5
    row = _row(F.concat(F.lit("Course "), k), F.when(F.col("o_orderkey") % 2 == 0, k).otherwise(""), F.col("o_orderpriority"))
    part = F.when((t == 0) | (t == 3), row).when(t == 1, F.concat(F.lit("<h3>H <b>"), k, F.lit("</b></h3><p>학점 "), k, F.lit("</p><div>more &amp; <i>more</i></div>"))).when(t == 2, F.concat(F.lit("<strong>S "), k, F.lit("</strong><ul><li>a "), k, F.lit(". </li><li>과목명 b</li></ul>"))).otherwise(F.concat(F.lit("<p>menu "), k, F.lit("</p>")))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", part.alias("part")))), lambda x: x["part"]), "\n")  # a customer's orders
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(parts.alias("parts"))
    body = F.when((F.col("o_custkey") % 5).isin(0, 3), F.concat(F.lit("<h2>졸업요건 안내</h2><table>"), _row("교과목명", "학점", "기타", tag="th"), F.col("parts"), F.lit("</table>"))).otherwise(F.col("parts"))
    title = F.when(F.col("o_custkey") % 5 == 3, "석사 대학원과정").otherwise("학부")
    return own.select("o_custkey", F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body><p>outside. </p><div class='cont wide'>"), body, F.lit("</div></body></html>")).alias("html"))


def course_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's records of the first kind that it has."""
    return cascade.course_records(_course_pages(spark, sf_dir), "o_custkey")


def course_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of course tables, graduate schools' too, with what their section is."""
    found = cascade.course_tables(_course_pages(spark, sf_dir), "o_custkey")
    return found.select("o_custkey", "section", "frame", F.array_join("header", "|").alias("header"), F.array_join("cells", "|").alias("cells"))


def schedule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    period = F.concat(F.lit("2026.03.0"), key % 9 + 1, F.when(key % 2 == 0, F.concat(F.lit(" ~ 2026. 4. 1"), key % 9)).otherwise(""))
    content = F.concat(F.lit("Event  "), key, F.when(key % 3 > 0, F.concat(F.lit(" (주관부서 : D"), key, F.lit(") 바로가기"))).otherwise(""))
    return pages.schedule_rows(_order_pages(spark, sf_dir, "2026학년도 교내일정", _row("기간", "내용", tag="th"), _row(period, content)), "o_custkey")


def _list_pages(spark: SparkSession, sf_dir: str, per_page: int = 40) -> DataFrame:
    """(board, page, html): a board per host, on whose list pages the crawled pages stand, newest first, as many to a page."""
    key, host = F.col("page_id"), F.regexp_extract("url", "//([^/:?#]*)", 1)
    own = table(spark, sf_dir, "pages").select("page_id", host.alias("board"), F.regexp_replace("url", "&", "&amp;").alias("title"))
    own = own.withColumn("at", F.row_number().over(Window.partitionBy("board").orderBy(F.desc("page_id"))) - 1)
    fixed = F.when(key % 5 == 0, "<span class=fix>x</span>").otherwise("")
    item = F.concat(F.lit('<li><a onclick="goDetail('), key, F.lit(')"><div class="mark">'), fixed, F.lit("</div><em>c"), key % 3, F.lit("</em><p class='tit'>"), F.col("title"), F.lit("</p><span>2026."), key % 13, F.lit("."), key % 28 + 1, F.lit(".</span><span>7</span></a></li>"))
    paged = own.groupBy("board", F.floor(F.col("at") / per_page).cast("int").alias("page"))  # per_page rows a group
    return paged.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", item.alias("item")))), lambda x: x["item"]), "").alias("html"))


def board_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the list pages of all hosts."""
    return pages.board_list(_list_pages(spark, sf_dir), "board", "page")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "boards")
    _list_pages(spark, sf_dir).write.partitionBy("board", "page").text(path)
    spark.dataSource.register(boards.BoardSource)
    return path


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages as posts of a board, some without date, post or files."""
    key, words = F.col("page_id"), F.regexp_replace(F.regexp_extract("url", "//([^/:?#]*)", 1), "[.]", " ")
    info = F.concat(F.lit("<div class='info'><span>등록일 2026."), key % 13, F.lit("."), key % 28 + 1, F.lit(".</span><span>조회 "), key, F.lit("</span></div>"))
    files = F.when(key % 4 > 0, F.concat(F.lit("<div class='view_files'><ul><li><a href=\"javascript:downGO('f "), key, F.lit(".pdf','/a b/c','s"), key, F.lit("')\">f</a></li><li><a href='#'>no</a></li></ul></div>"))).otherwise("")
    body = F.concat(F.lit("<div class='view_cont'><p>First <b>"), words, F.lit("</b></p><script>x()</script>\n<p> last &amp; </p></div>"))
    page = F.concat(F.when(key % 7 > 0, "<div class='board_view'>").otherwise("<div>"), F.lit("<div class='tit'><p>Post "), key, F.lit("</p>"), info, F.lit("</div>"), body, files, F.lit("</div>"))
    found = details.detail_pages(table(spark, sf_dir, "pages").select("page_id", page.alias("html")), "page_id", "https://board.example.edu")
    return found.select("page_id", F.coalesce("title", F.lit("")).alias("title"), "posted_at", F.coalesce("views", F.lit(-1)).alias("views"), "content", F.coalesce(F.get("attachments", F.lit(0))["url"], F.lit("")).alias("file_url"), F.size("attachments").alias("n_files"), "parsed")


def board_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of stored list pages, through the data source."""
    return spark.read.format("board_pages").option("pagesPerTask", 2).load(_stored(spark, sf_dir))


def board_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream over stored list pages hands on, as a table."""
    path, out = _stored(spark, sf_dir), scratch(spark, "items")
    run = spark.readStream.format("board_pages").load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as list items of a board per priority, fifty to a page; some are listed twice."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("board"), (key / 50).cast("int").alias("page"), (key % 50).cast("int").alias("place"), F.when(key % 10 == 9, key - 5).otherwise(key).alias("article_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_at"), (key % 17 == 0).alias("is_pinned"))


def board_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _listed(spark, sf_dir).filter("article_id % 13 = 0").select("board", "article_id").distinct()
    return pages.collected(_listed(spark, sf_dir), known, "board", 1994, 4).select("board", "article_id", "page", "place")


def item_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their pages; what couldn't be fetched has no body."""
    details = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("content")).filter("o_custkey % 3 > 0")
    return pages.with_details(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), details, ["o_custkey"])


MENUS = [
    "6/10 식당가 (본관)\n중식 비빔밥 5,500원\n식당나 휴무\n※ 안내 5,000", "식당나 조식 죽 3,000원 석식 밥 4,000원 식당가 x", "식당가 휴무 아님 1,000원", "없음",
]


def meal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(F.col("s_suppkey"), *MENUS).alias("menu"))
    return pages.meal_blocks(own, "s_suppkey", "menu", ["식당나", "식당가"])


def week_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("mon"), F.col("p_type").alias("tue"))
    return pages.unpivot_days(own, ["p_partkey"], {"mon": "2026-06-08", "tue": "2026-06-09"}).select("p_partkey", F.col("date").cast("string").alias("date"), "menu")


def weekly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts of a board per customer, the newest three of those in one year, with their first PDF."""
    key = F.col("o_orderkey").cast("string")
    files_of = F.when(F.col("o_orderkey") % 3 == 0, "[]").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('[{"name": "a.txt", "url": "x"}, {"name": "b.PDF", "url": "b'), key, F.lit('"}, {"name": "c.pdf", "url": "c"}]'))).otherwise('[{"name": "only.txt", "url": "x"}]')
    posts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), text.attachments(files_of)[0].alias("attachments"))
    posts = pages.in_window(posts, "day", F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return pages.newest_files(posts, "o_custkey", [F.desc("day"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "file_url")


def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines; an assistant's is a heading."""
    line = F.when(F.col("role") == "assistant", F.concat(F.lit("# "), "turn")).otherwise(F.concat(F.lit("line "), "turn"))
    return pages.sections(table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line", "^# ")


def lines_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat("text", F.lit("\n 12 \n"), F.col("lang"), F.lit("\n"), F.col("lang"), F.lit("\n\n\nend"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(pages.without_repeats(own, ["^[0-9]+$"]).cast("binary")).alias("text_md5"))


def notice_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices: some have no body, some a deadline in their title."""
    key = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(F.when(key % 4 == 0, F.concat(F.lit("신청 마감 6월 21일 "), key)).otherwise(F.concat(F.lit("T"), key)).alias("title"), F.when(key % 3 > 0, F.concat(F.lit("<p>Body "), key, F.lit("</p>"))).alias("content"), F.when(key % 5 > 0, F.date_format("o_orderdate", "yyyy. M. d.")).alias("date"), F.when(key % 2 == 0, "장학공지").alias("board"), F.concat(F.lit("https://u/"), key).alias("url"), F.lit(None).cast("string").alias("attachments"))
    return chunks.notice_documents(own)


def rule_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("relative_dir"), F.col("p_name").alias("filename"), F.when(F.col("p_partkey") % 9 > 0, F.concat(F.lit("<b>"), F.col("p_type"), F.lit("</b>"))).alias("text"), F.when(F.col("p_partkey") % 4 == 0, 2024).alias("entry_year"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S"), F.col("p_size"))).alias("section"), F.lit(None).cast("string").alias("college_name"))
    return chunks.rule_documents(own)


def schedule_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("Event "), key).alias("content"), F.col("o_orderpriority").alias("division"), F.when(key % 2 == 0, F.concat(F.lit("D"), key)).otherwise("nan").alias("department"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("start"), F.when(key % 7 > 0, F.date_format(F.date_add("o_orderdate", (key % 3).cast("int")), "yyyy-MM-dd")).alias("end"))
    return chunks.schedule_documents(own)


def staff_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("02-"), F.col("s_suppkey"))).alias("phone"), "s_name", "s_nationkey")
    return chunks.labelled_documents(own, ["s_name", "s_nationkey"], ["s_name"], "staff")


def meal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("restaurant"), F.concat(F.lit("m"), key).alias("menu_text"), F.when(key % 5 == 0, "Yes").otherwise("no").alias("is_closed"))
    return chunks.meal_documents(own)


def course_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("title"))
    return chunks.dataset_chunks(own, "courses").select("doc_id", "position", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"))


def submission_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as submissions of three kinds and of an unknown one."""
    key = F.col("c_custkey")
    data = F.concat(F.lit('{"question": "q'), key, F.lit('", "answer": "a", "title": "t'), key, F.lit('", "start_date": "2026-05-01", "end_date": "'), _pick(key, "2026-05-01", "2026-05-09"), F.lit('", "location": "'), _pick(key, "", "room", ""), F.lit('", "content": "c", "category": "'), _pick(key, "k", ""), F.lit('", "date": "2026-01-02"}'))
    own = table(spark, sf_dir, "customer").select("c_custkey", _pick(key, "custom_knowledge", "event", "announcement", "other").alias("kind"), data.alias("data"))
    return admin.submission_notices(own, F.lit("2026-03-04").cast("date"))


def guide_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of a guide; users' turns head the section of a college in three forms."""
    line = F.when(F.col("role") == "user", _pick(F.col("turn") + F.col("conv_id"), "이과대학", "[공과대학]", "이과대학 (02-1)")).otherwise(F.concat(F.lit("line "), "turn"))
    return admin.grouped_sections(table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line", ["이과대학", "공과대학"])


def guide_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sections of a guide; some of the assistant's hold the beginning of the users' section."""
    user = F.col("role") == "user"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(user, "졸업").otherwise(F.concat(F.lit("S"), "turn")).alias("section"), F.concat(F.lit("text "), "turn", F.when(F.col("turn") % 4 == 3, F.concat(F.lit(" 졸업기준 "), "turn")).otherwise("")).alias("body"))
    return admin.tail_moved(own, "conv_id", "turn", "section", "body", "졸업", "졸업기준")


def guide_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as colleges with their nations as departments, the first two named."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("departments"))
    own = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    college = F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name"))
    return own.select("r_regionkey", admin.guide_title(F.lit(2024), F.lit("졸업기준"), college, F.col("departments"), 2).alias("title"))


def descriptions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as description rows; a user's begins a course, the others go on with it."""
    starts = F.col("role") == "user"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(starts, "ABC1234").when(F.col("turn") % 5 == 3, "see 1").otherwise("").alias("code"), F.when(starts, F.concat(F.lit("T"), "turn")).alias("title"), F.lit(None).cast("string").alias("english"), F.concat(F.lit("d"), "turn").alias("description"))
    return admin.merged_descriptions(own, "conv_id", "turn", "code", "title", "english", "description").select("conv_id", "code", F.coalesce("title", F.lit("")).alias("title"), "description")


def notice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as crawled rows with Korean column names."""
    key = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("게시판"), _pick(key, "B1", "", "B2").alias("게시판코드"), F.when(key % 2 == 0, key.cast("string")).otherwise("x").alias("원문글ID"), F.concat(F.lit("T"), key).alias("제목"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("게시일"), F.concat(F.lit("https://u/detail/"), key, F.lit("?x")).alias("상세URL"), F.when(key % 3 == 0, "nan").otherwise("body").alias("본문"), _pick(key, "고정", "0", "TRUE").alias("상단고정"), _pick(key, "[]", "bad").alias("첨부파일"))
    return sync.notice_records(own).select("source_id", "document_key", "board_name", "board_code", "article_id", "title", "category", "published_at", "content_text", "attachments_parse_failed", "is_pinned")


def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First filled value, truth words, article ids and grade labels."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.first_filled(_pick(key, " ", "nan", "x "), _pick(key, "", "NaN"), F.col("p_brand")).alias("first"), text.truthy(_pick(key, "Y", "yes ", "0", "고정", "no")).alias("truth"),
        F.coalesce(text.article_id(F.concat(F.lit("https://u/"), _pick(key, "detail/", "list/"), key)), F.lit(-1).cast("long")).alias("article"), text.grade_label(_pick(key, "학사2년", "1, 2년", "3년")).alias("grade"),
    )


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, file names, telephone numbers, homepages and years of month-days."""
    key, url = F.col("s_suppkey"), F.concat(F.lit("https://"), _pick(F.col("s_suppkey"), "A.uni.edu", "www.uni.edu", "b.org"), F.lit("/x"))
    ref = F.date_add(F.lit("2025-12-01").cast("date"), (key % 60).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.slug(F.concat("s_name", _pick(key, " & Söhne!", " 학과", ""))).alias("slug"), text.safe_file_name(F.concat("s_name", F.lit(" a/b:c"))).alias("file"), text.phone_like(_pick(key, "02-123-4567", "1234", "02.1234", "a")).alias("phone"),
        text.homepage_url(url, ".uni.edu", ["www.uni.edu"]).alias("homepage"), dates.near_year(F.lit(1) + key % 2 * 11, F.lit(5), ref).cast("string").alias("near"),
    )


def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_mktsegment").distinct()


QUERIES = {f.__name__: f for f in (csv_scan, raw_layer, chunk_artifact, refreshed_dataset, appended_turns, refresh_guard, manifest_verify, homepage_map, department_colleges, courses_coalesced, filled_columns, page_tables, course_records, course_tables, schedule_table, board_items, detail_pages, board_source, board_stream, board_collected, item_details, meal_rows, week_days, weekly_files, text_sections, lines_without_repeats, notice_docs, rule_docs, schedule_docs, staff_docs, meal_docs, course_chunks, submission_notices, guide_sections, guide_tails, guide_titles, descriptions_merged, notice_records, field_rules, name_rules, distinct_names)}

_NOTICE_DATE = "CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE END"
_BOARDS = """WITH p AS (SELECT page_id AS k, regexp_extract(url, '//([^/:?#]*)', 1) AS board, url, row_number() OVER (PARTITION BY regexp_extract(url, '//([^/:?#]*)', 1) ORDER BY page_id DESC) - 1 AS i FROM pages),
items AS (SELECT board, (i // 40)::INT AS page, (i % 40)::INT AS place, k AS article_id, url AS title, 'c' || (k % 3) AS category, CASE WHEN k % 13 > 0 THEN strftime(make_date(2026, (k % 13)::INT, (k % 28 + 1)::INT), '%Y-%m-%d') END AS posted_at, k % 5 = 0 AS is_pinned FROM p)"""
ORACLES = {
    "csv_scan": "SELECT c_custkey::VARCHAR AS source_id, CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE '' END AS title, '2026-01-1' || (c_custkey % 9) AS published_at, ['active', 'updated'][c_custkey % 3 + 1] AS status FROM customer WHERE c_custkey % 3 < 2",
    "raw_layer": "SELECT 'notices:' || o_orderkey AS document_key, o_orderpriority AS title, 'notices_' || o_orderkey AS file, CASE WHEN o_orderkey % 6 > 0 THEN year(o_orderdate) ELSE 2026 END::INT AS year, CASE WHEN o_orderkey % 6 > 0 THEN month(o_orderdate) ELSE 2 END::INT AS month FROM orders",
    "chunk_artifact": "SELECT doc_id AS chunk_id, source AS dataset, n_chars FROM documents WHERE source IN ('src1', 'src3')",
    "refreshed_dataset": "SELECT p_partkey, p_size FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey + 1000000, 0 FROM part",
    "appended_turns": "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')",
    "refresh_guard": "SELECT n_nationkey, n_name FROM nation",
    "manifest_verify": "SELECT doc_id::VARCHAR AS name, doc_id % 3 = 0 OR doc_id % 7 > 0 AS accepted, doc_id % 3 > 0 AND doc_id % 7 > 0 AS strict FROM documents",
    "homepage_map": "SELECT 'd' || c_nationkey AS department_name, 'https://d' || max(c_custkey) || '.uni.edu' AS department_url, arg_max(c_name, c_custkey) AS college_name FROM customer GROUP BY c_nationkey",
    "department_colleges": "SELECT 'd' || c_nationkey AS department, arg_max(c_name, c_custkey) AS college FROM customer WHERE c_custkey % 3 = 2 GROUP BY c_nationkey",
    "courses_coalesced": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'X' END || p_partkey AS course_code, trim(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END) AS title, '' AS description, p_size::VARCHAR AS credit, '' AS semester, '' AS grade, '' AS course_type FROM part",
    "filled_columns": "SELECT unnest(['s_suppkey', 's_name', 'once']) AS name",
    "page_tables": """SELECT o_custkey, '1' AS "table", 'Customer ' || o_custkey AS heading, 'c' AS caption, '국문 교과목명|n' AS header, c AS cells, 3 + CASE WHEN contains(c, '학점') THEN 1 ELSE 0 END + CASE WHEN contains(lower(c), 'urgent') THEN 1 ELSE 0 END AS score, 'title' AS first
FROM (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || '|' || o_orderkey WHEN 1 THEN o_orderpriority || '|' ELSE o_orderpriority || ' & co|학점' END AS c FROM orders)""",
    "course_records": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_custkey % 5 AS t, o_orderpriority AS p, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS place FROM orders)
SELECT c AS o_custkey, CASE t WHEN 0 THEN 'table_row' WHEN 1 THEN 'heading_paragraph' ELSE 'section_text' END AS record_type, place, CASE t WHEN 0 THEN '졸업요건 안내' WHEN 1 THEN 'H ' || k ELSE 'S ' || k END AS section,
CASE t WHEN 0 THEN 'Course ' || k WHEN 1 THEN 'H ' || k ELSE 'S ' || k END AS title,
CASE t WHEN 0 THEN concat_ws(chr(10), 'title: Course ' || k, CASE WHEN k % 2 = 0 THEN 'credit: ' || k END, '기타: ' || p) WHEN 1 THEN '학점 ' || k || ' more & more' ELSE 'a ' || k || '. 과목명 b' END AS text
FROM o WHERE t < 3""",
    "course_tables": """SELECT o_custkey, '졸업요건 안내' AS section, 'graduation' AS frame, '교과목명|학점|기타' AS header, 'Course ' || o_orderkey || '|' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '' END || '|' || o_orderpriority AS cells FROM orders WHERE o_custkey % 5 IN (0, 3)""",
    "schedule_table": """SELECT o_custkey, '2026' AS year, 'Event ' || o_orderkey AS content, CASE WHEN o_orderkey % 3 > 0 THEN 'D' || o_orderkey ELSE '' END AS department, '2026-03-0' || (o_orderkey % 9 + 1) AS start, CASE WHEN o_orderkey % 2 = 0 THEN '2026-04-1' || (o_orderkey % 9) ELSE '2026-03-0' || (o_orderkey % 9 + 1) END AS "end" FROM orders""",
    "board_items": f"{_BOARDS} SELECT * FROM items",
    "detail_pages": """WITH p AS (SELECT page_id AS k, page_id % 7 > 0 AS ok, replace(regexp_extract(url, '//([^/:?#]*)', 1), '.', ' ') AS w FROM pages)
SELECT k AS page_id, CASE WHEN ok THEN 'Post ' || k ELSE '' END AS title, CASE WHEN ok AND k % 13 > 0 THEN strftime(make_date(2026, (k % 13)::INT, (k % 28 + 1)::INT), '%Y-%m-%d') END AS posted_at, CASE WHEN ok THEN k ELSE -1 END AS views,
CASE WHEN ok THEN 'First' || chr(10) || w || chr(10) || 'last &' ELSE '' END AS content, CASE WHEN ok AND k % 4 > 0 THEN 'https://board.example.edu/cmmn/fileDown.do?filename=f%20' || k || '.pdf&filepath=/a%20b/c&filerealname=s' || k ELSE '' END AS file_url, CASE WHEN ok AND k % 4 > 0 THEN 1 ELSE 0 END::INT AS n_files, ok AS parsed FROM p""",
    "board_source": f"{_BOARDS} SELECT * FROM items",
    "board_stream": f"{_BOARDS} SELECT * FROM items",
    "board_collected": """WITH l AS (SELECT o_orderpriority AS board, o_orderkey // 50 AS page, o_orderkey % 50 AS place, CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 5 ELSE o_orderkey END AS article_id, year(o_orderdate) < 1994 AS old, o_orderkey % 17 = 0 AS pin FROM orders),
g AS (SELECT *, sum((NOT old AND NOT pin)::INT) OVER (PARTITION BY board ORDER BY page, place ROWS UNBOUNDED PRECEDING) AS g FROM l),
s AS (SELECT *, sum((old AND NOT pin)::INT) OVER (PARTITION BY board, g ORDER BY page, place ROWS UNBOUNDED PRECEDING) AS s FROM g),
e AS (SELECT *, coalesce(max(s) OVER (PARTITION BY board ORDER BY page, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 4 AS ended FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY board, article_id ORDER BY page, place) AS n FROM e WHERE NOT ended AND NOT old)
SELECT board, article_id, page::INT AS page, place::INT AS place FROM f WHERE n = 1 AND article_id % 13 > 0""",
    "item_details": "SELECT o_custkey, o_orderkey, coalesce(c_name, '') AS content FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 > 0",
    "meal_rows": """WITH m AS (SELECT * FROM (VALUES (0, '식당가', '중식 비빔밥 5,500원', false), (0, '식당나', '휴무', true), (1, '식당나', '조식 죽 3,000원 석식 밥 4,000원', false), (1, '식당가', '휴무', true), (2, '식당가', '휴무 아님 1,000원', false)) AS t(k, restaurant, menu_text, is_closed))
SELECT s_suppkey, restaurant, menu_text, is_closed FROM supplier JOIN m ON s_suppkey % 4 = k""",
    "week_days": "SELECT p_partkey, '2026-06-08' AS date, p_brand AS menu FROM part UNION ALL SELECT p_partkey, '2026-06-09', p_type FROM part",
    "weekly_files": """WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS n FROM orders WHERE year(o_orderdate) = 1996)
SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'b' || o_orderkey END AS file_url FROM p WHERE n <= 3""",
    "text_sections": """WITH n AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations)
SELECT conv_id, '# ' || max(turn) FILTER (role = 'assistant') AS section, coalesce(string_agg('line ' || turn, chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '') AS body FROM n WHERE n > 0 GROUP BY conv_id, n""",
    "lines_without_repeats": """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text || chr(10) || ' 12 ' || chr(10) || lang || chr(10) || lang || chr(10) || chr(10) || chr(10) || 'end', chr(10)), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS l FROM documents)
SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'))) AS text_md5 FROM l""",
    "notice_docs": f"""WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '신청 마감 6월 21일 ' || o_orderkey ELSE 'T' || o_orderkey END AS title, 'https://u/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN '장학공지' ELSE '' END AS topics, {_NOTICE_DATE} AS p FROM orders),
m AS (SELECT *, coalesce(strftime(p, '%Y-%m-%d'), '') AS published_at, CASE WHEN k % 3 > 0 THEN 'Body ' || k ELSE '공지 제목: ' || title || chr(10) || '본문이 비어 있어 상세 내용은 공지 링크를 확인하세요: ' || url END AS body, CASE WHEN k % 4 = 0 AND p IS NOT NULL THEN make_date(year(p), 6, 21) END AS d FROM n)
SELECT sha1(concat_ws('|', title, nullif(topics, ''), nullif(published_at, ''), url)) AS doc_id, title, CASE WHEN topics <> '' OR published_at <> '' THEN '[' || concat_ws(', ', CASE WHEN topics <> '' THEN '게시판: ' || topics END, CASE WHEN published_at <> '' THEN '게시일: ' || published_at END) || ']' || chr(10) || chr(10) ELSE '' END || body AS text,
topics, published_at, strftime(CASE WHEN d < p THEN make_date(year(d) + 1, 6, 21) ELSE d END, '%Y-%m-%d') AS apply_deadline, url, '[]' AS attachments, 'notices' AS source FROM m""",
    "rule_docs": """WITH r AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN '2024' END AS y, CASE WHEN p_partkey % 2 = 0 THEN 'S' || p_size END AS s FROM part WHERE p_partkey % 9 > 0)
SELECT sha1(concat_ws('|', p_brand, p_name, y, s)) AS doc_id, trim(coalesce(s, p_name)) AS title, p_type AS text, p_brand AS topics, y AS entry_year, 'rules' AS source FROM r""",
    "schedule_docs": """WITH e AS (SELECT o_orderkey AS k, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS a, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate::DATE + (o_orderkey % 3)::INT, '%Y-%m-%d') END AS b FROM orders)
SELECT sha1(concat_ws('|', a, b, 'Event ' || k)) AS doc_id, 'Event ' || k AS title, concat_ws(chr(10), '일정: Event ' || k, '기간: ' || CASE WHEN a = b THEN a ELSE concat_ws(' ~ ', a, b) END, CASE WHEN k % 2 = 0 THEN '주관부서: D' || k END) AS text, o_orderpriority AS topics, a AS published_at, 'schedule' AS source FROM e""",
    "staff_docs": "SELECT sha1(concat_ws('|', s_name, CASE WHEN s_nationkey <> 0 THEN s_nationkey END)) AS doc_id, s_name AS title, concat_ws(chr(10), CASE WHEN s_suppkey % 3 > 0 THEN 'phone: 02-' || s_suppkey END, s_name, 's_nationkey: ' || s_nationkey) AS text, 'staff' AS source FROM supplier",
    "meal_docs": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS r, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderdate::DATE, o_orderpriority ORDER BY 'm' || o_orderkey) AS n FROM orders)
SELECT sha1(d || '|' || r) AS doc_id, r AS title, d || ' ' || r || chr(10) || CASE WHEN k % 5 = 0 THEN '휴무' ELSE 'm' || k END AS text, d AS published_at, (k % 5 = 0)::INT AS is_closed, 'meals' AS source FROM m WHERE n = 1""",
    "course_chunks": """WITH c AS (SELECT doc_id, lang, text, unnest(range(0, greatest(1, ceil((length(text) - 600) / 520.0)::INT + 1))) AS position FROM documents), k AS (SELECT *, regexp_replace(substr(text, position * 520 + 1, 600), '^\\s+|\\s+$', '', 'g') AS segment FROM c)
SELECT doc_id::VARCHAR AS doc_id, position::INT AS position, md5(CASE WHEN doc_id % 2 = 0 THEN '[' || lang || ']' || chr(10) || chr(10) ELSE '' END || segment) AS text_md5 FROM k WHERE segment <> ''""",
    "submission_notices": """WITH s AS (SELECT c_custkey AS k, c_custkey % 4 AS t, ['k', ''][c_custkey % 2 + 1] AS cat, ['2026-05-01', '2026-05-09'][c_custkey % 2 + 1] AS stop, ['', 'room', ''][c_custkey % 3 + 1] AS loc FROM customer WHERE c_custkey % 4 < 3), b AS (SELECT *, CASE WHEN cat <> '' THEN '주관: ' || cat END AS own FROM s)
SELECT k AS c_custkey, ['학과지식', '학과행사', '학과공지'][t + 1] AS board, CASE t WHEN 0 THEN 'q' ELSE 't' END || k AS title, ['FAQ', '행사', CASE WHEN cat <> '' THEN cat ELSE '일반' END][t + 1] AS category, ['2026-03-04', '2026-05-01', '2026-01-02'][t + 1] AS date,
CASE t WHEN 0 THEN concat_ws(chr(10) || chr(10), 'a', own) WHEN 1 THEN concat_ws(chr(10) || chr(10), '일시: 2026-05-01' || CASE WHEN stop <> '2026-05-01' THEN ' ~ ' || stop ELSE '' END, CASE WHEN loc <> '' THEN '장소: ' || loc END, own) ELSE concat_ws(chr(10) || chr(10), 'c', own) END AS content FROM b""",
    "guide_sections": """WITH n AS (SELECT *, CASE WHEN role = 'user' THEN ['이과대학', '[공과대학]', '이과대학 (02-1)'][(turn + conv_id) % 3 + 1] END AS h FROM conversations),
m AS (SELECT conv_id, turn, coalesce(h, 'line ' || turn) AS line, h, sum((h IS NOT NULL)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM n)
SELECT conv_id, coalesce(max(CASE WHEN contains(h, '이과') THEN '이과대학' WHEN h IS NOT NULL THEN '공과대학' END), '') AS name, string_agg(line, chr(10) ORDER BY turn) AS body FROM m GROUP BY conv_id, n""",
    "guide_tails": """WITH s AS (SELECT conv_id, turn, role = 'user' AS u, turn % 4 = 3 AS m FROM conversations)
SELECT conv_id, 'S' || turn AS section, 'text ' || turn AS body FROM s WHERE NOT u
UNION ALL SELECT conv_id, '졸업', string_agg(CASE WHEN u THEN 'text ' || turn || CASE WHEN m THEN ' 졸업기준 ' || turn ELSE '' END ELSE '졸업기준 ' || turn END, chr(10) ORDER BY turn) FROM s WHERE u OR m GROUP BY conv_id""",
    "guide_titles": """WITH n AS (SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name)[:2], ', ') AS d FROM nation GROUP BY n_regionkey)
SELECT r_regionkey, '2024학번 졸업기준' || CASE WHEN r_regionkey % 2 = 0 THEN ' - ' || r_name || coalesce(' (소속 학과: ' || d || ')', '') ELSE '' END AS title FROM region LEFT JOIN n ON r_regionkey = n_regionkey""",
    "descriptions_merged": """WITH n AS (SELECT conv_id, turn, role = 'user' AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS f FROM conversations), m AS (SELECT *, sum((s OR f)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM n)
SELECT conv_id, CASE WHEN bool_or(s) THEN 'ABC1234' ELSE '' END AS code, coalesce('T' || min(turn) FILTER (s), '') AS title, string_agg('d' || turn || CASE WHEN NOT s AND turn % 5 = 3 THEN ' (see 1)' ELSE '' END, ' ' ORDER BY turn) AS description FROM m GROUP BY conv_id, n""",
    "notice_records": """WITH r AS (SELECT o_orderkey AS k, o_orderpriority, o_orderdate, ['B1', '', 'B2'][o_orderkey % 3 + 1] AS c FROM orders), s AS (SELECT *, CASE WHEN c <> '' THEN c || ':' || k ELSE '' END AS source_id FROM r)
SELECT source_id, CASE WHEN source_id <> '' THEN 'notices:' || source_id ELSE '' END AS document_key, o_orderpriority AS board_name, c AS board_code, k AS article_id, 'T' || k AS title, '' AS category, strftime(o_orderdate, '%Y-%m-%d') AS published_at, CASE WHEN k % 3 = 0 THEN '' ELSE 'body' END AS content_text, k % 2 = 1 AS attachments_parse_failed, k % 3 <> 1 AS is_pinned FROM s""",
    "field_rules": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'x' ELSE p_brand END AS first, p_partkey % 5 IN (0, 1, 3) AS truth, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -1 END AS article, ['2학년', '1학년, 2학년', '3학년'][p_partkey % 3 + 1] AS grade FROM part",
    "name_rules": """SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name || [' & Söhne!', ' 학과', ''][s_suppkey % 3 + 1]), '[^0-9a-z가-힣]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(s_name || ' a/b:c', '[^0-9A-Za-z가-힣._-]+', '_', 'g') AS file, s_suppkey % 4 IN (0, 2) AS phone, s_suppkey % 3 = 0 AS homepage,
CASE WHEN s_suppkey % 2 = 0 THEN '2026-01-05' ELSE '2025-12-05' END AS near FROM supplier""",
    "distinct_names": "SELECT DISTINCT c_mktsegment FROM customer",
}
