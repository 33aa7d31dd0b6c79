"""Records of course pages: relevant tables, else headings with what follows them, else running sections.

A page is parsed once, in Arrow batches, into candidates of all three kinds; which kind a page gives, and
which of its candidates count, is decided by Column expressions on the same row. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import useful_section
from docmill.sources.pages import _Tables, canonical, relevance

# Element names, places of a page's content, column names, titles.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RECORD_HEADINGS = ("h3", "h4")
SECTION_HEADINGS = ("h1", "h2", "h3", "h4", "strong")
FOLLOWING = ("p", "ul", "ol", "div")
CONTENT = ["#jwxe_main_content", ".fr-view", ".cont", ".content", "#content", "main"]
COLUMNS = {
    "course_code": ["학수번호", "과목코드", "학수", "code", "course code", "subject code"],
    "title": ["교과목명", "과목명", "국문교과목명", "교과목", "교과명", "title", "course"],
    "english_title": ["영문명", "english", "영문교과목명"],
    "credit": ["학점", "credit"],
    "semester": ["개설학기", "학기", "semester"],
    "grade": ["학년", "이수대상", "대상", "수강대상"],
    "course_type": ["전공구분", "이수구분", "구분", "이수", "category", "type"],
    "description": ["해설", "설명", "비고", "교과목 해설", "내용", "description"],
}
GRADUATE = ["대학원과정", "대학원 교과과정"]
NO_TITLE, NO_SECTION, UNSORTED = "교과과정 정보", "교과과정", "미분류"
COURSE_WORDS = ["과목", "구분", "학점", "학년", "이수", "code", "subject"]
FRAMES = {"전공과목 개설총괄표": "overview", "학과내규": "policy", "졸업요건": "graduation", "진출분야": "career", "트랙별 이수체계": "career", "교과목 해설": "descriptions"}
PLACES = {place: i for i, place in enumerate([*CONTENT, "body"])}

_TEXT = pa.struct([("title", pa.string()), ("text", pa.string())])
_TABLE = pa.struct([("section", pa.string()), ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
TABLES = "tables array<struct<section: string, header: array<string>, rows: array<array<string>>>>"
CANDIDATES = f"page_title string, {TABLES}, headings array<struct<title: string, text: string>>, sections array<struct<title: string, text: string>>"


class _Node:
    __slots__ = ("tag", "id", "classes", "href", "children")

    def __init__(self, tag: str, attrs: list):
        at = dict(attrs)
        self.tag, self.id, self.classes, self.href, self.children = tag, at.get("id"), (at.get("class") or "").split(), at.get("href"), []


class _Tree(HTMLParser):
    """A page's elements; an end tag closes what is open inside its element, one without an element is passed over."""

    def __init__(self, html: str):
        super().__init__()
        self.root = _Node("#root", [])
        self.stack, self.open = [self.root], {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.stack[-1].children.append(_Node(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        while self.open.get(tag):
            last = self.stack.pop()
            self.open[last.tag] -= 1
            if last.tag == tag:
                break

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


class _Page(_Tree):
    """A page's elements and its tables, of one pass over it."""

    def __init__(self, html: str):
        self.found = _Tables("")
        super().__init__(html)

    def close(self) -> None:
        self.found.close_table()  # tables end with the last whole tag
        self.tables, self.found = self.found.tables, None
        super().close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.found:
            self.found.handle_starttag(tag, attrs)
        super().handle_starttag(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if self.found:
            self.found.handle_startendtag(tag, attrs)
        super().handle_startendtag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.found:
            self.found.handle_endtag(tag)
        super().handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.found:
            self.found.handle_data(data)
        super().handle_data(data)


def _walk(node: _Node) -> Iterator[_Node]:
    """Elements in document order."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(c for c in reversed(x.children) if isinstance(c, _Node))


def _text(node: _Node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in ("script", "style"):
            todo.extend(reversed(x.children))
    return " ".join(" ".join(parts).split())


def _content(nodes: list[_Node]) -> _Node:
    """The first element of the first of CONTENT that the page has, else its body, else all. nodes: the page's, its root first."""
    first = {}
    for x in nodes:
        for place in (x.tag, x.id and f"#{x.id}", *(f".{c}" for c in x.classes)):
            if place in PLACES:
                first.setdefault(place, x)
    return next((first[p] for p in PLACES if p in first), nodes[0])


def _headings(nodes: list[_Node]) -> list[dict]:
    """Each heading with the text of the blocks after it, up to the next heading beside it. nodes: the content's."""
    if not any(x.tag in RECORD_HEADINGS for x in nodes):
        return []
    out = []
    for parent in nodes:
        parts = None
        for x in parent.children:
            if isinstance(x, str):
                continue
            if x.tag in RECORD_HEADINGS:
                parts = []
                out.append((x, parts))
            elif parts is not None and x.tag in FOLLOWING and (text := _text(x)):
                parts.append(text)
    place = {id(x): i for i, x in enumerate(nodes)}
    return [{"title": _text(x), "text": " ".join(parts)} for x, parts in sorted(out, key=lambda o: place[id(o[0])]) if parts and _text(x)]


def _sections(nodes: list[_Node]) -> list[dict]:
    """Paragraphs and list items under the last heading before them. nodes: the content's."""
    if not any(x.tag in ("p", "li") for x in nodes):
        return []
    out, title, parts = [], NO_SECTION, []
    for x in nodes:
        if x.tag in SECTION_HEADINGS and (text := _text(x)):
            out.append((title, parts))
            title, parts = text, []
        elif x.tag in ("p", "li") and (text := _text(x)):
            parts.append(text)
    return [{"title": t, "text": " ".join(p)} for t, p in [*out, (title, parts)] if p]


def _rows(tables: list[tuple]) -> list[dict]:
    return [{"section": heading, "header": header, "rows": rows} for _, heading, _, header, rows in tables]


def outline(html: str | None) -> tuple[str, list[dict], list[dict], list[dict]]:
    """(title, tables, headings, sections) of a page."""
    page = _Page(html or "")
    every = list(_walk(page.root))
    title = next((_text(x) for x in every if x.tag == "title"), "")
    nodes = list(_walk(_content(every)))
    return title, _rows(page.tables), _headings(nodes), _sections(nodes)


def candidates(pages: DataFrame, key: str, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """(key, keep, page_title, tables, headings, sections) of each page; a table's heading, header and caption stand once, above its rows."""
    names = [key, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(outline, b[html].to_pylist()), strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.list_(_TABLE), pa.list_(_TEXT), pa.list_(_TEXT)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *map(pa.array, found, kinds)], names=[*names, "page_title", "tables", "headings", "sections"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(*names, html).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + CANDIDATES)


def page_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, tables): those of ``candidates``, for which a page's elements need not be put in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[key], pa.array([_rows(_Tables(h or "").tables) for h in b[html].to_pylist()], pa.list_(_TABLE))], names=[key, "tables"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {TABLES}")


def _table_records(tables: Column, words: list[str], least: int) -> Column:
    """Records of the rows of tables that score least or more; all-empty rows go.

    What is used more than once is an element of an array first: Spark works an expression in a lambda out wherever it stands.
    """

    def records(t: Column) -> Column:
        def pairs(names: Column) -> Column:
            return F.transform(t["rows"], lambda cells: F.filter(F.arrays_zip(names.alias("name"), cells.alias("value")), lambda p: p["value"] != ""))

        def record(pairs: Column) -> Column:
            titled = F.filter(pairs, lambda p: p["name"] == "title")
            title = F.coalesce(F.get(titled, F.lit(0))["value"], F.substring(F.get(pairs, F.lit(0))["value"], 1, 80), F.lit(NO_TITLE))
            lines = F.transform(pairs, lambda p: F.concat(p["name"], F.lit(": "), p["value"]))
            return F.struct(t["section"].alias("section"), title.alias("title"), F.array_join(lines, "\n").alias("text"))

        names = F.array(F.transform(t["header"], lambda h: canonical(h, COLUMNS)))
        return F.filter(F.transform(F.flatten(F.transform(names, pairs)), record), lambda r: r["text"] != "")

    body = lambda t: F.array_join(F.flatten(F.slice(t["rows"], 1, 5)), " ")
    scored = lambda t: F.exists(F.array(F.struct(t["header"].alias("header"), body(t).alias("body"))), lambda x: relevance(x["header"], x["body"], words) >= least)
    return F.flatten(F.transform(F.filter(tables, scored), records))


def course_records(pages: DataFrame, key: str, html: str = "html", department: str | None = None, least: int = 3) -> DataFrame:
    """(key, record_type, place, section, title, text): every page's records of one kind, the first that it has of table_row, heading_paragraph and section_text.

    A table counts from ``least`` points on: three for a column word in its header, else one in its first
    five rows. Headings and sections count if they are useful and not the page's own department (a
    column of pages). Graduate schools' pages, null pages and those without a record give no
    row. Repeated keys are pages of their own; places count from 0 in page order, so nothing ties.
    """
    own = candidates(pages, key, html, [department] if department else None)
    words = [w for every in COLUMNS.values() for w in every]
    dept = F.col(department) if department else F.lit(None).cast("string")
    useful = lambda column: F.transform(F.filter(column, lambda r: useful_section(r["title"], r["text"], dept)), lambda r: F.struct(r["title"].alias("section"), r["title"].alias("title"), r["text"].alias("text")))
    own = own.filter(~reduce(lambda a, b: a | b, (F.col("page_title").contains(g) for g in GRADUATE)))
    own = own.select(key, _table_records(F.col("tables"), words, least).alias("t"), useful("headings").alias("h"), useful("sections").alias("s"))
    kind = F.when(F.size("t") > 0, "table_row").when(F.size("h") > 0, "heading_paragraph").otherwise("section_text")
    found = F.when(F.size("t") > 0, F.col("t")).when(F.size("h") > 0, F.col("h")).otherwise(F.col("s"))
    return own.select(key, kind.alias("record_type"), F.posexplode(found).alias("place", "r")).select(key, "record_type", "place", "r.section", "r.title", "r.text")


def course_tables(pages: DataFrame, key: str, html: str = "html", least: int = 2) -> DataFrame:
    """(key, section, frame, header, cells): rows of the course tables of a page, tagged with the heading before them.

    A table counts from ``least`` points on: two for a course word in its header, one for it anywhere in
    the table. frame: what a section's name makes of it, by the first of FRAMES in it; null if none is.
    Pages without such a table give no row.
    """
    own = page_tables(pages, key, html).select(key, F.explode("tables").alias("t"))
    head, body = F.array_join("t.header", " "), F.concat_ws(" ", F.array_join("t.header", " "), F.array_join(F.flatten("t.rows"), " "))
    score = reduce(lambda a, b: a + b, (F.when(head.contains(w), 2).otherwise(0) + F.when(body.contains(w), 1).otherwise(0) for w in COURSE_WORDS))
    section = F.coalesce(F.nullif("t.section", F.lit("")), F.lit(UNSORTED))
    frame = reduce(lambda rest, kv: F.when(section.contains(kv[0]), kv[1]).otherwise(rest), reversed(FRAMES.items()), F.lit(None).cast("string"))
    return own.filter(score >= least).select(key, section.alias("section"), frame.alias("frame"), F.col("t.header").alias("header"), F.explode("t.rows").alias("cells"))
