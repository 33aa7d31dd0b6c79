"""Rows out of crawled pages: board lists and details, tables, calendars, menus.

One small parser turns a page into table rows, links and text lines per element; what the rows
mean is decided by Column expressions afterwards.
"""

from __future__ import annotations

import re
from datetime import date
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docmill.functions.dates import day, standard_date
from docmill.functions.fixed import DATE, EVENT_DEPARTMENT, EVENT_LINE, EVENT_YEAR
from docmill.operators.chunks import keep_first
from docmill.operators.reports import rank_islands, streaks

TABLE = StructType([StructField("table", StringType()), StructField("heading", StringType()), StructField("caption", StringType()), StructField("header", ArrayType(StringType())), StructField("rows", ArrayType(ArrayType(StringType())))])
HEADINGS = {"h1", "h2", "h3", "h4", "strong", "dt"}


class _Tables(HTMLParser):
    """All tables with rows, each with the heading before it; ragged rows are cut or filled to the header."""

    def __init__(self, html: str):
        super().__init__()
        self.tables, self.n, self.heading, self.caption, self.header, self.cells, self.text, self.into = [], 0, "", "", None, None, "", None
        self.inside, self.own, self.table_heading = False, [], ""
        self.feed(html)
        self.close_table()

    def close_table(self) -> None:
        width = len(self.header) if self.header else max(map(len, self.own), default=0)
        header = self.header or [f"col_{i + 1}" for i in range(width)]
        if self.own:
            self.tables.append((str(self.n), self.table_heading, self.caption, header, [(r + [""] * width)[:width] for r in self.own]))
        self.own, self.header, self.caption, self.inside = [], None, "", False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.close_table()
            self.inside, self.n, self.table_heading = True, self.n + 1, self.heading
        elif tag == "tr" and self.inside:
            self.cells, self.has_th = [], False
        elif tag in ("td", "th") and self.cells is not None:
            self.into, self.text, self.has_th = "cell", "", self.has_th or tag == "th"
        elif tag == "caption" or tag in HEADINGS and not self.inside:
            self.into, self.text = tag, ""
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag: str) -> None:
        text = " ".join(self.text.split())
        if tag in ("td", "th") and self.into == "cell":
            self.cells.append(text)
            self.into = None
        elif tag == "caption" and self.into == "caption":
            self.caption, self.into = text, None
        elif tag in HEADINGS and self.into == tag:
            self.heading, self.into = text, None
        elif tag == "tr" and self.cells is not None:
            if self.cells and self.has_th and self.header is None:
                self.header = self.cells
            elif self.cells:
                self.own.append(self.cells)
            self.cells = None
        elif tag == "table":
            self.close_table()

    def handle_data(self, data: str) -> None:
        if self.into:
            self.text += data + " " * (self.into == "cell")


@F.pandas_udf(ArrayType(TABLE))
def page_tables(html: pd.Series) -> pd.Series:
    """All tables of a page; what a table's rows share stands once."""
    return html.map(lambda h: _Tables(h or "").tables)


def tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table, heading, caption, header, cells): a row per table row."""
    own = pages.select(key, F.explode(page_tables(F.col(html))).alias("t"))
    return own.select(key, "t.table", "t.heading", "t.caption", "t.header", F.explode("t.rows").alias("cells"))


def relevance(header: Column, body: Column, words: list[str]) -> Column:
    """Three points for each word in the header, else one if it stands in the first rows."""
    head, rest = F.lower(F.array_join(header, " ")), F.lower(body)
    points = F.lit(0)
    for w in words:
        points = points + F.when(head.contains(w.lower()), 3).when(rest.contains(w.lower()), 1).otherwise(0)
    return points


def canonical(name: Column, variants: dict[str, list[str]]) -> Column:
    """The first canonical name of which a variant stands in name, else name."""
    out = name
    for key, words in reversed(variants.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(name).contains(w.lower())
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def schedule_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, year, content, department, start, end): table rows with a date; the last other cell is the content.

    The first and last date of the date cell bound the period; a department stands as '주관부서 : name'.
    """
    rows = tables(pages, key, html)
    dated = F.filter("cells", lambda c: c.rlike(DATE))
    at = F.get(dated, F.lit(0))
    others = F.filter("cells", lambda c: ~c.rlike(DATE))
    own = rows.select(key, F.regexp_extract("caption", "([0-9]{4})", 1).alias("year"), at.alias("period"), F.element_at(others, -1).alias("raw")).filter("period is not null and raw is not null")
    found = F.regexp_extract_all("period", F.lit(f"({DATE})"), F.lit(1))
    date = lambda t: F.date_format(day(*(F.regexp_extract(t, DATE, i) for i in (1, 2, 3))), "yyyy-MM-dd")
    department = r"\(?주관부서\s*:\s*([^)]*)\)?"
    content = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", department, ""), r"바로가기", ""), r"\s+", " "))
    return own.select(key, "year", content.alias("content"), F.trim(F.regexp_extract("raw", department, 1)).alias("department"), date(F.get(found, F.lit(0))).alias("start"), date(F.element_at(found, -1)).alias("end")).filter("content != ''")


def schedule_lines(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, year, content, department, start, end): events of a calendar page without a table, from its text lines.

    A line that begins with a date begins an event, other lines go on with its content, but for
    years and months alone; a department stands in a line of its own. What comes before the line
    that names the school year is left out.
    """
    own = lines.withColumn("__line", F.trim(text)).filter("__line != ''")
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    year, dept = F.regexp_extract("__line", EVENT_YEAR, 1), F.regexp_extract("__line", EVENT_DEPARTMENT, 1)
    own = own.withColumns({"__year": F.nullif(year, F.lit("")), "__dept": F.nullif(F.trim(dept), F.lit("")), "__starts": F.col("__line").rlike(EVENT_LINE)})
    own = own.withColumn("__of", F.last("__year", True).over(so_far)).filter("__of is not null and __year is null")
    own = own.withColumn("__starts", F.col("__starts") & F.col("__dept").isNull())
    own = own.withColumn("__n", rank_islands(F.col("__starts"), key, [order])).filter("__n > 0")
    part = F.when(F.col("__starts"), F.regexp_extract("__line", EVENT_LINE, 3)).when(F.col("__dept").isNull() & ~F.col("__line").rlike(r"^([0-9]{4}|[0-9]{2})$"), F.col("__line"))
    part = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(part, "바로가기", ""), r"\s+", " ")), F.lit(""))
    date = lambda i: F.max(F.when(F.col("__starts"), F.regexp_extract("__line", EVENT_LINE, i)))
    text_of = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(part.isNotNull(), F.struct(order, part.alias("part"))))), lambda x: x["part"]), " ")
    out = own.groupBy(key, "__n").agg(F.max(F.when(F.col("__starts"), F.col("__of"))).alias("year"), text_of.alias("content"), F.coalesce(F.max_by("__dept", F.when(F.col("__dept").isNotNull(), F.col(order))), F.lit("")).alias("department"), date(1).alias("start"), date(2).alias("end"))
    end = F.coalesce(F.nullif("end", F.lit("")), F.col("start"))
    return out.select(key, "year", "content", "department", standard_date(F.col("start")).alias("start"), standard_date(end).alias("end"))


def contents_page(text: Column) -> Column:
    """Whether a page is a table of contents: it says so at its top, or six of its first twenty lines end in a number and six are short."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.slice(lines, 1, 20)
    numbered, short = F.size(F.filter(first, lambda x: x.rlike(r"[0-9]\s*$"))), F.size(F.filter(first, lambda x: F.length(x) <= 40))
    return F.exists(F.slice(lines, 1, 5), lambda x: x == "목차") | ((numbered >= 6) & (short >= 6))


def meal_blocks(menus: DataFrame, key: str, text: str, anchors: list[str]) -> DataFrame:
    """(key, restaurant, menu_text, is_closed): the text of a day cut at the restaurants' names.

    A block starts at its section word; it is closed if it names no price and says 휴무 or has
    fewer than four characters. Names are looked up by position, so their order in the text counts.
    """
    body = F.regexp_replace(F.split(text, "※")[0], r"\s+", " ")
    places = F.array_sort(F.filter(F.array(*(F.struct(F.instr(body, a).alias("at"), F.lit(a).alias("name")) for a in anchors)), lambda p: p["at"] > 0))
    own = menus.select(key, body.alias("body"), places.alias("places")).select(key, "body", "places", F.posexplode("places").alias("i", "p"))
    stop = F.coalesce(F.get("places", F.col("i") + 1)["at"], F.length("body") + 1)
    own = own.withColumn("stop", stop)
    block = F.trim(F.substring("body", F.col("p.at") + F.length("p.name"), F.col("stop") - F.col("p.at") - F.length("p.name")))
    start = F.regexp_instr(block, F.lit("조식|중식|중·석식|구분"))
    menu = F.when(start > 0, F.substring(block, start, F.length(block))).otherwise(F.trim(F.regexp_replace(block, r"^\([^)]*\)\s*", "")))
    closed = ~menu.rlike(r"[0-9]{1,3},[0-9]{3}") & (menu.contains("휴무") | (F.length(menu) < 4))
    return own.select(key, F.col("p.name").alias("restaurant"), F.when(closed, "휴무").otherwise(menu).alias("menu_text"), closed.alias("is_closed"))


LISTED = "array<struct<article_id: long, title: string, category: string, posted_at: string, is_pinned: boolean>>"
ITEM = re.compile(r"goDetail\((\d+)\)")


class _Items(HTMLParser):
    """List items whose link calls goDetail(id)."""

    def __init__(self, html: str):
        super().__init__()
        self.items, self.into = [], None
        self.feed(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = dict(attrs)
        name = (at.get("class") or "").split()
        if tag == "a" and (m := ITEM.search(at.get("onclick") or "")):
            self.items.append({"article_id": int(m[1]), "title": "", "category": None, "posted_at": None, "is_pinned": False})
        if not self.items:
            return
        if tag == "p" and "tit" in name:
            self.into = "title"
        elif tag == "em":
            self.into = "category"
        elif tag == "span" and "fix" in name:
            self.items[-1]["is_pinned"] = True
        elif tag == "span" and self.items[-1]["posted_at"] is None:
            self.into = "posted_at"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "em", "span"):
            self.into = None

    def handle_data(self, data: str) -> None:
        if self.into and self.items:
            old = self.items[-1][self.into]
            self.items[-1][self.into] = " ".join(f"{old or ''} {data}".split()) or None


_POSTED = re.compile(r"([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})")


def iso_date(text: str | None) -> str | None:
    """The first yyyy.M.d of a text as yyyy-MM-dd; None if it is no date."""
    try:
        return date(*map(int, _POSTED.search(text or "").groups())).isoformat()
    except (AttributeError, ValueError):
        return None


def list_items(html: str) -> list[dict]:
    """The items of a list page, with posted_at as yyyy-MM-dd."""
    return [item | {"posted_at": iso_date(item["posted_at"])} for item in _Items(html or "").items]


def board_list(pages: DataFrame, board: str, page: str, html: str = "html") -> DataFrame:
    """(board, page, place, article_id, title, category, posted_at, is_pinned) of the items on list pages."""

    @F.pandas_udf(LISTED)
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(list_items)

    return pages.select(board, page, F.posexplode(items(F.col(html))).alias("place", "i")).select(board, page, "place", "i.*")


def collected(items: DataFrame, known: DataFrame, board: str, earliest_year: int, stop_after: int = 5) -> DataFrame:
    """New items of each board, in list order, as a crawl would collect them.

    Items without a year or from earliest_year on count as recent. Old items that aren't pinned
    form a streak, a recent one ends it, pinned ones do neither; at stop_after old ones in a row the
    board ends. Old and known items are left out, and of an item listed twice the first place counts.
    """
    order = ["page", "place"]
    old = F.coalesce(F.substring("posted_at", 1, 4).try_cast("int") < earliest_year, F.lit(False))
    own = streaks(items.withColumn("old", old), board, order, F.col("old") & ~F.col("is_pinned"), ~F.col("old") & ~F.col("is_pinned"))
    so_far = Window.partitionBy(board).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("ended", F.coalesce(F.max("streak").over(so_far), F.lit(0)) >= stop_after).filter("not ended and not old")
    return keep_first(own.drop("ended", "old", "streak"), [board, "article_id"], order).join(known, [board, "article_id"], "left_anti")


def with_details(items: DataFrame, details: DataFrame, key: list[str]) -> DataFrame:
    """Items with their page's content; an item whose page could not be fetched keeps its row, with an empty body."""
    return items.join(details, key, "left").withColumn("content", F.coalesce("content", F.lit("")))


def newest_files(posts: DataFrame, board: str, order: list, suffix: str = ".pdf", n: int = 3) -> DataFrame:
    """The newest n posts of each board with the address of their first attachment of that kind, null without one. posts: attachments (name and url)."""
    nth = F.row_number().over(Window.partitionBy(board).orderBy(*order))
    found = F.filter("attachments", lambda a: F.lower(a["name"]).endswith(suffix))
    return posts.withColumn("__nth", nth).filter(F.col("__nth") <= n).withColumn("file_url", F.get(found, F.lit(0))["url"]).drop("__nth")


def in_window(rows: DataFrame, date: str, start: Column, end: Column) -> DataFrame:
    """Rows of the days that a collection asks for."""
    return rows.filter(F.col(date).between(start, end))


def unpivot_days(rows: DataFrame, keys: list[str], days: dict[str, str]) -> DataFrame:
    """A weekly table with a column per weekday to rows (keys, date, menu); days: column -> date."""
    out = rows.unpivot(keys, list(days), "weekday", "menu")
    return out.withColumn("date", F.element_at(F.create_map(*(F.lit(x) for kv in days.items() for x in kv)), F.col("weekday")).cast("date"))


def sections(lines: DataFrame, key: str, order: str, text: str, pattern: str) -> DataFrame:
    """(key, section, body): lines grouped under the last heading line before them; lines before any heading go."""
    head = F.when(F.col(text).rlike(pattern), F.col(text))
    own = lines.withColumns({"__n": rank_islands(head.isNotNull(), key, [order]), "__head": head}).filter("__n > 0")
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("__head").isNull(), F.struct(order, text)))), lambda x: x[text])
    return own.groupBy(key, "__n").agg(F.max("__head").alias("section"), F.array_join(body, "\n").alias("body")).drop("__n")


def without_repeats(text: Column, noise: list[str]) -> Column:
    """Lines without those that match a noise pattern and without a line equal to the one before."""
    kept = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    for pattern in noise:
        kept = F.filter(kept, _unlike(pattern))
    fresh = F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1)))
    return F.trim(F.regexp_replace(F.array_join(fresh, "\n"), r"\n{3,}", "\n\n"))


def _unlike(pattern: str):
    return lambda x: ~x.rlike(pattern)
