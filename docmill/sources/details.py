"""Detail pages of a board: title, date, views, text and attachments of a post."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.sources.cascade import _Node, _text, _Tree, _walk
from docmill.sources.pages import iso_date

# Marks of a post's date and views, and its download call.
DATE_MARK, VIEWS_MARK = "등록일", "조회"
DOWNLOAD = re.compile(r"downGO\('(.+?)','(.+?)','(.+?)'\)")
FILE_PATH = "/cmmn/fileDown.do?filename={}&filepath={}&filerealname={}"

DETAIL = "title string, posted_at string, views long, content string, attachments array<struct<name: string, url: string>>, parsed boolean"
_FILES = pa.list_(pa.struct([("name", pa.string()), ("url", pa.string())]))


def _first(node: _Node, tag: str, name: str | None = None) -> _Node | None:
    return next((x for x in _walk(node) if x is not node and x.tag == tag and (name is None or name in x.classes)), None)


def _child(node: _Node | None, tag: str, name: str | None = None) -> _Node | None:
    return next((x for x in node.children if isinstance(x, _Node) and x.tag == tag and (name is None or name in x.classes)), None) if node else None


def _lines(node: _Node) -> str:
    """The texts inside, each trimmed, one a line; scripts are none."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out += [x.strip()] if x.strip() else []
        elif x.tag not in ("script", "style"):
            todo.extend(reversed(x.children))
    return "\n".join(out)


def detail(html: str | None, base: str) -> tuple:
    """(title, posted_at, views, content, attachments, parsed) of a page; one without a post isn't parsed."""
    post = _first(_Tree(html or "").root, "div", "board_view")
    if post is None:
        return None, None, None, "", [], False
    head = next((x for x in _walk(post) if x.tag == "div" and "tit" in x.classes), None)
    title, posted, views = _child(head, "p"), None, None
    for x in _walk(_child(head, "div", "info") or _Node("div", [])):
        text = _text(x) if x.tag == "span" else ""
        if text.startswith(DATE_MARK):
            posted = iso_date(text)
        elif text.startswith(VIEWS_MARK) and (m := re.search("[0-9]+", text)):
            views = int(m[0])
    content, files = _first(post, "div", "view_cont"), _first(post, "div", "view_files")
    links = [x.href for x in _walk(files) if x.tag == "a" and x.href] if files else []
    found = [m.groups() for href in links if (m := DOWNLOAD.search(href))]
    attached = [{"name": name, "url": urljoin(base, FILE_PATH.format(quote(name), quote(path, safe="/"), quote(stored)))} for name, path, stored in found]
    return _text(title) if title else "", posted, views, _lines(content) if content else "", attached, True


def detail_pages(pages: DataFrame, key: str, base: str, html: str = "html") -> DataFrame:
    """(key, title, posted_at, views, content, attachments, parsed) of detail pages.

    posted_at is yyyy-MM-dd, null without a date, as views is without a number. A page without a post, an
    empty and a null one have an empty content and parsed false: the list's data stand for them.
    Repeated pages give a row each; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*(detail(h, base) for h in b[html].to_pylist()), strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), _FILES, pa.bool_()]
            yield pa.RecordBatch.from_arrays([b[key], *map(pa.array, found, kinds)], names=[key, "title", "posted_at", "views", "content", "attachments", "parsed"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {DETAIL}")
