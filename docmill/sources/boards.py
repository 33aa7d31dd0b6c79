"""A Spark data source over stored list pages of boards, as a batch and as a stream.

The pages lie as Spark's partitioned writer puts them: ``board=<name>/page=<number>/<files>``. They are
read with pyarrow's file systems, so the path may be local, on HDFS or in an object store.

    spark.dataSource.register(BoardSource)
    spark.read.format("board_pages").load(path)
    spark.readStream.format("board_pages").load(path)
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docmill.sources.pages import list_items

#: Pages of a board that a task of the batch reader reads.
PAGES_PER_TASK = 50
PLACE = re.compile(r"board=([^/]*)/page=(-?[0-9]+)/[^/_.][^/]*$")
SCHEMA = "board string, page int, place int, article_id long, title string, category string, posted_at string, is_pinned boolean"
Page = tuple[int, str, int]  # number, file, time of its last change in ns


class Pages(InputPartition):
    """Pages of a board; items with an id above low and at most high."""

    def __init__(self, board: str, pages: list[Page], low: int | None = None, high: int | None = None):
        self.board, self.pages, self.low, self.high = board, pages, low, high


def stored_pages(path: str) -> dict[str, list[Page]]:
    """The pages of each board in order; what lies elsewhere in the folder is no page. Lists names, reads nothing."""
    store, root = fs.FileSystem.from_uri(path)
    found = defaultdict(list)
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File and (m := PLACE.search(f.path)):
            found[unquote(m[1])].append((int(m[2]), f.path, f.mtime_ns or 0))
    return {board: sorted(pages) for board, pages in sorted(found.items())}


def items_of(path: str, board: str, pages: list[Page]) -> Iterator[tuple]:
    """The list items of these pages, page by page; a page of several files counts its items on."""
    store, _ = fs.FileSystem.from_uri(path)
    last, place = None, 0
    for number, file, _ in pages:
        place = place if number == last else 0
        last = number
        with store.open_input_stream(file) as f:
            html = f.read().decode("utf-8", "replace")
        for item in list_items(html):
            yield (board, number, place, item["article_id"], item["title"], item["category"], item["posted_at"], item["is_pinned"])
            place += 1


class BoardReader(DataSourceReader):
    """All list items, in partitions by board and page. Option known: JSON of the highest known id of each board, whose items up to it are left out."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], max(1, int(options.get("pagespertask", PAGES_PER_TASK)))
        self.known = json.loads(options.get("known", "{}"))

    def partitions(self) -> list[Pages]:
        return [Pages(b, pages[i : i + self.step], self.known.get(b)) for b, pages in stored_pages(self.path).items() for i in range(0, len(pages), self.step)] or [Pages("", [])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from (r for r in items_of(self.path, partition.board, partition.pages) if partition.low is None or r[3] > partition.low)


class BoardStream(DataSourceStreamReader):
    """New list items. The offset is the highest known id of each board, so a restart gives no item twice.

    A batch holds the ids between two offsets, each once, at its first place. Pages that haven't changed
    since this reader last saw them aren't read again to find the newest id, and a batch reads only pages
    with an id in its range. New items of a board are one partition: after the first batch they are few.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.seen: dict[str, tuple[int, int]] = {}  # file: time of its last change, its highest id

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _highest(self, board: str, pages: list[Page]) -> int:
        for page in pages:
            if self.seen.get(page[1], (None,))[0] != page[2]:
                self.seen[page[1]] = (page[2], max((r[3] for r in items_of(self.path, board, [page])), default=-1))
        return max(self.seen[p[1]][1] for p in pages)

    def latestOffset(self) -> dict:  # noqa: N802
        found = {board: self._highest(board, pages) for board, pages in stored_pages(self.path).items()}
        return {board: high for board, high in found.items() if high >= 0}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        stored = stored_pages(self.path)
        out = []
        for board, high in end.items():
            low, pages = start.get(board, -1), stored.get(board, [])
            if high > low and pages:
                self._highest(board, pages)
                out.append(Pages(board, [p for p in pages if self.seen[p[1]][1] > low], low, high))
        return out or [Pages("", [])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        given: set[int] = set()
        for r in items_of(self.path, partition.board, partition.pages):
            if partition.low < r[3] <= partition.high and r[3] not in given:
                given.add(r[3])
                yield r

    def commit(self, end: dict) -> None:
        pass


class BoardSource(DataSource):
    """Format ``board_pages``: (board, page, place, article_id, title, category, posted_at, is_pinned) of the items on stored list pages.

    posted_at is yyyy-MM-dd, null without a date. Items need a link that calls goDetail(id); a page
    without one, an empty page and an empty folder give no rows. Options: path, pagesPerTask, known.
    """

    @classmethod
    def name(cls) -> str:
        return "board_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoardReader:  # noqa: ANN001
        return BoardReader(self.options)

    def streamReader(self, schema) -> BoardStream:  # noqa: ANN001, N802
        return BoardStream(self.options)
