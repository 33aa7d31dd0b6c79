"""Main text of web pages: site templates found by counting element subtrees per host, then extraction.

Every element's subtree is hashed. Spark counts on how many different pages of a host each hash
stands: subtrees above the limits are the host's template. Hosts that take turns with their parts are
met by a second, lower limit for containers, which goes outside of an explicit article alone. Kinds of elements (tag, classes and id)
are counted too: how often their subtrees recur on the host. A kind that nearly always recurs is
template as well, where it doesn't recur; and a kind that looks like page furniture by its name, but
never recurs, is none. So names only say what is likely until a host's counts are known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.plans.shared import BROADCAST_ROWS, join_checked, materialise

# Element and class names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math canvas object audio video".split())
TO_THE_END = {"script", "style", "textarea", "title"}  # unclosed, these hold the rest of the page
FOREIGN = {"svg", "math"}  # only these of RAW can close themselves
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTAINERS = set("aside div dl footer form header menu nav ol section table ul".split())
CELLS = {"td", "th", "br", "option"}
DROPPED = RAW | set("head nav aside footer header menu dialog button select input label fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
READERS = set("comment comments disqus replies respond".split())
LIKELY = READERS | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topbar toolbar notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social reply related "
    "recommended widget pagination pager skip search form".split()
)
HEADERS = {"header", "masthead"}
#: no-sidebar or has-comments tells of a page's parts; the element is no such part.
TELLING = set("has no not with without".split())
NAME = re.compile(r"[A-Za-z][^\s/>]*+")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
NAME_PARTS = re.compile(r"[a-z]+")
#: Pages that a kind's name weighs as much as, and the shares of recurring elements that it stands for.
PRIOR_PAGES, PRIOR_LIKELY, PRIOR_OTHER = 100.0, 0.9, 0.1


class Element:
    """An element. linked, size: its text in links and all of it; plain: its text outside links and dropped elements."""

    __slots__ = ("tag", "names", "role", "hidden", "children", "digest", "kind", "size", "linked", "plain")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.names, self.role, self.hidden = tag, [], "", "", False
        if attributes and not attributes.isspace():
            own = {}
            for m in ATTRIBUTE.finditer(attributes):
                own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            self.names = f"{own.get('class', '')} {own.get('id', '')}".strip().lower()
            self.role = own.get("role", "").strip().lower()
            self.hidden = "hidden" in own or own.get("aria-hidden") == "true"


def _tag_end(html: str, at: int, gone: set[str]) -> int:
    """Place behind the tag's >, quoted values skipped; -1 without one. gone: quotes that don't occur any more."""
    while m := STOP.search(html, at):
        at = m.end()
        if m[0] == ">":
            return at
        before = m.start() - 1
        while html[before].isspace():
            before -= 1
        if html[before] == "=" and m[0] not in gone:
            end = html.find(m[0], at)
            if end < 0:
                gone.add(m[0])
            else:
                at = end + 1
    return -1


@lru_cache(maxsize=len(RAW))
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/]*+>", re.I)


def parse(html: str) -> Element:
    """A tree of elements and text, in one pass and linear time.

    Unclosed and misnested tags end with their parent, a p also at the next block. An unfinished
    tag at the end of the page is no text.
    """
    root = Element("#root")
    stack, blocks, opened, gone, unclosed = [root], [], Counter(), set(), set()  # blocks: places of BLOCKS in stack
    at, size = 0, len(html)

    def close(place: int) -> None:
        opened.subtract(e.tag for e in stack[place:])
        del stack[place:]
        while blocks and blocks[-1] >= place:
            blocks.pop()

    while at < size:
        start = html.find("<", at)
        if start != at:
            stack[-1].children.append(html[at : start if start >= 0 else size])
        if start < 0:
            break
        if html.startswith(("<!", "<?"), start):
            comment = html.startswith("<!--", start)
            end = html.find("-->" if comment else ">", start + 4 * comment)
            at = end + 1 + 2 * comment if end >= 0 else size
            continue
        ends = html.startswith("/", start + 1)
        m = NAME.match(html, start + 1 + ends)
        if not m:
            stack[-1].children.append("<")
            at = start + 1
            continue
        at = _tag_end(html, m.end(), gone)
        if at < 0:
            break
        tag, attributes = m[0].lower(), html[m.end() : at - 1]
        if ends:
            if opened[tag] > 0:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close(place)
            continue
        if tag in BLOCKS and blocks and (stack[blocks[-1]].tag == "p" or stack[blocks[-1]].tag == tag == "li"):
            close(blocks[-1])
        element = Element(tag, attributes)
        stack[-1].children.append(element)
        closed = attributes.endswith("/")
        if tag in RAW:
            if not (closed and tag in FOREIGN) and tag not in unclosed:
                if end := _end_of(tag).search(html, at):
                    at = end.end()
                elif tag in TO_THE_END:
                    break
                else:
                    unclosed.add(tag)
        elif tag not in VOID and not closed:
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(element)
            opened[tag] += 1
    return root


def _walk(root: Element) -> list[Element]:
    """All elements, parents first."""
    out = [root]
    for e in out:
        out.extend(c for c in e.children if isinstance(c, Element))
    return out


@lru_cache(maxsize=1 << 14)
def _named(names: str, role: str) -> tuple[bool, bool, bool, bool]:
    """Of classes and id: whether they make page furniture likely, one does as a whole, they tell of readers, of a header."""
    tokens = names.split()
    parts = [NAME_PARTS.findall(t) for t in tokens]
    parts = {x for p in parts if p and p[0] not in TELLING for x in p}
    whole = role in ROLES or any(t in LIKELY for t in tokens)
    return whole or bool(parts & LIKELY), whole, any(t in READERS for t in tokens), bool(parts & HEADERS)


def measure(root: Element, hashes: bool = True) -> list[Element]:
    """All elements, parents first, with their sizes; with hashes also subtree (tag, classes, id, text without extra white space, children) and kind."""
    every = _walk(root)
    for e in reversed(every):
        e.size = e.linked = e.plain = 0
        h = xxhash.xxh64(f"{e.tag} {e.names} {e.role}".encode("utf-8", "replace")) if hashes else None
        for c in e.children:
            if isinstance(c, Element):
                if hashes:
                    h.update(c.digest.to_bytes(8, "little", signed=True))
                e.size += c.size
                e.linked += c.linked
                e.plain += c.plain
            elif text := " ".join(c.split()):
                if hashes:
                    h.update(b"\0" + text.encode("utf-8", "replace"))
                e.size += len(text)
                e.plain += len(text)
        if e.tag == "a":
            e.linked, e.plain = e.size, 0
        elif e.tag in DROPPED:
            e.plain = 0
        if hashes:
            e.digest, e.kind = h.intdigest() - (1 << 63), kind_of(e)
    return every


def kind_of(e: Element) -> int | None:
    """Hash of tag, classes, id and role without digits; none for an element without names and for what always goes or always stays."""
    if not (e.names or e.role) or e.tag in DROPPED or e.tag in ("html", "body", "main", "#root") or _named(e.names, e.role)[2]:
        return None
    return xxhash.xxh64_intdigest(f"kind {e.tag} {re.sub('[0-9]+', '', e.names)} {e.role}".encode("utf-8", "replace")) - (1 << 63)


def _headings(e: Element) -> list[Element]:
    """The outermost first and second headings in e."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if x.tag in ("h1", "h2"):
            out.append(x)
        else:
            todo.extend(c for c in reversed(x.children) if isinstance(c, Element))
    return out


def _found(root: Element, tag: str, template: frozenset[int]) -> list[Element]:
    """The outermost wanted elements of this tag."""
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        # here a name counts only as a whole class or id: sidebar-left may well be the layout that holds the article
        if e.hidden or e.tag in DROPPED or e.tag not in ("html", "body", "main") and _named(e.names, e.role)[1]:
            continue
        if e.tag == tag:
            found.append(e)
        elif not (template and e.digest in template):
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))
    return found


def _beside(root: Element, found: list[Element], template: frozenset[int]) -> int:
    """The text outside of the elements found, and outside of what tags, names and counts tell to be furniture."""
    out, todo, own = 0, [root], {id(e) for e in found}
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            out += len(" ".join(e.split()))
        elif id(e) not in own and e.tag != "a" and not (_named(e.names, e.role)[1] or _goes(e, root, template)) and not (template and (e.digest in template or e.kind in template)):
            todo.extend(e.children)
    return out


def _roots(root: Element, template: frozenset[int]) -> list[Element]:
    """The elements whose text is the page's: articles, if they hold at least half of the wanted text, else the same of main, else all.

    Articles that are cards or comments by a part of their name stand back where others hold half of the
    articles' text. So a teaser or a comment in an article of its own never takes the text's place.
    """
    for tag in ("article", "main"):
        found = _found(root, tag, template)
        plain = sum(e.plain for e in found)
        held = [e for e in found if not _named(e.names, e.role)[0]]
        if 2 * sum(e.plain for e in held) >= plain:
            found = held
        if found and sum(e.plain for e in found) >= _beside(root, found, template):
            return found
    return [root]


def _goes(e: Element, top: Element, template: frozenset[int]) -> bool:
    """Whether e's tag or name, with what the host's counts say of its kind, keeps it out of top's text."""
    if e.hidden or e.tag in DROPPED:
        return True
    if e.tag in ("html", "body", "main", "#root"):
        return False
    likely, _, readers, _ = _named(e.names, e.role)
    if e.tag == "article" and top.tag != "article" and (2 * e.linked >= e.size or likely) and 2 * e.plain <= top.plain:
        return True  # a card of links or a comment beside the text
    if template and likely and e.kind in template:
        return False
    return readers or (likely or e.tag == "form") and 2 * e.plain <= top.plain  # what holds most of the text is a wrapper


def _recurring(top: Element, template: frozenset[int]) -> set[int]:
    """The ids of elements in top to cut out because the host's counts say so.

    In an article or main: elements of links, and others if together they hold at most half of
    the text, for a page most of which recurs is a copy of others, not a template. Elsewhere all,
    if any text is left, and the containers that recur at the lower limit unless they hold most of
    the text.
    """
    strict = top.tag in ("article", "main")
    links, others, plain, todo = set(), set(), 0, list(top.children)
    while todo:
        e = todo.pop()
        if isinstance(e, str) or _goes(e, top, template):
            continue
        turns = not strict and e.tag in CONTAINERS and ~e.digest in template and 2 * e.plain <= top.plain
        if e.digest in template or turns or e.kind in template and not _named(e.names, e.role)[0]:
            if 2 * e.linked >= e.size:
                links.add(id(e))
            else:
                others.add(id(e))
                plain += e.plain
        else:
            todo.extend(e.children)
    return links | others if (2 * plain <= top.plain if strict else plain < top.plain) else links


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text in page order, joined by a line feed; template: subtrees and kinds of the host, as ``site_templates`` gives them."""
    root = parse(html or "")
    measure(root, bool(template))
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(parts).split()):
            blocks.append(text)
        parts.clear()

    for top in _roots(root, template):
        strict = top.tag in ("article", "main")
        cut = _recurring(top, template) if template else ()
        todo: list = [(top, True)]
        while todo:
            e, opening = todo.pop()
            if isinstance(e, str):
                parts.append(unescape(e))
            elif not opening:
                flush() if e.tag in BLOCKS else parts.append(" ")
            else:
                inside = e.children
                if e is not top and (id(e) in cut or _goes(e, top, template)):
                    if id(e) in cut or not (strict and (e.tag == "header" or _named(e.names, e.role)[3])):
                        if e.tag in BLOCKS:
                            flush()
                        continue
                    inside = _headings(e)
                if e.tag in BLOCKS:
                    flush()
                elif e.tag in CELLS:
                    parts.append(" ")
                if e.tag in BLOCKS or e.tag in CELLS:
                    todo.append((e, False))
                todo.extend((c, True) for c in reversed(inside))
        flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def site_templates(pages: DataFrame, share: float = 0.5, least: int = 5, rare: float = 0.01, keep: list[str] | None = None) -> DataFrame:
    """(host, template): per host the subtrees on over share of its different pages, and on least or more, and the kinds its counts decide.

    The complement of a container's hash is listed if it is on over rare of the pages, and on least or more.
    A kind is listed if counts overrule its name: of its elements, counted by pages, so many recur
    on other pages (or so few, for a likely name) that with PRIOR_PAGES pages for the name the
    share crosses a half. Pages of a host whose whole trees are equal count once, so copies
    don't turn a page into a template. A page adds a hash once, so the count needs no distinct
    shuffle, and sums are formed before the shuffle. Kinds on under rare of a host's pages are left
    out, so a host lists at most its mean elements per page / share + / rare hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.list_(pa.struct([("subtree", pa.int64()), ("kind", pa.int64()), ("likely", pa.bool_()), ("container", pa.bool_())]))
        for b in batches:
            trees, wholes = [], []
            for html in b["html"]:
                every = measure(parse(html.as_py() or ""))
                wholes.append(every[0].digest)
                own = {e.digest: e for e in every if e.tag not in ("#root", "html", "head", "body")}
                trees.append([{"subtree": d, "kind": e.kind, "likely": _named(e.names, e.role)[0], "container": e.tag in CONTAINERS} for d, e in own.items()])
            yield pa.RecordBatch.from_arrays([b["host"], pa.array(wholes, pa.int64()), pa.array(trees, part)], names=["host", "page", "parts"])

    own = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, page long, parts array<struct<subtree: long, kind: long, likely: boolean, container: boolean>>")
    own = materialise(own.groupBy("host", "page").agg(F.first("parts").alias("parts")), "subtrees", keep)
    totals = materialise(own.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")), "host-pages", keep)
    trees = own.select("host", F.explode("parts").alias("p")).groupBy("host", "p.subtree").agg(F.count(F.lit(1)).alias("pages"), F.first("p.kind").alias("kind"), F.first("p.likely").alias("likely"), F.first("p.container").alias("container"))
    told = F.array(
        F.struct(F.lit("subtree").alias("of"), F.col("subtree").alias("hash")),
        F.struct(F.lit("container").alias("of"), F.when(F.col("container"), F.bitwise_not("subtree")).alias("hash")),
        F.struct(F.when(F.col("likely"), "likely").otherwise("other").alias("of"), F.col("kind").alias("hash")),
    )
    rows = trees.select("host", "pages", F.explode(told).alias("t")).select("host", "pages", "t.hash", "t.of").filter(F.col("hash").isNotNull() & (F.col("of").isin("likely", "other") | (F.col("pages") >= least)))
    sums = rows.groupBy("host", "hash", "of").agg(F.sum("pages").alias("n"), F.sum(F.when(F.col("pages") > 1, F.col("pages")).otherwise(0)).alias("again"))
    sums = join_checked(sums.filter(F.col("n") >= least), totals, ["host"])
    likely, some = F.col("of") == "likely", F.col("n") >= F.col("host_pages") * F.lit(float(rare))
    recur = (F.col("again") + F.when(likely, PRIOR_LIKELY).otherwise(PRIOR_OTHER) * PRIOR_PAGES) > 0.5 * (F.col("n") + PRIOR_PAGES)
    often = sums.filter(F.when(F.col("of") == "subtree", F.col("n") > F.col("host_pages") * F.lit(float(share))).when(F.col("of") == "container", some).otherwise(some & (recur != likely)))
    return materialise(often.groupBy("host").agg(F.collect_list("hash").alias("template")), "templates", keep)


def extract(pages: DataFrame, share: float = 0.5, least: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars, host.

    text: the main text, empty if there is none or html is null; n_chars: its code points. Pages
    without a host in their url form one host. Ties: equal pages count once for a template. Repeated
    rows get equal texts; an empty table gives no rows; other columns of pages are not read. Very
    long and broken pages take time in proportion to their length; a task holds the tree of one.
    """
    templates = site_templates(pages, share, least, keep=keep)
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    kind = own.schema["page_id"].dataType.simpleString()
    small = (templates.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_ROWS
    known = {r["host"]: frozenset(r["template"]) for r in templates.collect()} if small else {}  # BROADCAST_ROWS hashes at most
    if not small:
        own = join_checked(own, templates, ["host"], weight="template").select("page_id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = (known.get(h, frozenset()) for h in b["host"].to_pylist()) if small else (frozenset(t.as_py() or ()) for t in b["template"])
            texts = [main_text(h.as_py(), t) for h, t in zip(b["html"], of, strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b["host"]], names=["page_id", "url", "text", "n_chars", "host"])

    return own.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, host string")
