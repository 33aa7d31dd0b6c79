"""Cleaning and small scalar rules as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docmill.functions.fixed import PARTICLES, SECTION_BOILERPLATE, SECTION_IGNORED, SECTION_SIGNALS, SENTENCE_MARKS, SQUEEZE, SYNONYMS, TRUE_WORDS, WORD_TOKENIZERS

INVISIBLE = "​‌‍⁠﻿­"

#: Bytes of texts that are Python strings at once.
SLICE = 1 << 20


def strip_markup(html: Column) -> Column:
    """Text of markup by patterns: scripts and styles to a space, breaks and block ends to a line feed, other tags to a space."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?is)</(p|div|li|tr|h[1-6])>", "\n")
    return F.regexp_replace(out, r"(?is)<[^>]*>", " ")


def _by_slice(texts: pa.Array, change: Callable[[str], str], plain: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Texts changed, but for those that plain tells are the same afterwards; Python holds a slice of SLICE bytes, or one text, at once."""
    texts = texts.cast(pa.large_string())
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
    parts, a = [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        own, a = texts.slice(a, b - a), b
        todo = pc.fill_null(pc.invert(plain(own)), False)
        if pc.any(todo).as_py():
            own = pc.replace_with_mask(own, todo, pa.array([change(t) for t in own.filter(todo).to_pylist()], own.type))
        parts.append(own)
    return pa.chunked_array(parts, texts.type).cast(pa.string()).combine_chunks() if parts else texts.cast(pa.string())


def _nfkc(texts: pa.Array) -> pa.Array:
    return _by_slice(texts, lambda t: unicodedata.normalize("NFKC", t), pc.string_is_ascii)


def _unescape(texts: pa.Array) -> pa.Array:
    from html import unescape as decode

    return _by_slice(texts, decode, lambda t: pc.invert(pc.match_substring(t, "&")))


@F.arrow_udf(StringType())
def unescape(text: pa.Array) -> pa.Array:
    """Character references of markup decoded; Spark has no function for them."""
    return _unescape(text)


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode NFKC; Spark has no function for it."""
    return _nfkc(text)


@F.arrow_udf(StringType())
def unescaped_nfkc(text: pa.Array) -> pa.Array:
    """Character references decoded, then NFKC, in one Python step."""
    return _nfkc(_unescape(text))


#: Said to be non-deterministic, which it isn't: a filter on the result is then not pushed below it, where a second Python worker a task would work it out again.
_once = unescaped_nfkc.asNondeterministic()


def normalize_unicode(text: Column) -> Column:
    return F.translate(nfkc(F.coalesce(text, F.lit(""))), INVISIBLE, "")


def squeeze(text: Column) -> Column:
    """White-space rules for text that is already in NFKC, in their order."""
    for pattern, by in SQUEEZE:
        text = F.regexp_replace(text, pattern, by)
    return text


def normalize_whitespace(text: Column) -> Column:
    return squeeze(normalize_unicode(text))


def clean_text(html: Column) -> Column:
    """Markup and white space removed: the cleaned body of a document."""
    return squeeze(F.translate(_once(strip_markup(html)), INVISIBLE, ""))


def filled(value: Column) -> Column:
    """The trimmed text, null for empty text and 'nan'."""
    text = F.trim(value.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def first_filled(*values: Column) -> Column:
    """The first value with text in it, else empty."""
    return F.coalesce(*(filled(v) for v in values), F.lit(""))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def article_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/detail/([0-9]+)", 1).try_cast("bigint")


def attachments(value: Column) -> tuple[Column, Column]:
    """(list of name and url, whether parsing failed) of a JSON text."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.from_json(text, "array<struct<name: string, url: string>>")
    fine = parsed.isNotNull() & text.startswith("[")
    return F.when(fine, parsed).otherwise(F.array().cast("array<struct<name: string, url: string>>")), (text != "") & ~fine


def grade_label(value: Column) -> Column:
    """'학사2년' to '2학년'; each part of a comma list gets 학년."""
    bare = F.replace(value, F.lit("학사"), F.lit(""))
    parts = F.transform(F.split(F.replace(bare, F.lit("년"), F.lit("")), ","), lambda x: F.concat(F.trim(x), F.lit("학년")))
    return F.when(bare.contains(","), F.array_join(parts, ", ")).otherwise(F.replace(bare, F.lit("년"), F.lit("학년")))


def phone_like(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(r"^[0-9]{2,4}[-.]?[0-9]{3,4}([-.]?[0-9]{4})?$"), F.lit(False))


def chunk_title(text: Column, cut: int = 120) -> Column:
    """The text in leading brackets, else the first line, cut."""
    bracket = F.trim(F.regexp_extract(text, r"^\[([^\]]*)\]", 1))
    line = F.substring(F.trim(F.split(text, "\n")[0]), 1, cut)
    return F.when(text.startswith("[") & text.contains("]"), bracket).otherwise(F.coalesce(line, F.lit("")))


def slug(name: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(name)), r"[^0-9a-z가-힣]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(out, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^0-9A-Za-z가-힣._-]+", "_")


def homepage_url(url: Column, suffix: str, denied: list[str]) -> Column:
    """Whether url is http(s), of a host under suffix and not one of denied."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(url.rlike("^https?://") & host.endswith(suffix) & ~host.isin(denied), F.lit(False))


def expand_synonyms(query: Column) -> Column:
    """Thirteen substring replacements in order; later ones see what earlier ones wrote."""
    for short, full in SYNONYMS.items():
        query = F.replace(query, F.lit(short), F.lit(full))
    return query


def tokens(text: Column) -> Column:
    """Distinct tokens of two characters or more: word, word without its particle, 2- and 3-grams of long Hangul words."""
    particle = "|".join(sorted(PARTICLES, key=lambda p: (-len(p), p)))
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([가-힣A-Za-z0-9]+)"), F.lit(1)), F.lower)

    def of(word: Column) -> Column:
        stem = F.regexp_replace(word, f"^(.{{2,}}?)(?:{particle})$", "$1")
        gram = lambda n: F.transform(F.sequence(F.lit(1), F.length(stem) - (n - 1)), lambda i: F.substring(stem, i, F.lit(n)))
        grams = F.when(stem.rlike("^[가-힣]{4,}$"), F.concat(gram(2), gram(3))).otherwise(F.array().cast("array<string>"))
        # particles and grams are Hangul, so other words stand alone
        return F.when(word.rlike("[가-힣]"), F.concat(F.array(word, stem), grams)).otherwise(F.array(word))

    long = lambda t: F.length(t) >= 2
    return F.when(text.rlike("[가-힣]"), F.array_distinct(F.filter(F.flatten(F.transform(words, of)), long))).otherwise(F.array_distinct(F.filter(words, long)))


def money_per_million(tokens_in: Column, tokens_out: Column, price_in: float | None, price_out: float | None) -> Column:
    """Estimated cost, null without prices."""
    if price_in is None or price_out is None:
        return F.lit(None).cast("double")
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 8)


def unfenced(text: Column) -> Column:
    """A model's reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", ""))


class _Strings(HTMLParser):
    """Text nodes outside of elements that hold no text."""

    EMPTY = {"script", "style", "noscript", "iframe", "head"}

    def __init__(self, html: str):
        super().__init__()
        self.nodes, self.open, self.fresh = [], [], True
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.fresh = True
        if tag in self.EMPTY:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.fresh = True
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data: str) -> None:
        self.fresh = True

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data: str) -> None:
        if not self.open:
            self.nodes += [data] if self.fresh else []
            if not self.fresh:
                self.nodes[-1] += data
            self.fresh = False


@F.pandas_udf(StringType())
def parsed_text(html: pd.Series) -> pd.Series:
    """Text nodes of markup, a line feed between them, without scripts, styles, noscript, iframes and head; text without markup as it is, blank and null text empty."""
    return html.map(lambda h: "" if not h or not h.strip() else "\n".join(_Strings(h).nodes) if "<" in h or "&" in h else h)


@F.pandas_udf(StringType())
def without_marked_sections(markup: pd.Series) -> pd.Series:
    """Markup without its <![ ... ]> sections that name data-hwpjson; one scan from mark to mark."""

    def clean(text: str | None) -> str | None:
        out, at, low = [], 0, (text or "").lower()
        while (start := low.find("<![", at)) >= 0 and (end := low.find("]>", start)) >= 0:
            out.append(text[at:start] if "data-hwpjson" in low[start:end] else text[at : end + 2])
            at = end + 2
        return text if text is None else "".join(out) + text[at:]

    return markup.map(clean)


def neutral_sections(markup: Column) -> Column:
    """<![ ... ]> sections turned to comments."""
    return F.regexp_replace(markup, r"<!(\[[^>]*?\])>", "<!--$1-->")


def tokens_by(name: str, text: Column) -> Column:
    """Distinct tokens by the tokenizer's name: whole words of two characters or more, or ``tokens`` for all other names."""
    if name.strip().lower() in WORD_TOKENIZERS:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1)))
    return tokens(text)


def usage(message: Column) -> Column:
    """Struct (input_tokens, output_tokens, total_tokens) of a reply's JSON, whatever the keys' names; null if it tells none. A missing total is the sum."""
    raw = F.get_json_object(message, "$.usage_metadata")
    other = F.coalesce(F.get_json_object(message, "$.response_metadata.token_usage"), F.get_json_object(message, "$.response_metadata.usage"))
    own = F.when(raw.startswith("{"), raw).otherwise(other)
    get = lambda *keys: F.coalesce(*(F.get_json_object(own, f"$.{k}").try_cast("double").cast("long") for k in keys))
    n_in, n_out, n_all = get("input_tokens", "prompt_tokens"), get("output_tokens", "completion_tokens"), get("total_tokens")
    zero = F.lit(0).cast("long")
    a, b = F.coalesce(n_in, zero), F.coalesce(n_out, zero)
    told = n_in.isNotNull() | n_out.isNotNull() | n_all.isNotNull()
    return F.when(told, F.struct(a.alias("input_tokens"), b.alias("output_tokens"), F.coalesce(n_all, a + b).alias("total_tokens")))


def useful_section(title: Column, text: Column, department: Column) -> Column:
    """Whether a page's section tells of courses: no boilerplate, not the page's own name, and a signal word or a sentence."""
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    has = lambda c, words: F.greatest(*(c.contains(w) for w in words))
    head, body = squeezed(title), squeezed(text)
    barred = has(F.lower(body), SECTION_BOILERPLATE) | (F.lower(head) == "popup zone") | head.eqNullSafe(department) | has(body, SECTION_IGNORED)
    return (body != "") & ~barred & (has(body, SECTION_SIGNALS) | has(body, SENTENCE_MARKS))


def menu_section(raw: Column) -> Column:
    """What a section cell of a menu names, from its key words in their order, with the price if there is one; empty if it names nothing."""
    joined = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", "")
    price = F.regexp_replace(F.regexp_extract(F.coalesce(raw, F.lit("")), r"([0-9]{1,3},[0-9]{3}\s*원)", 1), " ", "")
    named = lambda label: F.concat_ws(" ", F.lit(label), F.nullif(price, F.lit("")))
    return (
        F.when(joined.contains("석식"), named("석식"))
        .when(joined.contains("B") & joined.contains("코너"), named("중식 B코너"))
        .when(joined.contains("A코너"), named("중식 A코너"))
        .when(joined.contains("특별"), named("중식 특별코너"))
        .when(joined.contains("일반"), "일반(뚝배기)")
        .when(joined.contains("중식"), named("중식"))
        .otherwise("")
    )
