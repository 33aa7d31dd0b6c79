"""Quality rules: per-text counts, and lines that recur across the documents of a host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docmill.plans.shared import join_checked, materialise

SYMBOLS = "#*$%&|<>"
#: Words from which on a text's windows are counted as numbers.
LONG_TEXT = 1 << 16
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words"]


def line_key(line: Column) -> Column:
    """A line as it is compared: lower case, white space runs one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order; what is made of them is a second step, so that a key is computed once."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_key)


def line_hashes(text: Column) -> Column:
    """64-bit hash of each line's key, in order; null for a line without a word."""
    return F.transform(line_keys(text), lambda k: F.when(k != "", F.xxhash64(k)))


def with_own(lines: Column, often: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(lines, those of often that are among them): a hashed intersection first, so that no line is looked up in all of often.

    Both stand in arrays of one, so that Spark computes them once for a text, not once for a line.
    """
    return F.transform(F.array(lines), lambda x: F.transform(F.array(F.array_intersect(x, often)), lambda mine: then(x, mine))[0])[0]


def frequent_lines(docs: DataFrame, share: float = 0.05, least: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Per host: the lines above the limits, as often: array of (line, owner).

    A line is above the limits if over ``share`` of the host's documents and at least ``least`` of
    them hold it. Documents of identical text count as one, so copies don't make their lines
    boilerplate. owner: MD5 of the first text that holds the line (smallest doc_id, null last); it
    keeps the line. A host has at most its mean lines per text / share such lines.
    """
    own = docs.select("source", "doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"), F.array_distinct(F.filter(line_hashes(F.col("text")), lambda h: h.isNotNull())).alias("lines"))
    texts = own.groupBy("source", "digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"), F.first("lines").alias("lines"))
    texts = materialise(texts, "texts", keep)
    totals = materialise(texts.groupBy("source").agg(F.count(F.lit(1)).alias("host_texts")), "host-texts", keep)
    lines = texts.select("source", F.explode("lines").alias("line"), F.struct("first", "digest").alias("holder")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("texts"), F.min("holder").alias("holder"))
    often = join_checked(lines.filter(F.col("texts") >= least), totals, ["source"]).filter(F.col("texts") > F.col("host_texts") * F.lit(float(share)))
    often = often.groupBy("source").agg(F.collect_list(F.struct("line", F.col("holder.digest").alias("owner"))).alias("often"))
    return materialise(often, "frequent", keep)


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more, the first included. Long texts take numbers for their words, not tuples."""
    if len(words) < LONG_TEXT:
        triples = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(triples)) == len(triples):
            return 0
        seen, end, repeated = Counter(triples), 0, 0
        for i, t in enumerate(triples):
            if seen[t] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
        return repeated
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    at, n = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)[1:]
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= n[at] > 1
    return int(inside.sum())


def _counts(text: str | None, frequent: list[int]) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()  # bytes split at [\x20\x09-\x0D] alone
    repeated = repeat_words(words)
    lines = text.split("\n")
    worded = [x for x in lines if x.strip(" \t\n\r\v\f")]
    removed = sum(len(lines[i].encode().split()) for i in frequent)
    chars = len(text) - sum(map(text.count, " \t\n\r\v\f"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded)), repeated, removed


def judge(docs: DataFrame, share: float = 0.05, least: int = 10, min_words: int = 50, max_removed: float = 0.5, extra: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, source, text): counts, base_failed, kept, the text without frequent lines.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words
    (those of frequent lines), base_failed, kept, cleaned, and the columns of ``extra``.
    base_failed: fewer than min_words words, or over half the words in 3-word windows found twice
    or more. kept: not base_failed, and frequent lines hold at most max_removed of the words.
    A null text has no words and fails; its cleaned text is null. Null sources form one host;
    repeated rows get equal verdicts; an empty table gives no rows. There are no ties: at a limit a
    line stays. A text is counted as a whole: memory follows its words.
    """
    often = frequent_lines(docs, share, least, keep)
    own = docs.select("doc_id", "source", "text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"), *(F.col(f"`{c}`").alias(f"__extra_{c}") for c in extra or []))
    own = join_checked(own, often, ["source"], weight="often")
    theirs = F.transform(F.filter("often", lambda x: x["owner"] != F.col("digest")), lambda x: x["line"])
    own = own.withColumn("often", F.when(F.size("often") > 0, theirs))
    places = lambda lines, mine: F.filter(F.transform(lines, lambda h, i: F.when(F.array_contains(mine, h), i)), lambda i: i.isNotNull())
    at = with_own(line_hashes(F.col("text")), F.col("often"), places)
    own = own.withColumn("at", F.when(F.size("often") > 0, at).otherwise(F.array().cast("array<int>"))).drop("often", "digest", "source")
    rest = [c for c in own.columns if c != "at"]
    schema = StructType([*(own.schema[c] for c in [*rest, "at"]), *(StructField(c, LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_counts(t.as_py(), f.as_py()) for t, f in zip(b["text"], b["at"], strict=True)]
            cols = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), b["at"], *cols], names=[*rest, "at", *COUNTS])

    out = own.mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("removed_words") > F.col("n_words") * F.lit(float(max_removed))
    cleaned = F.when(F.size("at") == 0, F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("at", i)), "\n"))
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), cleaned.alias("cleaned"), *(F.col(f"__extra_{c}").alias(c) for c in extra or []))


def keep_good(docs: DataFrame, keep: list[str] | None = None, **limits) -> DataFrame:
    """The kept rows of docs with its own columns; text loses its frequent lines and n_chars follows.

    Rows with a null text go, for they have no words; null sources are one host; repeated rows stay or go
    together. Columns of any name keep their place; text and n_chars are the only ones that change. At a
    limit a row stays (no ties). An empty table gives no rows. A very long text is judged as a whole.
    """
    cols = docs.columns
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in cols if c != "text")).alias("__row"))
    out = judge(whole, extra=["__row"], keep=keep, **limits).filter("kept")
    own = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return out.select(*((own[c] if c in own else F.col("__row")[c]).alias(c) for c in cols))
