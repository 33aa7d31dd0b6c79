"""Line dedup by site-relative frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.line_quality import line_keys, with_own
from docmill.plans.shared import join_checked, materialise


def line_hashes(text: Column) -> Column:
    """MD5 of each line's key, in order; null for a line without a word."""
    return F.transform(line_keys(text), lambda k: F.when(k != "", F.md5(k.cast("binary"))))


def boilerplate(docs: DataFrame, ratio: float = 0.1, least: int = 5) -> DataFrame:
    """Per host: total pages and the hashes of the lines on more than ratio of them and on least or more.

    Within a page a line counts once, so pages are counted without a distinct shuffle. A host's
    hashes are at most its mean lines per page / ratio.
    """
    host = docs.select("source", F.array_distinct(F.filter(line_hashes(F.col("text")), lambda h: h.isNotNull())).alias("keys"))
    totals = host.groupBy("source").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = host.select("source", F.explode("keys").alias("key")).groupBy("source", "key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least)
    totals = materialise(totals, "host-pages")
    often = join_checked(lines, totals, ["source"]).filter(F.col("pages") > F.col("host_pages") * F.lit(float(ratio)))
    often = materialise(often.groupBy("source").agg(F.sort_array(F.collect_list("key")).alias("often")), "boilerplate")
    return materialise(join_checked(totals, often, ["source"]).select("source", "host_pages", F.coalesce("often", F.array().cast("array<string>")).alias("often")), "hosts")


def drop_site_lines(docs: DataFrame, ratio: float = 0.1, least: int = 5) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, text, n_lines, n_dropped, host_pages.

    text: without the lines that occur on more than ratio of the host's pages (and on least or
    more). A null text stays null and counts as a page without lines; null sources are one host;
    repeated rows are pages of their own. Lines without a word stay. There are no ties: a line on
    just ratio of the pages stays. An empty table gives no rows; other columns of docs are not read.
    A very long text is one row of its task, as are its lines' hashes.
    """
    hosts = boilerplate(docs, ratio, least)
    out = join_checked(docs.select("doc_id", "source", "text"), hosts, ["source"], weight="often")
    left = lambda keys, gone: F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), keys.alias("key")), lambda x: x["key"].isNull() | ~F.array_contains(gone, x["key"]))
    out = out.withColumn("__left", with_own(line_hashes(F.col("text")), F.col("often"), left))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = out.select("doc_id", F.array_join(F.col("__left.line"), "\n").alias("__text"), n.alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.size("__left")).cast("long").alias("n_left"), "host_pages", F.col("text").isNull().alias("__none"))
    return out.select("doc_id", F.when(~F.col("__none"), F.col("__text")).alias("text"), "n_lines", (F.col("n_lines") - F.col("n_left")).alias("n_dropped"), "host_pages")
