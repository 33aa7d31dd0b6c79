"""Administration, log and evaluation rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.fixed import GATES, PAGE_LIMITS, VERDICTS


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")


def with_latest(left: DataFrame, log: DataFrame, key: str, order: list) -> DataFrame:
    """left with the newest log row of its key, or nulls: one join for what would be a lookup per row."""
    return left.join(latest(log, [key], order), key, "left")


def counted(rows: DataFrame, by: Column, name: str, unknown: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(by, F.lit(unknown)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def feedback_rollup(rows: DataFrame, rating: str, by: list[str]) -> DataFrame:
    """up, down, total and satisfaction = up / (up + down), null without either."""
    up, down = F.count_if(F.col(rating) > 0), F.count_if(F.col(rating) < 0)
    return rows.groupBy(*by).agg(up.alias("up"), down.alias("down"), F.count(F.lit(1)).alias("total"), F.round(F.try_divide(up, up + down), 6).alias("satisfaction"))


def grounding_rollup(rows: DataFrame, checked: Column, grounded: Column, by: list[str]) -> DataFrame:
    """checked, ungrounded (of all rows, checked or not) and their rate."""
    n, bad = F.count_if(checked), F.count_if(F.coalesce(~grounded, F.lit(False)))
    return rows.groupBy(*by).agg(n.alias("checked"), bad.alias("ungrounded"), F.round(F.try_divide(bad, n), 6).alias("ungrounded_rate"))


def visitors(rows: DataFrame, session: str, time: str, shift_hours: int = 9) -> DataFrame:
    """Distinct sessions per day of a fixed offset from UTC."""
    day = F.to_date(F.col(time) + F.make_dt_interval(F.lit(0), F.lit(shift_hours)))
    return rows.groupBy(day.alias("day")).agg(F.count_distinct(session).alias("visitors"), F.count(F.lit(1)).alias("n"))


def health(n_rows: Column, missing: Column, no_index: Column, old_version: Column) -> Column:
    """'ok', or the first reason that degrades a dataset."""
    return F.when(missing, "artifact_missing").when(n_rows == 0, "empty_collection").when(no_index, "vectorizer_missing").when(old_version, "version_mismatch").otherwise("ok")


def evaluation(results: DataFrame, by: str | None = None) -> DataFrame:
    """Means of the result columns, null where nothing is valid; with by, per group (null is a group)."""
    means = {"route_hit_rate": "hit", "context_recall_proxy": "context_recall_proxy", "answer_relevancy_proxy": "keyword_score", "fallback_rate": "fallback", "avg_top_hybrid_score": "top_hybrid_score"}
    aggs = [F.count(F.lit(1)).alias("count"), *(F.round(F.avg(F.col(c).try_cast("double")), 6).alias(n) for n, c in means.items() if c in results.columns)]
    return results.groupBy(by).agg(*aggs) if by else results.agg(*aggs)


def gates(metrics: DataFrame, thresholds: dict[str, float] = GATES) -> DataFrame:
    """(metric, value, threshold, passed): above the threshold is good, but for fallback_rate; null metrics give no row."""
    wide = metrics.select(*(c for c in thresholds if c in metrics.columns))
    out = wide.unpivot([], wide.columns, "metric", "value").filter("value is not null")
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv)), F.col("metric"))
    return out.withColumn("threshold", limit).withColumn("passed", F.when(F.col("metric") == "fallback_rate", F.col("value") <= limit).otherwise(F.col("value") >= limit))


def recall_at(hits: DataFrame, totals: DataFrame, request: str, ks: tuple[int, ...] = (5, 10, 20, 40)) -> DataFrame:
    """(request, n_relevant, recall_at_k ...): share of the relevant rows among the first k; null without relevant rows.

    hits: rank and relevant (boolean) per hit. totals: n_relevant per request; the relevant rows
    themselves are counted, never paired with requests.
    """
    found = hits.groupBy(request).agg(*(F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"f{k}") for k in ks)).join(totals, request, "left")
    return found.select(request, F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), *(F.round(F.try_divide(f"f{k}", F.nullif("n_relevant", F.lit(0))), 6).alias(f"recall_at_{k}") for k in ks))


def cost(rows: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """Sum of known costs, null if none is known, to eight digits."""
    return rows.groupBy(*by).agg(F.round(F.sum(amount), 8).alias("cost"))


def rank_islands(flag: Column, key: str, order: list) -> Column:
    """Number of the run that a row belongs to: it grows at each row whose flag holds."""
    return F.sum(flag.cast("int")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def streaks(rows: DataFrame, key: str, order: list, counts: Column, resets: Column) -> DataFrame:
    """rows with streak: how many counting rows lie since the last reset of their key, this one included."""
    own = rows.withColumns({"__counts": counts.cast("int"), "__resets": resets.cast("int")})
    own = own.withColumn("__island", rank_islands(F.col("__resets") == 1, key, order))
    run = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.withColumn("streak", F.sum(F.when(F.col("__resets") == 0, F.col("__counts")).otherwise(0)).over(run)).drop("__counts", "__resets", "__island")


def clamped(limit: int, kind: str) -> int:
    """A page size as asked for, between one and the largest of its kind."""
    return min(max(limit, 1), PAGE_LIMITS[kind])


def page(rows: DataFrame, order: list, limit: int, kind: str) -> DataFrame:
    """The first rows in order, as many as ``clamped`` admits: a report of a page."""
    return rows.orderBy(*order).limit(clamped(limit, kind))


def last_published(rows: DataFrame, date: str, by: list[str]) -> DataFrame:
    """The latest date of each group among those that are dates."""
    return rows.groupBy(*by).agg(F.max(F.try_to_date(F.col(date), "yyyy-MM-dd")).alias("last_published"))


def verdict_shares(judged: DataFrame, by: list[str]) -> DataFrame:
    """Shares of a judge's verdicts and of grounded answers among those with a verdict; rows with none or an unknown one don't count."""
    own = judged.filter(F.col("verdict").isin(VERDICTS))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("judged"), *(share(F.col("verdict") == v).alias(v) for v in VERDICTS), share(F.col("grounded")).alias("grounded"))


def collection_diagnosis(sources: DataFrame, records: DataFrame, by: str = "department_name") -> DataFrame:
    """Per department: found and missing sources, its records by kind, failed crawls, records with a course code and with a grade, status.

    sources: department_name, status (found, not_found). records: department_name, record_type
    (table_row, section, .. error), course_code, grade. Both are counted before they are joined.
    """
    found = sources.groupBy(by).agg(F.count_if(F.col("status") == "found").alias("found_sources"), F.count_if(F.col("status") != "found").alias("not_found_sources"))
    kind, filled = F.col("record_type"), lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    made = records.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(kind == "table_row").alias("table_rows"), F.count_if(kind == "section").alias("section_rows"), F.count_if(kind.contains("error")).alias("crawl_errors"),
        F.count_if(filled("course_code")).alias("rows_with_course_code"), F.count_if(filled("grade")).alias("rows_with_grade"),
    )
    both = found.join(made, by, "full_outer").na.fill(0)
    status = F.when(F.col("found_sources") == 0, "no_source").when(F.col("total_records") == F.col("crawl_errors"), "crawl_failed").when(F.col("crawl_errors") > 0, "partial").otherwise("ok")
    return both.withColumn("status", status)


def console(results: DataFrame, by: str) -> DataFrame:
    """Per dataset: questions, hit rate, misses, place by hit rate, the best first."""
    own = results.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.count_if(F.col("hit") == 0).alias("misses"))
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hit_rate"), by)))  # a row per dataset


def report_lines(metrics: DataFrame, by_dataset: DataFrame, gated: DataFrame) -> DataFrame:
    """(part, line): the lines of a Markdown report of ``evaluation`` and ``gates``: a row per metric, dataset and gate that isn't passed."""
    percent = lambda c: F.coalesce(F.format_string("%.2f%%", c * 100), F.lit("n/a"))
    names = [c for c in metrics.columns if c != "count"]
    head = metrics.select(F.explode(F.array(*(F.struct(F.lit(f"1 {i}").alias("part"), F.concat(F.lit(f"- {n}: "), percent(F.col(n))).alias("line")) for i, n in enumerate(names)))).alias("l")).select("l.*")
    cells = F.concat_ws(" | ", F.coalesce("dataset", F.lit("unknown")), F.col("count").cast("string"), *(percent(F.col(n)) for n in names))
    body = by_dataset.select(F.concat(F.lit("2 "), F.coalesce("dataset", F.lit("unknown"))).alias("part"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    warn = gated.filter(~F.col("passed")).select(F.concat(F.lit("3 "), "metric").alias("part"), F.concat(F.lit("- "), "metric", F.lit(" "), F.format_string("%.4f", "value"), F.lit(" misses "), F.format_string("%.2f", "threshold")).alias("line"))
    return head.unionByName(body).unionByName(warn)
