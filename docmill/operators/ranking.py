"""Recency, bonuses, orders and the fallback decision over merged hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.dates import has_any
from docmill.functions.fixed import DECAY_DAYS, GUIDE_SOURCE, RECENCY_WEIGHT


def recency(dataset: Column, date: Column, as_of: Column, decay: dict[str, float] = DECAY_DAYS) -> Column:
    """exp(-age / decay); 1 for a dataset without decay, 0 without a date; the future counts as now."""
    days = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(date.cast("timestamp"))) / 86400.0)
    rate = F.lit(None).cast("double")
    for name, d in decay.items():
        rate = F.when(dataset == name, F.lit(float(d))).otherwise(rate)
    return F.when(rate.isNull(), 1.0).when(date.isNull(), 0.0).otherwise(F.exp(-days / rate))


def normalised(score: Column, request: str) -> Column:
    """Score between the request's least and largest; where all are equal, itself within 0 and 1."""
    per = Window.partitionBy(request)
    low, high = F.min(score).over(per), F.max(score).over(per)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def final_scores(hits: DataFrame, request: str, as_of: Column, weight: float = RECENCY_WEIGHT, decay: dict[str, float] = DECAY_DAYS) -> DataFrame:
    """hits with norm_hybrid, norm_recency and final_score.

    hits: hybrid_score, dataset, sort_date, matched_query_count, date_unknown_auxiliary, is_closed,
    source_type, entry_year, own_major and guide_intent (bools), asked_year. Rows without a
    hybrid_score go. The score mixes both; then -0.20 undated auxiliary, +0.03 for each further
    matched query, -0.25 closed, +0.12 guide of the asked year or +0.06 of the latest one, +0.10 own
    major among courses.
    """
    own = hits.filter("hybrid_score is not null").withColumn("norm_hybrid", normalised(F.col("hybrid_score"), request))
    own = own.withColumn("norm_recency", recency(F.col("dataset"), F.col("sort_date"), as_of, decay))
    guide = F.coalesce((F.col("source_type") == GUIDE_SOURCE) & F.col("guide_intent"), F.lit(False))
    year = F.col("entry_year").try_cast("int")
    latest = F.max(F.when(guide, year)).over(Window.partitionBy(request))
    points = lambda when, n: F.when(F.coalesce(when, F.lit(False)), n).otherwise(0.0)
    score = (
        (1 - weight) * F.col("norm_hybrid") + weight * F.col("norm_recency")
        + points(F.col("date_unknown_auxiliary") == 1, -0.20)
        + (F.greatest(F.coalesce("matched_query_count", F.lit(1)), F.lit(1)) - 1) * 0.03
        + points(F.col("is_closed").cast("string").isin("1", "True", "true"), -0.25)
        + points(guide & F.col("asked_year").isNotNull() & (year == F.col("asked_year")), 0.12)
        + points(guide & F.col("asked_year").isNull() & (year == latest), 0.06)
        + points((F.col("dataset") == "courses") & F.col("own_major"), 0.10)
    )
    return own.withColumn("final_score", F.round(score, 6))


def default_order(key: str) -> list:
    return [F.desc("matched_query_count"), F.desc("final_score"), F.desc("hybrid_score"), key]


def recent_order(key: str) -> list:
    """Topic match, matched queries, dated notices, newest, then scores."""
    return [F.desc("notice_topic_match"), F.desc("matched_query_count"), F.desc("recent_notice_priority"), F.desc_nulls_last("sort_date"), F.desc("final_score"), F.desc("hybrid_score"), key]


def reranked(hits: DataFrame, request: str, key: str, head: int = 20, weight: float = RECENCY_WEIGHT) -> DataFrame:
    """The first head rows by rank in the order of rerank_score mixed with norm_recency, the others as they are.

    hits: rank, rerank_score (null: the request keeps its order), norm_recency, hybrid_score.
    """
    top = F.col("rank") <= head
    per = Window.partitionBy(request, top)
    low, high, missing = F.min("rerank_score").over(per), F.max("rerank_score").over(per), F.max(F.col("rerank_score").isNull()).over(per)
    norm = F.when(high > low, (F.col("rerank_score") - low) / (high - low)).otherwise(0.5)
    own = hits.withColumn("final_score", F.when(top & ~missing, F.round((1 - weight) * norm + weight * F.col("norm_recency"), 6)).otherwise(F.col("final_score"))).withColumn("__moved", top & ~missing)
    order = Window.partitionBy(request).orderBy(~top, F.when(F.col("__moved"), -F.col("final_score")), F.when(F.col("__moved"), -F.col("hybrid_score")), F.when(~F.col("__moved"), F.col("rank")), key)
    return own.withColumn("rank", F.row_number().over(order)).drop("__moved")


def topic_aligned(hits: DataFrame, request: str, rank: str, text: str, terms: list[str], first: int = 5) -> DataFrame:
    """(request, aligned): whether one of the first notices holds a focus term; true if there are no terms."""
    notices = hits.filter("dataset = 'notices'").withColumn("__nth", F.row_number().over(Window.partitionBy(request).orderBy(rank))).filter(F.col("__nth") <= first)
    found = notices.groupBy(request).agg(F.max(has_any(F.col(text), terms) if terms else F.lit(True)).alias("aligned"))
    return hits.select(request).distinct().join(found, request, "left").select(request, F.coalesce("aligned", F.lit(not terms)).alias("aligned"))


def fallback_reason(n_hits: Column, top_score: Column, min_score: Column, unavailable: Column, eliminated: Column, recency_override: Column, aligned: Column) -> Column:
    """Null, or why a request gets no answer."""
    empty = F.when(unavailable, "dataset_unavailable").when(eliminated, "date_filter_eliminated_all").otherwise("no_results")
    weak = (top_score < min_score) & ~(recency_override & aligned)
    return F.when(n_hits == 0, empty).when(weak, "score_below_threshold")
