"""Questions to routes, policies, query lists and scopes."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docmill.functions.dates import has_any
from docmill.functions.fixed import BOARDS, DATASETS, GRADUATION_TERMS, GUIDE_TERMS, MIN_SCORE, RECENT_TOPICS, RECENT_WORDS, ROUTES, SCHOOL_TERMS, SCOPE_TERMS, STAFF_WORDS
from docmill.plans.shared import BROADCAST_ROWS, join_checked

NO_MAJOR = ["Default", "Unknown"]


def keyword_route(query: Column) -> Column:
    """Datasets whose pattern stands in the query, in rule order; notices if none."""
    found = F.array_compact(F.array(*(F.when(F.lower(query).rlike(pattern), F.lit(name)) for name, pattern in ROUTES)))
    return F.when(F.size(found) == 0, F.array(F.lit("notices"))).otherwise(found)


def merged_route(intent: Column, routed: Column, sub_datasets: Column, query: Column) -> Column:
    """The intent if it names a dataset, then the routed ones, then those of sub-queries; rules join courses that ask for guide terms."""
    first = F.when(intent.isin(DATASETS), F.array(intent)).otherwise(F.array().cast("array<string>"))
    route = F.array_distinct(F.concat(first, routed, F.coalesce(sub_datasets, F.array().cast("array<string>"))))
    route = F.when(F.size(route) == 0, F.array(F.lit("notices"))).otherwise(route)
    return F.when(F.array_contains(route, "courses") & ~F.array_contains(route, "rules") & has_any(query, GUIDE_TERMS), F.array_append(route, F.lit("rules"))).otherwise(route)


def recent_notice(query: Column, route: Column) -> Column:
    return F.array_contains(route, "notices") & has_any(query, RECENT_TOPICS) & has_any(query, RECENT_WORDS)


def staff_lookup(query: Column, route: Column) -> Column:
    return F.array_contains(route, "staff") & has_any(query, STAFF_WORDS)


def school_info(query: Column, names: tuple[str, ...] = ()) -> Column:
    """Whether a school term, or one of the institution's own names, stands in the query; white space doesn't count."""
    return has_any(F.regexp_replace(F.lower(query), r"(?U)\s+", ""), [*SCHOOL_TERMS, *names])


def entry_year(query: Column) -> Column:
    """20dd at a word start, else dd before 학번."""
    full, short = (F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in (r"(?U)\b(20[0-9]{2})", r"(?U)\b([0-9]{2})\s*학번"))
    return F.coalesce(full.cast("int"), short.cast("int") + 2000)


def board(query: Column, route: Column) -> Column:
    """The first board named in the query, with or without a space before 공지; null unless notices are routed."""
    out = F.lit(None).cast("string")
    for name in reversed(BOARDS):
        out = F.when(query.contains(name) | query.contains(name[:-2] + " 공지"), F.lit(name)).otherwise(out)
    return F.when(F.array_contains(route, "notices"), out)


def policy(query: Column, route: Column) -> Column:
    """Struct (name, min_score, allow_recency_override) of the first policy that fits."""
    has = lambda name: F.array_contains(route, name)
    made = lambda name, score, override=False: F.struct(F.lit(name).alias("name"), F.lit(round(score, 6)).alias("min_score"), F.lit(override).alias("allow_recency_override"))
    return (
        F.when(recent_notice(query, route), made("recent_notices", max(MIN_SCORE - 0.04, 0.08), True))
        .when(staff_lookup(query, route), made("staff_lookup", min(MIN_SCORE, max(MIN_SCORE - 0.03, 0.08))))
        .when(has("courses") & (F.size(F.array_except(route, F.array(F.lit("courses"), F.lit("rules")))) == 0), made("courses", min(MIN_SCORE, max(MIN_SCORE - 0.07, 0.05))))
        .when((has("rules") | has("schedule")) & ~has("notices"), made("rules_schedule", MIN_SCORE))
        .when(has("notices"), made("general_notices", MIN_SCORE))
        .otherwise(made("default", MIN_SCORE))
    )


def retrieval_queries(raw: Column, normal: Column, searches: Column, subs: Column, expanded: Column, extras: Column, max_subs: int = 4) -> Column:
    """Distinct queries in order: raw, normalised, searches (3), sub-queries; the expansion if fewer than three; cut to 3, or 2 + max_subs with sub-queries; extras beyond that."""
    none = F.array().cast("array<string>")
    trimmed = lambda a: F.filter(F.transform(F.coalesce(a, none), lambda x: F.trim(x)), lambda x: x != "")
    one = lambda c: F.filter(F.array(F.trim(F.coalesce(c, F.lit("")))), lambda x: x != "")
    compound = F.size(trimmed(subs)) > 0
    out = F.array_distinct(F.concat(F.array(F.trim(raw)), one(normal), trimmed(F.slice(F.coalesce(searches, none), 1, 3)), trimmed(subs)))
    out = F.when(F.size(out) < 3, F.array_union(out, one(expanded))).otherwise(out)
    return F.array_union(F.when(compound, F.slice(out, 1, 2 + max_subs)).otherwise(F.slice(out, 1, 3)), F.coalesce(extras, none))


def department_map(catalogue: DataFrame, order: str | None = None) -> DataFrame:
    """(department, college) of a catalogue; the placeholder college and blanks go, the last row of a department wins.

    order: a column that rises from row to row. Without it rows count in the order of the catalogue's
    partitions, which is the file's only if there is one.
    """
    last = F.col(order) if order else F.monotonically_increasing_id()
    own = catalogue.select(F.trim("department_name").alias("department"), F.trim("college_name").alias("college"), last.alias("n")).filter("department != '' and college != '' and college != '대학'")
    return own.groupBy("department").agg(F.max_by("college", "n").alias("college"))


def longest_match(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, value: str) -> DataFrame:
    """rows with (name, value) of the longest name that stands in text, ties by name, then value; null without one.

    names: written. Up to BROADCAST_ROWS of them become one automaton, which a task runs over each
    text once, without a shuffle; more are met by ``longest_by_parts``.
    """
    if names.count() > BROADCAST_ROWS:
        return longest_by_parts(rows, key, text, names, name, value)
    found = names.filter(F.col(name) != "").groupBy(name).agg(F.min(value).alias(value)).orderBy(name).collect()  # BROADCAST_ROWS at most
    kind = StructType([StructField(name, StringType()), StructField(value, names.schema[value].dataType)])

    @F.pandas_udf(kind)
    def longest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for i, r in enumerate(found):
            automaton.add_word(r[0], i)
        automaton.make_automaton()
        for texts in batches:
            best = [min((i for _, i in automaton.iter(t)), key=lambda i: (-len(found[i][0]), i), default=None) if t and len(automaton) else None for t in texts]
            yield pd.DataFrame({name: [found[i][0] if i is not None else None for i in best], value: [found[i][1] if i is not None else None for i in best]})

    out = rows.withColumn("__best", longest(F.col(text)))
    return out.select(*rows.columns, F.col("__best")[name].alias(name), F.col("__best")[value].alias(value))


def longest_by_parts(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, value: str) -> DataFrame:
    """``longest_match`` for many names: each text gives its substrings of the lengths that names have, which meet the names in an equality join."""
    sizes = [r[0] for r in names.select(F.length(name)).distinct().collect()]  # a number for each length
    none = F.array().cast("array<string>")

    def cuts(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)

    parts = [cuts(n) for n in sizes if n]
    own = rows.select(key, F.explode(F.array_distinct(F.concat(*parts) if parts else none)).alias(name))
    hit = own.join(names.select(name, value), name).groupBy(key).agg(F.min(F.struct(-F.length(name), F.col(name), F.col(value))).alias("m"))
    return rows.join(hit.select(key, F.col("m")[name].alias(name), F.col("m")[value].alias(value)), key, "left")


def scope_queries(query: Column, major: Column, own_college: Column, named_college: Column) -> Column:
    """Further queries about graduation and college-wide matters; own_college: of the major, named_college: of the department in the query."""
    real = F.when((F.coalesce(major, F.lit("")) != "") & ~major.isin(NO_MAJOR), F.trim(major))
    graduation, suffix = has_any(query, GRADUATION_TERMS), F.lit(" 졸업기준")
    college = F.coalesce(F.when(real.isNotNull(), own_college), named_college)
    scope = F.coalesce(query.contains(real), F.lit(False)) | F.coalesce(named_college == college, F.lit(False)) | has_any(query, SCOPE_TERMS)
    return F.array_distinct(F.array_compact(F.array(
        F.when(graduation & named_college.isNotNull(), F.concat(named_college, suffix)),
        F.when(graduation & real.isNotNull(), F.concat(real, suffix)),
        F.when(graduation & real.isNotNull() & own_college.isNotNull(), F.concat(own_college, suffix)),
        F.when(scope & college.isNotNull(), college),
    )))


def scope_label(major: Column, college: Column) -> Column:
    return F.when(F.coalesce(major, F.lit("")) == "", "").when(college.isNotNull(), F.concat(F.trim(major), F.lit(" ("), college, F.lit(")"))).otherwise(F.trim(major))


def scope_filter(dataset: Column, major: Column, college: Column, asked_major: Column, asked_college: Column) -> Column:
    """Own major or college; only courses are filtered."""
    return F.coalesce((dataset != "courses") | asked_major.isNull() | (major == asked_major) | (college == asked_college), F.lit(False))


def cacheable(route: Column, fallback: Column, date_filtered: Column, grounded: Column, answer: Column) -> Column:
    """Whether an answer may be cached."""
    return ~fallback & ~F.array_contains(route, "meals") & ~date_filtered & F.coalesce(grounded, F.lit(True)) & (F.coalesce(F.trim(answer), F.lit("x")) != "")


def with_college(rows: DataFrame, major: str, colleges: DataFrame) -> DataFrame:
    """rows with the college of their major, null if unknown; colleges: written."""
    return join_checked(rows, colleges.select(F.col("department").alias(major), "college"), [major])


def ordered_distinct(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): distinct values per key, in order of first appearance."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias("values"))


def last_before(rows: DataFrame, key: str, order: str, value: str) -> Column:
    """The latest filled value so far within key."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
