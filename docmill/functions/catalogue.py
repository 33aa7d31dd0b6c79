"""Rules for department catalogues and curriculum links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.dates import has_any
from docmill.functions.fixed import NAME_BOILERPLATE, NOT_CURRICULUM_TEXTS, NOT_CURRICULUM_URLS, NOT_DEPARTMENT_NAMES, NOT_DEPARTMENTS


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clean_name(name: Column) -> Column:
    """A name without link boilerplate."""
    out = squeezed(name)
    for word in NAME_BOILERPLATE:
        out = F.replace(out, F.lit(word), F.lit(""))
    return squeezed(out)


def department_like(name: Column) -> Column:
    """Holds a department word, or is three characters or more and ends in 과; none of the excluded names or words."""
    text = squeezed(name)
    barred = (F.length(text) < 2) | F.lower(text).isin(NOT_DEPARTMENT_NAMES) | text.startswith("#") | has_any(text, NOT_DEPARTMENTS)
    named = has_any(text, ["학과", "전공", "학부"]) | has_any(F.lower(text), ["department", "major"])
    cleaned = clean_name(name)
    return ~barred & (named | ((F.length(cleaned) >= 3) & cleaned.endswith("과")))


def college_like(name: Column) -> Column:
    text = squeezed(name)
    return (F.length(text) >= 2) & (has_any(text, ["대학", "학부"]) | has_any(F.lower(text), ["college", "school", "faculty"]))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def valid_row(department: Column, url: Column, college: Column, denied_hosts: list[str]) -> Column:
    return department_like(department) & ~has_any(squeezed(college), NOT_DEPARTMENTS) & ~host(url).isin(denied_hosts) & ~F.coalesce(url.contains("search.do"), F.lit(False))


def internal_url(base: Column, url: Column, suffix: str) -> Column:
    return (host(url) != "") & ((host(url) == host(base)) | host(url).endswith(suffix))


def same_page(base: Column, url: Column) -> Column:
    """The same scheme, host and path, a last slash aside, and no query."""
    part = lambda u, p: F.coalesce(F.try_parse_url(u, F.lit(p)), F.lit(""))
    path = lambda u: F.regexp_replace(part(u, "PATH"), "/+$", "")
    return (part(base, "PROTOCOL") == part(url, "PROTOCOL")) & (part(base, "AUTHORITY") == part(url, "AUTHORITY")) & (path(base) == path(url)) & (part(url, "QUERY") == "")


def source_type(anchor: Column, url: Column, hub: str = "") -> Column:
    """What a curriculum link leads to; hub: address of the official overview."""
    both = F.lower(F.concat_ws(" ", anchor, url))
    official = url.contains(hub) if hub else F.lit(False)
    return (
        F.when(both.contains("pdf"), F.when(official, "official_pdf").otherwise("pdf_curriculum"))
        .when(url.contains("/article/") | url.contains("/reference/detail/"), "reference_article")
        .when(anchor.contains("해설") | both.contains("description"), "course_description")
        .when(has_any(anchor, ["총괄표", "이수체계도", "개설"]), "curriculum_table")
        .otherwise("curriculum_page")
    )


def usable_candidate(base: Column, anchor: Column, url: Column) -> Column:
    strong = has_any(anchor, ["총괄표", "이수체계도", "해설", "전공과목", "학부과정"])
    return ~has_any(F.lower(F.concat_ws(" ", anchor, url)), NOT_CURRICULUM_TEXTS) & ~has_any(F.lower(url), NOT_CURRICULUM_URLS) & (~same_page(base, url) | strong)


def candidate_score(base: Column, anchor: Column, url: Column) -> Column:
    """Struct that sorts candidates, the best largest."""
    points = lambda when, n: F.when(when, n).otherwise(0)
    score = points(~same_page(base, url), 3) + points(has_any(anchor, ["총괄표", "이수체계도"]), 3) + points(anchor.contains("해설"), 2) + points(has_any(anchor, ["학부과정", "전공과목"]), 1)
    return F.struct(score.alias("score"), F.length(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))).alias("path"), (-F.length(anchor)).alias("anchor"))
