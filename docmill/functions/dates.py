"""Dates in text: standard form, deadlines, and date phrases of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.fixed import BODY_DEADLINE, DATE, DEADLINE_WORDS, MONTH_DAY, MONTH_DAY_END, RECENT_PHRASES, TITLE_DEADLINE


def day(year: Column, month: Column, dom: Column) -> Column:
    """The date, null if there is no such day."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.try_to_date(F.concat_ws("-", pad(year, 4), pad(month, 2), pad(dom, 2)), "yyyy-MM-dd")


def _parts(text: Column, pattern: str, groups: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, i + 1), F.lit("")) for i in range(groups)]


def standard_date(value: Column) -> Column:
    """The first year-month-day in value as YYYY-MM-DD; null if there is none or no such day."""
    return F.date_format(day(*_parts(value, DATE, 3)), "yyyy-MM-dd")


def _not_before(found: Column, published: Column) -> Column:
    """found, a year later if it lies before published."""
    later = day(F.year(found) + 1, F.month(found), F.dayofmonth(found))
    return F.when(found < published, later).otherwise(found)


def deadline_in_title(title: Column, published: Column) -> Column:
    """A date after a deadline marker; the year is that of published (a date) unless given."""
    y, m, d = _parts(title, TITLE_DEADLINE, 3)
    return F.when(published.isNotNull(), _not_before(day(F.coalesce(y, F.year(published).cast("string")), m, d), published))


def deadline_in_body(body: Column, published: Column) -> Column:
    """Within 180 characters after the first period word: a full range end, a month-day range end, a full date, a month-day; the first that stands there decides."""
    start = F.regexp_instr(body, F.lit(BODY_DEADLINE))
    length = F.length(F.regexp_extract(body, f"({BODY_DEADLINE})", 1))
    window = F.when(start > 0, F.substring(body, start + length, F.lit(180)))
    end_full, end_short = _parts(window, r"(?:~|-|–|—|∼|〜)\s*" + DATE, 3), _parts(window, MONTH_DAY_END, 2)
    one_full, one_short = _parts(window, DATE, 3), _parts(window, MONTH_DAY, 2)
    short = lambda p: _not_before(day(F.year(published), *p), published)
    return (
        F.when(end_full[0].isNotNull(), day(*end_full))
        .when(end_short[0].isNotNull() & published.isNotNull(), short(end_short))
        .when(one_full[0].isNotNull(), day(*one_full))
        .when(one_short[0].isNotNull() & published.isNotNull(), short(one_short))
    )


def apply_deadline(title: Column, body: Column, published: Column) -> Column:
    return F.date_format(F.coalesce(deadline_in_title(title, published), deadline_in_body(body, published)), "yyyy-MM-dd")


def near_year(month: Column, dom: Column, ref: Column) -> Column:
    """Year of a month-day seen at ref: the next one for January in December, the last one for December in January."""
    shift = F.when((F.month(ref) == 12) & (month == 1), 1).when((F.month(ref) == 1) & (month == 12), -1).otherwise(0)
    return day(F.year(ref) + shift, month, dom)


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return F.coalesce(out, F.lit(False))


def date_filter(query: Column, as_of: Column) -> Column:
    """Struct (start, end, label, is_relative, relaxed_start, relaxed_end, kind) of the first date phrase; null if there is none.

    Weeks start on Monday. The kind is deadline if any deadline word stands in the query.
    """
    deadline = has_any(query, DEADLINE_WORDS)
    kind = F.when(deadline, "deadline").otherwise("published")
    none = F.lit(None).cast("date")
    week = F.date_trunc("week", as_of).cast("date")
    first = F.trunc(as_of, "month")

    def made(start: Column, end: Column, label: str, relative: bool = True, relaxed: tuple = (none, none)) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(label).alias("label"), F.lit(relative).alias("is_relative"), relaxed[0].alias("relaxed_start"), relaxed[1].alias("relaxed_end"), kind.alias("kind"))

    has = lambda *words: has_any(query, list(words))
    plus = lambda n: F.date_add(as_of, n)
    relative = (
        F.when(deadline & query.contains("마감") & query.contains("임박"), made(as_of, plus(7), "deadline_imminent", relaxed=(as_of, plus(14))))
        .when(has("오늘"), made(as_of, as_of, "today", relaxed=(plus(-2), as_of)))
        .when(has("어제"), made(plus(-1), plus(-1), "yesterday"))
        .when(has("내일"), made(plus(1), plus(1), "tomorrow"))
        .when(has(*RECENT_PHRASES), made(plus(-6), as_of, "recent", relaxed=(plus(-29), as_of)))
        .when(has("지난주", "지난 주"), made(F.date_add(week, -7), F.date_add(week, -1), "last_week"))
        .when(has("이번주", "이번 주"), made(week, F.date_add(week, 6), "this_week"))
        .when(has("다음주", "다음 주"), made(F.date_add(week, 7), F.date_add(week, 13), "next_week"))
        .when(has("지난달", "지난 달"), made(F.add_months(first, -1), F.date_add(first, -1), "last_month"))
        .when(has("이번달", "이번 달"), made(first, F.last_day(as_of), "this_month"))
        .when(has("다음달", "다음 달"), made(F.add_months(first, 1), F.last_day(F.add_months(first, 1)), "next_month"))
    )
    full = day(*_parts(query, r"([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일", 3))
    y, m = _parts(query, r"([0-9]{4})년\s*([0-9]{1,2})월", 2)
    month = day(y, m, F.lit("1"))
    (bare,) = _parts(query, r"(?<![0-9])([0-9]{1,2})월(?!\s*[0-9]{1,2}일)", 1)
    this_year = day(F.year(as_of), bare, F.lit("1"))
    specific = (
        F.when(full.isNotNull(), made(full, full, "specific_day", False))
        .when(month.isNotNull(), made(month, F.last_day(month), "specific_month", False))
        .when(this_year.isNotNull(), made(this_year, F.last_day(this_year), "specific_month", False))
    )
    return F.coalesce(relative, specific)


def sort_date(published: Column, updated: Column) -> Column:
    """The time that hits are ranked by: of published, or of updated where that is null; null if it is no time."""
    return F.try_to_timestamp(F.coalesce(published.cast("string"), updated.cast("string"))).cast("timestamp_ntz")
