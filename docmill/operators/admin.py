"""Submissions, role scopes, prompt parts, grouped guide sections, log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.fixed import BODY_LABEL, BY_LABEL, DATE_LABEL, FILES_LABEL, GUIDE_DEPARTMENTS, GUIDE_SOURCE, GUIDE_YEAR, NO_SOURCE, PART_LABEL, SOURCE_LABEL, SUBMISSIONS, SUBMITTED_BOARDS, SUBMITTED_CATEGORIES, TITLE_LABEL, WHEN_LABEL, WHERE_LABEL
from docmill.functions.text import attachments, filled, unfenced
from docmill.operators.reports import latest, rank_islands


def field(data: Column, name: str) -> Column:
    """A field of JSON text, null if blank."""
    return filled(F.get_json_object(data, f"$.{name}"))


def submission_problem(kind: Column, data: Column) -> Column:
    """Null for a valid submission, else what is wrong with it: type, JSON, or the missing fields."""
    missing = F.lit("")
    for name, needed in SUBMISSIONS.items():
        blank = F.concat_ws(", ", *(F.when(field(data, f).isNull(), F.lit(f)) for f in needed))
        missing = F.when(F.trim(kind) == name, blank).otherwise(missing)
    known = F.coalesce(F.trim(kind).isin(list(SUBMISSIONS)), F.lit(False))
    parsed = F.coalesce(F.try_parse_json(data).isNotNull() & F.trim(data).startswith("{"), F.lit(False))
    return F.when(~known, "unknown type").when(~parsed, "not a JSON object").when(missing != "", F.concat(F.lit("missing: "), missing))


def department(kind: Column, data: Column) -> Column:
    """Knowledge names its department in category first, the others in department first."""
    category, dept = field(data, "category"), field(data, "department")
    return F.coalesce(F.when(kind == "custom_knowledge", F.coalesce(category, dept)).otherwise(F.coalesce(dept, category)), F.lit(""))


def submission_notices(rows: DataFrame, as_of: Column) -> DataFrame:
    """Approved submissions (kind, data) to notice rows: board, title, category, date, content."""
    kind, data = F.col("kind"), F.col("data")
    get = lambda name: F.coalesce(field(data, name), F.lit(""))
    dept = department(kind, data)
    by = F.when(dept != "", F.concat(F.lit(BY_LABEL), dept))
    full = lambda text: F.trim(F.concat_ws("\n\n", F.when(text != "", text), by))
    when = F.concat(F.lit(WHEN_LABEL), get("start_date"), F.when((get("end_date") != "") & (get("end_date") != get("start_date")), F.concat(F.lit(" ~ "), get("end_date"))).otherwise(""))
    event = F.concat_ws("\n\n", field(data, "description"), when, F.when(get("location") != "", F.concat(F.lit(WHERE_LABEL), get("location"))), by)
    pick = lambda k, e, a: F.when(kind == "custom_knowledge", k).when(kind == "event", e).when(kind == "announcement", a)
    return rows.filter(kind.isin(list(SUBMISSIONS))).select(
        *(c for c in rows.columns if c not in ("kind", "data")),
        pick(*map(F.lit, SUBMITTED_BOARDS.values())).alias("board"), pick(get("question"), get("title"), get("title")).alias("title"),
        pick(F.lit(SUBMITTED_CATEGORIES["custom_knowledge"]), F.lit(SUBMITTED_CATEGORIES["event"]), F.coalesce(field(data, "category"), F.lit(SUBMITTED_CATEGORIES["announcement"]))).alias("category"),
        pick(F.date_format(as_of, "yyyy-MM-dd"), get("start_date"), get("date")).alias("date"), pick(full(get("answer")), event, full(get("content"))).alias("content"),
    )


def in_scope(data: Column, own_department: Column) -> Column:
    """Role scope of an item: its department, else its category, equals one's own; without either it is hidden."""
    return F.coalesce(F.coalesce(field(data, "department"), field(data, "category")) == own_department, F.lit(False))


def context_part(rank: Column, source: Column, title: Column, published: Column, url: Column, text: Column, files: Column) -> Column:
    """A numbered part of the prompt's context, with links to attachments."""
    line = lambda label, c: F.coalesce(F.concat(F.lit(label), filled(c), F.lit("\n")), F.lit(""))
    links = F.transform(F.filter(attachments(files)[0], lambda a: a["name"].isNotNull() & a["url"].isNotNull()), lambda a: F.concat(F.lit("- ["), a["name"], F.lit("]("), a["url"], F.lit(")")))
    tail = F.when(F.size(links) > 0, F.concat(F.lit(f"\n{FILES_LABEL}\n"), F.array_join(links, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit(PART_LABEL), rank.cast("string"), F.lit(SOURCE_LABEL), F.coalesce(source, F.lit(NO_SOURCE)), F.lit("]:\n"), line(TITLE_LABEL, title), line(DATE_LABEL, published), line("URL: ", url), F.lit(f"{BODY_LABEL}\n"), text, F.lit("\n"), tail)


def grounding(reply: Column, least: float) -> Column:
    """Struct (checked, grounded, score) of a judge's reply; one that can't be read passes unchecked."""
    score = F.get_json_object(unfenced(reply), "$.score").try_cast("double")
    clamped = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return F.struct(score.isNotNull().alias("checked"), F.coalesce(clamped >= least, F.lit(True)).alias("grounded"), clamped.alias("score"))


def followups(reply: Column, question: Column, n: int = 3) -> Column:
    """The first n different questions of a JSON list that aren't blank or the question itself."""
    asked = F.transform(F.from_json(unfenced(reply), "array<string>"), lambda x: F.trim(x))
    return F.coalesce(F.slice(F.array_distinct(F.filter(asked, lambda x: (x != "") & (x != F.trim(question)))), 1, n), F.array().cast("array<string>"))


def guide_prefix(hits: DataFrame, request: str, asked_year: str, courses_routed: str) -> DataFrame:
    """(request, year): the guide year that an answer's note names: the asked one, else the latest among guide hits; none without guide hits."""
    guide = hits.filter(F.col("source_type") == GUIDE_SOURCE).groupBy(request).agg(F.max(F.col("entry_year").try_cast("int")).alias("latest"), F.max(asked_year).alias("asked"), F.max(courses_routed).alias("courses"))
    return guide.select(request, F.when(F.col("courses") | F.col("asked").isNull(), F.coalesce("asked", "latest")).alias("year"))


def grouped_sections(lines: DataFrame, key: str, order: str, text: str, names: list[str]) -> DataFrame:
    """(key, name, body): lines under the last header of one of names, which stands alone, in brackets, or before a phone number in parentheses.

    Lines before any header form a section of their own with an empty name.
    """
    own = lines.withColumn("__line", F.trim(text)).filter("__line != ''")
    head = F.lit(None).cast("string")
    for name in sorted(names):  # longer names are tried first, as the last to wrap
        hit = F.col("__line").isin(name, f"[{name}]", f"[ {name} ]") | F.col("__line").rlike(rf"^\Q{name}\E\s*[(（]\s*[0-9]")
        head = F.when(hit, F.lit(name)).otherwise(head)
    own = own.withColumn("__head", head)
    own = own.withColumn("__n", rank_islands(F.col("__head").isNotNull(), key, [order]))
    body = F.transform(F.sort_array(F.collect_list(F.struct(order, "__line"))), lambda x: x["__line"])
    return own.groupBy(key, "__n").agg(F.coalesce(F.max("__head"), F.lit("")).alias("name"), F.array_join(body, "\n").alias("body")).drop("__n")


def merged_descriptions(rows: DataFrame, group: str, order: str, code: str, title: str, english: str, description: str) -> DataFrame:
    """Description rows with what continues them: a row without code and titles adds its text to the one before it."""
    bad = (F.trim(code) != "") & ~F.trim(code).rlike(r"^[A-Za-z]{3}[0-9]{4}$")
    own = rows.withColumns({description: F.when(bad, F.trim(F.concat_ws(" ", filled(F.col(description)), F.concat(F.lit("("), F.trim(code), F.lit(")"))))).otherwise(F.trim(F.coalesce(description, F.lit("")))), code: F.when(bad, "").otherwise(F.trim(F.coalesce(code, F.lit(""))))})
    starts = (F.col(code) != "") | (F.trim(F.coalesce(title, F.lit(""))) != "") | (F.trim(F.coalesce(english, F.lit(""))) != "")
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    own = own.withColumn("__starts", starts | first)
    own = own.withColumn("__n", rank_islands(F.col("__starts"), group, [order]))
    text = F.transform(F.sort_array(F.collect_list(F.when(F.col(description) != "", F.struct(order, description)))), lambda x: x[description])
    return own.groupBy(group, "__n").agg(*(F.min_by(c, order).alias(c) for c in (code, title, english)), F.array_join(text, " ").alias(description)).drop("__n")


def log_rows(answers: DataFrame, hits: DataFrame, request: str, rank: str) -> tuple[DataFrame, DataFrame]:
    """One query-log row per request with its best score and source count, and one ranked row per source."""
    top = hits.groupBy(request).agg(F.max("hybrid_score").alias("top_hybrid_score"), F.count(F.lit(1)).alias("source_count"))
    return answers.join(top, request, "left").withColumn("source_count", F.coalesce("source_count", F.lit(0))), hits.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(rank)))


def with_updates(log: DataFrame, updates: DataFrame, request: str, time: str, cols: list[str]) -> DataFrame:
    """The log with later values of cols: an update is a row of its own, and the newest one of a request counts."""
    new = latest(updates, [request], [F.desc(time)]).select(request, *(F.col(c).alias(f"__{c}") for c in cols))
    out = log.join(new, request, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) if c in log.columns else F.col(f"__{c}") for c in cols}).drop(*(f"__{c}" for c in cols))


def replayed(events: DataFrame, session: str, order: str, payload: str) -> DataFrame:
    """(session, answer, error): text events of a decoded stream joined in order, and the first error."""
    own = events.select(session, order, F.from_json(payload, "type string, content string, message string").alias("e")).select(session, order, "e.*")
    text = F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == "text", F.struct(order, "content")))), lambda x: x["content"])
    return own.groupBy(session).agg(F.array_join(text, "").alias("answer"), F.min_by(F.coalesce("message", "content"), F.when(F.col("type") == "error", F.col(order))).alias("error"))


def tail_moved(sections: DataFrame, key: str, order: str, section: str, body: str, target: str, marker: str) -> DataFrame:
    """(key, section, body): sections without what follows a marker in them; these tails join the target section, in order, which is one row per key."""
    at, own = F.regexp_instr(body, F.lit(marker)), F.col(section) == target
    parts = sections.select(key, order, section, F.when(~own & (at > 0), F.trim(F.substring(body, F.lit(1), at - 1))).when(~own, F.col(body)).alias("head"), F.when(own, F.col(body)).when(at > 0, F.substring(body, at, F.length(body))).alias("tail"))
    tails = F.transform(F.sort_array(F.collect_list(F.when(F.col("tail").isNotNull(), F.struct(order, "tail")))), lambda x: x["tail"])
    whole = parts.groupBy(key).agg(F.array_join(tails, "\n").alias(body)).filter(F.col(body) != "").select(key, F.lit(target).alias(section), body)
    return parts.filter("head is not null and head != ''").select(key, section, F.col("head").alias(body)).unionByName(whole)


def guide_title(year: Column, section: Column, college: Column, departments: Column, most: int = 8) -> Column:
    """Title of a guide's section: the entry year, the section, its college and that college's first departments."""
    named = F.when(F.coalesce(college, F.lit("")) != "", F.concat(F.lit(" - "), college))
    listed = F.when(named.isNotNull() & (F.size(departments) > 0), F.concat(F.lit(GUIDE_DEPARTMENTS), F.array_join(F.slice(departments, 1, most), ", "), F.lit(")")))
    return F.concat(year.cast("string"), F.lit(GUIDE_YEAR), section, F.coalesce(named, F.lit("")), F.coalesce(listed, F.lit("")))
