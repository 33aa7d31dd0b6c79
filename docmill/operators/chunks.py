"""Documents to chunks, and chunks to context, citations and history text."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.dates import apply_deadline, standard_date
from docmill.functions.fixed import BOARD_LABEL, CHUNK_SIZES, DATE_LABEL, EMPTY_BODY_LINK, EMPTY_BODY_TITLE, MAX_CONTEXT
from docmill.functions.identity import chunk_key, doc_key
from docmill.functions.text import chunk_title, clean_text, filled, first_filled, truthy

SEPARATOR = "\n\n---\n\n"
#: The title line above a chunk.
UNTITLED = r"(?s)^\[.*?\]\n\n"


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of size characters at steps of size - overlap; the first that reaches the end is the last.

    The text is cut once into pieces of which windows and steps are multiples, and a window joins its
    pieces, so the work grows with the text's length.
    """
    step = max(1, size - overlap)
    piece = gcd(size, step)
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - size) / step).cast("int") + 1)
    cut = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))  # in an array, so that the function below gets it as a value
    whole = lambda pieces: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(pieces, i * (step // piece) + 1, F.lit(size // piece)), ""))
    return F.when(F.length(text) > 0, F.transform(cut, whole)[0]).otherwise(F.array(text))


def to_chunks(docs: DataFrame, size: int | None, overlap: int = 0, title: str | None = None, text: str = "text") -> DataFrame:
    """One row per chunk: chunk_id, doc_id, chunk_text, position, token_len and the other columns of docs.

    docs: doc_id and text. Blank segments keep their number but give no row. title: a column whose
    text, in brackets, stands above the segment. A generator over an array: no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    segments = windows(body, size, overlap) if size else F.array(body)
    rest = [c for c in docs.columns if c not in ("doc_id", text)]
    out = docs.select("doc_id", *rest, F.posexplode(segments).alias("position", "segment")).withColumn("segment", F.trim(F.regexp_replace("segment", r"^\s+|\s+\z", ""))).filter("segment != ''")
    whole = F.when(filled(F.col(title)).isNotNull(), F.concat(F.lit("["), F.col(title), F.lit("]\n\n"), F.col("segment"))).otherwise(F.col("segment")) if title else F.col("segment")
    out = out.withColumn("chunk_text", whole)
    return out.select(chunk_key(F.col("doc_id"), F.col("position")).alias("chunk_id"), "doc_id", "chunk_text", "position", F.size(F.split(F.trim("chunk_text"), r"\s+")).alias("token_len"), *rest)


def chunks_in_context(docs: DataFrame, size: int, overlap: int = 0, title: str | None = None, text: str = "text") -> DataFrame:
    """The chunks of ``to_chunks`` (doc_id, position, chunk_text, context), with the context of ``with_neighbours``.

    All chunks of a document come from one row, so its neighbours are shifted arrays: no shuffle.
    """
    cut = F.transform(windows(F.coalesce(F.col(text), F.lit("")), size, overlap), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+\z", "")))
    head = F.coalesce(F.concat(F.lit("["), F.when(filled(F.col(title)).isNotNull(), F.col(title)), F.lit("]\n\n")), F.lit("")) if title else F.lit("")
    own = docs.select("doc_id", F.transform(cut, lambda s: F.when(s != "", F.concat(head, s))).alias("__whole"))
    own = own.withColumn("__bare", F.transform("__whole", lambda w: F.nullif(F.trim(F.regexp_replace(F.trim(w), UNTITLED, "")), F.lit(""))))
    none, n = F.array(F.lit(None).cast("string")), F.size("__bare")
    shifted = F.arrays_zip(F.col("__whole").alias("own"), F.concat(none, F.slice("__bare", F.lit(1), n - 1)).alias("before"), F.concat(F.slice("__bare", F.lit(2), n), none).alias("after"))
    own = own.select("doc_id", F.posexplode(shifted).alias("position", "c")).filter("c.own is not null")
    return own.select("doc_id", "position", F.col("c.own").alias("chunk_text"), F.concat_ws("\n", "c.before", "c.own", "c.after").alias("context"))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates promises none)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def notice_documents(notices: DataFrame) -> DataFrame:
    """Board notices (title, content, date, board, url, attachments) to documents.

    An empty body becomes the title and a pointer to the link; a board and date line stands above
    the text; the deadline is read from title, then text. Rows with neither text, title nor url go.
    """
    own = notices.select(
        F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.trim(F.coalesce("url", F.lit(""))).alias("url"), F.coalesce("board", F.lit("")).alias("topics"),
        standard_date(F.col("date")).alias("published_at"), clean_text(F.col("content")).alias("body"), F.coalesce(filled(F.col("attachments")), F.lit("[]")).alias("attachments"),
    )
    instead = F.concat_ws("\n", F.when(F.col("title") != "", F.concat(F.lit(EMPTY_BODY_TITLE), "title")), F.when(F.col("url") != "", F.concat(F.lit(EMPTY_BODY_LINK), "url")))
    own = own.withColumn("body", F.when(F.col("body") != "", F.col("body")).otherwise(instead)).filter("body != ''")
    own = own.withColumn("apply_deadline", apply_deadline(F.col("title"), F.col("body"), F.to_date("published_at")))
    head = F.concat_ws(", ", F.when(F.col("topics") != "", F.concat(F.lit(BOARD_LABEL), "topics")), F.when(F.col("published_at").isNotNull(), F.concat(F.lit(DATE_LABEL), "published_at")))
    text = F.when(head != "", F.concat(F.lit("["), head, F.lit("]\n\n"), F.col("body"))).otherwise(F.col("body"))
    key = doc_key(F.col("title"), F.col("topics"), F.coalesce("published_at", F.lit("")), F.col("url"))
    return own.select(key.alias("doc_id"), "title", text.alias("text"), "topics", F.coalesce("published_at", F.lit("")).alias("published_at"), "apply_deadline", "url", "attachments", F.lit("notices").alias("source"))


def rule_documents(rules: DataFrame) -> DataFrame:
    """Rule files (relative_dir, filename, text, entry_year, section, college_name) to documents."""
    key = doc_key(*(F.col(c) for c in ("relative_dir", "filename", "entry_year", "section", "college_name")))
    title = first_filled(F.col("section"), F.col("filename"))
    return rules.select(key.alias("doc_id"), title.alias("title"), clean_text(F.col("text")).alias("text"), F.col("relative_dir").alias("topics"), F.col("entry_year").cast("string").alias("entry_year"), F.lit("rules").alias("source")).filter("text != ''")


def schedule_documents(events: DataFrame) -> DataFrame:
    """Calendar rows (year, division, content, department, start, end) to documents with their period."""
    start, end = standard_date(F.col("start")), standard_date(F.col("end"))
    period = F.when(start == end, start).otherwise(F.concat_ws(" ~ ", start, end))
    text = F.concat_ws("\n", F.concat(F.lit("일정: "), "content"), F.when(period != "", F.concat(F.lit("기간: "), period)), F.when(filled(F.col("department")).isNotNull(), F.concat(F.lit("주관부서: "), "department")))
    return events.select(doc_key(F.coalesce(start, F.lit("")), F.coalesce(end, F.lit("")), F.col("content")).alias("doc_id"), F.col("content").alias("title"), text.alias("text"), F.col("division").alias("topics"), start.alias("published_at"), F.lit("schedule").alias("source"))


def labelled_documents(rows: DataFrame, key: list[str], bare: list[str], source: str) -> DataFrame:
    """Any table to documents: every filled column as 'label: value' in schema order, the columns of bare without label."""
    parts = [F.when(filled(F.col(c)).isNotNull(), filled(F.col(c)) if c in bare else F.concat(F.lit(f"{c}: "), filled(F.col(c)))) for c in rows.columns]
    return rows.select(doc_key(*(F.col(c) for c in key)).alias("doc_id"), first_filled(*(F.col(c) for c in bare)).alias("title"), F.concat_ws("\n", *parts).alias("text"), F.lit(source).alias("source")).filter("text != ''")


def meal_documents(meals: DataFrame) -> DataFrame:
    """One document per date and restaurant, the first row of each, with a closed flag."""
    own = keep_first(meals, ["date", "restaurant"], ["menu_text"])
    text = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" "), "restaurant", F.lit("\n"), F.when(truthy(F.col("is_closed")), "휴무").otherwise(F.col("menu_text")))
    return own.select(doc_key(F.date_format("date", "yyyy-MM-dd"), F.col("restaurant")).alias("doc_id"), F.col("restaurant").alias("title"), text.alias("text"), F.date_format("date", "yyyy-MM-dd").alias("published_at"), truthy(F.col("is_closed")).cast("int").alias("is_closed"), F.lit("meals").alias("source"))


def dataset_chunks(docs: DataFrame, dataset: str) -> DataFrame:
    """Chunks at the dataset's size and overlap, titled."""
    size = CHUNK_SIZES[dataset]
    return to_chunks(docs, *(size or (None, 0)), title="title")


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """chunks with context: the chunk between its neighbours at position -1 and +1 of its document, their titles left out."""
    own = Window.partitionBy("doc_id").orderBy("position")

    def side(offset: int) -> Column:
        text, pos = (F.lag if offset < 0 else F.lead)("chunk_text", 1).over(own), (F.lag if offset < 0 else F.lead)("position", 1).over(own)
        bare = F.trim(F.regexp_replace(F.trim(text), UNTITLED, ""))
        return F.nullif(F.when(pos == F.col("position") + offset, bare), F.lit(""))

    return chunks.withColumn("context", F.concat_ws("\n", side(-1), F.col("chunk_text"), side(1)))


def pack_context(parts: DataFrame, key: str, rank: str, text: str, limit: int = MAX_CONTEXT) -> DataFrame:
    """Per key the parts in rank order, joined, until the first that would pass limit; the first stays and is cut. (key, context, n_parts)

    Packing stops for good at the first overflow, so the kept parts are those before it in a running maximum.
    """
    per = Window.partitionBy(key).orderBy(rank)
    # a part after the first takes the separator at least, so no more parts than this can fit
    own = parts.select(key, rank, text, F.row_number().over(per).alias("__nth")).filter(F.col("__nth") <= limit // len(SEPARATOR) + 1)
    own = own.withColumn("__size", F.length(text) + F.when(F.col("__nth") > 1, len(SEPARATOR)).otherwise(0))
    own = own.withColumn("__used", F.sum("__size").over(per.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter((F.col("__nth") == 1) | (F.col("__used") <= limit))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__nth", text))), lambda p: p[text]), SEPARATOR)
    return own.groupBy(key).agg(F.substring(whole, 1, limit).alias("context"), F.count(F.lit(1)).alias("n_parts"))


def citation(text: Column, published: Column, url: Column) -> Column:
    """'- title (date) — url', without what is missing."""
    title, day, link = chunk_title(text), filled(published), filled(url)
    return F.when(link.isNotNull() & day.isNotNull(), F.concat(F.lit("- "), title, F.lit(" ("), day, F.lit(") — "), link)).when(link.isNotNull(), F.concat(F.lit("- "), title, F.lit(" — "), link)).otherwise(F.concat(F.lit("- "), title))


def recent_history(messages: DataFrame, session: str, order: str, role: str, text: str, turns: int = 3, cut: int = 200, labels: tuple[str, str] = ("사용자", "답변")) -> DataFrame:
    """(session, history): the last 2 * turns messages in order, answers cut at cut characters and an ellipsis."""
    nth = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    own = messages.filter(F.col(role).isin("user", "assistant")).withColumn("__nth", nth).filter(F.col("__nth") <= 2 * turns)
    body = F.trim(F.col(text))
    line = F.when(F.col(role) == "user", F.concat(F.lit(f"{labels[0]}: "), body)).otherwise(F.concat(F.lit(f"{labels[1]}: "), F.when(F.length(body) > cut, F.concat(F.substring(body, 1, cut), F.lit("…"))).otherwise(body)))
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return own.groupBy(session).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))
