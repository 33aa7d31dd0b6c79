"""Incremental synchronisation: snapshot against incoming records, checks, upserts, run status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.dates import standard_date
from docmill.functions.fixed import CHECKS, REQUIRED, RUN_MODES
from docmill.functions.identity import content_hash, source_key
from docmill.functions.text import article_id, attachments, first_filled, truthy


def notice_records(rows: DataFrame) -> DataFrame:
    """Rows with Korean or English column names to records with keys and content hash; rows keep their columns' absence as empty."""
    pick = lambda *names: first_filled(*(F.col(n) for n in names if n in rows.columns))
    files, failed = attachments(pick("첨부파일", "attachments"))
    url, code = pick("상세URL", "detail_url"), pick("게시판코드", "board_code")
    article = F.coalesce(pick("원문글ID", "article_id").try_cast("bigint"), article_id(url))
    source = source_key(code, article)
    own = rows.select(
        F.coalesce(source, F.lit("")).alias("source_id"), F.coalesce(F.concat(F.lit("notices:"), source), F.lit("")).alias("document_key"), pick("게시판", "board_name").alias("board_name"), code.alias("board_code"), article.alias("article_id"),
        pick("제목", "title").alias("title"), pick("카테고리", "category").alias("category"), F.coalesce(standard_date(pick("게시일", "posted_at")), F.lit("")).alias("published_at"), url.alias("detail_url"),
        pick("본문", "content_text").alias("content_text"), files.alias("attachments"), failed.alias("attachments_parse_failed"), truthy(pick("상단고정", "is_pinned")).alias("is_pinned"),
    )
    return own.withColumn("content_hash", content_hash(*(F.col(c) for c in ("attachments", "category", "content_text", "published_at", "title"))))


def quality_checks(records: DataFrame, key: str, required: dict[str, str] = REQUIRED) -> DataFrame:
    """(key, check_type, severity, message): missing required fields are errors; date, attachments and short bodies warn."""
    make = lambda kind, severity, message, when: F.when(when, F.struct(F.lit(kind).alias("check_type"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))
    body = F.trim(F.coalesce("content_text", F.lit("")))
    checks = [make(c, "error", m, F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "") for c, m in required.items()]
    checks.append(make("published_at", "warning", CHECKS["published_at"], F.coalesce("published_at", F.lit("")) == ""))
    checks.append(make("attachments", "warning", CHECKS["attachments"], F.col("attachments_parse_failed")))
    checks.append(make("content_text", "warning", CHECKS["content_text"], body == ""))
    checks.append(make("content_length", "warning", CHECKS["content_length"], (body != "") & (F.length(body) < 40)))
    return records.select(key, F.explode(F.array_compact(F.array(*checks))).alias("check")).select(key, "check.*")


def parse_failed(required: dict[str, str] = REQUIRED) -> Column:
    return reduce(lambda a, b: a | b, (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in required))


def diff(snapshot: DataFrame, incoming: DataFrame, detect_missing: bool = True) -> DataFrame:
    """Per source_id: change, status, miss_count, content_hash, should_index, from one full outer join.

    snapshot: source_id, content_hash, status, miss_count, is_pinned. incoming: source_id,
    content_hash, failed, one row per source_id (the last record seen). change: new, updated
    (hash differs, or it was hidden, deleted or unparsable), unchanged, parse_failed, hidden,
    missed (stays visible) or untouched. A visible document that isn't seen is hidden, a pinned
    one only at its second miss. Rows without source_id are left out.
    """
    old = snapshot.select("source_id", F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"), F.coalesce("miss_count", F.lit(0)).alias("old_miss"), F.coalesce("is_pinned", F.lit(False)).alias("old_pinned"))
    new = incoming.filter("source_id is not null and source_id != ''").select("source_id", "content_hash", "failed", F.lit(True).alias("seen"))
    both = old.join(new, "source_id", "full_outer")
    seen, known = F.coalesce("seen", F.lit(False)), F.col("old_status").isNotNull()
    visible = F.col("old_status").isin("active", "updated")
    changed = (F.col("old_hash") != F.col("content_hash")) | F.col("old_status").isin("hidden", "deleted", "parse_failed")
    missing = ~seen & visible & F.lit(detect_missing)
    change = (
        F.when(seen & F.col("failed"), "parse_failed").when(seen & ~known, "new").when(seen & F.coalesce(changed, F.lit(True)), "updated").when(seen, "unchanged")
        .when(missing & F.col("old_pinned") & (F.col("old_miss") + 1 < 2), "missed").when(missing, "hidden").otherwise("untouched")
    )
    out = both.withColumn("change", change)
    status = F.when(F.col("change") == "parse_failed", "parse_failed").when(F.col("change") == "updated", "updated").when(F.col("change").isin("new", "unchanged"), "active").when(F.col("change") == "hidden", "hidden").otherwise(F.col("old_status"))
    miss = F.when(seen, 0).when(missing, F.col("old_miss") + 1).otherwise(F.col("old_miss"))
    return out.select("source_id", "change", status.alias("status"), miss.cast("int").alias("miss_count"), F.when(seen, F.col("content_hash")).otherwise(F.col("old_hash")).alias("content_hash"), F.col("change").isin("new", "updated").alias("should_index"))


def run_status(changes: DataFrame, skipped: int | None = None) -> DataFrame:
    """One row of counters and the run's status: failed if all seen failed, partial_success if some did."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    out = changes.agg(n("new", "updated", "unchanged", "parse_failed").alias("documents_seen"), n("new").alias("documents_new"), n("updated").alias("documents_updated"), n("hidden").alias("documents_deleted"), n("parse_failed").alias("documents_failed"))
    failed, seen = F.col("documents_failed"), F.col("documents_seen")
    return out.withColumn("status", F.when(seen == 0, "success").when(failed >= seen, "failed").when(failed > 0, "partial_success").otherwise("success"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows that share a key with rows, and rows; columns that one side lacks are null."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def cascade_delete(parents: DataFrame, tables: dict[str, tuple[DataFrame, str]], key: str) -> dict[str, DataFrame]:
    """Each table without the rows whose foreign key is among the deleted parents."""
    gone = parents.select(key).distinct()
    return {name: t.join(gone, t[fk] == gone[key], "left_anti") for name, (t, fk) in tables.items()}


def refresh(table_path: str, rows: DataFrame, mode: str = "overwrite") -> bool:
    """Write rows over a table unless there are none: an empty collection keeps the old index."""
    if rows.isEmpty():
        return False
    rows.write.mode(mode).parquet(table_path)
    return True


def run_actions(changes: DataFrame, mode: str = "full-sync") -> DataFrame:
    """(source_id, change, normalise, index, refresh): what a run of this mode does with each document of ``diff`` that changed or went out of sight.

    collect-only does nothing further; normalize-only writes their records; index-only and
    full-sync also replace their chunks, and then the artifacts are made anew.
    """
    if mode not in RUN_MODES:
        raise ValueError(f"mode is one of {', '.join(RUN_MODES)}")
    level = RUN_MODES.index(mode)
    target = changes.filter(F.col("change").isin("new", "updated", "hidden", "parse_failed"))
    return target.select("source_id", "change", F.lit(level >= 1).alias("normalise"), F.lit(level >= 2).alias("index"), F.lit(level >= 2).alias("refresh"))


def index_repairs(chunks: DataFrame, index: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, n_chunks, n_indexed, action): keep the index of a dataset if it has as many rows as the table, rebuild it if not, reset it if the table has none."""
    have, want = (t.groupBy(dataset).agg(F.count(F.lit(1)).alias(n)) for t, n in ((index, "n_indexed"), (chunks, "n_chunks")))
    both = want.join(have, dataset, "full_outer").na.fill(0, ["n_chunks", "n_indexed"])
    return both.select(dataset, "n_chunks", "n_indexed", F.when(F.col("n_chunks") == 0, "reset").when(F.col("n_chunks") == F.col("n_indexed"), "keep").otherwise("rebuild").alias("action"))


def repaired(chunks: DataFrame, index: DataFrame, repairs: DataFrame, dataset: str = "dataset") -> DataFrame:
    """The index after ``index_repairs``: rows of kept datasets as they are, those of rebuilt ones from the table. repairs: written, a row per dataset."""
    of = lambda action: repairs.filter(F.col("action") == action).select(dataset)
    return index.join(of("keep"), dataset, "left_semi").unionByName(chunks.join(of("rebuild"), dataset, "left_semi"), allowMissingColumns=True)


def index_frame(datasets: dict[str, tuple[DataFrame, DataFrame]], key: str, meta: list[str]) -> DataFrame:
    """Chunks of all datasets with the meta columns of their entity, from the tables: the rows that an index is rebuilt from.

    datasets: name -> (chunks with chunk_id, key, chunk_text, position; entities with key). Chunks
    without an entity go; what an entity lacks is empty.
    """
    parts = []
    for name, (chunks, entities) in datasets.items():
        own = entities.select(key, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in entities.columns else F.lit("").alias(c) for c in meta))
        parts.append(chunks.select("chunk_id", key, "chunk_text", "position").join(own, key).withColumn("dataset", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def settled(items: DataFrame, steps: DataFrame, key: str, order: str) -> DataFrame:
    """(key, status, undo): items approved step by step.

    steps: key, order, step, ok. An item all of whose steps are done is approved; if one fails, the
    item is pending again and the steps before it are undone, the last first. An item without steps
    stays pending.
    """
    failed = F.min(F.when(~F.col("ok"), F.col(order)))
    done = F.sort_array(F.collect_list(F.struct(order, "step", "ok")))
    own = steps.groupBy(key).agg(failed.alias("failed"), done.alias("done"))
    back = F.reverse(F.transform(F.filter("done", lambda s: s[order] < F.col("failed")), lambda s: s["step"]))
    own = own.select(key, F.when(F.col("failed").isNull(), "approved").otherwise("pending").alias("status"), F.when(F.col("failed").isNull(), F.array().cast("array<string>")).otherwise(back).alias("undo"))
    return items.select(key).join(own, key, "left").select(key, F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("undo", F.array().cast("array<string>")).alias("undo"))
