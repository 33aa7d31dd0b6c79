"""Approval and rejection of submissions: items, notices and chunks change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.fixed import CHUNK_SIZES, SUBMISSIONS
from docmill.operators.admin import submission_notices
from docmill.operators.chunks import to_chunks
from docmill.sources.versions import TableSet

APPROVED = ("approved", "approved_manually")


def notices_of(items: DataFrame, as_of: Column) -> DataFrame:
    """(item_id, detail_url and the columns of ``submission_notices``) of items (item_id, kind, data) of a known kind."""
    own = items.select("item_id", "kind", "data", F.concat(F.lit("manual://notice/"), "kind", F.lit("/"), "item_id").alias("detail_url"))
    return submission_notices(own, as_of)


def chunks_of(notices: DataFrame, size: int, overlap: int) -> DataFrame:
    """(item_id, chunk_id, position, chunk_text) of notices."""
    docs = notices.select(F.col("detail_url").alias("doc_id"), "item_id", "title", F.col("content").alias("text"))
    return to_chunks(docs, size, overlap, "title").select("item_id", "chunk_id", "position", "chunk_text")


def settle(tables: TableSet, decisions: DataFrame, as_of: Column, size: int = CHUNK_SIZES["notices"][0], overlap: int = CHUNK_SIZES["notices"][1]) -> None:
    """Carry out decisions (item_id, approve) on the tables items (item_id, kind, data, status), notices and chunks.

    An approved item gets its notice and the notice's chunks; one of an unknown kind becomes
    approved_manually without; one whose notice has no text for a chunk stays as it is, as does an
    item that is approved already. A rejected item loses its notice and chunks. Decisions that name no
    item change nothing; if an item is named twice, rejection counts. All three tables take effect
    together, or, if a step fails, none.
    """
    items, notices, chunks = (tables.read(n) for n in ("items", "notices", "chunks"))
    wanted = decisions.filter("approve is not null").groupBy("item_id").agg(F.min("approve").alias("approve"))
    both = items.join(wanted, "item_id", "left")
    fresh = both.filter(F.col("approve") & ~F.coalesce(F.col("status").isin(*APPROVED), F.lit(False)))
    with tables.change() as change:
        new = notices_of(fresh.filter(F.col("kind").isin(list(SUBMISSIONS))), as_of)
        cut = chunks_of(new, size, overlap)
        out = both.filter(~F.col("approve")).select("item_id")
        kept = chunks.join(out, "item_id", "left_anti").unionByName(cut)
        kept = change.write("chunks", kept)
        texts = kept.select("item_id").distinct()
        change.write("notices", notices.join(out, "item_id", "left_anti").unionByName(new.join(texts, "item_id", "left_semi"), allowMissingColumns=True))
        known = F.coalesce(F.col("kind").isin(list(SUBMISSIONS)), F.lit(False))
        start = F.coalesce(F.col("status").isin(*APPROVED), F.lit(False))
        done = both.join(texts.withColumn("has_text", F.lit(True)), "item_id", "left")
        status = (
            F.when(~F.col("approve"), "rejected").when(F.col("approve") & ~start & ~known, "approved_manually")
            .when(F.col("approve") & ~start & F.col("has_text"), "approved").otherwise(F.col("status"))
        )
        change.write("items", done.withColumn("status", status).select(*items.columns))
