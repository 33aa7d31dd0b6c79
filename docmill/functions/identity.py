"""Stable identifiers: SHA-1 over UTF-8, as hexadecimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_key(*parts: Column) -> Column:
    """SHA-1 of the non-empty parts joined by a bar; so ('a', '', 'b') and ('a', 'b') share a key, and 0 is left out."""
    text = [F.nullif(p.cast("string"), F.lit("")) for p in parts]
    return F.sha1(F.encode(F.concat_ws("|", *(F.when(t != "0", t) for t in text)), "UTF-8"))


def chunk_key(doc_id: Column, position: Column) -> Column:
    return F.sha1(F.encode(F.concat(doc_id, F.lit("|"), position.cast("string")), "UTF-8"))


def content_hash(*fields: Column) -> Column:
    """SHA-1 of the fields as one JSON object; null and empty differ."""
    return F.sha1(F.encode(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), "UTF-8"))


def source_key(board: Column, article: Column) -> Column:
    """'board:article', null if either is missing."""
    return F.when((F.coalesce(board, F.lit("")) != "") & article.isNotNull(), F.concat(board, F.lit(":"), article.cast("string")))
