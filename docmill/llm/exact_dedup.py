"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text's fixed-size blocks get integer names in sorted order; then adjacent names are paired and
the pairs named, level by level, until each text has one name. Names are given to blocks (or
pairs) that differ as a whole, so equal names mean equal texts. Blocks reach their names by a
128-bit hash, which is checked to be one-to-one on the blocks at hand; if it isn't, the next salt
is taken. Texts move through one shuffle, in which equal blocks of a task have already met.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.plans.shared import materialise

SPACES = r"[\x20\x09-\x0D]"
#: Code points of a block.
BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _blocks(norm: Column, size: int) -> Column:
    """The text's blocks; an empty text is one empty block."""
    return F.when(F.length(norm) <= size, F.array(norm)).otherwise(F.regexp_extract_all(norm, F.lit(f"((?s).{{1,{size}}})"), F.lit(1)))


def _route(block: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * salt), block).alias("h"), F.xxhash64(F.lit(2 * salt + 1), block).alias("g"))


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """An integer for each row of a table without equal rows, sorted within Spark's hash partitions."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(norm: DataFrame, size: int, keep: list[str] | None) -> tuple[DataFrame, int]:
    """(h, g, name) of every different block, and the salt of their hashes."""
    for salt in count():
        distinct = norm.select(F.explode(_blocks(F.col("norm"), size)).alias("block")).groupBy("block").agg(F.lit(0).alias("__one"))
        routed = distinct.select("block", _route(F.col("block"), salt).alias("r")).select("block", "r.h", "r.g")
        names = materialise(_numbered(routed, ["h", "g", "block"]).select("h", "g", "name"), "names", keep)
        if names.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return names, salt


def identities(docs: DataFrame, size: int = BLOCK, row: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): __row, doc_id, chars, text_sha256, blocks and name.

    Two rows have equal (blocks, name) if and only if their texts are identical after deleting
    white space [\\x20\\x09-\\x0D]; null counts as empty. row: a stored column that tells rows
    apart; without it rows are numbered here.
    """
    norm = docs.select(normalised(F.col("text")).alias("norm"))
    names, salt = _named_blocks(norm, size, keep)
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("__row"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), normalised(F.col("text")).alias("__norm"))
    rows = rows.select("__row", "doc_id", "chars", F.sha2(F.col("__norm").cast("binary"), 256).alias("text_sha256"), F.transform(_blocks(F.col("__norm"), size), lambda b: _route(b, salt)).alias("routes"))
    rows = materialise(rows, "rows", keep)
    blocks = rows.select("__row", F.size("routes").alias("blocks"), F.posexplode("routes").alias("pos", "r")).select("__row", "blocks", "pos", "r.h", "r.g")
    level = materialise(blocks.join(names, ["h", "g"]).select("__row", "blocks", "pos", "name", F.col("blocks").alias("left")), "level", keep)
    done = [level.filter("left = 1").select("__row", "blocks", "name")]
    while (level := level.filter("left > 1")).select("left").limit(1).count():
        pairs = level.groupBy("__row", "blocks", F.expr("(left + 1) div 2").alias("left"), F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = materialise(pairs, "pairs", keep)
        names = materialise(_numbered(pairs.groupBy("a", "b").agg(F.lit(0).alias("__one")).select("a", "b"), ["a", "b"]), "names", keep)
        level = materialise(pairs.join(names, ["a", "b"]).select("__row", "blocks", "pos", "name", "left"), "level", keep)
        done.append(level.filter("left = 1").select("__row", "blocks", "name"))
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return materialise(rows.drop("routes").join(named, "__row"), "identities", keep)


def exact_groups(docs: DataFrame, size: int = BLOCK, row: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: __row, doc_id, keep_id, group_size, kept, text_sha256, blocks, name.

    Of equal texts the row with the most code points stays, then the smallest doc_id (null last),
    then the first row; just one of repeated rows stays. keep_id is null where the row that stays
    has no doc_id. Empty table: no rows. A very long text is cut into blocks that shuffle apart;
    other columns of docs are not read.
    """
    found = identities(docs, size, row, keep)
    first = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__row").alias("r")))
    groups = found.groupBy("blocks", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "text-groups", keep)  # else AQE can't split a hot text in the join
    out = found.join(groups, ["blocks", "name"])
    return out.select("__row", "doc_id", F.col("first.d").alias("keep_id"), "group_size", (F.col("first.r") == F.col("__row")).alias("kept"), "text_sha256", "blocks", "name")


def drop_copies(docs: DataFrame, size: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """docs, with its own columns, without the rows whose text an earlier choice already holds.

    docs is first written with a row number, so that choice and text belong to the same row. Null texts
    count as empty and are copies of each other; of repeated rows one stays. Ties of length go to the
    smaller doc_id, null last, then to the smaller row. Columns of any name are kept. An empty table
    gives no rows; a very long text is compared block by block.
    """
    cols = docs.columns
    stored = materialise(docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("__doc")).withColumn("__row", F.monotonically_increasing_id()), "numbered", keep)
    groups = exact_groups(stored.select("__row", "__doc.doc_id", "__doc.text"), size, "__row", keep)
    return stored.join(groups.filter("kept").select("__row"), "__row", "left_semi").select(*(F.col("__doc")[c].alias(c) for c in cols))
