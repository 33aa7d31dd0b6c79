"""Paths of a parent table of any depth, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.plans.shared import materialise, release

#: Parents that stand for none.
NO_PARENT = ["", "#", "Top"]


def paths(nodes: DataFrame, separator: str = " > ", keep: list[str] | None = None) -> DataFrame:
    """(id, path) of nodes (id, parent, name): the names from the root down to the node. Ids are distinct.

    A node whose parent is null, blank, one of NO_PARENT or not in the table is a root. Names are trimmed,
    and blank ones leave no trace in the paths below them. Nodes of a cycle, or below one, have a null
    path. Null ids are left out; an empty table gives no rows.

    In each round a node's path grows by that of its pointer, and the pointer jumps to the pointer's
    pointer: after r rounds all nodes up to depth 2**r are done, so there are as many rounds as the
    logarithm of the depth. A round that finishes no node ends it, for a deeper tree would have
    nodes of that depth too: what is left has no root. Each round is written.
    """
    text = F.trim(F.coalesce(F.col("name").cast("string"), F.lit("")))
    parent = F.when(F.col("parent").isNull() | F.trim(F.col("parent").cast("string")).isin(NO_PARENT), None).otherwise(F.col("parent"))
    own = nodes.filter("id is not null").select("id", parent.alias("up"), text.alias("path"))
    there = own.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    spent: list[str] = []
    at = materialise(own.join(there, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up"), "path"), "paths", spent)
    done = at.filter("up is null").count()
    total = at.count()
    before = -1
    while done not in (before, total):
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        kept: list[str] = []
        at = materialise(at.join(above, "up", "left").select("id", F.col("next").alias("up"), _joined("head", "path", separator).alias("path")), "paths", kept)
        release(nodes.sparkSession, spent)
        spent = kept
        before, done = done, at.filter("up is null").count()
    if keep is not None:
        keep += spent
    return at.select("id", F.when(F.col("up").isNull(), F.col("path")).alias("path"))


def _joined(head: str, path: str, separator: str) -> Column:
    """head, separator and path; one of them alone where the other is null or blank."""
    return F.concat_ws(separator, F.nullif(F.col(head), F.lit("")), F.nullif(F.col(path), F.lit("")))
