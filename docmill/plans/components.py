"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.plans.shared import materialise, release


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the edges do, but for the odds of equal 64-bit sums."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(node, component): every node of edges (a, b) with the smallest node it can reach.

    Each round takes a minimum per node with map-side combine, writes it and joins it back. Both
    sides of such a join are plain shuffles, which AQE splits, so a node with many links is never
    gathered in one task; rounds grow as the logarithm of the longest path.
    Empty edges: no rows.
    """
    kind = edges.schema["a"].dataType
    edges = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", keep)
    mark = _mark(edges)
    spent: list[str] = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low", spent)
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialise(large, "large", spent)
        low = materialise(large.groupBy("a").agg(F.min("b").alias("low")), "low", spent)
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        done: list[str] = []
        edges = materialise(small.filter("a != b").distinct(), "edges", done)
        release(edges.sparkSession, spent)
        spent = done
        if (now := _mark(edges)) == mark:
            break
        mark = now
    if keep is not None:
        keep.extend(spent)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
