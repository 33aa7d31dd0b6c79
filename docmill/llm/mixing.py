"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.plans.shared import join_checked, materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size, weight, target.

    sizes: source, size. Sources take the weights in turn by code point, null last. Together they
    get ``share`` times all sizes by weight, none over ``most`` times its own size; what a source
    can't take goes to the others by weight until none is above. That fixed point is one level
    x with target = least(most * source_size, weight * x), found by a running sum over the sources
    in the order in which they fill up. The windows see one pre-aggregated row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by = by.withColumns({
        "level": (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    # the first source in filling order that doesn't fill up sets the level for it and all after it
    free = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level"))))
    level = free.over(everything)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return by.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", extra: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and the columns of ``extra``.

    A source's repetition rate is target / source_size. Each document gets floor(rate) copies and
    one more where the MD5 of seed, doc_id and the text's MD5, read as a number from 0 to 1, falls
    below the rate's fraction; so reruns agree. Null and wordless texts have size 0, one of a source
    without words rate 0. Null sources form one source, the last. Equal rows get equal copies, an
    empty table gives no rows. Ties: sources that fill up together go by code point. A very long
    text is a row like any other, taken whole.
    """
    own = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("__key"),
        *(F.col(f"`{c}`").alias(f"__extra_{c}") for c in extra or []),
    )
    targets = materialise(source_targets(own.select("source", "size"), weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.col("__key").cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    out = join_checked(own, targets, ["source"]).withColumn("__rate", rate)
    copies = F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *(F.col(f"__extra_{c}").alias(c) for c in extra or []))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of docs, with its own columns of any name, as often as ``mix`` takes it.

    Null texts have no words, null sources are the last source; repeated rows draw alike, for a draw follows
    doc_id and text. An empty table gives no rows. Reruns agree, so there are no ties to break. A
    copy of a very long text is that text again.
    """
    cols = docs.columns
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in cols)).alias("__row"))
    taken = mix(whole, extra=["__row"], **options)
    return taken.select("__row", F.explode(F.expr("array_repeat(0, int(copies))")).alias("__copy")).select(*(F.col("__row")[c].alias(c) for c in cols))
