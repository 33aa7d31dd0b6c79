"""A corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and decides on all
of it. All stages but the last return the columns of documents. A stage's intermediate tables are
removed when the next stage begins; by then its result has been written.
"""

from __future__ import annotations

from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docmill.llm import exact_dedup, line_quality, mixing, packing, simhash
from docmill.plans.shared import materialise, release, table

#: Intermediate tables of the stage that ran last: of a run, or of stages that are called by themselves.
_spent: ContextVar[list[str]] = ContextVar("spent", default=[])  # noqa: B039


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that recur across their source; a null text fails. See ``keep_good``."""
    release(spark, _spent.get())
    return line_quality.keep_good(docs, keep=_spent.get())


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, null and empty ones being equal. See ``drop_copies``."""
    release(spark, _spent.get())
    return exact_dedup.drop_copies(docs, keep=_spent.get())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; texts without words stay. See ``drop_near_copies``."""
    release(spark, _spent.get())
    return simhash.drop_near_copies(docs, keep=_spent.get())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights, null being a source. See ``emit``."""
    release(spark, _spent.get())
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeated ones too, placed in sequences of 2048 tokens; a null text is empty. See ``pack``."""
    release(spark, _spent.get())
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=_spent.get())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SimHash has no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table in turn. An empty table gives no rows.

    A run keeps its intermediate tables apart from those of others; the last stage's stay until the
    driver ends, for the result reads them.
    """
    docs, before, mine = table(spark, sf_dir, "documents"), [], _spent.set([])
    try:
        for name, stage in STAGES[:-1]:
            own: list[str] = []
            docs = materialise(stage(spark, docs, sf_dir), name, own)
            release(spark, before)  # what this stage read
            before = own
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _spent.reset(mine)
