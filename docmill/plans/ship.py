"""Makes the package importable for Python workers that don't have it on their path."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def _importable(spark: SparkSession) -> bool:
    name = PACKAGE.name

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # nested, so that it travels by value
        from importlib.util import find_spec

        for _ in batches:
            yield pd.DataFrame({"found": [find_spec(name) is not None]})

    return spark.range(1).mapInPandas(probe, "found boolean").first()["found"]


def ship_package(spark: SparkSession) -> None:
    """Once per context: if workers can't import the package, Spark's file server hands it to them as a zip file."""
    context = spark.sparkContext
    if getattr(context, "_docmill_shipped", False):
        return
    if not _importable(spark):
        folder = Path(tempfile.mkdtemp(prefix="docmill-"))
        context.addPyFile(shutil.make_archive(str(folder / PACKAGE.name), "zip", PACKAGE.parent, PACKAGE.name))
    context._docmill_shipped = True
