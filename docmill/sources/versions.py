"""Tables that change together: new versions beside the live ones, and one pointer that is swapped last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docmill.plans.shared import release


class Conflict(RuntimeError):
    """Another change was made in between."""


class TableSet:
    """Parquet tables in a folder, as the pointer file names their versions.

    Readers see one state of all tables: that of the pointer when they ask. A change writes new versions
    and then replaces the pointer in one rename. If it fails, what it wrote is removed; if its process is
    killed, readers keep the old state, and ``clean`` removes what was left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        path, fs = self._hadoop("current.json")
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0]) if fs.exists(path) else {"number": 0, "tables": {}}

    def _swap(self, pointer: dict) -> None:
        jvm = self.spark._jvm
        (new, fs), (live, _) = self._hadoop(f"next-{uuid.uuid4().hex}.json"), self._hadoop("current.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, live, how)

    def names(self) -> list[str]:
        return sorted(self._pointer()["tables"])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._pointer()['tables'][name]}")

    @contextmanager
    def change(self) -> Iterator[Change]:
        """Write tables within; they take effect together at the end. An exception undoes them, the last first."""
        began = self._pointer()
        own = Change(self)
        try:
            yield own
            if self._pointer()["number"] != began["number"]:
                raise Conflict(f"{self.path} was changed meanwhile")
            if own.written:
                tables = began["tables"] | own.written
                old = [began["tables"][n] for n in own.written if n in began["tables"]]
                self._swap({"number": began["number"] + 1, "tables": tables, "before": old})
        except Exception:
            release(self.spark, [f"{self.path}/{folder}" for folder in own.folders])  # the last first
            raise

    def clean(self, keep_previous: bool = True) -> list[str]:
        """Remove folders that the pointer doesn't name, but for the versions that it replaced last, which readers may still hold; returns what went."""
        pointer = self._pointer()
        needed = {*pointer["tables"].values(), *(pointer.get("before", []) if keep_previous else [])}
        root, fs = self._hadoop("")
        found = [f"{t.getPath().getName()}/{v.getPath().getName()}" for t in fs.listStatus(root) if t.isDirectory() for v in fs.listStatus(t.getPath())]
        gone = sorted(f for f in found if f not in needed)
        release(self.spark, [f"{self.path}/{f}" for f in gone])
        return gone


class Change:
    """The tables that a change has written so far."""

    def __init__(self, tables: TableSet):
        self.tables, self.written, self.folders = tables, {}, []

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """A new version of the table, which is returned as written; others see it at the end."""
        folder = f"{name}/{uuid.uuid4().hex}"
        self.folders.append(folder)
        rows.write.parquet(f"{self.tables.path}/{folder}")
        self.written[name] = folder
        return self.tables.spark.read.parquet(f"{self.tables.path}/{folder}")


def refresh(tables: TableSet, name: str, loaded: DataFrame, manual) -> bool:  # noqa: ANN001
    """Replace a table by its manual rows and what was loaded; a load without rows changes nothing."""
    from docmill.sources.files import refresh_dataset

    if loaded.isEmpty():
        return False
    with tables.change() as change:
        change.write(name, refresh_dataset(tables.read(name), loaded, manual) if name in tables.names() else loaded)
    return True
