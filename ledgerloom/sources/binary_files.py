"""Files from rows: a data source that stores one file per row, whole or not at all.

Every task writes into a folder of its own attempt; the commit moves the files
to their place, and an abort, or an attempt that was lost, leaves nothing there.
Reading them back is Spark's ``binaryFile``, with the empty files that it skips.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerloom.session import ship_package


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Files named by ``nom`` and ``ending`` with ``contenu`` in them."""

    def __init__(self, folder: str, ending: str, overwrite: bool):
        self._folder, self._ending, self._overwrite = folder, ending, overwrite
        self._staging = os.path.join(folder, f"_temporary-{uuid.uuid4().hex}")
        os.makedirs(self._staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own = os.path.join(self._staging, uuid.uuid4().hex)  # no two attempts share a folder
        os.mkdir(own)  # fails, as it should, in a task that outlives the job's abort
        names = []
        for batch in iterator:
            for cell, content in zip(batch.column("nom"), batch.column("contenu")):
                name = (cell.as_py() or "") + self._ending
                if os.path.basename(name) != name or name in (self._ending, ".", ".."):
                    raise ValueError(f"no file name: {cell.as_py()}")
                with open(os.path.join(own, name), "wb") as out:
                    out.write(content.as_py() or b"")
                names.append(name)
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        written = [m for m in messages if m is not None]
        names = [n for m in written for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several rows would be one file: " + next(n for n in names if names.count(n) > 1))
        for m in written:
            for name in m.names:
                os.replace(os.path.join(m.folder, name), os.path.join(self._folder, name))
        if self._overwrite:
            for old in set(os.listdir(self._folder)) - set(names):
                if old.endswith(self._ending):
                    os.remove(os.path.join(self._folder, old))
        shutil.rmtree(self._staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self._staging, ignore_errors=True)


class BinaryFiles(DataSource):
    """``df.write.format("binary_files").option("ending", ".zip").save(folder)`` for rows (nom, contenu).

    The folder must be one that driver and executors share, given as a path or a
    ``file:`` address.
    """

    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def schema(self) -> str:
        return "nom string, contenu binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        address = urlparse(self.options["path"])
        if address.scheme not in ("", "file"):
            raise ValueError(f"files are written to shared folders, not to {address.scheme}:")
        folder = unquote(address.path)
        return FileWriter(folder, self.options.get("ending", ""), overwrite)


def write(rows: DataFrame, folder: str, ending: str, mode: str = "append") -> None:
    """Store (nom, contenu) as files; ``overwrite`` removes others of the same ending once the new ones are in place."""
    ship_package(rows.sparkSession)
    rows.sparkSession.dataSource.register(BinaryFiles)
    rows.select("nom", "contenu").write.format("binary_files").option("ending", ending).mode(mode).save(folder)


def read(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of a folder whose names match, as (path: the name, content); empty ones have empty content.

    The scan leaves empty files out, so their names come from the listing, which
    Spark keeps on the driver for every scan of files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    listed = [(unquote(p).rsplit("/", 1)[-1],) for p in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.filter("length > 0").select(name.alias("path")), "path", "left_anti")
    return files.select(name.alias("path"), "content").unionByName(empty.withColumn("content", F.lit(b"")))
