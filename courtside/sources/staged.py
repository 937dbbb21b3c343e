"""Staged table writes: a table is always its old or its new state.

A write goes to a staging folder beside the table. When all of it is there, a
journal names the partitions to drop and to move in; carrying it out is a row of
renames that can be repeated. A run that dies before the journal leaves the old
table, one that dies behind it is carried on by whoever opens the table
next. The journal also holds the table's schema, which is stored beside the data,
so that an empty table can be read. One writer a table at a time.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

SCHEMA_FILE = "_schema.json"


class Files:
    """The few file operations needed, on any Hadoop path."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def matches(self, pattern: str) -> bool:
        """Does any file match? Folder levels are listed, no file is opened."""
        return bool(self._fs.globStatus(self._path(pattern)))

    def names(self, path: str, folders: bool) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory() == folders)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written aside, then renamed."""
        aside = f"{path}.{uuid.uuid4().hex[:8]}"
        stream = self._fs.create(self._path(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(aside, path)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, source: str, target: str) -> None:
        """Replace ``target`` by ``source``."""
        self.delete(target)
        self.make(target.rsplit("/", 1)[0])
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")


def _split(table: str) -> tuple[str, str]:
    folder, name = table.rstrip("/").rsplit("/", 1)
    return folder, name


def staging(table: str) -> str:
    """A new staging folder; scans skip names that begin with an underscore."""
    folder, name = _split(table)
    return f"{folder}/_staging/{name}-{uuid.uuid4().hex[:12]}"


def _journal(table: str) -> str:
    folder, name = _split(table)
    return f"{folder}/_journal/{name}.json"


def leaves(files: Files, root: str, depth: int) -> list[str]:
    """Partition folders ``depth`` levels down, relative; data files where depth is 0."""
    if depth == 0:
        return [f for f in files.names(root, folders=False) if f[0] not in "_."]
    found = [""]
    for _ in range(depth):
        found = [f"{p}/{n}".lstrip("/") for p in found for n in files.names(f"{root}/{p}", folders=True) if n[0] not in "_."]
    return found


def partition_folder(spark: SparkSession, names: Sequence[str], values: Sequence) -> str:
    """Folder of a partition as Spark writes it (special characters escaped)."""
    to_path = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join(to_path(n, str(v)) for n, v in zip(names, values))


def publish(spark: SparkSession, source: str, table: str, schema: T.StructType, depth: int, whole: bool,
            replaced: Iterable[str] = (), fmt: str = "parquet") -> None:
    """Make the staged folder the table's content: all of it with ``whole``, else
    the partitions it has and those ``replaced`` names (gone if it has no rows of them).
    A table without rows gets one file without rows, for readers that look for a schema."""
    files = Files(spark, table)
    new, there = leaves(files, source, depth), leaves(files, table, depth)
    gone = set(there if whole or depth == 0 else replaced) - set(new)
    if not new and not set(there) - gone:
        none = f"{source}/_none"
        spark.createDataFrame([], schema).coalesce(1).write.format(fmt).save(none)
        new = leaves(files, none, 0)
        for name in new:
            files.move(f"{none}/{name}", f"{source}/{name}")
    if depth:
        gone |= set(leaves(files, table, 0)) - set(new)  # the file of a table that was empty
    files.write(_journal(table), json.dumps({"source": source, "drop": sorted(gone), "move": new, "schema": schema.json()}))
    recover(spark, table)


def recover(spark: SparkSession, table: str) -> None:
    """Carry out what a journal of the table still asks for."""
    files, path = Files(spark, table), _journal(table)
    if not files.exists(path):
        return
    todo = json.loads(files.read(path))
    files.make(table)
    files.write(f"{table}/{SCHEMA_FILE}", todo["schema"])
    for part in todo["drop"]:
        files.delete(f"{table}/{part}")
    for part in todo["move"]:
        if files.exists(f"{todo['source']}/{part}"):  # else moved by an earlier attempt
            files.move(f"{todo['source']}/{part}", f"{table}/{part}")
    files.delete(path)
    files.delete(todo["source"])


def stored_schema(spark: SparkSession, table: str) -> T.StructType | None:
    files = Files(spark, table)
    path = f"{table}/{SCHEMA_FILE}"
    return T.StructType.fromJson(json.loads(files.read(path))) if files.exists(path) else None
