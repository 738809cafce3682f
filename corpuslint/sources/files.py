"""`files` sources: a directory tree, a table, or a driver table renamed.

A `files` DataFrame has columns ``repo, path, content, size_bytes``; content is
BINARY (raw bytes, decoded strictly later) or STRING (already text).
"""

from __future__ import annotations

import os
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


COLUMNS = "repo string, path string, content binary, size_bytes bigint, read_error string"
_LISTED = "rel string, size_bytes bigint, folder boolean, read_error string"


def read_directory(spark: SparkSession, root: str, repo: str | None = None,
                   max_file_bytes: int | None = None) -> DataFrame:
    """Recursive directory source: every regular file, names beginning with `_` or `.` too (relative POSIX path).

    With ``repo=None`` every first-level folder under ``root`` is one repository, and
    the files directly under ``root`` are the repository ``.``. Files over the size
    cap are not read: their row has its size and null content, and admission under
    the same cap reports it as skipped. What cannot be listed or read, or has a name
    that is not UTF-8, is one row with the reason in ``read_error`` and null content.
    ``repo_files`` (``corpuslint.sources.repo_files``) reads the same rows as a data source.
    """
    listed = list_directory(spark, root, repo)
    read = partial(_read_files, root, max_file_bytes)
    return listed.repartition(_tasks(spark), "rel").mapInArrow(read, COLUMNS)


def list_directory(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """The same files without content: repo, path, size_bytes, rel (path below ``root``), read_error.

    Spark's own file sources hide names beginning with `_` or `.`, so folders are
    listed in tasks (local paths, or through ``pyarrow.fs`` the stores it knows by
    URI): two levels one after the other, spread over tasks, then each folder below
    them is walked by one task, holding one folder's names at a time.
    """
    found = spark.createDataFrame([("", None, True, None)], _LISTED)
    for deep in (False, False, True):
        found = found.mapInArrow(partial(_list_folders, root, deep), _LISTED)
        if not deep:
            found = found.repartition(_tasks(spark), "rel")
    files = found.filter("not folder")
    if repo is not None:
        return files.select(F.lit(repo).alias("repo"), F.col("rel").alias("path"), "size_bytes", "rel", "read_error")
    nested = F.col("rel").contains("/")
    return files.select(F.when(nested, F.substring_index("rel", "/", 1)).otherwise(F.lit(".")).alias("repo"),
                        F.when(nested, F.expr("substring(rel, instr(rel, '/') + 1)")).otherwise(F.col("rel")).alias("path"),
                        "size_bytes", "rel", "read_error")


def _tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


class Store:
    """A folder tree on a local disk or in a store that ``pyarrow.fs`` knows by its URI."""

    def __init__(self, root: str):
        self.remote = None
        if "://" in root and not root.startswith("file:"):
            self.remote, self.base = fs.FileSystem.from_uri(root)
        else:
            self.base = os.path.abspath(root.removeprefix("file://").removeprefix("file:"))

    def entries(self, rel: str) -> list[tuple[str, int | None, bool, str | None]]:
        """(rel, size, is a folder, error) of a folder's entries; a folder that cannot be listed is one error row."""
        at = f"{self.base}/{rel}".rstrip("/")
        try:
            if self.remote is not None:
                infos = self.remote.get_file_info(fs.FileSelector(at))
                return [(f"{rel}/{i.base_name}".lstrip("/"), i.size, i.type == fs.FileType.Directory, None)
                        for i in infos if i.type in (fs.FileType.File, fs.FileType.Directory)]
            with os.scandir(os.fsencode(at)) as found:
                return [e for entry in found if (e := self._local(rel, entry)) is not None]
        except OSError as exc:
            return [(rel, None, False, f"cannot be listed: {exc}")]

    @staticmethod
    def _local(rel: str, entry: os.DirEntry) -> tuple[str, int | None, bool, str | None] | None:
        name = f"{rel}/{entry.name.decode('utf-8', 'backslashreplace')}".lstrip("/")
        try:
            entry.name.decode("utf-8")
            if entry.is_dir(follow_symlinks=False):
                return name, None, True, None
            return (name, entry.stat().st_size, False, None) if entry.is_file() else None
        except UnicodeDecodeError:
            return name, None, False, "its name is not UTF-8"
        except OSError as exc:
            return name, None, False, str(exc)

    def read(self, rel: str) -> tuple[bytes | None, str | None]:
        """(content, error) of a file; whatever is wrong with it stays with it."""
        try:
            if self.remote is not None:
                with self.remote.open_input_stream(f"{self.base}/{rel}") as stream:
                    return stream.read(), None
            with open(f"{self.base}/{rel}", "rb") as stream:
                return stream.read(), None
        except OSError as exc:
            return None, f"cannot be read: {exc}"


def _list_folders(root: str, deep: bool, batches):
    """Folders become their entries, all levels of them if deep; files pass."""
    store = Store(root)
    types = [pa.string(), pa.int64(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in _LISTED.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for row in batch.to_pylist():
            if not row["folder"]:
                yield batch_of([tuple(row[n] for n in names)])
                continue
            folders = [row["rel"]]
            while folders:
                found = store.entries(folders.pop())
                if deep:
                    folders += [rel for rel, _, folder, _ in found if folder]
                    found = [e for e in found if not e[2]]
                yield batch_of(found)


def _read_files(root: str, max_file_bytes: int | None, batches):
    store = Store(root)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            content, error = None, row["read_error"]
            if error is None and (max_file_bytes is None or row["size_bytes"] <= max_file_bytes):
                content, error = store.read(row["rel"])
            yield pa.RecordBatch.from_arrays([pa.array([row["repo"]], pa.string()), pa.array([row["path"]], pa.string()),
                                              pa.array([content], pa.binary()), pa.array([row["size_bytes"]], pa.int64()),
                                              pa.array([error], pa.string())], names)
