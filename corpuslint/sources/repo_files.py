"""A1 as a data source: ``spark.read.format("repo_files").load(root)``.

Columns ``repo, path, content, size_bytes, read_error``, the rows of ``read_directory``.
Partitions are subtrees: the driver goes down the tree breadth-first until there are
enough folders to deal out (never further), and tasks walk theirs, a folder at a time.
Comparisons of ``size_bytes`` and of ``repo`` and ``path`` with literals are pushed down:
files they exclude are listed but never opened. (Spark hands filters to Python sources
when ``spark.sql.python.filterPushdown.enabled`` is set; ``register`` sets it.)

Options: ``repo`` (one repository under the root, named so), ``partitions`` (default 64).
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
                                    InputPartition, LessThan, LessThanOrEqual, StringStartsWith)

from corpuslint.sources.files import COLUMNS, Store

BATCH_BYTES = 32 << 20
_COMPARISONS: dict[type, Callable] = {
    EqualTo: operator.eq, LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge,
}


@dataclass
class Subtrees(InputPartition):
    folders: list[str]  # walked to the bottom
    files: list[tuple[str, int | None, str | None]]  # found on the way down: rel, size, error


class RepoFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.repo = options["path"], options.get("repo")
        self.wanted = int(options.get("partitions", 64))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _COMPARISONS and (column == "size_bytes" or column in ("repo", "path") and type(f) is EqualTo):
                self.tests.append((column, type(f).__name__, f.value))
            elif isinstance(f, StringStartsWith) and column in ("repo", "path"):
                self.tests.append((column, "StringStartsWith", f.value))
            else:
                yield f

    def _passes(self, row: dict) -> bool:
        compare = {kind.__name__: fn for kind, fn in _COMPARISONS.items()} | {"StringStartsWith": str.startswith}
        return all(row[c] is not None and compare[kind](row[c], value) for c, kind, value in self.tests)

    def partitions(self) -> list[Subtrees]:
        store, folders, files = Store(self.root), [""], []
        while folders and len(folders) < self.wanted:
            below = []
            for rel in folders:
                for name, size, folder, error in store.entries(rel):
                    if folder:
                        below.append(name)
                    else:
                        files.append((name, size, error))
            folders = below
        out = [Subtrees(folders[i::self.wanted], files[i::self.wanted]) for i in range(self.wanted)]
        return [p for p in out if p.folders or p.files] or [Subtrees([], [])]

    def _rows(self, part: Subtrees, store: Store) -> Iterator[dict]:
        def named(rel: str, size: int | None, error: str | None) -> dict:
            repo, _, path = rel.partition("/")
            repo, path = (self.repo, rel) if self.repo is not None else (repo, path) if path else (".", rel)
            return {"repo": repo, "path": path, "content": None, "size_bytes": size, "read_error": error, "rel": rel}

        for entry in part.files:
            yield named(*entry)
        folders = list(part.folders)
        while folders:
            for rel, size, folder, error in store.entries(folders.pop()):
                if folder:
                    folders.append(rel)
                else:
                    yield named(rel, size, error)

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        store, held, size = Store(self.root), [], 0
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()])))
        for row in self._rows(partition, store):
            if not self._passes(row):
                continue
            rel = row.pop("rel")
            if row["read_error"] is None:
                row["content"], row["read_error"] = store.read(rel)
            held.append(row)
            size += len(row["content"] or b"")
            if size >= BATCH_BYTES or len(held) >= 256:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> RepoFilesReader:
        return RepoFilesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter push-down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoFiles)
