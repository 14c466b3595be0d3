"""Files of a folder as a table: `spark.read.format("inkbasin_tree").option("path", root).load()`.

One row a file, empty ones included: path, relative (to the root), name, extension (lower-case), size, modified, and
with the option `content` its bytes (null beyond `content_limit`). Hidden and excluded folders are not entered. The
driver lists the first levels only, until there are `folders` of them; each is a partition that lists itself, so the
work grows with the tree and stops at no single machine. Filters on name, extension and size are applied while listing.
A root that is missing or no folder is an error. Options: recursive (true), hidden (false), exclude (names by comma).
The root is a path or URI that pyarrow.fs can open.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from inkbasin.sources.filewriter import opened

SCHEMA = "path string, relative string, name string, extension string, size long, modified timestamp"
#: Bytes of content in a batch, about; a larger file is a batch of its own.
BATCH_BYTES = 8 << 20
_COMPARED = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b}


@dataclass
class Folder(InputPartition):
    """A folder to list, with all below it or its own files alone."""

    path: str
    below: bool


def extension_of(name: str) -> str:
    """Lower-case, with its dot; empty without one or for a dot file."""
    head, dot, tail = name.rpartition(".")
    return f".{tail.lower()}" if dot and head and tail else ""


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        flag = lambda name, other: options.get(name, other).lower() == "true"
        self.recursive, self.hidden, self.content = flag("recursive", "true"), flag("hidden", "false"), flag("content", "false")
        self.limit = int(options.get("content_limit", 500 << 20))
        self.folders = int(options.get("folders", 64))
        self.exclude = {x.strip() for x in options.get("exclude", "").split(",") if x.strip()}
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("name",), ("extension",), ("size",)):
                self.tests.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def _shown(self, name: str) -> bool:
        return (self.hidden or not name.startswith(".")) and name not in self.exclude

    def _list(self, fs, path: str) -> tuple[list, list]:
        """Files and folders of a folder, by name."""
        from pyarrow import fs as pafs

        found = [x for x in fs.get_file_info(pafs.FileSelector(path)) if self._shown(x.base_name)]
        found.sort(key=lambda x: x.base_name)
        return [x for x in found if x.type == pafs.FileType.File], [x.path for x in found if x.type == pafs.FileType.Directory]

    def partitions(self) -> list[Folder]:
        from pyarrow import fs as pafs

        fs, root = opened(self.root)
        if fs.get_file_info(root).type != pafs.FileType.Directory:
            raise ValueError(f"not a folder: {self.root}")
        if not self.recursive:
            return [Folder(root, False)]
        entered, open_ = [], [root]
        while open_ and len(open_) < self.folders:
            below = [(x, self._list(fs, x)[1]) for x in open_]
            if not any(x for _, x in below):
                break
            entered += [x for x, _ in below]
            open_ = [y for _, x in below for y in x]
        return [Folder(x, False) for x in entered] + [Folder(x, True) for x in open_]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.root)
        held, size = [], 0
        todo = [partition.path]
        while todo:
            files, folders = self._list(fs, todo.pop())
            if partition.below:
                todo += reversed(folders)
            for x in files:
                row = {"path": x.path, "relative": x.path[len(root.rstrip("/")) + 1 :], "name": x.base_name, "extension": extension_of(x.base_name), "size": x.size, "modified": x.mtime or datetime.datetime.fromtimestamp(0, datetime.timezone.utc)}
                if not all(row[name] is not None and _COMPARED[kind](row[name], value) for kind, name, value in self.tests):
                    continue
                if self.content:
                    row["content"] = None
                    if x.size <= self.limit:
                        with fs.open_input_stream(x.path) as f:
                            row["content"] = f.read()
                        size += x.size
                held.append(row)
                if len(held) >= 10_000 or size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = [("path", pa.string()), ("relative", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds + [("content", pa.binary())] * self.content))


class Tree(DataSource):
    """The source's format; see the module's text."""

    @classmethod
    def name(cls) -> str:
        return "inkbasin_tree"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
