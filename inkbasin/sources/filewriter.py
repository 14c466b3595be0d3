"""A sink of files under their own names: `df.write.format("inkbasin_files").mode("append" or "overwrite").save(root)`.

Rows are (path relative to the root, value): one file each. Tasks write into a folder of the job beside the root's other
content, each file under a name of its attempt that is then renamed, so a task that runs twice, or at two places at
once, leaves whole files only. When all tasks are done the driver moves what they wrote into place; when the job fails
it deletes the job's folder and nothing else has changed.

Options: `unit`, how many leading folders of a path make a unit that is moved as a whole (2: `package/extract`); with
`history` a unit that is already there goes to `<first folder>/.history/<history>/...`, else it is deleted; 0, the
default, moves file by file into folders that stay as they are. The root is a path or URI that pyarrow.fs can open and
whose folders can be renamed; driver and executors must share it.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "path string, value string"
#: Moves of single files that run at once when the job commits.
MOVES = 32


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    import os
    import re

    from pyarrow import fs

    local = re.sub(r"^file:(//[^/]*(?=/))?", "", path)
    if "://" in local:
        return fs.FileSystem.from_uri(local)
    return fs.LocalFileSystem(), os.path.abspath(local)


def relative(path: str) -> str:
    """A path below the root; one that would leave it is an error."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"not a path below the root: {path!r}")
    return "/".join(parts)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: units, or files where there are none."""

    moved: list[str] = field(default_factory=list)
    files: int = 0


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root = options["path"]
        self.unit = int(options.get("unit", 0))
        self.history = options.get("history", "")
        self.overwrite = overwrite
        self.staging = f".inkbasin-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        fs, root = opened(self.root)
        attempt = uuid.uuid4().hex[:12]
        moved, n, made = set(), 0, set()
        for row in rows:
            to = relative(row["path"])
            folder = f"{root}/{self.staging}/{to}".rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{attempt}-{n}.part"
            with fs.open_output_stream(part) as out:
                out.write((row["value"] or "").encode())
            fs.move(part, f"{root}/{self.staging}/{to}")
            n += 1
            parts = to.split("/")
            if self.unit and len(parts) <= self.unit:
                moved.add(to)
            else:
                moved.add("/".join(parts[: self.unit]) if self.unit else to)
        return Written(sorted(moved), n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as pafs

        fs, root = opened(self.root)
        there = lambda p: fs.get_file_info(p).type != pafs.FileType.NotFound
        moves = sorted({m for message in messages if message for m in message.moved})
        if self.overwrite and not self.unit:
            for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if info.base_name != self.staging:
                    fs.delete_dir(info.path) if info.type == pafs.FileType.Directory else fs.delete_file(info.path)

        def move(name: str) -> None:
            target = f"{root}/{name}"
            fs.create_dir(target.rpartition("/")[0], recursive=True)
            if there(target):
                folder = fs.get_file_info(target).type == pafs.FileType.Directory
                if self.history and self.unit:
                    first, _, rest = name.partition("/")
                    kept = f"{root}/{first}/.history/{self.history}/{rest or first}"
                    fs.create_dir(kept.rpartition("/")[0], recursive=True)
                    fs.move(target, kept)
                elif folder:
                    fs.delete_dir(target)
            fs.move(f"{root}/{self.staging}/{name}", target)

        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(move, moves))
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.root))

    def _clear(self, fs, root: str) -> None:
        from pyarrow import fs as pafs

        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class Files(DataSource):
    """The sink's format; see the module's text."""

    @classmethod
    def name(cls) -> str:
        return "inkbasin_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
