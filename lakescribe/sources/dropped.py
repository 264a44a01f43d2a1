"""Dropped files as a stream that sees rewritten ones (ST1).

Spark's file source knows a file by its name alone. This one knows it by name and time of change: its offset is the ledger of the
folder (name to time), a batch has the files whose time differs from the ledger before. The offset grows with the files that lie
in the folder, some dozens of bytes each, so move away what has long been read.

The folder is read through pyarrow's file systems, so it is a path or URI that driver and executors both reach that way.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Tasks of a batch at most.
TASKS = 64


def _listed(folder: str) -> tuple:
    """The folder's file system and its .json files' names and times in microseconds."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return system, root, {f.base_name: f.mtime_ns // 1000 for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json")}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class DroppedReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": _listed(self.folder)[2]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        changed = sorted((name, at) for name, at in end["files"].items() if start["files"].get(name) != at)
        return [Files(changed[i::TASKS]) for i in range(min(TASKS, len(changed)))]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root, now = _listed(self.folder)
        for name, at in partition.files:
            if now.get(name) != at:  # changed again, or gone: the next batch has it
                continue
            with system.open_input_stream(f"{root}/{name}") as f:
                text = f.read().decode("utf-8", "replace")
            yield f"{self.folder.rstrip('/')}/{name}", datetime.fromtimestamp(at / 1e6, timezone.utc), text

    def commit(self, end: dict) -> None:
        pass


class DroppedFiles(DataSource):
    """``spark.readStream.format("dropped_files").option("folder", uri)``: (path, mtime, value) of new and rewritten .json files."""

    @classmethod
    def name(cls) -> str:
        return "dropped_files"

    def schema(self) -> str:
        return "path string, mtime timestamp, value string"

    def streamReader(self, schema) -> DroppedReader:
        return DroppedReader(self.options["folder"])
