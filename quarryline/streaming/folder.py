"""A streaming source that polls a folder: added, changed and deleted files as rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of files that one partition reads.
PARTITION_BYTES = 64_000_000
_CHUNK = 1 << 20


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listing(folder: str) -> dict[str, list[int]]:
    """Modification time (ns) and size of every file below a folder, by path; empty if there is no such folder."""
    from pyarrow import fs

    system, path = _opened(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: [f.mtime_ns or 0, f.size] for f in found if f.is_file}


@dataclass
class Changes(InputPartition):
    rows: list[tuple[str, str, int, int]]

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.rows = rows


class FolderReader(DataSourceStreamReader):
    """Offsets are numbers of polls. A poll that finds the folder changed writes its listing to the state folder, so the
    changes between two offsets are the same whenever they are read, after a restart too."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.state = options["path"], options["state"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    def _snapshot(self, n: int) -> dict[str, list[int]]:
        if n == 0:
            return {}
        system, path = _opened(self.state)
        with system.open_input_stream(f"{path}/{n:012}.json") as f:
            return json.loads(f.read())

    def _last(self) -> int:
        return max((int(p.rpartition("/")[2].removesuffix(".json")) for p in listing(self.state) if p.endswith(".json")), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        n, now = self._last(), listing(self.folder)
        if now != self._snapshot(n):
            n += 1
            system, path = _opened(self.state)
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{n:012}.part") as f:
                f.write(json.dumps(now).encode())
            system.move(f"{path}/{n:012}.part", f"{path}/{n:012}.json")
        return {"poll": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self._snapshot(start["poll"]), self._snapshot(end["poll"])
        rows = [(p, "deleted", *before[p]) for p in sorted(before.keys() - after.keys())]
        rows += [(p, "changed" if p in before else "added", *after[p]) for p in sorted(after) if before.get(p) != after[p]]
        parts, held = [[]], 0
        for row in rows:
            size = 0 if row[1] == "deleted" else row[3]
            if parts[-1] and held + size > self.most:
                parts.append([])
                held = 0
            parts[-1].append(row)
            held += size
        return [Changes(p) for p in parts]

    def read(self, partition: Changes) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        for path, kind, mtime, size in partition.rows:
            digest = None
            if kind != "deleted":
                state = hashlib.md5()
                try:
                    with system.open_input_stream(path) as f:
                        while piece := f.read(_CHUNK):
                            state.update(piece)
                    digest = state.hexdigest()
                except FileNotFoundError:  # gone since; the next poll tells
                    pass
            yield path, kind, mtime, size, digest

    def commit(self, end: dict) -> None:
        """Listings before the one committed aren't needed any more."""
        system, path = _opened(self.state)
        for p in listing(self.state):
            name = p.rpartition("/")[2]
            if name.endswith(".json") and int(name.removesuffix(".json")) < end["poll"]:
                system.delete_file(f"{path}/{name}")


class FolderChanges(DataSource):
    """`spark.readStream.format("folder_changes")` with the options `path` (the folder) and `state` (a folder for the listings,
    which the driver keeps between runs): rows (path, change, mtime, size, hash), change being added, changed or deleted.
    The folder must be reachable from all executors."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, change string, mtime long, size long, hash string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FolderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderChanges)
