"""Boards as a data source of Spark's own API: spark.read.format("boards") and spark.readStream.format("boards").

    board_source.register(spark)
    spark.read.format("boards").load(folder)

A folder has the listing of the boards, boards.json (one object a line: provider, url and file), and their payloads under the
names that it gives. A batch read has one partition for each board. The options `providers` and `urls` (comma-separated)
are answered from the listing, so boards that they leave out are never opened. (They are options and no pushed filters:
Spark 4.1 lets scans of one frame share what was pushed last, so a union of three filters on it lost rows.) A stream reads each payload again when it has changed:
its offset is the time and name of the newest payload seen, so a stream that starts again goes on where it was. A
board that can't be read stays as a row, with an error: not_found, invalid (no JSON) or failed (anything else).

Files are opened with pyarrow's file systems, so a folder may be local, or in HDFS, S3 or GCS. A listing goes through the
driver, as all planning does: one short row a board.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LISTING = "boards.json"
SCHEMA = "provider string, url string, file string, payload string, error string"
KNOWN = ("provider", "url", "file")
PER_PARTITION = 50  # boards that one task of a stream reads


@dataclass
class BoardPartition(InputPartition):
    boards: list[dict]


class Folder:
    """The listing and the payloads under a path or URI."""

    def __init__(self, path: str):
        self.store, self.base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    def listing(self) -> list[dict]:
        with self.store.open_input_stream(f"{self.base}/{LISTING}") as f:
            rows = [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
        return [{k: r.get(k) for k in KNOWN} for r in rows]

    def changed(self) -> dict[str, int]:
        """When each payload was written, in nanoseconds."""
        found = self.store.get_file_info(fs.FileSelector(self.base, recursive=False))
        return {i.base_name: i.mtime_ns or 0 for i in found if i.type == fs.FileType.File and i.base_name != LISTING}

    def fetch(self, board: dict) -> tuple:
        payload, error = None, None
        try:
            with self.store.open_input_stream(f"{self.base}/{board['file']}") as f:
                payload = f.read().decode("utf-8", "replace")
            json.loads(payload)
        except FileNotFoundError:
            error = "not_found"
        except ValueError:
            error = "invalid"
        except Exception:  # one board never ends a run
            error = "failed"
        return (board["provider"], board["url"], board["file"], payload, error)


def _wanted(boards: list[dict], wanted: dict[str, set[str]]) -> list[dict]:
    return [b for b in boards if all(b[name] in values for name, values in wanted.items())]


class BoardsReader(DataSourceReader):
    def __init__(self, path: str, wanted: dict[str, set[str]]):
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[BoardPartition]:
        boards = _wanted(Folder(self.path).listing(), self.wanted)
        return [BoardPartition([b]) for b in boards] or [BoardPartition([])]

    def read(self, partition: BoardPartition) -> Iterator[tuple]:
        folder = Folder(self.path)
        return (folder.fetch(b) for b in partition.boards)


class BoardsStreamReader(DataSourceStreamReader):
    """Offsets are the time and name of a payload; a batch has the payloads after one offset, up to another."""

    def __init__(self, path: str, wanted: dict[str, set[str]]):
        self.path, self.wanted = path, wanted

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        at, file = max(((at, file) for file, at in Folder(self.path).changed().items()), default=(-1, ""))
        return {"at": at, "file": file}

    def partitions(self, start: dict, end: dict) -> list[BoardPartition]:
        folder = Folder(self.path)
        changed, after, until = folder.changed(), (start["at"], start["file"]), (end["at"], end["file"])
        due = [b for b in _wanted(folder.listing(), self.wanted) if b["file"] in changed and after < (changed[b["file"]], b["file"]) <= until]
        return [BoardPartition(due[i : i + PER_PARTITION]) for i in range(0, len(due), PER_PARTITION)]

    def read(self, partition: BoardPartition) -> Iterator[tuple]:
        folder = Folder(self.path)
        return (folder.fetch(b) for b in partition.boards)


class BoardsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return SCHEMA

    def _wanted(self) -> dict[str, set[str]]:
        given = {name: self.options.get(f"{name}s") for name in ("provider", "url")}
        return {name: set(v.split(",")) for name, v in given.items() if v}

    def reader(self, schema: StructType) -> BoardsReader:
        return BoardsReader(self.options["path"], self._wanted())

    def streamReader(self, schema: StructType) -> BoardsStreamReader:  # noqa: N802
        return BoardsStreamReader(self.options["path"], self._wanted())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(BoardsSource)
