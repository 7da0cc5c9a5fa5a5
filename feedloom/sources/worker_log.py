"""A data source of rotating logs, in batch and as a stream: ``spark.read.format("rotating_log").load(path)``.

``path`` is a log file; with it go its rotated forms (``path`` + ``.1``, ``.2`` and so on), or all files of a folder. A
rotation renames files, so a file is known by a hash of its first line, not by its name; an offset says of each such file
how many bytes have been read. A line counts when its end is written. Files are read in pieces of ``split`` bytes, each
by a task: a piece has the lines that begin in it.

Rows are (file, at, value): the file's hash, the place of the line in it, and the line. The files have to lie where all
executors can open them. Two files with the same first line would count as one, so logs should begin with a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT = 64 << 20


class Piece(InputPartition):
    def __init__(self, path: str, name: str, start: int, stop: int):
        self.path, self.name, self.start, self.stop = path, name, start, stop


def _first_line(path: str) -> str | None:
    """The hash of a file's first line; None while it is being written."""
    with open(path, "rb") as f:
        line = f.readline()
    return hashlib.sha256(line).hexdigest()[:32] if line.endswith(b"\n") else None


def _whole_lines(path: str) -> int:
    """Bytes of a file up to the end of its last whole line."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            start = max(end - 65_536, 0)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class Log:
    """The files of a log as they are now."""

    def __init__(self, options: dict):
        path = re.sub("^file:(//)?", "", options["path"])
        self.split = int(options.get("split", SPLIT))
        folder, name = (path, "") if os.path.isdir(path) else os.path.split(path)
        names = [x for x in sorted(os.listdir(folder)) if not x.startswith((".", "_")) and (not name or re.fullmatch(re.escape(name) + r"(\.\d+)?", x))]
        self.files = {}
        for found in names:
            full = os.path.join(folder, found)
            if os.path.isfile(full) and (key := _first_line(full)):
                if key in self.files:
                    raise ValueError(f"{full} and {self.files[key]} have the same first line")
                self.files[key] = full

    def sizes(self) -> dict[str, int]:
        return {key: _whole_lines(path) for key, path in self.files.items()}

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        """Pieces of what was written from one offset to another; files that are gone by now have none."""
        return [Piece(self.files[key], key, at, min(at + self.split, stop)) for key, stop in sorted(end.items()) if key in self.files for at in range(start.get(key, 0), stop, self.split)]


def _lines(piece: Piece) -> Iterator[tuple[str, int, str]]:
    path = piece.path
    if not os.path.exists(path) or _first_line(path) != piece.name:  # rotated since the pieces were made
        base = re.sub(r"\.\d+$", "", path)
        path = Log({"path": base if os.path.exists(base) else os.path.dirname(base)}).files[piece.name]
    with open(path, "rb") as f:
        at = piece.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # a line that began before belongs to the piece before
        f.seek(at)
        while at < piece.stop and (line := f.readline()).endswith(b"\n"):
            yield piece.name, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Piece]:
        log = Log(self.options)
        return log.pieces({}, log.sizes())

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _lines(partition) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"read": "{}"}

    def latestOffset(self) -> dict:
        return {"read": json.dumps(Log(self.options).sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return Log(self.options).pieces(json.loads(start["read"]), json.loads(end["read"]))

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _lines(partition)

    def commit(self, end: dict) -> None:
        pass


class RotatingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rotating_log"

    def schema(self) -> str:
        return "file string, at long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    from feedloom.shared import ship

    ship(spark)
    spark.dataSource.register(RotatingLog)
