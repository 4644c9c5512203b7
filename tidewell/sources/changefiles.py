"""A stream of changes from JSON lines, with offsets at transaction ends only.

A line is a change, ``{"progress": position}`` or ``{"error": text}``. Files are read in the order of their names
and may grow. A micro-batch ends at a progress line, so it never splits a transaction; a transaction larger than
the cap is delivered whole. Progress alone makes a batch without changes, which moves the offset of an idle source. An
offset is a place in a file, so a batch costs what it holds, however long the log is. Lines that cannot be decoded become
rows with op ``error``, for a side output. The same reader serves a live log once its lines come from a transport.
The folder is opened as a path of its machine: on a cluster, one that all machines share.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewell.operators.changelog import EVENT

CAP = 1000
REQUIRED = {"schema", "table", "op", "position", "commit_position", "commit_timestamp_us"}


def ends(records: list[dict]) -> list[int]:
    """Numbers of lines read after each progress line."""
    return [n + 1 for n, r in enumerate(records) if "progress" in r]


def next_end(records: list[dict], start: int, cap: int) -> int:
    """Where a batch from start ends: the last transaction end within the cap, or else the first."""
    possible = [e for e in ends(records) if e > start]
    changes = lambda e: sum("progress" not in r for r in records[start:e])
    fitting = [e for e in possible if changes(e) <= cap]
    return fitting[-1] if fitting else possible[0] if possible else start


def _files(path: str, since: str) -> list[str]:
    """Names of the files from one on, in order."""
    if not os.path.isdir(path):
        return []
    with os.scandir(path) as found:
        return sorted(e.name for e in found if e.name.endswith(".jsonl") and e.name >= since)


def _record(raw: bytes) -> dict:
    """A line as a record; one that cannot be decoded is an error with the line's text."""
    try:
        found = json.loads(raw)
        if isinstance(found, dict) and ("progress" in found or "error" in found or REQUIRED <= found.keys()):
            return found
        return {"error": "no change", "raw": raw.decode()}
    except ValueError as error:
        return {"error": str(error), "raw": raw.decode(errors="replace")}


def walk(path: str, offset: dict) -> Iterator[tuple[dict, dict]]:
    """(record, offset behind it) of the lines from an offset on; only what lies behind it is opened.

    A last line without its end is read if it is whole, and left for later if not.
    """
    line = offset["line"]
    for name in _files(path, offset["file"]):
        at = offset["byte"] if name == offset["file"] else 0
        with open(os.path.join(path, name), "rb") as f:
            f.seek(at)
            for raw in f:
                at += len(raw)
                if not raw.strip():
                    continue
                record = _record(raw)
                if not raw.endswith(b"\n") and "raw" in record:
                    return
                line += 1
                yield record, {"file": name, "byte": at, "line": line}


class _Range(InputPartition):
    def __init__(self, start: dict, end: dict) -> None:
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    """An offset is a file, a byte in it, and the number of lines before. Options: ``cap``, changes of a batch, about;
    ``split``, changes of a partition, about; ``confirm``, a file that gets the offsets that are done."""

    def __init__(self, options: dict) -> None:
        self.path, self.cap = options["path"], int(options.get("cap", CAP))
        self.split = int(options.get("split", CAP))
        self.confirm_path = options.get("confirm")
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0, "line": 0}

    def latestOffset(self) -> dict:
        """The last transaction end within the cap, or else the first: reads no further than one transaction beyond the cap."""
        changes = 0
        start = self.last
        for record, offset in walk(self.path, start):
            changes += "progress" not in record
            if changes > self.cap and self.last is not start:
                break
            if "progress" in record:
                self.last = offset
        return self.last

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        """Ranges of whole transactions, side by side."""
        self.last = max(self.last, end, key=lambda o: (o["file"], o["byte"]))
        found, low, changes = [], start, 0
        for record, offset in walk(self.path, start):
            changes += "progress" not in record
            if "progress" in record and (changes >= self.split or offset["line"] >= end["line"]):
                found.append(_Range(low, offset))
                low, changes = offset, 0
            if offset["line"] >= end["line"]:
                break
        return found or [_Range(start, end)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for r, offset in walk(self.path, partition.start):
            n = offset["line"] - 1
            if n >= partition.end["line"]:
                return
            if "progress" in r:
                yield ("", "", "progress", None, None, r["progress"], r["progress"], 0, n)
            elif "error" in r:
                yield ("", "", "error", None, {"error": str(r["error"]), "raw": str(r.get("raw", ""))}, "", "", 0, n)
            else:
                yield (r["schema"], r["table"], r["op"], r.get("before"), r.get("after"), r["position"], r["commit_position"], r["commit_timestamp_us"], n)

    def commit(self, end: dict) -> None:
        if self.confirm_path:
            with open(self.confirm_path, "a", encoding="utf-8") as f:
                f.write(json.dumps(end) + "\n")


class ChangeFiles(DataSource):
    """``spark.readStream.format("changefiles").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "changefiles"

    def schema(self) -> StructType:
        return StructType([*EVENT.fields]).add("line", "long")

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeFiles)
