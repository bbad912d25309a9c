"""A change source whose tasks each list a part of a directory tree, and whose offsets are times.

A micro-batch lists the tree anew: each task takes the subtrees (of the first two levels of directories) whose names hash to it,
compares them with what it found last, and reports the difference.  What was found is kept in a file a task and batch in a
shared folder, so an offset has the same few bytes however many files there are, and nothing is listed on the driver.  A task
that is tried again finds the listing of its batch already there and reports the same.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from repolens.sources.files import IGNORED_DIRS, opened

PARTS = 8
LEVELS = 2


def _owner(names: list[str], parts: int) -> int:
    """The task of a file or directory with these names from the root on: files above the last level that is dealt go by the
    directories they are in."""
    return zlib.crc32("/".join(names[:LEVELS]).encode()) % parts


def listed(root: str, part: int, parts: int) -> dict[str, list[int]]:
    """path -> time of change and size of the files that are this task's, outside ignored directories."""
    fs, top = opened(root)
    top = top.rstrip("/")
    out: dict[str, list[int]] = {}
    todo: list[tuple[str, list[str]]] = [(top, [])]
    while todo:
        folder, names = todo.pop()
        try:
            found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        except OSError:  # it may go while it is read
            continue
        for x in found:
            if x.type == pafs.FileType.Directory:
                own = [*names, x.base_name]
                if x.base_name not in IGNORED_DIRS and (len(own) < LEVELS or _owner(own, parts) == part):
                    todo.append((x.path, own))
            elif len(names) >= LEVELS or _owner(names, parts) == part:
                out[root.rstrip("/") + x.path[len(top) :]] = [x.mtime_ns or 0, x.size or 0]
    return out


class _Listings:
    """The listings of a watched tree, by time and task."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = opened(folder)

    def _file(self, at: int, part: int) -> str:
        return f"{self.folder}/{at}/{part}.json"

    def load(self, at: int, part: int) -> dict[str, list[int]] | None:
        try:
            with self.fs.open_input_stream(self._file(at, part)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def store(self, at: int, part: int, found: dict[str, list[int]]) -> None:
        self.fs.create_dir(f"{self.folder}/{at}", recursive=True)
        temp = f"{self.folder}/{at}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as f:
            f.write(json.dumps(found).encode())
        self.fs.move(temp, self._file(at, part))

    def at_or_list(self, root: str, at: int, part: int, parts: int) -> dict[str, list[int]]:
        """What was found then, or, if nobody has looked yet, what is there now."""
        found = self.load(at, part)
        if found is None:
            self.store(at, part, listed(root, part, parts))
            found = self.load(at, part)
        return found or {}

    def forget(self, before: int) -> None:
        for x in self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True)):
            if x.base_name.isdigit() and int(x.base_name) < before:
                self.fs.delete_dir(x.path)


class _Subtree(InputPartition):
    def __init__(self, start: int, end: int, part: int) -> None:
        super().__init__(part)
        self.start, self.end, self.part = start, end, part


class SubtreeReader(DataSourceStreamReader):
    def __init__(self, path: str, state: str, parts: int, first: int | None) -> None:
        self.path, self.state, self.parts, self.first = path, state, parts, first

    def initialOffset(self) -> dict:  # noqa: N802
        at = self.first if self.first is not None else int(time.time() * 1e6)
        if self.first is None:  # nobody has listed the tree for this query
            for part in range(self.parts):
                _Listings(self.state).at_or_list(self.path, at, part, self.parts)
        return {"at": at}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": int(time.time() * 1e6)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Subtree(start["at"], end["at"], part) for part in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The changes of a task's subtrees; the first task adds the tick, which states the time alone."""
        p, listings = partition, _Listings(self.state)
        old, new = listings.at_or_list(self.path, p.start, p.part, self.parts), listings.at_or_list(self.path, p.end, p.part, self.parts)
        changes = [(f, "add") for f in new if f not in old] + [(f, "change") for f in new if f in old and old[f] != new[f]] + [(f, "unlink") for f in old if f not in new]
        when = datetime.fromtimestamp(p.end / 1e6, UTC)
        for i, (f, op) in enumerate([("", "tick"), *sorted(changes)] if p.part == 0 else sorted(changes)):
            yield f, op, when, i

    def commit(self, end: dict) -> None:
        _Listings(self.state).forget(end["at"])


class SubtreeChanges(DataSource):
    """``spark.readStream.format("subtree_changes").option("path", tree).option("state", shared)``: path, op (add, change, unlink,
    tick), event_time, seq.

    ``state`` is a folder of this query that all machines share.  A query that goes on from its checkpoint reports what happened
    meanwhile.  Files that are there when it first starts are not reported: ``first`` names the listing that ``primed`` made;
    without it the driver lists the tree, once.
    """

    @classmethod
    def name(cls) -> str:
        return "subtree_changes"

    def schema(self) -> str:
        return "path string, op string, event_time timestamp, seq long"

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802, ARG002
        first = self.options.get("first")
        return SubtreeReader(self.options["path"], self.options["state"], int(self.options.get("parts", PARTS)), None if first is None else int(first))


def primed(spark: SparkSession, path: str, state: str, parts: int = PARTS) -> int:
    """List a tree by tasks and keep it as what there was; returns the listing's time, for the option ``first``."""
    at = int(time.time() * 1e6)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for part in batch["id"].to_pylist():
                _Listings(state).at_or_list(path, at, part, parts)
            yield batch

    _parts(spark, parts).mapInArrow(run, "id long").collect()
    return at


def _parts(spark: SparkSession, parts: int) -> DataFrame:
    return spark.range(0, parts, 1, parts)
