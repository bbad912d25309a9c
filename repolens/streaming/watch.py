"""Watching directories: a change stream, debouncing, and re-indexing.

A source compares listings of a directory: each micro-batch holds the files added, changed or unlinked since the last.
``Watcher`` takes the one whose tasks list a subtree each (``subtrees``); ``DirectoryChanges`` lists on the driver, for small trees.
Changes of a path that follow within the quiet time are one session, across micro-batches, and the last of them decides
what is done.  A session is closed by the watermark, so for a while after a change the source reports the time alone (op
``tick``), which moves the watermark on when no other file changes.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from repolens.functions.parsers import EXTENSIONS
from repolens.operators.traverse import shared_folder
from repolens.plans.index import Indexer
from repolens.sources.files import IGNORED_DIRS, contents, exists, rooted
from repolens.streaming.subtrees import SubtreeChanges, primed

QUIET = "2 seconds"
#: Seconds for which the source goes on reporting the time after a change: enough for the watermark to pass the quiet time.
TICKS = 12
#: Tasks that keep the sessions of one watched directory.
STATE_TASKS = "4"
EVENTS = "path string, op string, event_time timestamp, seq long"
IGNORE_REGEX = "(^|/)(" + "|".join(re.escape(x) for x in IGNORED_DIRS) + ")(/|$)"


class DirectoryChanges(DataSource):
    """``spark.readStream.format("directory_changes").option("path", dir)``: path, op (add, change, unlink), event_time, seq.

    The offset is the listing itself, so a restarted query goes on from its checkpoint and reports what happened meanwhile.
    Rows of op ``tick`` and an empty path, for ``TICKS`` seconds after a change, state only the time.
    Files that are there when a query first starts are not reported.  The directory must be readable from the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:  # noqa: N802, ARG002
        return _Listing(self.options["path"])


class _Listing(SimpleDataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def listing(self) -> dict[str, list[int]]:
        out = {}
        for top, dirs, files in os.walk(self.path):
            dirs[:] = [d for d in dirs if d not in IGNORED_DIRS]
            for f in files:
                try:
                    s = os.stat(p := f"{top}/{f}")
                except OSError:
                    continue
                out[p] = [s.st_mtime_ns, s.st_size]
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps(self.listing()), "seq": 0, "at": 0, "changed": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new, now = self.listing(), int(time.time() * 1e6)
        changed = json.loads(start["files"]) != new
        if not changed and now > start["changed"] + TICKS * 1_000_000:
            return iter([]), start
        end = {"files": json.dumps(new), "seq": start["seq"], "at": now, "changed": now if changed else start["changed"]}
        rows = self._rows(start, end)
        return iter(rows), end | {"seq": start["seq"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._rows(start, end))

    def _rows(self, start: dict, end: dict) -> list[tuple]:
        """The changes between two listings and the tick; what they are follows from the offsets alone."""
        old, new = json.loads(start["files"]), json.loads(end["files"])
        changes = [(p, "add") for p in new if p not in old] + [(p, "change") for p in new if p in old and old[p] != new[p]] + [(p, "unlink") for p in old if p not in new]
        when = datetime.fromtimestamp(end["at"] / 1e6, UTC)
        return [(p, op, when, start["seq"] + i) for i, (p, op) in enumerate([("", "tick"), *sorted(changes)])]


def is_relevant() -> Column:
    """Whether a path is a source file outside ignored directories."""
    pattern = r"(?i)(" + "|".join(re.escape(x) for x in EXTENSIONS) + ")$"
    return F.col("path").rlike(pattern) & ~F.col("path").rlike(IGNORE_REGEX)


def relevant(events: DataFrame) -> DataFrame:
    """Events on source files outside ignored directories."""
    return events.where(is_relevant())


def debounced(events: DataFrame, quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """path, op, session_end, n_events: sessions of a path separated by ``quiet``; the last event decides ``op``.

    ``events`` is path, op, event_time (timestamp), seq; on a stream give ``late``, the watermark's delay.
    """
    df = events.withWatermark("event_time", late) if late else events
    grouped = df.groupBy("path", F.session_window("event_time", quiet).alias("session"))
    out = grouped.agg(F.max_by("op", F.struct("event_time", "seq")).alias("op"), F.count("*").alias("n_events"))
    return out.select("path", "op", F.col("session.end").alias("session_end"), "n_events")


def apply_changes(indexer: Indexer, root: str, changes: DataFrame) -> None:
    """Re-index added and changed files and remove unlinked ones, links included, in one publish."""
    spark = changes.sparkSession
    root = rooted(spark, root)
    last = changes.groupBy("path").agg(F.max_by("op", "session_end").alias("op"))
    ops = {r["path"]: r["op"] for r in last.collect()}  # the files of one micro-batch
    alive = [p for p, op in ops.items() if op != "unlink" and exists(spark, p)]
    dead = [(p,) for p in ops if p not in alive]
    if not ops:
        return
    if alive:
        sources = contents(spark.read.format("binaryFile").load(alive), root)
    else:
        sources = spark.createDataFrame([], "path string, rel string, lang string, source string, content_hash string")
    indexer.index_files(root, sources, spark.createDataFrame(dead, "path string"))


class Watcher:
    """Streaming queries by directory; watching a directory twice is the same as once."""

    def __init__(self, spark: SparkSession, indexer: Indexer) -> None:
        self.spark, self.indexer = spark, indexer
        self.queries: dict[str, StreamingQuery] = {}
        spark.dataSource.register(DirectoryChanges)
        spark.dataSource.register(SubtreeChanges)

    def watch(self, path: str, interval: str = "2 seconds", checkpoint: str | None = None) -> StreamingQuery:
        path = rooted(self.spark, path)
        if path in self.queries and self.queries[path].isActive:
            return self.queries[path]
        checkpoint = checkpoint or f"{shared_folder(self.spark)}/watch-{uuid.uuid4().hex}"
        state = f"{checkpoint}-listings"
        reader = self.spark.readStream.format("subtree_changes").option("path", path).option("state", state)
        if not exists(self.spark, f"{checkpoint}/offsets"):
            reader = reader.option("first", str(primed(self.spark, path, state)))
        events = reader.load()
        sessions = debounced(events.where((F.col("op") == "tick") | is_relevant()), QUIET, "0 seconds")

        def run(batch: DataFrame, _: int) -> None:
            apply_changes(self.indexer, path, batch.where("op <> 'tick'"))

        writer = sessions.writeStream.queryName(f"watch:{path}").outputMode("append").foreachBatch(run)
        writer = writer.trigger(processingTime=interval).option("checkpointLocation", checkpoint)
        # a query keeps the settings that it starts with
        old = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", STATE_TASKS)
        try:
            self.queries[path] = writer.start()
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", old)
        return self.queries[path]

    def unwatch(self, path: str) -> bool:
        query = self.queries.pop(rooted(self.spark, path), None)
        if query is not None:
            query.stop()
        return query is not None

    def watched(self) -> list[str]:
        return sorted(p for p, q in self.queries.items() if q.isActive)

    def close(self) -> None:
        for path in list(self.queries):
            self.unwatch(path)
