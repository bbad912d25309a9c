"""Descriptions and embeddings, gated by hashes.

Only rows whose hash differs from the one last described reach a generator.  Generators are pluggable callables of a
prompt; without one, nothing is described.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.vectors import HashingEmbedder, embedder_udf
from repolens.operators.graph import directory_groups

Generator = Callable[[str, int], "str | None"]


_slots = threading.Lock()


class TransientError(Exception):
    """A failure worth another try: a rate limit, a server's error, a lost connection."""


@dataclass
class Pool:
    """Several generators with slots each; a prompt goes to the one with most free slots (the first of equals), and after a
    failure worth another try to the next.

    One task holds one prompt at a time, and at most ``slots`` tasks run at once, in processes that share nothing.  So each
    task of a job has a slot of its own, by its number, and never a member more tasks than slots.  Outside tasks, as in
    threads of one process, slots are counted.
    """

    members: list[tuple[Generator, int]]
    retries: int = 3
    pause: Callable[[float], None] = time.sleep
    used: list[int] = field(default_factory=list)
    busy: dict[int, int] = field(default_factory=dict)

    @property
    def slots(self) -> int:
        return sum(n for _, n in self.members)

    def __call__(self, prompt: str, max_tokens: int = 150) -> str | None:
        if not self.members:
            return None
        task = TaskContext.get()
        who = None
        for attempt in range(self.retries + 1):
            if task is not None:
                who = self.home(task.partitionId()) if who is None else (who + 1) % len(self.members)
            else:
                who = self._taken(who)
            try:
                self.used.append(who)
                text = self.members[who][0](prompt, max_tokens)
                return text.strip() if text and text.strip() else None
            except TransientError:
                if attempt < self.retries:
                    self.pause(2.0 ** (attempt + 1))
            except Exception:  # noqa: BLE001  any other failure leaves this prompt without a description
                return None
            finally:
                if task is None:
                    with _slots:
                        self.busy[who] -= 1
        return None

    def home(self, task: int) -> int:
        """The member of a task: each member has as many of any ``slots`` tasks in a row as it has slots, dealt out one slot
        at a time to the member with most left."""
        left = [n for _, n in self.members]
        dealt = []
        for _ in range(self.slots):
            who = left.index(max(left))
            left[who] -= 1
            dealt.append(who)
        return dealt[task % len(dealt)] if dealt else 0

    def _taken(self, last: int | None) -> int:
        """The member with most free slots, not ``last`` if there is another; its slot is taken."""
        with _slots:
            free = [(n - self.busy.get(i, 0), -i) for i, (_, n) in enumerate(self.members) if i != last or len(self.members) == 1]
            who = -max(free)[1]
            self.busy[who] = self.busy.get(who, 0) + 1
            return who


def first_line_generator(prompt: str, max_tokens: int = 150) -> str | None:
    """A stand-in without a model: the subject of the prompt as a sentence."""
    subject = [x.partition(": ")[2] for x in prompt.splitlines() if x.startswith(("Symbol: ", "File: ", "Directory: "))]
    return f"{subject[-1]}."[: max_tokens * 4] if subject else None


def symbol_prompt(kind: Column, name: Column, path: Column, source: Column) -> Column:
    head = F.lit("Say in one or two plain sentences what this code is for.\n\n")
    return F.concat(head, F.lit("File: "), path, F.lit("\nSymbol: "), kind, F.lit(" "), name, F.lit("\n\nCode:\n"), F.substring(source, 1, 2000))


def file_prompt(path: Column, symbols: Column, source: Column) -> Column:
    head = F.lit("Say in one or two plain sentences what this file is for.\n\n")
    return F.concat(head, F.lit("Symbols: "), symbols, F.lit("\nFile: "), path, F.lit("\n\nCode:\n"), F.substring(source, 1, 2000))


def directory_prompt(path: Column, files: Column) -> Column:
    return F.concat(F.lit("Say in one or two plain sentences what this directory is for.\n\nFiles: "), files, F.lit("\nDirectory: "), path)


def generate(rows: DataFrame, generator: Generator, slots: int = 16, max_tokens: int = 150) -> DataFrame:
    """``rows`` (with ``prompt``) with a ``description``, at most ``slots`` prompts at once; null where none came back."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", description string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(description=[generator(p, max_tokens) for p in batch["prompt"]])

    return rows.repartition(slots).mapInPandas(run, schema)


def changed(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, hash, prompt) whose hash is not the described one of the table."""
    stored = table.groupBy(*key).agg(F.max("described_hash").alias("stored"))
    return rows.join(stored, key, "left").where(~F.col("hash").eqNullSafe(F.col("stored"))).drop("stored")


def describe(rows: DataFrame, table: DataFrame, key: list[str], generator: Generator, embed: Callable | None = None, slots: int = 16) -> DataFrame:
    """key, description, described_hash, embedding of the changed rows that got a description."""
    made = generate(changed(rows, table, key), generator, slots).where("description is not null")
    vector = embedder_udf(embed or HashingEmbedder())(F.col("description"))
    return made.select(*key, "description", F.col("hash").alias("described_hash"), vector.alias("embedding"))


def symbol_rows(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """kind, id, hash, prompt of symbols with source."""
    kind = lambda df, k: df.where("source is not null and source <> ''").select(
        F.lit(k).alias("kind"), "id", F.sha2("source", 256).alias("hash"), symbol_prompt(F.lit(k), F.col("name"), F.col("path"), F.col("source")).alias("prompt")
    )
    return kind(functions, "function").unionByName(kind(classes, "class"))


def file_rows(files: DataFrame, sources: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """path, hash, prompt of files; the prompt lists classes, then functions."""
    names = lambda df: df.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))
    both = files.select("path", "content_hash").join(sources.select("path", "source"), "path")
    both = both.join(names(classes).withColumnRenamed("names", "c"), "path", "left").join(names(functions).withColumnRenamed("names", "f"), "path", "left")
    empty = F.array().cast("array<string>")
    listed = F.array_join(F.concat(F.coalesce("c", empty), F.coalesce("f", empty)), ", ")
    return both.select("path", F.col("content_hash").alias("hash"), file_prompt(F.col("path"), listed, F.col("source")).alias("prompt"))


def directory_rows(files: DataFrame) -> DataFrame:
    """path, hash, prompt of directories with files of their own."""
    groups = directory_groups(files)
    return groups.select(F.col("dir_path").alias("path"), F.col("list_hash").alias("hash"), directory_prompt(F.col("dir_path"), F.col("file_list")).alias("prompt"))
