"""Versioned snapshots of the graph's tables, each a stack of runs.

A run is what one publish writes for a table: rows, in buckets by the hash of the table's *unit* (the path of a file, the
source of an edge, a name), and the units that it replaces.  Reading merges: a row counts unless a later run replaces its
unit.  So a change of one file writes the rows of that file and of what it concerns, however large the table is.  When many
runs have piled up, the newest ones are merged, as far as the one below is not at least twice as large: every row is
rewritten a number of times that grows with the logarithm of the table.

A publish writes the runs of all its tables at once, then adds a numbered pointer file in one rename: readers see all of a
batch or nothing.  Of two that publish on the same snapshot the second fails.  Tables that a batch does not touch keep
their runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.sources.files import read_text
from repolens.sources.schema import FOLDERS, INDEXES, KEYS, ORDERS, TABLES, UNITS

#: Runs that a table may have before its newest ones are merged.
MOST_RUNS = 8
#: Replaced units that are broadcast to the rows of older runs, and rows of a table that a join may broadcast; their number is
#: known from when they were written.
BROADCAST_UNITS = 200_000
#: Jobs of one publish that run beside each other.
AT_ONCE = 8


@dataclass(frozen=True)
class Run:
    """A folder of rows in ``buckets`` buckets, and the units of older runs that it replaces: ``gone`` of them in the folder
    ``units``, which runs of several tables may share."""

    id: str
    rows: int = -1
    gone: int = 0
    buckets: int = 1
    units: str = ""

    @property
    def size(self) -> int:
        return max(0, self.rows) + self.gone


@dataclass(frozen=True)
class Units:
    """A written set of units, which has those of all rows that come with it."""

    id: str
    n: int


@dataclass(frozen=True)
class Change:
    """``rows`` replace all rows of their units and of ``gone`` (one column, the unit)."""

    rows: DataFrame
    gone: DataFrame | Units


@dataclass(frozen=True)
class Snapshot:
    number: int
    runs: dict[str, list[Run]]


def together(spark: SparkSession, jobs: list[Callable[[], object]]) -> list:
    """The results of jobs that run beside each other, in order."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def bucket_of(unit: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(unit), F.lit(buckets)).cast("int")


class SnapshotStore:
    """Tables under ``path`` and their indexes; ``load`` reads the current snapshot, ``publish`` changes tables as one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- snapshots ---------------------------------------------------------------------------------

    def _pointers(self) -> list[int]:
        """Numbers of the snapshots there are."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self) -> Snapshot:
        """The newest snapshot."""
        number = max(self._pointers(), default=0)
        held = json.loads(read_text(self.spark, f"{self.path}/snapshots/{number}.json")) if number else {}
        # a store of an earlier version names one folder a table
        return Snapshot(number, {t: [Run(runs)] if isinstance(runs, str) else [Run(**r) for r in runs] for t, runs in held.items()})

    # -- reading -----------------------------------------------------------------------------------

    def _rows(self, name: str, run: Run, buckets: Callable[[int], list[int]] | None = None) -> DataFrame:
        """The rows of one run; of the buckets that ``buckets`` names for their number, if it is given."""
        read = self.spark.read.schema(schema_of(name) + (", bucket int" if run.buckets > 1 else ""))
        rows = read.parquet(f"{self.path}/{name}/{run.id}")
        if run.buckets > 1:
            rows = (rows.where(F.col("bucket").isin(buckets(run.buckets))) if buckets else rows).drop("bucket")
        return rows

    def _gone(self, run: Run) -> DataFrame:
        return self.spark.read.schema("unit string").parquet(f"{self.path}/units/{run.units}")

    def merged(self, name: str, runs: list[Run], buckets: Callable[[int], list[int]] | None = None) -> DataFrame:
        """The rows of ``runs``, oldest first, that no later one of them replaces."""
        if not runs:
            return self.spark.createDataFrame([], schema_of(name))
        later = [(i, r) for i, r in enumerate(runs) if i and r.gone]
        if not later:
            return self._shuffled(reduce(DataFrame.unionByName, [self._rows(name, r, buckets) for r in runs]), runs)
        rows = reduce(DataFrame.unionByName, [self._rows(name, r, buckets).withColumn("run", F.lit(i)) for i, r in enumerate(runs)])
        gone = reduce(DataFrame.unionByName, [self._gone(r).withColumn("by", F.lit(i)) for i, r in later]).groupBy("unit").agg(F.max("by").alias("by"))
        gone = F.broadcast(gone) if sum(r.gone for _, r in later) <= BROADCAST_UNITS else gone
        unit = UNITS[name]
        alive = rows.join(gone, F.col(unit) == F.col("unit"), "left").where("by is null or by <= run")
        return self._shuffled(alive.drop("unit", "by", "run"), runs)

    @staticmethod
    def _shuffled(rows: DataFrame, runs: list[Run]) -> DataFrame:
        """Rows that no join broadcasts if they are many: Spark goes by the bytes of files, and few of those hold many rows."""
        return rows.hint("merge") if sum(r.rows for r in runs) > BROADCAST_UNITS else rows

    def load(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        return self.merged(name, (snapshot or self.snapshot()).runs.get(name, []))

    def lookup(self, name: str, units: list[str], snapshot: Snapshot | None = None) -> DataFrame:
        """The rows of a few units: of a table in buckets, only theirs are read."""
        hash_of = lambda n: sorted({r[0] for r in self.spark.createDataFrame([(u,) for u in units], "unit string").select(bucket_of(F.col("unit"), n)).collect()})
        found = self.merged(name, (snapshot or self.snapshot()).runs.get(name, []), hash_of if units else None)
        return found.where(F.col(UNITS[name]).isin(units))

    def tables(self, snapshot: Snapshot | None = None) -> dict[str, DataFrame]:
        """All tables of one snapshot, and the indexes that it has."""
        snapshot = snapshot or self.snapshot()
        names = [t for t in (*TABLES, *INDEXES) if t in TABLES or t in snapshot.runs]
        return dict(zip(names, together(self.spark, [lambda t=t: self.load(t, snapshot) for t in names]), strict=True))

    def ensure_schema(self) -> list[dict]:
        """Make the tables that are not there yet, and check those that are: table, key, rows, twice (keys that two rows
        have) and odd (columns that are missing or of another type in the files) for each."""
        snapshot = self.snapshot()
        missing = {t: self.spark.createDataFrame([], TABLES[t]) for t in TABLES if t not in snapshot.runs}
        if missing:
            self.publish(missing, snapshot)
            snapshot = self.snapshot()

        def state(t: str) -> dict:
            wanted = {f.name: f.dataType for f in self.spark.createDataFrame([], schema_of(t)).schema}
            odd = set()
            for run in [r for r in snapshot.runs[t] if r.rows]:
                found = {f.name: f.dataType for f in self.spark.read.parquet(f"{self.path}/{t}/{run.id}").schema}
                odd |= {c for c in wanted if found.get(c) != wanted[c]}
            key, rows = KEYS.get(t, []), self.load(t, snapshot)
            return {"table": t, "key": key, "rows": rows.count(), "twice": duplicates(rows, key).count() if key else 0, "odd": sorted(odd)}

        return together(self.spark, [lambda t=t: state(t) for t in sorted(snapshot.runs)])

    # -- writing -----------------------------------------------------------------------------------

    def write(self, name: str, change: DataFrame | Change, buckets: int = 1, first: bool = False) -> Run:
        """Write a run, which no snapshot names yet; the ``first`` of a table has nothing to replace.  A key that two of its rows have is an error; rows of other runs can't
        have it too, since a key holds its unit, of which the new rows replace all others."""
        run = uuid.uuid4().hex
        path = f"{self.path}/{name}/{run}"
        wanted = self.spark.createDataFrame([], schema_of(name)).schema
        rows = change.rows if isinstance(change, Change) else change
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])
        buckets = 1 if name in FOLDERS else buckets
        folder = FOLDERS.get(name, "bucket" if buckets > 1 else None)
        if buckets > 1:
            rows = rows.withColumn("bucket", bucket_of(F.col(UNITS[name]), buckets))
        if folder:
            rows = rows.hint("rebalance", folder)
        order = [c for c in (folder, ORDERS.get(name)) if c]
        rows = rows.sortWithinPartitions(*order) if name in ORDERS else rows
        (rows.write.partitionBy(folder) if folder else rows.write).parquet(path)
        written = Run(run, buckets=buckets)
        made = self._rows(name, written)
        key = KEYS.get(name)
        if key:
            sums = made.groupBy(*key).agg(F.count("*").alias("times")).agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
            if sums[1] > 1:
                raise ValueError(f"{name} would hold two rows of one key")
            n = sums[0]
        else:
            n = made.count()
        units = Units("", 0)
        if isinstance(change, Change) and not first:
            units = change.gone
            if not isinstance(units, Units):
                units = self.write_units(units.toDF("unit").unionByName(made.select(F.col(UNITS[name]).alias("unit"))))
        return Run(run, n, units.n, buckets, units.id)

    def write_units(self, units: DataFrame) -> Units:
        """Write the values of one column as units."""
        name = uuid.uuid4().hex
        path = f"{self.path}/units/{name}"
        units.toDF("unit").where("unit is not null").distinct().write.parquet(path)
        return Units(name, self.spark.read.schema("unit string").parquet(path).count())

    def publish(self, changed: dict[str, DataFrame | Change | list[Run]], base: Snapshot | None = None, buckets: int = 1) -> Snapshot:
        """Make changes current together: a DataFrame is a table's new content, a ``Change`` replaces units, a list of runs
        that ``write`` has made comes on top.  ``base`` is the snapshot that the changes were made from, by default the newest."""
        base = base or self.snapshot()
        runs = {t: list(r) for t, r in base.runs.items()}
        names = list(changed)
        made = together(self.spark, [lambda t=t: changed[t] if isinstance(changed[t], list) else [self.write(t, changed[t], buckets, not runs.get(t))] for t in names])
        for t, new in zip(names, made, strict=True):
            runs[t] = new if isinstance(changed[t], DataFrame) else runs.get(t, []) + [r for r in new if r.size]
        together(self.spark, [lambda t=t: runs.update({t: self.compacted(t, runs[t])}) for t in names if len(runs[t]) > MOST_RUNS])
        snapshot = Snapshot(base.number + 1, runs)
        self._point(snapshot)
        return snapshot

    def compacted(self, name: str, runs: list[Run]) -> list[Run]:
        """``runs`` with the newest ones merged into one, down to the first that is at least twice as large as all above."""
        first, size = len(runs) - 1, runs[-1].size
        while first and runs[first - 1].size < 2 * size:
            first -= 1
            size += runs[first].size
        if first == len(runs) - 1:
            return runs
        tail, buckets = runs[first:], max(r.buckets for r in runs[first:])
        rows = self.merged(name, tail)
        if not first:
            return [self.write(name, rows, buckets)]
        gone = [self._gone(r) for r in tail if r.gone] or [self.spark.createDataFrame([], "unit string")]
        return runs[:first] + [self.write(name, Change(rows, reduce(DataFrame.unionByName, gone)), buckets)]

    def _point(self, snapshot: Snapshot) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        temp = path(f"{self.path}/snapshots/_{uuid.uuid4().hex}")
        fs = temp.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps({t: [asdict(r) for r in runs] for t, runs in snapshot.runs.items()}).encode()))
        out.close()
        target = path(f"{self.path}/snapshots/{snapshot.number}.json")
        # a snapshot's number is taken once: of two that publish on the same base, the second fails.  This rename never
        # replaces a file; file systems that can, do both in one step
        whole = fs.makeQualified(target)
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fs.makeQualified(temp), whole, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise RuntimeError(f"snapshot {snapshot.number} was published by another writer") from e
            raise


def schema_of(name: str) -> str:
    return (TABLES | INDEXES)[name]


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1")
