"""Traversals: trails of bounded length and reachability.

A trail may meet a node again but never an edge.  Trails grow by one join a step; each state carries the ids of its edges.
Reachability walks node by node: a frontier joins the edges and drops what has been seen.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 100
#: Bytes of files or of a shuffle, both compressed, that a join within ``few_broadcasts`` may broadcast by Spark's own choice.
BROADCAST_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a local session that names none, as in
    tests, gets a temporary one, which goes when the process ends."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="repolens-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_written: list[list[str]] = []


def durable(df: DataFrame, label: str = "durable") -> DataFrame:
    """Write to the shared checkpoint folder and read back, which cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _written:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``durable`` writes within: for work whose results are stored elsewhere by then."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield
    finally:
        _written[:] = [x for x in _written if x is not paths]
        for p in paths:
            remove(spark, p)


_BROADCAST_KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
_lowered: dict[SparkSession, tuple[int, dict[str, str | None]]] = {}
_lowering = threading.Lock()


@contextmanager
def few_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within it joins broadcast at most ``BROADCAST_BYTES`` by Spark's own choice, for work of very many joins: what each may
    send through the driver adds up, and some 10 MB of files or shuffles are well over 100 MB of rows.

    The setting is the session's, so of several at once the last to end restores it.
    """
    def least(value: str) -> int:
        return -1 if value.startswith("-") else min(BROADCAST_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value))

    with _lowering:
        depth, old = _lowered.get(spark, (0, {}))
        if not depth:
            old = {k: spark.conf.get(k, None) for k in _BROADCAST_KEYS}
            spark.conf.set(_BROADCAST_KEYS[0], least(spark.conf.get(_BROADCAST_KEYS[0])))
            if old[_BROADCAST_KEYS[1]] is not None:  # unset, it follows the other
                spark.conf.set(_BROADCAST_KEYS[1], least(old[_BROADCAST_KEYS[1]]))
        _lowered[spark] = depth + 1, old
    try:
        yield
    finally:
        with _lowering:
            depth, old = _lowered.pop(spark)
            if depth > 1:
                _lowered[spark] = depth - 1, old
            else:
                for k, v in old.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark can write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same for rows with any names and types of columns."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def trails(nodes: DataFrame, edges: DataFrame, name: str, depth: int, min_length: int = 1, limit: int | None = None) -> DataFrame:
    """length, names: the trails of ``min_length`` to ``depth`` edges from every node called ``name``.

    ``nodes`` has id and name; ``edges`` has src_id, dst_id and line_number.  Parallel edges give trails of their own.  With
    a limit the first in the order (length, names, edge ids) are returned, and no longer trails are built once there are
    enough.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 0 to {MAX_DEPTH}")
    line = F.col("line_number") if "line_number" in edges.columns else F.lit(None).cast("int")
    edge = edges.select("src_id", "dst_id", F.concat_ws(">", F.col("src_id").cast("string"), F.col("dst_id").cast("string"), line.cast("string")).alias("edge"))
    hop = edge.join(nodes.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name")), "dst_id")
    state = nodes.where(F.col("name") == name).select(F.col("id").alias("at"), F.array("name").alias("names"), F.array().cast("array<string>").alias("edges"))
    found, enough = [], 0
    for length in range(depth + 1):
        if length:
            state = state.join(hop, state["at"] == hop["src_id"]).where(~F.array_contains("edges", F.col("edge")))
            state = state.select(F.col("dst_id").alias("at"), F.array_append("names", F.col("dst_name")).alias("names"), F.array_append("edges", F.col("edge")).alias("edges"))
            if length % 2 == 0 and limit is None:
                state = durable(state)
        if length >= min_length:
            found.append(state.select(F.lit(length).alias("length"), "names", "edges"))
            if limit is not None and length < depth:
                enough += state.limit(limit).count()
                if enough >= limit:
                    break
                # fewer than the limit: kept, so that the next length does not build them again
                state = durable(state)
                found[-1] = state.select(F.lit(length).alias("length"), "names", "edges")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    if limit is not None:
        out = out.orderBy("length", "names", "edges").limit(limit)
    return out.select("length", "names")


def trails_sql(spark, nodes: str, edges: str, name: str, depth: int, min_length: int = 1) -> DataFrame:  # noqa: ANN001
    """The same by a recursive query over views, for interactive use on small graphs."""
    return spark.sql(
        f"""
        WITH RECURSIVE walk(at, names, edges, length) AS (
          SELECT id, array(name), cast(array() AS array<string>), 0 FROM {nodes} WHERE name = :name
          UNION ALL
          SELECT n.id, array_append(w.names, n.name), array_append(w.edges, concat_ws('>', e.src_id, e.dst_id, e.line_number)), w.length + 1
          FROM walk w JOIN {edges} e ON e.src_id = w.at JOIN {nodes} n ON n.id = e.dst_id
          WHERE w.length < :depth AND NOT array_contains(w.edges, concat_ws('>', e.src_id, e.dst_id, e.line_number))
        ) SELECT length, names FROM walk WHERE length >= :min_length""",
        args={"name": name, "depth": depth, "min_length": min_length},
    )


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """id of ``start`` and of every node that edges (src_id, dst_id) lead to from it.

    Each round is one job: the nodes next to the last frontier that no frontier has held.
    """
    edges = durable(edges.select("src_id", "dst_id").distinct())
    frontier = seen = durable(start.select("id").distinct())
    for _ in range(max_rounds):
        ahead = edges.join(frontier.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct()
        frontier = durable(ahead.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"reachability did not settle in {max_rounds} rounds")
