"""Connected components: a distributed loop of joins, or one task where the edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import BROADCAST_ROWS, materialise


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of all edges (a, b) of a task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    if root:
        nodes = np.fromiter(root, np.int64, len(root))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(x) for x in nodes.tolist()], pa.int64())], names=["node", "label"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): the least node of its component.

    Edges that are counted to be no more than what is broadcast go through one task.  More take rounds: each takes the least
    label among a node's neighbours and then what that label's node had as label (pointer jumping), so the rounds grow with
    the logarithm of a component's diameter.  A node with very many edges is aggregated map-side.
    """
    edges = materialise(edges.select("a", "b"), "cc-edges")
    if edges.count() <= BROADCAST_ROWS:
        return edges.coalesce(1).mapInArrow(_labelled, "node long, label long")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-both")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), F.lit(True).alias("moved")), "cc-labels")
    # one row a node: a lookup that every task can hold as long as there are few of them
    side = F.broadcast if labels.count() <= BROADCAST_ROWS else (lambda df: df)
    for _ in range(max_rounds):
        known = labels.select("node", "label")
        near = both.join(side(known.select(F.col("node").alias("b"), "label")), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = near.select(F.col("a").alias("node"), "m").join(side(known), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("next"))
        jump = known.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = step.join(side(jump), "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("old")).alias("moved"))
        labels = materialise(step, "cc-labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
