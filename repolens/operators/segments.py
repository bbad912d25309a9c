"""Vector search by trained cells, kept by the store.

Centroids are trained by k-means on a bounded sample; every vector goes to the cell of its nearest centroid.  The store keeps the
vectors as a table of runs with a folder a cell: each publish adds a segment, vanished and changed paths are merged away on
reading, and segments are merged as they pile up.  A search reads the cells that are nearest to the query and compares exactly
there.  How many that are is measured when they are trained: the least number with which queries of the sample find ``WANTED`` of
their ten nearest in it; vectors that lie in groups need few, vectors without any order about half.  Cells are trained again when the table has grown to ``REGROWN`` times the vectors that they were trained for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.vectors import cosine_score, dot
from repolens.operators.traverse import durable

#: The sample that cells are trained on has at most so many vectors, those with the least hashes.
SAMPLE = 20_000
#: There are at most so many cells; fewer vectors than ``FEW`` have one.
MOST_CELLS, FEW = 1_024, 200
REGROWN = 4
#: So many vectors of the sample are the queries that measure how many cells to read, and the share of the nearest that they find.
ASKED, WANTED = 400, 0.95
#: A task compares its queries with so many vectors of a cell at once.
BLOCK_ROWS = 4_096


def unit_length(vector: str) -> Column:
    """The vector scaled to length 1, as doubles."""
    size = F.sqrt(dot(F.col(vector), F.col(vector)))
    return F.transform(vector, lambda x: x.cast("double") / size)


def usable(rows: DataFrame, dimensions: int) -> DataFrame:
    """The rows whose ``embedding`` has that many numbers and a length."""
    return rows.where((F.size("embedding") == dimensions) & (dot(F.col("embedding"), F.col("embedding")) > 0))


def n_cells(n: int) -> int:
    return 1 if n < FEW else min(MOST_CELLS, 2 * math.isqrt(n))


def train(rows: DataFrame, dimensions: int, seed: int = 7) -> DataFrame:
    """cell, center, trained (the vectors there were) and probes (the cells to read) for the vectors of ``rows``."""
    good = usable(rows, dimensions)
    n = good.count()
    sample = good.select(unit_length("embedding").alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE)
    k = n_cells(n)
    centers, probes = np.zeros((1, dimensions)), 1
    if k > 1:
        sample = durable(sample)
        model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="features").fit(sample.select(array_to_vector("v").alias("features")))
        centers = np.array(model.clusterCenters())
        # at most SAMPLE rows
        probes = _needed(np.array([r["v"] for r in sample.collect()]), centers)
    return rows.sparkSession.createDataFrame([(i, c.tolist(), n, probes) for i, c in enumerate(centers)], "cell int, center array<float>, trained long, probes int")


def _needed(sample: np.ndarray, centers: np.ndarray) -> int:
    """The least number of cells with which queries from the sample find ``WANTED`` of their nearest in it."""
    asked = sample[:: max(1, len(sample) // ASKED)]
    cells = _distances(sample, centers).argmin(axis=1)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :10]
    # the place of the cell of each of the nearest among the cells that the query reads, in order
    place = np.argsort(np.argsort(_distances(asked, centers), axis=1, kind="stable"), axis=1)
    places = np.sort(np.take_along_axis(place, cells[near], axis=1).ravel())
    return int(places[min(len(places) - 1, math.ceil(WANTED * len(places)) - 1)]) + 1


def centers_of(centroids: DataFrame) -> np.ndarray:
    """At most ``MOST_CELLS`` rows, in the order of cells."""
    found = centroids.orderBy("cell").collect()
    return np.array([r["center"] for r in found], np.float64)


def assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """``rows`` that can be searched, with their ``cell``."""
    kept = [f for f in usable(rows, centers.shape[1]).schema if f.name != "cell"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["embedding"], centers.shape[1])
            cells = _distances(v, centers).argmin(axis=1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    return usable(rows, centers.shape[1]).select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, f"{schema}, cell int")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    v = np.asarray(column.flatten(), np.float64).reshape(-1, dimensions)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _distances(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances to the centers, less what all of a row share."""
    return (centers * centers).sum(axis=1) - 2 * (v @ centers.T)


def probes_of(centroids: DataFrame) -> int:
    return centroids.agg(F.max("probes")).first()[0] or 0


def near_cells(centers: np.ndarray, query: list[float], probes: int) -> list[int]:
    """The cells to read for a query, nearest first."""
    v = np.array([query], np.float64)
    size = np.sqrt((v * v).sum())
    order = np.argsort(_distances(v / size if size else v, centers)[0], kind="stable")
    return order[:probes].tolist()


def nearest(vectors: DataFrame, centroids: DataFrame, query: list[float], limit: int, order: tuple[str, ...], probes: int | None = None) -> DataFrame:
    """The ``limit`` rows of the probed cells that are nearest to a query, with their score."""
    centers = centers_of(centroids)
    if not len(centers) or len(query) != centers.shape[1]:
        return vectors.limit(0).withColumn("score", F.lit(None).cast("double"))
    vector = F.array(*[F.lit(float(x)) for x in query])
    some = vectors.where(F.col("cell").isin(near_cells(centers, query, probes or probes_of(centroids))))
    scored = some.withColumn("score", cosine_score(F.col("embedding"), vector)).where("score is not null")
    return scored.orderBy(F.col("score").desc(), *order).limit(limit)


def nearest_many(vectors: DataFrame, centroids: DataFrame, queries: DataFrame, limit: int, key: str, probes: int | None = None) -> DataFrame:
    """query, key, score, nth: for each of ``queries`` (query long, embedding) the ``limit`` nearest rows of its probed cells.

    The rows of a cell are dealt to blocks of about ``BLOCK_ROWS``, however many share a cell; each block keeps the best of each
    query that probes it, so no pair of a row and a query is ever a row of a table.
    """
    centers = centers_of(centroids)
    n, dimensions = probes or probes_of(centroids), centers.shape[1]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["embedding"], dimensions)
            cells = np.argsort(_distances(v, centers), axis=1, kind="stable")[:, :n] if len(v) else np.zeros((0, 0), np.int64)
            lists = pa.array(cells.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["query"], batch["embedding"], lists], names=["query", "embedding", "cells"])

    asked = usable(queries.select("query", "embedding"), dimensions).mapInArrow(probe, "query long, embedding array<float>, cells array<int>")
    asked = asked.select("query", "embedding", F.explode("cells").alias("cell"))
    parts = vectors.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    # a row for each cell, of which there are at most MOST_CELLS
    parts = F.broadcast(parts)
    rows = vectors.select(F.col(key).alias("key"), "embedding", "cell").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kind = rows.schema["key"].dataType.simpleString()

    def compare(_: tuple, own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if own.empty or questions.empty:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "key": pd.Series([], dtype=object), "score": np.zeros(0)})
        keys = np.asarray(own["key"], object)
        order = keys.argsort(kind="stable").argsort()
        v, q = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (own, questions))
        v, q = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (v, q))
        out = []
        for i in range(0, len(q), 256):
            scores = (1 + q[i : i + 256] @ v.T) / 2
            # the order of equal scores is that of the keys
            best = np.lexsort((np.broadcast_to(order, scores.shape), -scores), axis=1)[:, :limit]
            out.append(pd.DataFrame({"query": np.repeat(questions["query"].to_numpy()[i : i + 256], best.shape[1]), "key": pd.Series(keys[best.ravel()], dtype=object), "score": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(out)

    met = rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInPandas(compare, f"query long, key {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "key"))
    return met.withColumn("nth", rank).where(F.col("nth") <= limit).withColumnRenamed("key", key)


def recall(vectors: DataFrame, centroids: DataFrame, queries: DataFrame, limit: int, key: str, probes: int | None = None) -> float:
    """The share of the exact nearest of all queries that a search with so many probes finds."""
    every = centroids.count()
    exact = nearest_many(vectors, centroids, queries, limit, key, every).select("query", key)
    found = nearest_many(vectors, centroids, queries, limit, key, probes).select("query", key, F.lit(1).alias("hit"))
    sums = exact.join(found, ["query", key], "left").agg(F.count("*"), F.count("hit")).first()
    return sums[1] / sums[0] if sums[0] else 1.0


def vector_rows(tables: dict[str, DataFrame], labels: dict[str, str], paths: DataFrame | None = None) -> DataFrame:
    """The rows of the node tables ``labels`` that have a vector, as the store's ``vectors`` holds them but for the cell."""
    from repolens.operators.graph import node_id  # noqa: PLC0415

    parts = []
    for t, label in labels.items():
        df = tables[t] if paths is None else tables[t].join(paths, "path", "left_semi")
        line = F.col("line_number").cast("long") if "line_number" in df.columns else F.lit(None).cast("long")
        parts.append(df.where("embedding is not null").select(F.lit(label).alias("label"), node_id(label, df.columns).alias("node"), "name", "path", line.alias("line_number"), "description", "repo_path", "embedding"))
    return reduce(DataFrame.unionByName, parts)
