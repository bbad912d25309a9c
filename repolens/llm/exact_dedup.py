"""Exact dedup against immutable snapshots, screened by static binary fuse filters.

A snapshot holds one entry per distinct text (SHA-256 of the text without white space, its byte length, the copy to keep
and the number of copies) in hash buckets, and one binary fuse filter per bucket.  A new batch is first grouped by itself;
its distinct digests are screened by the filter of their bucket, which is all that most of them ever touch; positives join
the exact bucket on the whole digest, and the bytes of both texts are compared before they count as one group.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``.  Of equal texts the row with the most code points in
its original text stays, then the smallest doc_id (null last).

Defined results: a null text counts as empty, and empty texts form one group; of repeated rows (same doc_id, same text)
one stays; a null doc_id gives a null keep_id if it stays (its bytes cannot be fetched by id: digest and length decide);
an empty table gives no rows.  Extra columns are ignored.  Sizes: filters are built per bucket of about ``BUCKET_KEYS``
keys; a hot group is one entry after map-side grouping.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import fuse
from repolens.llm.common import SPACES, materialise, scratch_path, small, text_of

BUCKET_KEYS = 50_000
#: A task probes about so many keys of a batch.
PROBED_KEYS = 200_000


def normalised(name: str = "text") -> Column:
    return F.translate(text_of(name), SPACES, "")


def digests(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, sha (32 bytes), n_bytes, n_points of each row, and what ``more`` adds."""
    norm = docs.select("doc_id", F.char_length(text_of()).cast("long").alias("n_points"), normalised().alias("norm"), *[c.alias(k) for k, c in more.items()])
    return norm.select("doc_id", "n_points", F.octet_length("norm").cast("long").alias("n_bytes"), F.unhex(F.sha2("norm", 256)).alias("sha"), *more)


def grouped(rows: DataFrame) -> DataFrame:
    """sha, n_bytes, best, copies: one row per distinct text; ``best`` orders by code points, then smallest doc_id
    (as its bitwise complement, which turns the order round and exists for every long)."""
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id")))
    return rows.groupBy("sha", "n_bytes").agg(best.alias("best"), F.sum("times").alias("copies"))


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of entries and its filters; ``n_buckets`` is fixed when it is written."""

    path: str
    n_buckets: int

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/entries")

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/filters")


def _keyed(entries: DataFrame, n_buckets: int) -> DataFrame:
    key = F.xxhash64("sha")
    return entries.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned(key, 20), F.lit(n_buckets)).cast("int"))


def write_snapshot(entries: DataFrame, path: str) -> Snapshot:
    """Write grouped entries and their filters; nothing in ``path`` is ever changed afterwards."""
    entries.write.parquet(f"{path}/entries")
    spark = entries.sparkSession
    kept = spark.read.parquet(f"{path}/entries")
    snapshot = Snapshot(path, 1 + kept.count() // BUCKET_KEYS)

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [fuse.build(rows["key"].to_numpy())]})

    keyed = _keyed(kept, snapshot.n_buckets).select("bucket", "key")
    keyed.groupBy("bucket").applyInPandas(make, "bucket int, filter binary").write.parquet(f"{path}/filters")
    return snapshot


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The grouped batch entries that the snapshot may hold (about 1 in 256 of the others passes too).

    The filter of a bucket (about ``BUCKET_KEYS`` bytes) goes to as many parts of the bucket's batch entries as leave about
    ``PROBED_KEYS`` in each, so a large batch against a small snapshot is spread like any other.
    """
    parts = 1 + batch.count() // (snapshot.n_buckets * PROBED_KEYS)
    filters = snapshot.filters(batch.sparkSession).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keyed = _keyed(batch, snapshot.n_buckets).withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))

    def probe(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if own.empty or rows.empty:
            return rows[["sha"]][:0]
        return rows.loc[fuse.contains(own["filter"].iloc[0], rows["key"].to_numpy()), ["sha"]]

    hits = keyed.select("bucket", "part", "key", "sha").groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInPandas(probe, "sha binary")
    return batch.join(hits, "sha", "left_semi")


def same_bytes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """sha of the pairs (batch_id, snapshot_id) whose texts are identical byte for byte.

    Only texts of the pairs' rows are gathered, at most one per digest and task.  A pair with a null id has no text to
    fetch and passes on its digest and length.
    """
    known = pairs.where("batch_id is not null and snapshot_id is not null")
    ids = materialise(known.select(F.explode(F.array("batch_id", "snapshot_id")).alias("doc_id")).distinct(), "dedup-ids")
    texts = docs.join(small(ids), "doc_id", "left_semi").select(normalised().alias("norm"))
    sets = texts.withColumn("sha", F.unhex(F.sha2("norm", 256))).groupBy("sha").agg(F.size(F.collect_set("norm")).alias("n_texts"))
    equal = known.join(sets.where("n_texts = 1"), "sha", "left_semi")
    return equal.select("sha").unionByName(pairs.where("batch_id is null or snapshot_id is null").select("sha"))


def dedup_batch(rows: DataFrame, snapshot: Snapshot, docs: DataFrame) -> DataFrame:
    """For a new batch of digest rows: its own groups, with ``known`` set where the snapshot holds the same bytes."""
    batch = materialise(grouped(rows), "dedup-batch")
    held = snapshot.entries(batch.sparkSession).select("sha", "n_bytes", F.bitwise_not("best.not_id").alias("snapshot_id"))
    pairs = screen(batch, snapshot).join(held, ["sha", "n_bytes"]).select("sha", F.bitwise_not("best.not_id").alias("batch_id"), "snapshot_id")
    same = same_bytes(materialise(pairs, "dedup-pairs"), docs).withColumn("known", F.lit(True))
    return batch.join(same, "sha", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    One half of the rows (by hash of doc_id) is taken as the snapshot and the other as the new batch, so every step of
    the incremental operator runs, and the groups of both are merged.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = digests(docs, part=part).groupBy("sha", "n_bytes", "doc_id", "n_points", "part").agg(F.count("*").alias("times"))
    rows = materialise(rows, "dedup-rows")
    snapshot = write_snapshot(grouped(rows.where("part = 0")), scratch_path(spark, "dedup-snapshot"))
    batch = materialise(dedup_batch(rows.where("part = 1"), snapshot, docs), "dedup-known")

    old = snapshot.entries(spark).withColumn("part", F.lit(0)).withColumn("own", F.lit(0))
    new = batch.withColumn("part", F.lit(1)).withColumn("own", F.when(F.col("known"), 0).otherwise(1)).drop("known")
    parts = old.unionByName(new)
    whole = parts.groupBy("sha", "own").agg(F.max("best").alias("best"), F.sum("copies").alias("copies")).where("copies > 1")
    groups = parts.select("sha", "own", "part").join(whole, ["sha", "own"]).select("sha", "part", "best", "copies")

    out = rows.join(groups, ["sha", "part"], "left")
    mine = F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"))
    first = F.col("best").isNull() | F.col("best").eqNullSafe(mine)
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.bitwise_not("best.not_id"))
    out = out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        first.alias("first"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"),
    )
    return out.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``documents``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
  row_number() OVER w = 1 AS kept,
  text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

