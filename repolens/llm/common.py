"""Helpers that several operators share: durable intermediates and null-safe text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.operators.traverse import durable, shared_folder

#: The white space of every contract here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast only if its counted rows and the counted bytes of their strings stay under these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: A key is hot if it has more than one in so many of the rows.
HOT_SHARE = 4_096


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Write to the shared folder and read back: the lineage is cut and a lost executor loses nothing.
materialise = durable


def text_of(name: str = "text") -> Column:
    """The column, with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns, whatever their names, as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def is_small(df: DataFrame) -> bool:
    """Whether rows and bytes of ``df``, which are counted, are few enough to broadcast."""
    sizes = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(c))
        elif kind not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp"):
            sizes.append(F.octet_length(F.to_json(F.struct(c))))
    total = sum((F.coalesce(F.sum(s), F.lit(0)) for s in sizes), F.lit(0))
    n, n_bytes = df.agg(F.count("*"), total).first()
    return n <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else ``df``, for a shuffled join."""
    return F.broadcast(df) if is_small(df) else df


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, so that no key of ``left`` is too much for one task.

    A small ``right`` is broadcast.  Else keys with more than one in ``HOT_SHARE`` rows, of which
    there are fewer than ``HOT_SHARE``, are salted: the list of them is broadcast, their rows on the left are dealt by the
    hash of ``by``, and their row on the right is copied for each salt, which makes fewer than 2 x ``HOT_SHARE`` copies
    whatever the data.  ``counts`` (the keys and n) says how many rows of ``left`` have a key, if that is known.
    """
    if is_small(right):
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, by, counts, how)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], by: str, counts: DataFrame | None = None, how: str = "inner", total: int | None = None
) -> DataFrame:
    """As ``spread_join``, without the broadcast: for a ``right`` whose rows are wide.  With ``total``, the rows of ``left``,
    ``counts`` is aggregated within the join instead of before it."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    known = total is not None
    total = total if known else counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    salts = F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, total))).cast("int").alias("salts")
    hot = counts.where(F.col("n") * HOT_SHARE > total).where("n > 1").select(*keys, salts)
    hot = hot if known else materialise(hot, "hot-keys")
    n = F.coalesce("salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), n).cast("int")).drop("salts")
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
    return dealt.join(copied, [*keys, "salt"], how).drop("salt")


@contextmanager
def arrow_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Within it, what runs hands Python at most so many bytes of rows at once, so wide rows take no more memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: A common table of SQL, ``crc_steps``, that ``crc32_sql`` reads: the step of each byte of the CRC-32 in use everywhere.
CRC_STEPS_SQL = """crc_steps AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) AS t(i)))"""


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text expression in UTF-8, where ``crc_steps`` is joined."""
    h = f"hex(encode({text}))"
    by_byte = f"list_transform(range(1, length({h}), 2), lambda i: CAST('0x' || substr({h}, i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {by_byte}), lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1])), 4294967295)"
