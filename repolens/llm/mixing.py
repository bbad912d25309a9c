"""Mixing sources to target weights by a low-discrepancy schedule.

A mix is a sequence of slots of ``block`` tokens each.  Slot *i* gets the golden-ratio point frac(i * 0.618...), which
the cumulative target shares map to a source; the slot's rank among the slots of its source names the block it takes.
The documents of a source are laid end to end in a hashed order and repeated at most ``max_epochs`` times; block *r*
covers the tokens [r * block, (r + 1) * block) of that tape.  Documents and slots meet in a join on (source, rank).

A source whose target is under ``SLOTS_PER_SOURCE`` blocks is *short*: the golden-ratio points could miss it, or be off by
a large part of it.  It leaves the unit interval and gets as many blocks as its target needs, spread evenly over the
sequence (each beside the block that the slot has anyway), of which the last ends at the target in whole words, at least one.

A source that is not short has a share of 1/64 or more, so there are at most 64 of them, and at most ``SLOTS`` slots to be
mapped, whatever the number of sources; weights and targets of many sources come from sums over ranges of them (``running``).

Positions on the tape come from two levels of prefix sums (hash buckets of a source, then rows of a bucket).  There are as
many buckets as the square root of the number of rows, so neither level puts more than about that many rows of a source in
one task, and a source that holds a third of all rows is spread over many.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, the last in the order of
weights; repeated rows are separate documents; an empty table gives no rows.  Extra columns are ignored.  The order is a
hash of doc_id and size, so reruns agree.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.llm.common import materialise, small, text_of, whole_row

GOLDEN = 0.6180339887498949
SLOTS = 65_536
SLOTS_PER_SOURCE = 1_024


def n_words(name: str = "text") -> Column:
    """The number of runs of characters other than white space."""
    return F.regexp_count(text_of(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_hash() -> Column:
    """60 bits of the MD5 of doc_id and size: the order of a source's documents, the same in any engine."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def running(df: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """``df`` with ``nth`` (from 0) and, for each column of ``sums``, ``before_`` its sum over all rows before, in one order
    of all rows.

    The sort deals ranges of rows to tasks; what lies before a range comes from a row per range, and the rest from within
    it, so no task sees more than its range however many rows there are.
    """
    rows = materialise(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "mix-ordered")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    ranges = rows.groupBy("range").agg(F.count("*").alias("nth"), *[F.sum(c).alias(c) for c in sums])
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"base_{c}") for c in ("nth", *sums)])
    inside = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.col("base_nth") + F.row_number().over(Window.partitionBy("range").orderBy("at")) - 1
    before = [(F.col(f"base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in sums]
    # one row for each task of the sort
    return rows.join(F.broadcast(base), "range").select(*df.columns, nth.alias("nth"), *before)


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """skey, source_size, target: all sizes shared by weight, no source above ``max_epochs`` times its size.

    The sources with the least cap per weight fill first; the share of the others is what is left over the weight that
    is left.
    """
    per = running(rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs).drop("nth", "source")
    per = running(per, [F.col("cap") / F.col("weight"), F.col("skey")], "cap", "weight")
    # sums of whole numbers, which doubles hold
    total, heavy = per.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    level = (F.lit(total or 0.0) - F.col("before_cap")) / (F.lit(heavy or 1.0) - F.col("before_weight"))
    per = per.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    open_level = per.where(~F.col("full")).agg(F.min_by("level", "nth")).first()[0]
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.lit(open_level).cast("double") * F.col("weight"))
    return per.select("skey", "source_size", share.alias("target"))


def schedule(target: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """slot, skey, rank: golden-ratio points mapped through the cumulative shares.

    The unit interval is cut into cells; a slot joins the sources of its cell, so no long source list is broadcast and
    no slot is compared with all sources.
    """
    spark = target.sparkSession
    cells = 4 * n_sources + 1
    order = Window.orderBy("skey")
    total = F.sum("target").over(Window.partitionBy())
    spans = target.where("target > 0").select(
        "skey",
        (F.coalesce(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / total).alias("low"),
        (F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("high"),
        F.row_number().over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"),
        F.count("*").over(Window.partitionBy()).alias("last"),
    )
    spans = spans.withColumn("high", F.when(F.col("nth") == F.col("last"), F.lit(2.0)).otherwise(F.col("high")))
    cell_of = lambda x: F.floor(F.least(x, F.lit(1.0)) * cells)
    spans = spans.select("skey", "low", "high", F.explode(F.sequence(cell_of(F.col("low")), cell_of(F.col("high")))).alias("cell"))
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))).alias("u")
    )
    hit = points.withColumn("cell", F.floor(F.col("u") * cells)).join(small(spans), "cell").where("low <= u and u < high")
    return hit.select("slot", "skey", (F.row_number().over(Window.partitionBy("skey").orderBy("slot")) - 1).cast("long").alias("rank"))


def planned(rows: DataFrame, total: int, block: int, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """``goal`` (skey, source_size, target, n_blocks, covered: the words of its tape that a source gives) and ``slots``
    (slot, skey, rank)."""
    short = (F.col("target") > 0) & (F.col("target") < SLOTS_PER_SOURCE * block)
    exact = F.least(F.greatest(F.round("target").cast("long"), F.lit(1)), F.col("source_size") * max_epochs)
    goal = materialise(targets(rows, weights, max_epochs).withColumn("exact", F.when(short, exact)), "mix-targets")
    few = goal.agg(F.coalesce(F.sum("exact"), F.lit(0))).first()[0]
    n_slots = -(-total // block)
    # sources that are not short have a share of SLOTS_PER_SOURCE / SLOTS at least, so there are few of them
    dealt = schedule(goal.where("exact is null"), max(0, -(-(total - few) // block)), SLOTS // SLOTS_PER_SOURCE)
    need = F.expr(f"(exact + {block - 1}) div {block}")
    even = goal.where("exact is not null").select("skey", need.alias("need")).select("skey", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)).alias("rank"))
    even = even.select(F.expr(f"((2 * rank + 1) * {n_slots}) div (2 * need)").alias("slot"), "skey", "rank")
    slots = materialise(dealt.unionByName(even), "mix-slots")
    goal = goal.join(slots.groupBy("skey").agg(F.count("*").alias("n_blocks")), "skey", "left")
    goal = goal.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    covered = F.coalesce("exact", F.least(F.col("n_blocks") * block, F.col("source_size") * max_epochs))
    goal = goal.select("skey", "source_size", "target", "n_blocks", covered.alias("covered"))
    return small(materialise(goal, "mix-goal")), slots


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and skey, a key of the source that is never null."""
    skey = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    return docs.select("doc_id", "source", n_words().alias("size"), skey.alias("skey"))


def mix_blocks(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """The mix over materialised ``sized`` rows.

    Returns ``tape`` (skey, doc_id, size, source_size, target, start: the place of each document in its source) and
    ``pieces`` (skey, start, doc_id, size, slot, rank, epoch, from_word, words: what each slot takes of which document).
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, total // SLOTS)
    goal, slots = planned(rows, total, block, weights, max_epochs)

    hashed = rows.withColumn("h", order_hash()).withColumn("bucket", F.pmod("h", F.lit(1 + math.isqrt(n))))
    sums = hashed.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size")).join(goal, "skey")
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    line = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    tape = (
        hashed.withColumn("upto", F.sum("size").over(line))
        .join(sums, ["skey", "bucket"])
        .select("skey", "doc_id", "size", "source_size", "target", "n_blocks", "covered", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
    )
    tape = materialise(tape, "mix-tape")

    epochs = tape.where("size > 0 and n_blocks > 0").select(
        "skey", "start", "doc_id", "size", F.col("covered").alias("limit"), F.col("source_size"), F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")
    )
    epochs = epochs.withColumn("low", F.col("epoch") * F.col("source_size") + F.col("start"))
    epochs = epochs.withColumn("high", F.least(F.col("low") + F.col("size"), "limit")).where("low < high")
    first, last = F.expr(f"low div {block}"), F.expr(f"(high - 1) div {block}")
    cut = epochs.withColumn("rank", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("low"), F.col("rank") * block)
    end = F.least(F.col("high"), (F.col("rank") + 1) * block)
    pieces = cut.join(slots, ["skey", "rank"]).select(
        "skey", "start", "doc_id", "size", "slot", "rank", "epoch", (begin - F.col("low")).alias("from_word"), (end - begin).alias("words")
    )
    return tape, pieces


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source key, doc_id, size, source_size, target, taken: the words the mix takes of each document, repeats counted; start:
    the words of its source that lie before it on the tape."""
    rows = materialise(sized(docs), "mix-rows")
    tape, pieces = mix_blocks(rows, weights, max_epochs)
    key = ["skey", "start", "doc_id", "size"]
    some = tape.where("size > 0").select(*key, "source_size", "target", F.lit(0).cast("long").alias("words"))
    # a document with words has a place of its own on the tape, so these keys are unique
    taken = (
        some.unionByName(pieces.select(*key, "words"), allowMissingColumns=True)
        .groupBy(*key)
        .agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken"))
    )
    out = ["skey", "doc_id", "size", "source_size", "target", "taken", "start"]
    return taken.select(*out).unionByName(tape.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``docs`` as the mix repeats them: each row as many times as the mix takes it, to the nearest whole copy.

    A source gives its tape from the start on, epoch by epoch, so of its documents only the last is taken in part, and the words
    of a source come within one document of its target.  The first document of a tape of which anything is taken is dealt at
    least once, so no source that has a target is lost.  Documents without words are in no block and leave.  Rows alike in doc_id,
    source and size share their copies.
    """
    per = mix(docs, weights, max_epochs).where("size > 0").groupBy("skey", "doc_id", "size")
    nearest = F.round(F.sum("taken") / F.sum("size")).cast("int")
    first = ((F.min("start") == 0) & (F.sum("taken") > 0)).cast("int")
    per = per.agg(F.greatest(nearest, first).alias("times")).where("times > 0")
    plan = per.select(F.struct("skey", "doc_id", "size").alias("mix_key"), F.col("times").alias("mix_times"))
    skey = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    left = docs.select(whole_row(docs).alias("doc"), F.struct(skey.alias("skey"), F.col("doc_id"), n_words().alias("size")).alias("mix_key"))
    joined = left.join(plan, left["mix_key"].eqNullSafe(plan["mix_key"]))
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("doc.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents``, weights 1, 2, 3 repeating, at most three epochs."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: The same schedule; what a document takes is its overlap with the words that its source's slots cover, epoch by epoch.
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('+' || source, '-') AS skey, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM d GROUP BY skey, source
), tot AS (SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS total, count(DISTINCT skey) AS n_sources FROM d),
num AS (SELECT *, greatest(1, total // greatest({SLOTS}, {SLOTS_PER_SOURCE} * n_sources)) AS block, 1 + CAST(floor(sqrt(n)) AS BIGINT) AS buckets FROM tot),
lev AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM per WINDOW before AS (ORDER BY source_size * 3.0::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT skey, source_size, CASE WHEN cap <= level * weight THEN cap ELSE weight * (SELECT arg_min(level, (cap / weight, skey)) FROM lev WHERE cap > level * weight) END AS target FROM lev
), spans AS (
  SELECT skey, (sum(target) OVER (ORDER BY skey) - target) / sum(target) OVER () AS low, CASE WHEN row_number() OVER (ORDER BY skey DESC) = 1 THEN 2 ELSE sum(target) OVER (ORDER BY skey) / sum(target) OVER () END AS high
  FROM goal WHERE target > 0
), points AS (SELECT i * {GOLDEN}::DOUBLE - floor(i * {GOLDEN}::DOUBLE) AS u FROM (SELECT unnest(range(CAST(ceil(total / block) AS BIGINT))) AS i FROM num)),
slots AS (SELECT skey, count(*) AS n_blocks FROM points JOIN spans ON low <= u AND u < high GROUP BY skey),
tape AS (
  SELECT d.*, g.source_size, g.target, least(coalesce(n_blocks, 0) * block, 3 * g.source_size) AS covered,
    sum(size) OVER (PARTITION BY d.skey ORDER BY h % buckets, h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 15) AS BIGINT) AS h FROM d) d
    JOIN goal g USING (skey) LEFT JOIN slots USING (skey), num
)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(e * source_size + start + size, covered) - (e * source_size + start))) AS BIGINT) AS taken
FROM tape, (VALUES (0), (1), (2)) t(e) GROUP BY doc_id, size, source_size, target, skey, start
"""
