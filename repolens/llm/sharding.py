"""Sharding by fixed virtual slots.

Every record hashes into one of ``n_slots`` virtual slots (thousands, fixed for the life of a data set).  The bytes of
each slot are summed in one aggregation, and a *versioned map* assigns slots to shards: the largest slot goes to the
least loaded shard.  The map has ``n_slots`` rows whatever the size of the data, so it is the only thing ever broadcast;
it is stored under its version, rows are placed by the stored map, and growth stores an edited one: slots move into the
new shard only.

Rows that agree in doc_id, checksum and size would all hash to one slot; each of them is hashed together with the number
that it gets when the rows are written, so a record that makes up a third of all rows is spread like others.

Defined results: a null text has 0 bytes (size 16 with the record overhead) and the crc32 of the empty string; a null
doc_id hashes like any value; repeated rows each get a slot and a place of their own (which of them gets which depends on
how the rows were dealt over files); an empty table gives no rows and a map that spreads the empty slots.  Extra columns
are ignored, or kept by ``with_shards``, whose own ``shard`` and ``slot`` replace columns of these names.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.llm.common import materialise, scratch_path, spread_join, text_of, whole_row

N_SLOTS = 8192
OVERHEAD = 16


def numbered(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """The columns of ``docs`` with size, text_crc32 and a number ``row`` of each row; rows keep it once it is written."""
    size = (F.octet_length(text_of()) + F.lit(overhead)).cast("long")
    own = docs.select(whole_row(docs).alias("doc"), "doc_id", size.alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return own.withColumn("row", F.monotonically_increasing_id())


def slotted(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, row; written, so that ``row`` is fixed) with the virtual slot of each."""
    rows = rows.withColumn("own", F.xxhash64("doc_id", "text_crc32", "size"))
    again = materialise(rows.groupBy("own").agg(F.count("*").alias("n")).where("n > 1"), "slot-repeats")
    marked = spread_join(rows, again.withColumn("again", F.lit(True)).drop("n"), ["own"], by="row", counts=again, how="left")
    spread = F.when(F.col("again"), F.xxhash64("own", "row")).otherwise(F.col("own"))
    return marked.select("doc_id", "size", "text_crc32", "row", F.pmod(spread, F.lit(n_slots)).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """vslot, n_rows, n_bytes for every slot, empty ones too."""
    spark = rows.sparkSession
    sums = rows.groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
    return (
        spark.range(n_slots)
        .select(F.col("id").cast("int").alias("vslot"))
        .join(sums, "vslot", "left")
        .select("vslot", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
    )


def balanced_map(loads: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """version, vslot, shard, n_rows, n_bytes: slots by falling bytes, each to the shard with the fewest so far.

    The fold runs over one array of ``n_slots`` entries, a fixed number.
    """
    packed = loads.agg(F.sort_array(F.collect_list(F.struct("n_bytes", "vslot", "n_rows")), asc=False).alias("slots"))
    fold = f"""
        aggregate(slots,
          named_struct('load', array_repeat(0L, {n_shards}), 'shards', cast(array() as array<int>)),
          (s, x) -> transform(array(cast(array_position(s.load, array_min(s.load)) as int)), p -> named_struct(
            'load', transform(s.load, (l, i) -> if(i = p - 1, l + x.n_bytes + 1, l)),
            'shards', array_append(s.shards, p - 1)))[0]).shards"""
    return (
        packed.select("slots", F.expr(fold).alias("shards"))
        .select(F.inline(F.arrays_zip("slots", "shards")))
        .select(F.lit(version).alias("version"), "slots.vslot", F.col("shards").alias("shard"), "slots.n_rows", "slots.n_bytes")
    )


def add_shard(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map with shard ``n_shards`` added: every old shard gives the new one what it has above the
    new mean, slot by slot; no slot moves between old shards."""
    order = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot")
    mean = F.sum("n_bytes").over(Window.partitionBy()) / F.lit(n_shards + 1)
    spare = F.sum("n_bytes").over(Window.partitionBy("shard")) - mean
    moved = (F.sum("n_bytes").over(order) <= F.col("spare")) & (F.col("n_bytes") > 0)
    return slot_map.withColumn("spare", spare).select(
        (F.col("version") + 1).alias("version"), "vslot", F.when(moved, F.lit(n_shards)).otherwise(F.col("shard")).alias("shard"), "n_rows", "n_bytes"
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to a map store; an existing version is never overwritten."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The named or latest version of a stored map."""
    maps = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("version", "vslot", "shard", "n_rows", "n_bytes")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Give slotted rows their shard and ``slot``, the gapless position in the shard.

    Positions come from the counts of the slots before (a window over the map) plus the place within the slot, so no
    task ever holds a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("place", within)
        .join(F.broadcast(starts), "vslot")
        .withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long"))
    )


def placed(rows: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """``rows`` as ``slotted`` takes them with vslot, shard and slot, placed by a map that is stored as version 1."""
    rows = materialise(slotted(rows, n_slots), "slotted")
    store = scratch_path(rows.sparkSession, "slot-map")
    store_map(balanced_map(slot_loads(rows, n_slots), n_shards), store)
    return place(rows, load_map(rows.sparkSession, store))


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot: records spread so that the bytes of the shards are near equal."""
    rows = materialise(numbered(docs).drop("doc"), "shard-rows")
    return placed(rows, n_shards, n_slots).select("doc_id", "size", "text_crc32", "vslot", "shard", "slot")


def with_shards(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS) -> DataFrame:
    """``docs`` with its columns (but for its own shard and slot) plus shard and slot.

    The rows are written once with their numbers.  Slots and places come from narrow rows, whatever their texts; the join
    that brings them back goes by row number, of which no two rows share one, and hashes the narrow side.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("shard", "slot")])
    rows = materialise(numbered(docs), "shard-docs")
    places = placed(rows.drop("doc"), n_shards, n_slots).select("row", "shard", "slot")
    return rows.select("row", "doc").join(places.hint("shuffle_hash"), "row").select("doc.*", "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: law ``bytes``, shards 0 to 39."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
