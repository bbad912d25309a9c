"""A Merkle manifest of a data set: one tree per group of rows, one over the groups' roots, and a proof for every row.

A row's leaf is the SHA-256 of its fields.  Within a group leaves ascend by key; two neighbours become the hash of both,
a last one alone the hash of itself, level by level until one node remains.  The same tree stands over the groups' roots.

Leaves are sorted by range once and written.  Each partition counts its rows of each group, and a running sum of these
counts, one row per partition and group, is the place of every leaf in its group.  A node's coordinate is (group, level,
place >> level), so each partition builds the complete aligned subtrees of its own rows alone, up to ``BLOCK`` levels.
Only the ragged nodes at the ends of such runs and the tops of whole blocks are shuffled, by the coordinate of the block they
lie in: first within blocks of 2^BLOCK leaves, then within blocks of 2^BLOCK such blocks, and so on, so no task gets more than
2^BLOCK nodes of a block, however large the group or however the partitions fall.  The paths above come back to the leaves by
the same coordinate.

Digests go as 32 bytes between steps and as lowercase hex into the hashes.

Defined results: a null field is ``-``, so it differs from an empty one; null is a group of its own, the first, and null
keys come first in their group; rows that share a key ascend by their leaves, and repeated rows are a leaf each, of equal
leaves and of proofs that differ only in their place; a text is hashed whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.llm.common import CRC_STEPS_SQL, crc32_sql, materialise, small, spread_join

#: Levels that are built in one place.
BLOCK = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """32 bytes: the hash of the fields in order."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def group_of(value: Column) -> Column:
    """A group's name that is never null and sorts null first and other names bytewise."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def height(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def node(left: str, right: str = "") -> str:
    return sha256((left + right).encode()).hexdigest()


# -- places -------------------------------------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part`` and ``nth``, the number of the row among those of its group in this partition."""
    part, group, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        nth = []
        for g in batch["grp"].to_pylist():
            if g != group:
                group, seen = g, 0
            nth.append(seen)
            seen += 1
        parts = pa.array([part] * len(nth), pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(nth, pa.int64())], names=[*batch.schema.names, "part", "nth"])


def placed(leaves: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``leaves`` (grp, digest and others) with ``at``, the place of each in its group, and ``n``, the leaves of the group, in
    runs of consecutive places; and the greatest n."""
    keys = [F.col("grp"), *order]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    rows = materialise(ranged.mapInArrow(_numbered, f"{types}, part int, nth long"), "merkle-sorted")
    counts = rows.groupBy("grp", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("grp").orderBy("part")
    start = F.sum("rows").over(before) - F.col("rows")
    starts = materialise(counts.select("grp", "part", start.alias("start"), F.sum("rows").over(Window.partitionBy("grp")).alias("n")), "merkle-starts")
    most = starts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    # a broadcast keeps the rows as they are; else they are sorted again, which gives the same runs
    side = small(starts)
    joined = rows.join(side, ["grp", "part"]).withColumn("at", F.col("start") + F.col("nth"))
    joined = joined if side is not starts else joined.sortWithinPartitions("grp", "at")
    return joined.drop("part", "nth", "start"), most


# -- subtrees -----------------------------------------------------------------------------------------


def _subtrees(start: int, n: int, digests: list[str], block: int) -> list[tuple[int, list[str | None], str | None]]:
    """For each leaf of a run of one block that begins at ``start`` of a group of n leaves: the level of the largest complete
    subtree it lies in, its siblings up to there, and the top of that subtree if the leaf is its first."""
    levels, tops = [], []
    low, row = start, digests
    for level in range(min(block, height(n)) + 1):
        levels.append((low, row))
        high, last = low + len(row), -(-n >> level)
        if level == min(block, height(n)):
            tops += [(level, i) for i in range(low, high)]
            break
        first = low + low % 2
        if low % 2:
            tops.append((level, low))
        made = [node(row[i - low], row[i + 1 - low]) for i in range(first, high - 1, 2)]
        if high > first and high % 2:
            if high == last:
                made.append(node(row[-1]))
            else:
                tops.append((level, high - 1))
        if not made:
            break
        low, row = first // 2, made
    out: list = [None] * len(digests)
    for level, i in tops:
        begins, top = max(start, i << level), levels[level][1][i - levels[level][0]]
        for at in range(begins, min(start + len(digests), (i + 1) << level)):
            siblings = []
            for below in range(level):
                base, nodes = levels[below]
                beside = ((at >> below) ^ 1) - base
                siblings.append(nodes[beside] if beside < len(nodes) else None)
            out[at - start] = (level, siblings, top if at == begins else None)
    return out


def _binary(x: str | None) -> bytes | None:
    return None if x is None else bytes.fromhex(x)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The rows with level, siblings and top of ``_subtrees``; a run ends where the next row isn't the next of its block."""
    held: list[dict] = []

    def done() -> pa.RecordBatch:
        names = [k for k in held[0]]
        found = _subtrees(held[0]["at"], held[0]["n"], [r["digest"].hex() for r in held], block)
        columns = [pa.array([r[k] for r in held], schema.field(k).type) for k in names]
        more = [
            pa.array([x[0] for x in found], pa.int32()),
            pa.array([[_binary(s) for s in x[1]] for x in found], pa.list_(pa.binary())),
            pa.array([_binary(x[2]) for x in found], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([*columns, *more], names=[*names, "level", "siblings", "top"])

    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if held:
                last = held[-1]
                if row["grp"] != last["grp"] or row["at"] != last["at"] + 1 or row["at"] >> block != last["at"] >> block:
                    yield done()
                    held = []
            held.append(row)
    if held:
        yield done()


def _merged(top_level: int):  # noqa: ANN202
    """Merge the nodes of one block up to ``top_level`` or the group's root: each with its siblings up to there and the top."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        goal = min(top_level, height(n))
        levels: list[dict[int, str]] = [{} for _ in range(goal + 1)]
        for level, i, digest in zip(rows["level"], rows["idx"], rows["digest"], strict=True):
            levels[level][i] = digest.hex()
        for level in range(goal):
            last = -(-n >> level) - 1
            for i, digest in list(levels[level].items()):
                if i % 2 == 0 and i + 1 in levels[level]:
                    levels[level + 1][i // 2] = node(digest, levels[level][i + 1])
                elif i == last and i % 2 == 0:
                    levels[level + 1][i // 2] = node(digest)
        siblings = [
            [_binary(levels[at].get((int(i) >> (at - level)) ^ 1)) for at in range(level, goal)] for level, i in zip(rows["level"], rows["idx"], strict=True)
        ]
        ((above, top),) = levels[goal].items()
        return rows[["grp", "level", "idx"]].assign(siblings=siblings, n=n, top_level=goal, top_idx=above, top=bytes.fromhex(top))

    return merge


def _paths(nodes: DataFrame, most: int, block: int) -> DataFrame:
    """grp, level, idx, up, root: of each node (grp, n, level, idx, digest), the siblings from it to its group's root."""
    schema = "grp string, level int, idx long, siblings array<binary>, n long, top_level int, top_idx long, top binary"
    paths = None
    for goal in range(block, max(block, height(most)) + block, block):
        within = F.expr(f"shiftright(idx, greatest({goal} - level, 0))")
        step = materialise(nodes.withColumn("block", within).groupBy("grp", "block").applyInPandas(_merged(goal), schema), "merkle-nodes")
        if paths is None:
            paths = step.withColumnRenamed("siblings", "up")
        else:
            above = step.select("grp", F.col("level").alias("top_level"), F.col("idx").alias("top_idx"), "siblings", *[F.col(c).alias(f"next_{c}") for c in ("top_level", "top_idx", "top")])
            paths = paths.join(small(above), ["grp", "top_level", "top_idx"]).select(
                "grp", "level", "idx", F.concat("up", "siblings").alias("up"), "n", *[F.col(f"next_{c}").alias(c) for c in ("top_level", "top_idx", "top")]
            )
        nodes = step.select("grp", "n", F.col("top_level").alias("level"), F.col("top_idx").alias("idx"), F.col("top").alias("digest")).distinct()
    return paths.select("grp", "level", "idx", "up", F.col("top").alias("root"))


def trees(leaves: DataFrame, order: list[Column], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (grp, digest and others; ``order`` is their order in a group) with ``at``, ``siblings`` from the leaf upwards
    (null where a node stands alone) as far as the leaf's subtree was built, and the coordinate (``level``, ``idx``) of its top
    -- and the paths of these tops: grp, level, idx, up, root."""
    numbered, most = placed(leaves, order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    rows = materialise(numbered.mapInArrow(lambda it: _blocks(it, block), f"{types}, level int, siblings array<binary>, top binary"), "merkle-leaves")
    rows = rows.withColumn("idx", F.expr("shiftright(at, level)"))
    tops = rows.where("top is not null").select("grp", "n", "level", "idx", F.col("top").alias("digest"))
    return rows.drop("top", "n"), _paths(tops, most, block)


def manifest(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (grp, key, digest and others) with all that proves each: ``at`` and ``siblings`` up to ``subroot``, then
    ``group_at`` and ``group_siblings`` up to ``root``; digests as 32 bytes, null for a missing sibling."""
    rows = materialise(rows.withColumn("copy", F.monotonically_increasing_id()), "merkle-rows")
    leaves, paths = trees(rows, [F.col("key").asc_nulls_first(), F.col("digest"), F.col("copy")], block)
    roots = paths.select("grp", "root").distinct()
    groups, above = trees(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")), [F.col("name")], block)
    groups = groups.join(small(above), ["grp", "level", "idx"]).select(
        F.col("name").alias("grp"), F.col("at").alias("group_at"), F.concat("siblings", "up").alias("group_siblings"), F.col("root").alias("all")
    )
    paths = spread_join(paths, groups, ["grp"], by="idx").withColumnRenamed("root", "subroot").withColumnRenamed("all", "root")
    joined = leaves.join(small(paths), ["grp", "level", "idx"])
    return joined.withColumn("siblings", F.concat("siblings", "up")).drop("up", "level", "idx", "copy")


def fold(leaf: str, at: int, siblings: list[str | None]) -> str:
    """The root that a leaf at this place and its siblings give."""
    for level, other in enumerate(siblings):
        leaf = node(leaf) if other is None else node(other, leaf) if at >> level & 1 else node(leaf, other)
    return leaf


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own, groups = ([None if s is None else s.hex() for s in r[k]] for k in ("siblings", "group_siblings"))
            proof = sha256("".join(s for s in own + groups if s is not None).encode()).hexdigest()
            top = fold(fold(r["claimed"].hex(), r["at"], own), r["group_at"], groups)
            out.append((r["digest"].hex(), r["subroot"].hex(), r["root"].hex(), proof, top, top == r["root"].hex()))
        columns = [pa.array(x) for x in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 5 + [pa.array([], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch["key"], *columns], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verify(proved: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the rows of a manifest: the root that ``claimed``, the
    leaf of what is to be checked, gives with the proof of the row."""
    kind = proved.schema["key"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = ("key", "digest", "claimed", "at", "siblings", "group_at", "group_siblings", "subroot", "root")
    return proved.select(*names).mapInArrow(_folded, schema)


def leaves(docs: DataFrame) -> DataFrame:
    """grp, key, digest, and ``claimed``: the leaf after adding 1 to n_chars where 7 divides the crc32 of the decimal doc_id, else
    the leaf itself (a null doc_id or n_chars is left as it is)."""
    columns = {c: F.col(c) for c in FIELDS}
    own = leaf_of(*columns.values())
    changed = leaf_of(*(columns | {"n_chars": F.col("n_chars") + 1}).values())
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select(group_of(F.col("lang")).alias("grp"), F.col("doc_id").alias("key"), own.alias("digest"), F.when(hit, changed).alias("claimed"))
    return rows.withColumn("claimed", F.coalesce("claimed", "digest"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``documents``."""
    return verify(manifest(leaves(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


def _tree_sql(name: str, base: str) -> str:
    """All nodes (grp, level, idx, h) above ``base``: a level has half the nodes of the last, while there are several."""
    return f"""{name} AS (
  {base}
  UNION ALL
  SELECT grp, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS m FROM {name}) WHERE m > 1 GROUP BY grp, level, idx // 2)"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_STEPS_SQL},
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS claimed
  FROM documents, crc_steps),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
{_tree_sql("nodes", "SELECT grp, 0 AS level, place AS idx, leaf AS h FROM placed")},
tops AS (SELECT grp, max(level) AS levels, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM nodes GROUP BY grp),
{_tree_sql("above", "SELECT '' AS grp, 0 AS level, place AS idx, subroot AS h FROM tops")},
top AS (SELECT max(level) AS levels, arg_max(h, level) AS root FROM above),
steps AS (
  SELECT p.grp, p.place, s.k AS step, (p.place >> s.k) % 2 = 1 AS is_right, n.h
  FROM placed p JOIN tops t USING (grp), range(64) AS s(k)
  LEFT JOIN nodes n ON n.grp = p.grp AND n.level = s.k AND n.idx = xor(p.place >> s.k, 1)
  WHERE s.k < t.levels
  UNION ALL
  SELECT p.grp, p.place, t.levels + s.k, (t.place >> s.k) % 2 = 1, a.h
  FROM placed p JOIN tops t USING (grp), top, range(64) AS s(k)
  LEFT JOIN above a ON a.level = s.k AND a.idx = xor(t.place >> s.k, 1)
  WHERE s.k < top.levels),
folded AS (
  SELECT grp, place, 0 AS step, claimed AS h FROM placed
  UNION ALL
  SELECT f.grp, f.place, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.is_right THEN s.h || f.h ELSE f.h || s.h END)
  FROM folded f JOIN steps s ON s.grp = f.grp AND s.place = f.place AND s.step = f.step),
ends AS (SELECT grp, place, arg_max(h, step) AS folded_root FROM folded GROUP BY grp, place),
proofs AS (SELECT grp, place, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM placed LEFT JOIN (SELECT grp, place, step, h FROM steps) USING (grp, place) GROUP BY grp, place)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN (SELECT grp, subroot FROM tops) USING (grp) JOIN proofs USING (grp, place) JOIN ends USING (grp, place), top
"""
