"""Near-duplicate detection by a signature-coordinate inverted join.

Each document's set of word shingles gets a MinHash signature of ``COORDINATES`` values.  A document is posted under each
(coordinate, value) pair; two documents are candidates if they collide in at least ``MATCHES`` coordinates, and linked if
their full sets have a Jaccard similarity of ``threshold`` or more.  Collisions are counted with prefix and skip merging:
coordinates are ordered by how common their value is, and two signatures that share ``MATCHES`` of ``COORDINATES`` values
must share one among the ``COORDINATES - MATCHES + 1`` rarest of each.  Only these lists are merged; the longer lists are
skipped, and their collisions are counted by comparing the two signatures.  So passages that very many documents share
produce no long lists unless the documents are alike.

At similarity 0.8 a pair falls short of 13 of 32 matches with probability 2e-7.

Documents with the same set are one class, a node, before anything is posted.  What is wanted is components, so pairs
within a list are not enumerated: each member is compared with the most central member of its lists, components are
contracted, and lists whose members are already one component drop out.  Short lists and one member of each component of
the longer ones follow in the same way.

Members of longer lists that are then still in different components are filtered once more, by their full sets: two sets
that are similar enough share a shingle among the rarest few of each (a fifth of a set at similarity 0.8), so the members
are posted under these.  Documents that have only a common passage or a template in common share none of these, whatever
the length of the lists that hold them together.  What still shares one is compared: within lists of at most
``RARE_LIST`` members as pairs, and beyond that in blocks of bounded size.  This makes the result the same as that of
comparing all candidates.

A value, a pivot or a class that very many rows have is dealt to many tasks (``spread_join``).

Defined results: a null or empty text has an empty set, no links and itself as component; a text of fewer words than a
shingle is one shingle of all its words; repeated rows each get a row; rows that share a doc_id but not their text go each
by its own text; a row with a null doc_id links like any other, but its component is null and it counts as kept; an empty
table gives no rows.  Extra columns are ignored.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm.common import BROADCAST_ROWS, arrow_batches, is_small, materialise, salted_join, small, spread_join
from repolens.llm.components import connected_components
from repolens.llm.textbytes import shingle_sets

COORDINATES, MATCHES = 32, 13
#: Lists of up to so many members are compared in full before the rounds of longer ones.
SHORT = 16
#: Lists of so many members under a rare shingle are compared as pairs.
RARE_LIST = 64
#: A block of a cluster has about so many rows and bytes of sets at most.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20

_rng = np.random.default_rng(5)
_FACTOR = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """32-bit minima of ``COORDINATES`` hash functions over a set."""
    least = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 8192):
        part = (shingles[i : i + 8192, None] * _FACTOR + _SHIFT) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0))
    return least.astype(np.uint32)


def _class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, classes, signs = [], [], []
        for s in shingle_sets(batch["text"], k):
            sizes.append(len(s))
            classes.append(_class_of(s) if len(s) else None)
            signs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["pick"], pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signs, pa.binary())],
            names=["doc_id", "pick", "n_shingles", "class", "sign"],
        )


def picked(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, pick (a hash of doc_id and text, which tells rows of one doc_id apart) and ``more``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("pick"), *more)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, pick, n_shingles, class (a 16-byte digest of the set), sign (the signature's bytes)."""
    return picked(docs, F.col("text")).mapInArrow(lambda it: _signed(it, k), "doc_id long, pick long, n_shingles long, class binary, sign binary")


def posted(reps: DataFrame) -> DataFrame:
    """list, node, n, weight: the postings of each node under the rarest coordinates that another one shares.

    ``weight`` adds up how many others share each of its coordinates: the most central of a group of variants has most.
    """
    word = lambda i: F.conv(F.hex(F.reverse(F.substring("sign", 4 * i + 1, 4))), 16, 10).cast("long")
    tokens = reps.select("node", F.col("n_shingles").alias("n"), F.posexplode(F.array(*[word(i) for i in range(COORDINATES)])).alias("at", "value"))
    tokens = tokens.select("node", "n", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")).alias("list"))
    shared = tokens.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    return _rarest(tokens, materialise(shared, "near-shared"), F.lit(MATCHES))


def _rarest(tokens: DataFrame, shared: DataFrame, needed: Column) -> DataFrame:
    """list, node, n, weight of the rarest ``shared`` lists (list, length) of each node, so many that two nodes which have
    ``needed`` of them in common share one.

    What a node has beside them comes first in the order and needs no posting; a node with fewer than ``needed`` has none.
    """
    met = spread_join(tokens, shared, ["list"], by="node", counts=shared.withColumnRenamed("length", "n"))
    own = met.groupBy("node", "n").agg(F.collect_list(F.struct("length", "list")).alias("lists"), F.sum("length").alias("weight"))
    own = own.withColumn("needed", needed).where(F.size("lists") >= F.col("needed"))
    prefix = F.slice(F.sort_array("lists"), F.lit(1), F.size("lists") - F.col("needed") + 1)
    own = own.select("node", "n", "weight", F.explode(prefix).alias("p"))
    posts = materialise(own.select(F.col("p.list").alias("list"), "node", "n", "weight"), "near-posted")
    lists = materialise(posts.groupBy("list").agg(F.count("*").alias("c")).where("c > 1"), "near-kept")
    kept = spread_join(posts, lists, ["list"], by="node", counts=lists.withColumnRenamed("c", "n"))
    return materialise(kept.drop("c"), "near-posts")


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # repeated rows of a task need only one set
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.slice(i, 512)
            fresh = []
            for p in part["pick"].to_pylist():
                fresh.append(p not in seen)
                seen.add(p)
            made = list(shingle_sets(part["text"].filter(pa.array(fresh)), k))
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())], names=["class", "shingles"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, own in zip(batch["node"].to_pylist(), batch["shingles"], strict=True):
            shingles = np.frombuffer(own.as_buffer(), np.int64)
            for i in range(0, len(shingles), 65_536):
                part = shingles[i : i + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(np.full(len(part), len(shingles))), pa.array(part)], names=["node", "n", "list"])


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        last, x = None, None
        for i, (p, a, b) in enumerate(zip(batch["a"].to_numpy(), batch["sa"], batch["sb"], strict=True)):
            if p != last:
                last, x = p, np.frombuffer(a.as_buffer(), np.uint64)
            y = np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])


class _Links:
    """Candidates' signatures and sets, and the check of pairs against them."""

    def __init__(self, docs: DataFrame, reps: DataFrame, ids: DataFrame, k: int, percent: int) -> None:
        few = materialise(reps.join(small(ids), "node", "left_semi").select("node", "class", "pick", "sign"), "near-signs")
        self.signs = few.select("node", "sign")
        texts = picked(docs, F.col("text")).join(small(few.select("pick")), "pick", "left_semi").select("pick", "text")
        sets = texts.mapInArrow(lambda it: _sets(it, k), "class binary, shingles binary")
        # one set a node, also where a row is repeated, and none of a text that only has the same hash
        self.sets = materialise(sets.dropDuplicates(["class"]).join(small(few.select("class", "node")), "class").select("node", "shingles"), "near-sets")
        self.percent = percent

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with enough collisions whose full sets are similar enough."""
        word = lambda c, i: F.substring(c, 4 * i + 1, 4)
        same = sum((word("ga", i) == word("gb", i)).cast("int") for i in range(COORDINATES))
        # however few keys they have, so few pairs with signatures of one size are no load for a task
        signed = _beside(pairs, self.signs, "sign", ("ga", "gb"), salt=pairs.count() > BROADCAST_ROWS)
        likely = materialise(signed.where(same >= MATCHES).select("a", "b"), "near-likely")
        percent = self.percent
        full = _beside(likely, self.sets, "shingles", ("sa", "sb")).select("a", "b", "sa", "sb")
        # a pair comes up once, so a link does
        return full.mapInArrow(lambda it: _alike(it, percent), "a long, b long")


def _beside(pairs: DataFrame, table: DataFrame, column: str, names: tuple[str, str], salt: bool = True) -> DataFrame:
    """``pairs`` (a, b; written) with the ``column`` of each one's row of ``table`` (node), under ``names``."""
    out = pairs
    for c, by, name in (("b", "a", names[1]), ("a", "b", names[0])):
        side = table.select(F.col("node").alias(c), F.col(column).alias(name))
        if salt:  # each node has its row, so the pairs themselves tell how many rows a key has
            out = salted_join(out, side, [c], by, pairs.groupBy(c).agg(F.count("*").alias("n")), total=pairs.count())
        else:
            out = out.join(side, c)
    return out


def _merged(member: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, comp after joining the components of linked documents."""
    of = lambda c, x: member.select(F.col("node").alias(c), F.col("comp").alias(x))
    edges = links.join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    moved = connected_components(edges).select(F.col("node").alias("comp"), "label")
    return materialise(member.join(moved, "comp", "left").select("node", F.coalesce("label", "comp").alias("comp")), "near-comp")


def _close(n: str, other: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, other) * 100 >= F.greatest(n, other) * percent


def _first_pivots(placed: DataFrame, percent: int) -> DataFrame:
    """Each member with the most central of the pivots of its lists: as many pairs as members at most."""
    met = placed.where((F.col("comp") != F.col("pivot_comp")) & _close("n", "pivot_n", percent))
    return met.groupBy(F.col("node").alias("x")).agg(F.max(F.struct("pivot_weight", "pivot")).alias("p")).select("x", F.col("p.pivot").alias("y"))


def _short_lists(placed: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """All pairs across components in lists of at most ``most`` (``SHORT``) members, which hold a document's closest kin."""
    short = placed.where(F.col("length") <= (most or SHORT)).select("list", "node", "n", "comp")
    other = short.select(F.col("list").alias("l2"), F.col("node").alias("y"), F.col("n").alias("n2"), F.col("comp").alias("c2"))
    met = (F.col("list") == F.col("l2")) & (F.col("comp") < F.col("c2")) & _close("n", "n2", percent)
    return short.join(other, met).select(F.col("node").alias("x"), "y")


def _leaders(placed: DataFrame, percent: int) -> DataFrame:
    """In each longer list the pivot with the most central member of each other component."""
    other = placed.where((F.col("length") > SHORT) & (F.col("comp") != F.col("pivot_comp"))).groupBy("list", "comp", "pivot", "pivot_n").agg(F.max(F.struct("weight", "node", "n")).alias("l"))
    return other.select(F.col("l.node").alias("x"), F.col("pivot").alias("y"), F.col("l.n").alias("n"), "pivot_n").where(_close("n", "pivot_n", percent)).select("x", "y")


def _rest(placed: DataFrame, member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components that long lists of rare shingles still hold together.

    Documents that such lists connect form a cluster, which is dealt into blocks of bounded size; each pair of blocks is
    one task that counts common shingles through an inverted index and returns links, never the pairs it looked at.
    """
    edges = placed.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    cluster = connected_components(edges.distinct()).select("node", F.col("label").alias("cluster"))
    rows = cluster.join(member, "node").join(sets, "node")
    rows = materialise(rows, "near-clusters")
    size = rows.groupBy("cluster").agg(
        (F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.octet_length("shingles")) / BLOCK_BYTES).cast("int") + 1).alias("blocks")
    )
    # one row a cluster: a large cluster's rows stay spread until they are dealt by pairs of blocks
    rows = rows.join(small(materialise(size, "near-sizes")), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    each = each.select("cluster", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "comp", "shingles")

    def compare(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(block, key[1], key[2], percent), columns=["a", "b"])

    return each.groupBy("cluster", "b1", "b2").applyInPandas(compare, "a long, b long")


def _block_links(rows: pd.DataFrame, first: int, second: int, percent: int) -> list[tuple[int, int]]:
    """Links between the rows of two blocks (or within one) that join different components, at most one less than there
    are components."""
    left, right = rows[rows["block"] == first], rows[rows["block"] == second]
    b_sets = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
    b_size = np.array([len(x) for x in b_sets])
    values = np.concatenate(b_sets) if b_sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(b_sets)), b_size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    b_ids, b_comp = right["node"].to_numpy(), right["comp"].to_numpy()
    root = {c: c for c in rows["comp"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for a, comp, own in zip(left["node"], left["comp"], left["shingles"], strict=True):
        mine = np.frombuffer(own, np.uint64)
        low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        times = high - low
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        both = np.bincount(owner[at], minlength=len(b_sets))
        for k in np.flatnonzero((100 * both >= percent * (len(mine) + b_size - both)) & (b_comp != comp)):
            x, y = find(comp), find(b_comp[k])
            if x != y:
                root[x] = y
                out.append((int(a), int(b_ids[k])))
    return out


def _open_lists(posts: DataFrame, member: DataFrame) -> DataFrame:
    """list, node, n, weight, comp, length and the pivot (pivot, pivot_comp, pivot_n, pivot_weight), the most central
    member, of the lists whose members are in more than one component.

    A long list is aggregated where its postings lie; the result, a row per open list, goes to the postings.  Components only
    grow, so ``posts`` may be an earlier result: a list that was not open then is not open now.
    """
    posts = posts.select("list", "node", "n", "weight")
    if is_small(member):  # a lookup, cheaper twice than a table of its own
        placed = posts.join(F.broadcast(member), "node")
    else:
        placed = materialise(posts.join(member, "node"), "near-placed")
    pivot = F.max(F.struct("weight", "comp", "node", "n")).alias("p")
    lists = placed.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("length"), pivot)
    own = [F.col(f"p.{c}").alias(k) for c, k in (("node", "pivot"), ("comp", "pivot_comp"), ("n", "pivot_n"), ("weight", "pivot_weight"))]
    lists = materialise(lists.where("low < high").select("list", "length", *own), "near-lists")
    return materialise(spread_join(placed, lists, ["list"], by="node", counts=lists.select("list", F.col("length").alias("n"))), "near-open")


def _lists_and_leaders(placed: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``_short_lists`` and, of the lists that these leave out, those of ``_leaders``."""
    return _short_lists(placed, percent).unionByName(_leaders(placed, percent))


def _rare_posts(open_lists: DataFrame, member: DataFrame, links: _Links, percent: int) -> DataFrame:
    """list, node, n, weight: the members of ``open_lists`` posted under the rarest shingles of their sets, so many that two
    sets which are similar enough share one.

    Only shingles that several components have count: sets of different components share no others, and a set that has too
    few of them is like none.
    """
    few = materialise(open_lists.select("node").distinct().join(small(member), "node"), "near-rest")
    tokens = links.sets.join(small(few.select("node")), "node", "left_semi").mapInArrow(_exploded, "node long, n long, list long")
    between = tokens.join(small(few), "node").groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("length"))
    shared = materialise(between.where("low < high").select("list", "length"), "near-shared")
    return _rarest(tokens, shared, F.expr(f"({percent} * n + 99) div 100").cast("int"))


def _nodes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, pick, n_shingles, class) of ``docs``, and for each class its ``node``, the number ``n_rows`` of its
    rows, their ``least`` doc_id and ``comp``, the node that stands for the component."""
    rows = materialise(signed(docs, k), "near-rows")
    classes = rows.where("n_shingles > 0").groupBy("class", "n_shingles", "sign")
    classes = classes.agg(F.min("doc_id").alias("least"), F.min("pick").alias("pick"), F.count("*").alias("n_rows"))
    # once written, the numbers stay
    reps = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    posts = posted(reps)
    ids = materialise(posts.select("node").distinct(), "near-ids")
    links = _Links(docs, reps, ids, k, percent)

    state = {"member": ids.withColumn("comp", F.col("node")), "tried": None}

    def compare(pairs: DataFrame, opened: DataFrame) -> DataFrame:
        """Confirm the pairs (x, y) that were not tried before, and contract the components that they link; what then is
        open of the lists ``opened``, the same table if nothing changed."""
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if state["tried"] is not None:
            pairs = pairs.join(state["tried"], ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near-pairs")
        if pairs.isEmpty():
            return opened
        state["tried"] = pairs if state["tried"] is None else state["tried"].unionByName(pairs)
        return _open_lists(opened, state["member"]) if contract(links.confirm(pairs)) else opened

    def contract(found: DataFrame) -> bool:
        found = materialise(found, "near-links")
        if found.isEmpty():
            return False
        state["member"] = _merged(state["member"], found)
        return True

    opened = _open_lists(posts, state["member"])
    for round_of in (_first_pivots, _lists_and_leaders):
        opened = compare(round_of(opened, percent), opened)
    # all pairs of short lists have been compared by now
    rest = opened.where(F.col("length") > SHORT)
    if not rest.isEmpty():
        opened = _open_lists(_rare_posts(rest, state["member"], links, percent), state["member"])
        rest = compare(_short_lists(opened, percent, RARE_LIST), opened).where(F.col("length") > RARE_LIST)
        if not rest.isEmpty():
            contract(_rest(rest, state["member"], links.sets, percent))
    placed = reps.join(state["member"], "node", "left").select("class", "n_rows", "least", F.coalesce("comp", "node").alias("comp"))
    return rows.drop("sign"), materialise(placed, "near-of-class")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    with arrow_batches(docs.sparkSession):
        rows, classes = _nodes(docs, k, percent)
        least = classes.groupBy("comp").agg(F.min("least").alias("component"))
        of_class = materialise(spread_join(classes, materialise(least, "near-least"), ["comp"], by="class").select("class", "component", "n_rows"), "near-of-class")
        sizes = of_class.select("class", F.col("n_rows").alias("n"))
        some = spread_join(rows.where("n_shingles > 0"), of_class.drop("n_rows"), ["class"], by="pick", counts=sizes)
    every = some.unionByName(rows.where("n_shingles = 0").withColumn("component", F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return every.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate component, that with the smallest doc_id (null last); all columns of ``docs``.

    Decided row by row: rows of one doc_id but different texts stay or go each by its own text.  Of rows that agree in doc_id
    and text the one that sorts first by all columns stays (any one, if a column has no order).  Rows without words all stay.
    """
    with arrow_batches(docs.sparkSession):
        rows, classes = _nodes(docs, k, percent)
        groups = classes.groupBy("comp").agg(F.sum("n_rows").alias("total")).where("total > 1")
        many = spread_join(classes, materialise(groups, "near-groups"), ["comp"], by="class")
        many = materialise(many.select("class", "comp", "n_rows", "total"), "near-many")
        sizes = many.select("class", F.col("n_rows").alias("n"))
        own = spread_join(rows.where("n_shingles > 0"), many.select("class", "comp", "total"), ["class"], by="pick", counts=sizes)
        own = materialise(own.groupBy("comp", "total", "doc_id", "pick").agg(F.count("*").alias("times")), "near-own")
    first = own.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pick", "times")).alias("top"))
    first = materialise(first.select("comp", "top.*").drop("no_id"), "near-first")
    again = materialise(first.where("times > 1").select("doc_id", "pick"), "near-again")
    sizes = own.groupBy("comp").agg(F.count("*").alias("n"))
    chosen = first.select("comp", F.col("doc_id").alias("top_id"), F.col("pick").alias("top_pick"))
    gone = spread_join(own, chosen, ["comp"], by="pick", counts=sizes)
    is_top = F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("pick") == F.col("top_pick"))
    gone = materialise(gone.where(~is_top).select("doc_id", "pick").unionByName(again), "near-gone")
    out = _by_row(docs, gone, "left_anti")
    if again.isEmpty():
        return out
    one = F.first if any("map<" in t or t == "variant" for _, t in docs.dtypes) else F.min
    kept = picked(_by_row(docs, again, "left_semi"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).groupBy("doc_id", "pick").agg(one("doc").alias("doc"))
    return out.unionByName(kept.select("doc.*"))


def _by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` that are (``left_semi``) or are not (``left_anti``) among ``rows`` (doc_id, pick)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    left = picked(docs, F.struct(*names).alias("doc"))
    right = small(rows.select(F.col("doc_id").alias("row_id"), F.col("pick").alias("row_pick")))
    met = left["doc_id"].eqNullSafe(right["row_id"]) & (left["pick"] == right["row_pick"])
    return left.join(right, met, how).select("doc.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: sets of 4-word shingles of all ``documents``, links at 80 %."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 4, 80)


#: All pairs that share a shingle, counted; components by closure.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), posts AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM posts a JOIN posts b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), near(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT n.doc_id, CASE WHEN l.a = n.other THEN l.b ELSE l.a END FROM near n JOIN links l ON l.a = n.other OR l.b = n.other
), least_of AS (SELECT doc_id, min(other) AS component_id FROM near GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM sets JOIN least_of USING (doc_id)
"""
