from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import common, components, exact_dedup, fuse, near_dedup
from repolens.llm.components import connected_components

DOC = "doc_id long, text string, lang string, kept boolean, sha string"  # extra columns whose names clash with results


def docs(spark, *pairs):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, t, "x", False, "y") for i, t in pairs], DOC)


def by_id(df) -> dict:  # noqa: ANN001
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500, 40_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n)
    made = fuse.build(keys)
    assert fuse.contains(made, keys).all()
    assert fuse.contains(made, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01
    if n > 10_000:
        assert len(made) < 1.3 * n
    assert fuse.contains(fuse.build(np.repeat(keys, 2)), keys).all()


def brute_exact(pairs):  # noqa: ANN001, ANN201
    groups: dict[str, list] = {}
    for i, t in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[2]
        for _, _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, " ", "a b", "ab", "a\tb\n", "Ab", "é x", "éx", "x" * 200_000, " x" * 100_000, "\u00a0", "hot copy"]
    pairs = [(i, rng.choice(texts)) for i in range(120)] + [(1000 + i, "hot copy") for i in range(60)] + [(2000 + i, f"only {i}") for i in range(60)]
    made = by_id(exact_dedup.exact_dedup(docs(spark, *pairs)))
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in made.items()} == brute_exact(pairs)


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(docs(spark)).count() == 0
    rows = exact_dedup.exact_dedup(docs(spark, (1, "a"), (1, "a"), (None, "a"), (None, "zz"), (2, None), (3, " "))).collect()
    assert len(rows) == 6
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows if r["keep_id"] == 1) == [
        (False, 1, 1, 3, False), (False, 1, 1, 3, True), (True, 0, 1, 3, False),
    ]
    assert [(r["keep_id"], r["kept"]) for r in rows if r["doc_id"] is None and r["group_size"] == 1] == [(None, True)]
    assert [(r["keep_id"], r["kept"]) for r in rows if r["doc_id"] in (2, 3)].count((3, True)) == 1  # the longer original stays


def test_exact_extreme_ids(spark):
    least, most = -(2**63), 2**63 - 1
    pairs = [(least, "a"), (1, "a "), (least + 1, "b"), (least, "b"), (most, "c"), (-1, "c"), (0, "d"), (most, "d")]
    rows = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, *pairs)).collect()}
    assert rows == {(least, 1, False), (1, 1, True), (least, least, True), (least + 1, least, False), (-1, -1, True), (most, -1, False), (0, 0, True), (most, 0, False)}


def test_large_batch_against_small_snapshot(spark, tmp_path, monkeypatch):
    """The batch is probed in parts, none of which has many more keys than asked for."""
    monkeypatch.setattr(exact_dedup, "PROBED_KEYS", 100)
    rows = lambda n, step: docs(spark, *[(i, f"text {i * step}") for i in range(n)])
    count = lambda d: exact_dedup.digests(d).withColumn("times", F.lit(1))
    snapshot = exact_dedup.write_snapshot(exact_dedup.grouped(count(rows(40, 5))), str(tmp_path / "s"))
    new = rows(2000, 1)
    batch = exact_dedup.grouped(count(new))
    screened = exact_dedup.screen(batch, snapshot)
    assert 40 <= screened.count() < 100
    sizes = exact_dedup._keyed(batch, 1).groupBy(F.pmod("key", F.lit(1 + 2000 // 100))).count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    assert exact_dedup.dedup_batch(count(new), snapshot, rows(40, 5).unionByName(new)).where("known").count() == 40


def test_snapshot_then_batches(spark, tmp_path):
    old = docs(spark, *[(i, f"text {i % 50}") for i in range(100)])
    new = docs(spark, *[(1000 + i, f"text {i}") for i in range(100)])
    count = lambda d: exact_dedup.digests(d).groupBy("sha", "n_bytes", "doc_id", "n_points").count().withColumnRenamed("count", "times")
    snapshot = exact_dedup.write_snapshot(exact_dedup.grouped(count(old)), str(tmp_path / "s"))
    out = exact_dedup.dedup_batch(count(new), snapshot, old.unionByName(new)).collect()
    assert sum(r["known"] for r in out) == 50 and len(out) == 100


def shingles(text, k):  # noqa: ANN001, ANN201
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(pairs, k, percent=80):  # noqa: ANN001, ANN201
    sets = {i: shingles(t, k) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):  # noqa: ANN001, ANN202
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed=3, groups=6, per=12):  # noqa: ANN001, ANN201
    """Bases with edits of several strengths around the threshold, a passage all share, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    out, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(80 + 30 * g)]
        for v in range(per):
            w = list(base)
            for _ in range(rng.randint(0, 1 + v // 2)):
                w[rng.randrange(len(w))] = word()
            if g % 2:
                w += passage
            out.append((n, " ".join(w)))
            n += 1
    return out


@pytest.mark.parametrize(("k", "short", "rare", "broadcast"), [(4, 16, 64, 200_000), (5, 16, 64, 20), (4, 2, 64, 200_000), (4, 2, 2, 0)])
def test_near_against_brute_force(spark, monkeypatch, k, short, rare, broadcast):
    """Also with every later step in use, and with no side small enough to be broadcast."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(components, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(near_dedup, "RARE_LIST", rare)
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    pairs = variants() + [(900, "a b c"), (901, "A  B\nc"), (902, "a b c d"), (903, ""), (904, None), (905, " \n"), (906, "a b"), (907, "x " * 30_000), (908, "x " * 20_000)]
    pairs += [(950 + i, "same words in every copy of this text") for i in range(20)]
    made = by_id(near_dedup.near_components(docs(spark, *pairs), k))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in made.items()} == brute_near(pairs, k)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in made.items())


def test_near_edges(spark):
    assert near_dedup.near_components(docs(spark)).count() == 0
    rows = near_dedup.near_components(docs(spark, (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"))).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    left = near_dedup.drop_near_duplicates(docs(spark, (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f")))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3"]  # the row without an id is a copy like any other
    assert left.columns == ["doc_id", "text", "lang", "kept", "sha"]


def test_near_rows_decided_one_by_one(spark, monkeypatch):
    """Rows that share a doc_id go each by its own text; of repeated rows, also without an id, one stays."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "some wholly other text of its own"), (3, "q w e r t y"), (3, "q w e r t y"), (None, "n n n n o n n m"), (None, "n n n n o n n m"),
            (None, "q w e r t y"), (4, "u v w x y z"), (4, "another one under this very id"), (5, "another one under this very id"), (None, ""), (None, ""), (6, ""), (6, ""), (7, None)]
    want = [(1, "a b c d e f"), (2, "some wholly other text of its own"), (3, "q w e r t y"), (None, "n n n n o n n m"), (4, "u v w x y z"), (4, "another one under this very id"), (None, ""), (None, ""), (6, ""), (6, ""), (7, None)]
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        left = near_dedup.drop_near_duplicates(docs(spark, *rows))
        assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string").collect()))
    # repeated rows that differ in another column, of a type without an order
    odd = spark.createDataFrame([(1, "a b c d e f", {"x": 1}), (1, "a b c d e f", {"x": 2})], "doc_id long, text string, `an odd name` map<string,int>")
    assert near_dedup.drop_near_duplicates(odd).count() == 1
    assert near_dedup.drop_near_duplicates(docs(spark)).count() == 0


def test_near_template(spark):
    """Many texts around one template, at a similarity under the threshold: long lists, no links, and nothing to compare."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template = " ".join(word() for _ in range(60))
    pairs = [(i, template + " " + " ".join(word() for _ in range(30))) for i in range(300)]
    pairs += [(1000 + i, pairs[i][1] + " more") for i in range(20)]
    made = by_id(near_dedup.near_components(docs(spark, *pairs)))
    assert {i: r["component_id"] for i, r in made.items()} == {i: i % 1000 for i, _ in pairs}


@pytest.mark.parametrize("few", [200_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "BROADCAST_ROWS", few)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5)]
    made = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(made[i] == 0 for i in range(41)) and made[249] == 100 and made[100] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
