from __future__ import annotations

import random

import corpus_pipeline
from repolens.llm.queries import oracle_sql, queries


def make(spark, folder):  # noqa: ANN001, ANN201
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows = [(i, text(60 + i % 40), "en", f"s{i % 4}") for i in range(240)]
    bench = [(k, text(30)) for k in range(5)]
    rows += [(1000 + i, rows[i][1], "en", "s0") for i in range(10)]  # exact copies
    rows += [(1100 + i, rows[20 + i][1] + " " + word(), "en", "s1") for i in range(10)]  # near copies
    rows += [(1200 + i, text(20) + " " + bench[i % 5][1] + " " + text(20), "en", "s2") for i in range(10)]
    rows += [(1300 + i, "BUY!! $$$ ### " * (10 + i), "en", "s3") for i in range(60)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], int(r[0] < 1300), 0) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r[0] for r in rows if r[0] < 240}
    assert set(seen["quality"]) == {r[0] for r in rows if r[0] < 1300}
    assert set(seen["near_duplicates"]) == clean | set(range(1200, 1210))
    assert set(seen["decontamination"]) == clean
    assert set(seen["mixing"]) <= clean and len(seen["mixing"]) > 200
    assert sorted(seen["sharding"]) == sorted(seen["mixing"])
    assert {r["shard"] for r in docs.collect()} <= set(range(40))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.select("doc_id").collect()) == sorted(seen["sharding"])


def test_stages_on_nothing(spark, tmp_path):
    make(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty and long texts, null sources, null and repeated ids, repeated rows, extra columns of clashing names: no
    stage crashes, and each does what its docstring says."""
    make(spark, str(tmp_path))
    long = "".join(f"long{i * i % 7919} " for i in range(60_000))
    odd = [
        (1, None, "en", "s0", 0), (1, None, "en", "s0", 0), (None, "", None, None, None), (None, None, None, None, None), (2, "", "en", None, 0), (3, long, "en", None, 1), (3, long, "en", None, 1),
        (4, "one of two texts that have the same number here", "en", "s1", 1), (4, "another text with that number and words of its own", "en", "s1", 1),
        (None, "a text without any number that occurs two times here", "en", "s2", 1), (None, "a text without any number that occurs two times here", "en", "s2", 1),
    ]
    docs = spark.createDataFrame([(*r, 7, 8, "t", 0.5, "x") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, size string, score double, `pick it` string")
    stage = dict(corpus_pipeline.STAGES)
    read = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    own = lambda *keep: sorted((str(odd[i][0]), odd[i][1] or "") for i in keep)

    good = stage["quality"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    same = [r for r in read(good) if r == ("3", long)]
    assert len(same) in (0, 2)  # equal texts have equal scores

    near = stage["near_duplicates"](spark, docs, str(tmp_path))
    assert near.columns == docs.columns and read(near) == own(0, 1, 2, 3, 4, 5, 7, 8, 9)

    clean = stage["decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and read(clean) == own(*range(11))

    mixed = stage["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    assert not [r for r in read(mixed) if not r[1]]  # without words a document is in no block
    for r in set(read(mixed)):
        assert read(mixed).count(r) <= 3 * read(docs).count(r)

    placed = stage["sharding"](spark, docs, str(tmp_path))
    assert placed.columns == [*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot"] and read(placed) == own(*range(11))
    places = [(r["shard"], r["slot"]) for r in placed.collect()]
    assert len(set(places)) == 11 and all(0 <= a < 40 for a, _ in places)


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """Each stage of ``run`` on its own input, by brute force; the classifier's scores are its own."""
    from collections import Counter

    from pyspark.sql import functions as F

    from repolens.llm import decontaminate, quality
    from tests.llm.test_dedup import brute_near
    from tests.llm.test_others import brute_targets, edits

    make(spark, str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    rows = {r["doc_id"]: r for r in read("documents").collect()}
    score = quality.scorer(quality.learn(read("documents"), quality._training(read("labels"))))
    kept = {r["doc_id"] for r in read("documents").where(score(F.col("text")) >= 0.5).collect()}
    near = brute_near([(i, rows[i]["text"]) for i in kept], 5)
    kept = {i for i in kept if near[i][1] == i}
    items = [r["text"] for r in read("benchmark").collect()]
    norm = lambda t: __import__("re").sub(r"[\s!-/:-@\[-`{-~]+", " ", t).lower()

    def leaks(text: str) -> bool:
        """Some 64 bytes of an item within 3 edits: for these texts and items, random apart from whole copies, any 64 from
        a start in every sixteenth."""
        return any(edits(norm(x)[s : s + decontaminate.WINDOW], norm(text)) <= 3 for x in items for s in range(0, len(norm(x)) - 63, 48))

    kept = {i for i in kept if not (i >= 1200 and leaks(rows[i]["text"]))}
    assert not any(leaks(rows[i]["text"]) for i in sorted(kept)[::40])
    sizes, words = Counter(), {i: len(rows[i]["text"].split()) for i in kept}
    for i in kept:
        sizes[rows[i]["source"]] += words[i]
    want = brute_targets(dict(sizes))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(r["doc_id"] for r in out)
    assert set(times) <= kept and max(times.values()) <= 3
    taken = Counter()
    for i, n in times.items():
        taken[rows[i]["source"]] += n * words[i]
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + max(words.values()) for s in want)
    load = Counter()
    for r in out:
        assert tuple(r[c] for c in rows[r["doc_id"]].asDict()) == tuple(rows[r["doc_id"]])
        load[r["shard"]] += len(r["text"].encode()) + 16
    places = Counter((r["shard"], r["slot"]) for r in out)
    assert max(places.values()) == 1 and all(sum(1 for s, _ in places if s == k) == 1 + max(p for s, p in places if s == k) for k in load)
    assert max(load.values()) - min(load.values()) <= 2 * max(len(r["text"].encode()) + 16 for r in out)


def test_names():
    found = [k for k in queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in found) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())
