"""The store's runs, indexing by units, vector segments, and the change source by subtrees."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from repolens.api import Lens
from repolens.operators import segments
from repolens.sources.store import MOST_RUNS, Change, SnapshotStore
from repolens.streaming.subtrees import SubtreeChanges, SubtreeReader, listed, primed

IMPORTS = "path string, module string, imported_name string, alias string, line_number int, is_default boolean, is_namespace boolean, repo_path string"


def imports(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(p, m, None, None, n, None, None, None) for p, m, n in rows], IMPORTS)


def units(spark, *names):  # noqa: ANN001, ANN002, ANN201
    return spark.createDataFrame([(n,) for n in names], "unit string")


def test_runs_replace_units_and_are_merged(spark, tmp_path):
    """Random changes against a dictionary; old runs are merged, and their number stays small."""
    rng, store, want = random.Random(5), SnapshotStore(spark, str(tmp_path / "s")), {f"p{i}": [("m", i)] for i in range(40)}
    store.publish({"imports": imports(spark, [(p, *x) for p, rows in want.items() for x in rows])}, buckets=4)
    for step in range(MOST_RUNS + 4):
        new = {f"p{rng.randrange(50)}": [(rng.choice("ab"), step) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(1, 4))}
        gone = [f"p{rng.randrange(50)}"]
        rows = imports(spark, [(p, *x) for p, own in new.items() for x in own])
        store.publish({"imports": Change(rows, units(spark, *gone, *new))}, buckets=2 if step % 3 == 0 else 1)
        for p in gone:
            want.pop(p, None)
        want |= new
        if step in (0, 5, MOST_RUNS + 3):
            held = defaultdict(list)
            for r in store.load("imports").collect():
                held[r["path"]].append((r["module"], r["line_number"]))
            assert {p: sorted(x) for p, x in held.items()} == {p: sorted(x) for p, x in want.items() if x}
    runs = store.snapshot().runs["imports"]
    assert len(runs) <= MOST_RUNS and runs[0].gone == 0
    some = sorted(want)[:3]
    assert store.lookup("imports", some).count() == sum(len(want[p]) for p in some)
    assert store.lookup("imports", ["nowhere"]).count() == 0


def test_a_publish_on_an_old_snapshot_fails(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    base = store.snapshot()
    store.publish({"imports": imports(spark, [("a", "m", 1)])}, base)
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish({"imports": Change(imports(spark, [("b", "m", 1)]), units(spark))}, base)
    assert [r["path"] for r in store.load("imports").collect()] == ["a"]


def test_a_key_twice_in_a_change_fails(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("x",), ("x",)], "name string")
    with pytest.raises(ValueError, match="two rows of one key"):
        store.publish({"modules": Change(row, units(spark))})


def _bytes(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_one_changed_file_writes_as_much_in_a_larger_repository(spark, tmp_path):
    """Bytes written for one file don't grow with the repository, and the tables are those of a full index."""
    wrote = {}
    for n in (3, 45):
        root, store = tmp_path / f"code{n}", tmp_path / f"store{n}"
        root.mkdir()
        for k in range(n):
            (root / f"f{k}.ts").write_text(f"import {{ g{k + 1} }} from './f{k + 1}';\nexport function g{k}() {{ return g{k + 1}(); }}\nclass C{k} extends C{k + 1} {{}}\n")
        graph = Lens(spark, str(store))
        assert graph.add_code_to_graph(f"file:{root}")["status"] == "completed"
        before = _bytes(store)
        (root / "f1.ts").write_text("import { g2 } from './f2';\nexport function g1() { return g2(); }\nfunction more() { g1(); }\nclass C1 extends C2 {}\n")
        assert graph.add_code_to_graph(str(root))["status"] == "completed"
        wrote[n] = _bytes(store) - before
        assert graph.add_code_to_graph(str(root))["status"] == "completed" and _bytes(store) - before == wrote[n]  # nothing changed
    assert wrote[45] < 1.2 * wrote[3]
    anew = Lens(spark, str(tmp_path / "anew"))
    anew.add_code_to_graph(str(root))
    theirs = anew.tables()
    for t, df in graph.tables().items():
        assert sorted(map(str, df.collect())) == sorted(map(str, theirs[t].collect())), t
    assert all(not x["twice"] and not x["odd"] for x in graph.store.ensure_schema())


# -- vectors ------------------------------------------------------------------------------------------


def _vectors(spark, n: int, seed: int = 1):  # noqa: ANN001, ANN202
    """Vectors around 12 directions; a third of them are one and the same."""
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, centers[0] if i % 3 == 0 else [x + rng.gauss(0, 0.1) for x in centers[i % 12]]) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (-1, None), (-2, [0.0] * 8), (-3, [1.0])], "key long, embedding array<float>")


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_ROWS", 100)
    rows, df = _vectors(spark, 900)
    centroids = segments.train(df, 8).cache()
    k, probes = centroids.count(), segments.probes_of(centroids)
    assert k > 4 and probes < k
    vectors = segments.assigned(df, segments.centers_of(centroids)).cache()
    assert vectors.count() == 900
    asked = df.where("key % 20 = 0 and key > 0").select(F.col("key").alias("query"), "embedding")
    assert segments.recall(vectors, centroids, asked, 10, "key") >= 0.9
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b)
    found = defaultdict(list)
    for r in segments.nearest_many(vectors, centroids, asked, 10, "key", k).collect():
        found[r["query"]].append(r["score"])
    for q in (20, 60):
        want = sorted(((1 + cos(rows[q][1], v)) / 2 for _, v in rows), reverse=True)[:10]
        assert sorted(found[q], reverse=True) == pytest.approx(want, abs=1e-6)
    one = [r["score"] for r in segments.nearest(vectors, centroids, rows[20][1], 10, ("key",), k).collect()]
    assert one == pytest.approx(sorted(found[20], reverse=True), abs=1e-6)
    assert segments.nearest(vectors, centroids, [1.0], 3, ("key",)).count() == 0


def test_segments_of_few_vectors_are_one_cell(spark):
    rows, df = _vectors(spark, 30)
    centroids = segments.train(df, 8)
    vectors = segments.assigned(df, segments.centers_of(centroids))
    assert centroids.count() == 1
    assert segments.nearest(vectors, centroids, rows[4][1], 1, ("key",)).first()["key"] == 4


def test_the_store_keeps_vectors_in_step(spark, tmp_path, monkeypatch):
    """The tools search the index; it follows changed and deleted files and new descriptions."""
    monkeypatch.setattr(segments, "FEW", 4)
    root = tmp_path / "code"
    root.mkdir()
    for k in range(8):
        (root / f"f{k}.ts").write_text(f"export function walk{k}(dog: string) {{ return dog; }}\n")
    graph = Lens(spark, str(tmp_path / "store"), generator=lambda prompt, most: prompt[-60:], slots=2)  # noqa: ARG005
    assert graph.add_code_to_graph(str(root))["status"] == "completed"

    def in_step() -> int:
        tables = graph.tables()
        want = sorted(map(str, segments.vector_rows(tables, {"functions": "Function", "classes": "Class", "variables": "Variable", "files": "File", "directories": "Directory"}).select("label", "node", "description").collect()))
        assert sorted(map(str, tables["vectors"].select("label", "node", "description").collect())) == want
        return len(want)

    assert in_step() >= 16 and graph.semantic_search("walk3", 3).count() == 3
    (root / "f0.ts").write_text("export function purr(cat: string) { return cat; }\n")
    (root / "f7.ts").unlink()
    assert graph.add_code_to_graph(str(root))["status"] == "completed"
    assert in_step() >= 14
    names = {r["name"] for r in graph.semantic_search("walk7", 40).collect()}
    assert "walk7" not in names and "purr" in names
    hits = graph.execute_cypher_query("CALL db.index.vector.queryNodes('function_embeddings', 50, $v) YIELD node RETURN node.name AS name", {"v": graph.embed("cat")}).collect()
    assert {r["name"] for r in hits} <= names | {f"walk{k}" for k in range(1, 7)} and hits
    graph.delete_repository(str(root))
    assert graph.semantic_search("walk1", 3).count() == 0


# -- changes ------------------------------------------------------------------------------------------


def _tree(top: Path) -> None:
    for p in ("a.js", "src/b.js", "src/deep/c.js", "src/deep/er/d.js", "lib/x/y/e.js", "node_modules/n.js", "src/node_modules/m.js", "with blank/f%41.js"):
        (top / p).parent.mkdir(parents=True, exist_ok=True)
        (top / p).write_text("x")


def test_each_file_is_of_one_task(tmp_path):
    _tree(tmp_path)
    for parts in (1, 3, 8):
        found = [f for part in range(parts) for f in listed(str(tmp_path), part, parts)]
        assert sorted(found) == sorted(str(tmp_path / p) for p in ("a.js", "src/b.js", "src/deep/c.js", "src/deep/er/d.js", "lib/x/y/e.js", "with blank/f%41.js"))


def test_reader_by_subtrees(tmp_path):
    """A batch that is read again reports the same, whatever happened since; offsets stay small; old listings go."""
    top, state = tmp_path / "t", tmp_path / "state"
    _tree(top)
    reader = SubtreeReader(str(top), str(state), 4, None)
    start = reader.initialOffset()
    (top / "src/b.js").write_text("xy")
    (top / "new.js").write_text("")
    (top / "src/deep/c.js").unlink()
    read = lambda a, b: sorted((f.removeprefix(str(top)), op) for p in reader.partitions(a, b) for f, op, _, _ in reader.read(p))
    end = reader.latestOffset()
    want = [("", "tick"), ("/new.js", "add"), ("/src/b.js", "change"), ("/src/deep/c.js", "unlink")]
    assert read(start, end) == want
    (top / "later.js").write_text("")
    assert read(start, end) == want and len(str(end)) < 40
    reader.commit(end)
    after = reader.latestOffset()
    assert read(end, after) == [("", "tick"), ("/later.js", "add")]
    assert {p.name for p in state.iterdir()} == {str(end["at"]), str(after["at"])}


def test_stream_by_subtrees(spark, tmp_path):
    """A query that is stopped and goes on from its checkpoint reports what happened meanwhile, once."""
    top = tmp_path / "t"
    _tree(top)
    spark.dataSource.register(SubtreeChanges)
    first = primed(spark, str(top), str(tmp_path / "state"), 3)

    def run() -> None:
        stream = spark.readStream.format("subtree_changes").option("path", str(top)).option("state", str(tmp_path / "state")).option("parts", 3).option("first", first).load()
        query = stream.where("op <> 'tick'").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start(str(tmp_path / "out"))
        seen, deadline = len(query.recentProgress), time.time() + 60
        try:
            while sum(p["batchId"] >= 0 for p in query.recentProgress) < seen + 3 and time.time() < deadline:
                time.sleep(0.2)
        finally:
            query.stop()

    (top / "src/b.js").write_text("xyz")
    run()
    (top / "lib/x/g.js").write_text("")
    run()
    found = [(r["path"].removeprefix(str(top)), r["op"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == [("/lib/x/g.js", "add"), ("/src/b.js", "change")]


def test_files_are_written_by_tasks(spark, tmp_path):
    from repolens.sources import files

    rows = [("a/b/c.ts", "x\n"), ("d.ts", "ä"), ("e.ts", None)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("writing files", "")
    files.write_files(spark.createDataFrame(rows, "rel string, source string"), f"file:{tmp_path}/w")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs.getJobIdsForGroup("writing files")
    assert [(tmp_path / "w" / rel).read_bytes().decode() for rel, _ in rows] == ["x\n", "ä", ""]


def test_large_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    from repolens.sources import store as module

    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.publish({"modules": spark.createDataFrame([("a",), ("b",), ("c",)], "name string")})
    plan = lambda: store.load("modules").where("name <> 'c'").join(store.load("modules"), "name")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(module, "BROADCAST_UNITS", 2)
    assert "BroadcastHashJoin" not in plan()


def test_indexing_broadcasts_little(spark, tmp_path, monkeypatch):
    """The joins of an index job follow its own bound, not the session's of 10 MB a side."""
    from repolens.operators import traverse

    monkeypatch.setattr(traverse, "BROADCAST_BYTES", -1, raising=False)
    root, key = tmp_path / "code", "spark.sql.autoBroadcastJoinThreshold"
    root.mkdir()
    for k in range(3):
        (root / f"f{k}.ts").write_text(f"import {{ g{k + 1} }} from './f{k + 1}';\nexport function g{k}() {{ return g{k + 1}(); }}\nclass C{k} extends C{k + 1} {{}}\n")

    def plans() -> dict[int, str]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        done = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in map(done.apply, range(done.size()))}

    kept, before, graph = spark.conf.get(key), set(plans()), Lens(spark, str(tmp_path / "store"))
    assert graph.add_code_to_graph(str(root))["status"] == "completed"
    made = [p for i, p in plans().items() if i not in before]
    assert any("SortMergeJoin" in p for p in made) and not any("BroadcastHashJoin" in p for p in made)
    assert spark.conf.get(key) == kept
    assert (graph.tables()["calls"].count(), graph.tables()["inherits"].count()) == (2, 2)


def test_bounds_of_broadcasts_nest(spark):
    from repolens.operators.traverse import BROADCAST_BYTES, few_broadcasts

    key, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    try:
        for own, want in (("64k", 64 << 10), ("10m", BROADCAST_BYTES), ("-1", -1)):
            spark.conf.set(key, own)
            spark.conf.set(adaptive, own)
            one, other = few_broadcasts(spark), few_broadcasts(spark)
            one.__enter__()
            other.__enter__()
            one.__exit__(None, None, None)
            assert [int(spark.conf.get(k)) for k in (key, adaptive)] == [want, want]
            other.__exit__(None, None, None)
            assert [spark.conf.get(k) for k in (key, adaptive)] == [own, own]
    finally:
        spark.conf.set(key, kept)
        spark.conf.unset(adaptive)
    with few_broadcasts(spark):
        assert int(spark.conf.get(key)) == BROADCAST_BYTES and spark.conf.get(adaptive, None) is None
    assert spark.conf.get(key) == kept
