from __future__ import annotations

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repolens import cli, config
from repolens.api import TOOLS, Lens
from repolens.plans.describe import Pool, TransientError, first_line_generator
from repolens.sources.schema import KEYS
from repolens.streaming.watch import debounced, relevant

A = 'import { util } from "./lib/b";\nexport function main(x) { if (x) { util(x); } local(); }\nfunction local() { return main(2); }\nexport class Dog extends Animal { bark() { local(); } }\n'
B = "export function helper(a) { return a; }\nexport function util(b) { return helper(b); }\nexport class Animal {}\n"


@pytest.fixture(scope="module")
def project(tmp_path_factory):  # noqa: ANN001, ANN201
    root = tmp_path_factory.mktemp("project")
    for name, text in {"src/a.ts": A, "src/lib/b.ts": B, "x.php": "<?php\nfunction php_main($a) { php_help($a); }\nfunction php_help($b) { return $b; }\n", "node_modules/i.js": "function skip() {}", "q.gen.ts": "function gen() {}", ".gitignore": "*.gen.ts\n", "readme.md": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def graph(spark, project, tmp_path_factory):  # noqa: ANN001, ANN201
    prompts = tmp_path_factory.mktemp("prompts") / "log"

    def counted(prompt: str, max_tokens: int = 150) -> str | None:
        with prompts.open("a") as f:
            f.write(prompt.splitlines()[-1][:0] + "x\n")
        return first_line_generator(prompt, max_tokens)

    g = Lens(spark, str(tmp_path_factory.mktemp("store")), counted, slots=2)
    g.prompts = prompts
    job = g.add_code_to_graph(str(project))
    assert (job["status"], job["files_total"]) == ("completed", 3), job
    yield g
    g.close()


def names(df, column="name") -> set[str]:  # noqa: ANN001
    return {r[column] for r in df.collect()}


def test_tables(graph):
    t = graph.tables()
    assert names(t["functions"]) == {"main", "local", "bark", "helper", "util", "php_main", "php_help"}
    calls = {(r["src_id"].split("#")[1], r["dst_id"].split("#")[1]) for r in t["calls"].collect()}
    assert calls == {("main", "util"), ("main", "local"), ("local", "main"), ("bark", "local"), ("util", "helper"), ("php_main", "php_help")}
    assert len(t["inherits"].collect()) == 1
    assert {r["path"].rsplit("/", 1)[1] for r in t["directories"].where("name <> '.'").collect()} == {"src", "lib"}
    assert t["functions"].where("description is null").count() == 0
    assert t["files"].where("description is null").count() == 0


def test_tools_give_json(graph, project):
    call = lambda tool, **a: json.loads(graph.call(tool, a))
    assert call("find_code", query="main")[0]["name"] == "main"
    assert call("semantic_search", query="helper")[0]["name"] == "helper"
    assert [x["caller_name"] for x in call("analyze_code_relationships", query_type="find_callers", target="helper")] == ["util"]
    assert "error" in call("analyze_code_relationships", query_type="x")
    assert call("execute_cypher_query", query="MATCH (f:Function) RETURN count(f) AS n") == [{"n": 7}]
    assert call("execute_query", query="SELECT count(*) AS n FROM nodes WHERE label = 'Function'") == [{"n": 7}]
    assert "error" in call("execute_query", query="DROP VIEW nodes")
    assert {x["name"] for x in call("find_dead_code")} == {"bark", "php_main"}
    assert call("find_most_complex_functions", limit=1)[0]["name"] == "main"
    assert call("calculate_cyclomatic_complexity", function_name="main")[0]["complexity"] == 2
    assert call("list_indexed_repositories")[0]["path"] == str(project)
    assert call("check_job_status")[0]["status"] == "completed"
    assert "error" in call("check_job_status", job_id="none")
    assert "error" in call("delete_repository")
    assert "error" in call("no_such_tool")
    assert call("list_watched_paths") == []
    assert len(TOOLS) == 15
    found = call("ask_codebase", question="helper?")
    assert found["sources"][0]["name"] == "helper"


def test_ask_without_hits(graph):
    assert graph.ask_codebase("?!")["sources"] == []


def test_cli(graph, capsys):
    args = lambda *a: cli.parser().parse_args(a)
    out: list[str] = []
    assert cli.run(graph, args("analyze", "callers", "helper"), out.append) == 0
    assert out and out[0].startswith("util")
    out.clear()
    cli.run(graph, args("stats"), out.append)
    assert "functions: 7" in out
    out.clear()
    cli.serve(graph, ['{"tool": "list_watched_paths"}', "not json"], out.append)
    assert json.loads(out[0]) == [] and "error" in json.loads(out[1])
    for a in (["search", "helper"], ["doctor"], ["list"], ["repo", "list"], ["analyze", "hierarchy", "Dog"], ["analyze", "complexity"], ["ask", "helper"]):
        assert cli.run(graph, args(*a), out.append) == 0


def test_reindex_is_incremental(graph, project):
    before = len(graph.prompts.read_text().splitlines())
    graph.add_code_to_graph(str(project))
    assert len(graph.prompts.read_text().splitlines()) == before  # nothing changed, nothing described
    (project / "src/lib/b.ts").write_text("\n" + B.replace("return a;", "return a + 1;"))
    (project / "x.php").unlink()
    graph.add_code_to_graph(str(project))
    t = graph.tables()
    assert names(t["functions"]) == {"main", "local", "bark", "helper", "util"}
    assert t["functions"].where("name = 'util' and description is not null and line_number = 3").count() == 1
    calls = {(r["src_id"].split("#")[1], r["dst_id"].split("#")[1]) for r in t["calls"].collect()}
    assert ("main", "util") in calls  # from an unchanged file into a changed one
    assert len(graph.prompts.read_text().splitlines()) == before + 2  # helper and its file
    (project / "x.php").write_text("<?php\nfunction again() {}\n")


def test_watch(graph, project, tmp_path):
    query = graph.watcher.watch(str(project), "1 second", str(tmp_path / "cp"))
    assert graph.watcher.watch(str(project)) is query
    try:
        deadline = time.time() + 60
        while not query.recentProgress and time.time() < deadline:
            time.sleep(0.3)
        (project / "src/new.ts").write_text("export function fresh() { util(1); }\n")
        while "fresh" not in names(graph.tables()["functions"]) and time.time() < deadline + 60:
            assert query.isActive, query.exception()
            time.sleep(1)
        assert "fresh" in names(graph.tables()["functions"])
        assert graph.list_watched_paths() == [str(project)]
    finally:
        graph.unwatch_directory(str(project))
    assert graph.list_watched_paths() == []


def test_relinking_after_changes_is_the_same_as_linking_anew(spark, tmp_path):
    """Files change, come, go and move their symbols: what is linked again with what is kept are the links of all files."""
    import random

    rng = random.Random(6)
    root = tmp_path / "code"
    root.mkdir()
    graph = Lens(spark, str(tmp_path / "store"))

    def write(k: int) -> None:
        names = rng.sample("abcdef", 3)
        calls = " ".join(f"{rng.choice('abcdefg')}();" for _ in range(4))
        imports = "".join(f"import {{ {rng.choice('abcdef')} as {rng.choice('uv')} }} from './f{rng.randrange(5)}';\n" for _ in range(2))
        own = "".join(f"function {n}() {{ {calls} u(); v(); }}\n" for n in names)
        (root / f"f{k}.ts").write_text(f"{imports}{own}class {rng.choice('PQR')} extends {rng.choice('PQR')} implements {rng.choice('IJ')} {{}}\ninterface {rng.choice('IJ')} {{}}\n")

    for step in range(4):
        for k in range(5) if not step else rng.sample(range(6), 2):
            write(k)
        if step == 2:
            (root / "f0.ts").unlink()
        assert graph.add_code_to_graph(str(root))["status"] == "completed"
        tables = graph.tables()
        anew = graph.indexer.linked(tables)
        for t in ("calls", "inherits", "implements"):
            kept = sorted(map(tuple, tables[t].collect()))
            assert kept == sorted(map(tuple, anew[t].select(*tables[t].columns).collect())) and kept, (step, t)


def test_debounce_across_batches(spark, tmp_path):
    """Changes of a file in several micro-batches within the quiet time are one session; ticks alone close it."""
    from repolens.streaming.watch import DirectoryChanges, _Listing

    spark.dataSource.register(DirectoryChanges)
    (tmp_path / "d").mkdir()
    source = _Listing(str(tmp_path / "d"))
    start = source.initialOffset()
    rows, end = source.read(start)
    assert list(rows) == [] and end == start  # nothing changed, and nothing did before
    batches = []
    for step in range(4):
        (tmp_path / "d" / "a.js").write_text("x" * step)
        (tmp_path / "d" / f"b{step}.js").write_text("")
        rows, after = source.read(end)
        rows = list(rows)
        assert rows == list(source.readBetweenOffsets(end, after))  # a replay gives the same
        batches.append(rows)
        end = after
    (tmp_path / "d" / "a.js").unlink()
    rows, end = source.read(end)
    batches.append(list(rows))
    assert [[(r[0].rpartition("/")[2], r[1]) for r in b] for b in batches] == [
        [("", "tick"), ("a.js", "add"), ("b0.js", "add")], *[[("", "tick"), ("a.js", "change"), (f"b{i}.js", "add")] for i in (1, 2, 3)], [("", "tick"), ("a.js", "unlink")],
    ]
    assert sorted({r[3] for b in batches for r in b}) == list(range(end["seq"]))

    made = [(p.rpartition("/")[2], op, datetime(2024, 1, 1) + timedelta(milliseconds=500 * k), n) for k, b in enumerate(batches) for p, op, _, n in b]
    made += [("", "tick", datetime(2024, 1, 1) + timedelta(seconds=10 + k), 100 + k) for k in range(2)]
    spark.createDataFrame([], "path string, op string, event_time timestamp, seq long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, op string, event_time timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out: list = []
    query = debounced(stream, "2 seconds", "0 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    query = query.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.where("op <> 'tick'").collect())).trigger(processingTime="0 seconds").start()
    try:
        for when in sorted({r[2] for r in made}):
            spark.createDataFrame([r for r in made if r[2] == when], "path string, op string, event_time timestamp, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted((p, op, n) for p, op, _, n in out) == [("a.js", "unlink", 5), *[(f"b{i}.js", "add", 1) for i in range(4)]]


def test_delete(graph, project):
    graph.delete_repository(str(project))
    assert list(graph.stats().first()) == [0] * 6


def test_failed_job(graph):
    job = graph.add_code_to_graph("/no/such/dir")
    assert job["status"] == "failed" and job["error"]


def test_debounce(spark):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    events = spark.createDataFrame(
        [("/a.ts", "add", at(0), 0), ("/a.ts", "change", at(1), 1), ("/a.ts", "unlink", at(2.5), 2), ("/a.ts", "add", at(9), 3), ("/b.py", "add", at(0), 4), ("/dist/c.js", "add", at(0), 5)],
        "path string, op string, event_time timestamp, seq long",
    )
    out = {(r["op"], r["n_events"]) for r in debounced(relevant(events)).collect()}
    assert out == {("unlink", 3), ("add", 1)}


def test_debounce_on_a_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("/a.ts", "add", t, 0), ("/a.ts", "change", t + timedelta(seconds=1), 1), ("/z.ts", "add", t + timedelta(hours=1), 2)], "path string, op string, event_time timestamp, seq long").write.parquet(str(tmp_path / "in"))
    stream = debounced(spark.readStream.schema("path string, op string, event_time timestamp, seq long").parquet(str(tmp_path / "in")), late="10 seconds")
    q = stream.writeStream.format("memory").queryName("debounced_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["path"], r["op"], r["n_events"]) for r in spark.table("debounced_out").collect()] == [("/a.ts", "change", 2)]


def test_pool():
    pauses: list[float] = []
    tries: list[int] = []

    def flaky(prompt: str, n: int) -> str:
        tries.append(1)
        if len(tries) < 3:
            raise TransientError
        return "  fine "

    assert Pool([(flaky, 3), (flaky, 5)], pause=pauses.append)("p") == "fine"
    assert pauses == [2.0, 4.0]
    assert Pool([])("p") is None
    assert Pool([(lambda p, n: 1 / 0, 1)])("p") is None
    assert Pool([(flaky, 3), (flaky, 5)]).slots == 8


def test_pool_deals_slots():
    """No member has more prompts at once than slots, in threads and by task number."""
    import threading
    from collections import Counter
    from concurrent.futures import ThreadPoolExecutor

    lock, now, most, met = threading.Lock(), Counter(), Counter(), threading.Barrier(16)

    def member(name):  # noqa: ANN001, ANN202
        def answer(prompt, max_tokens):  # noqa: ANN001, ANN202, ARG001
            with lock:
                now[name] += 1
                most[name] = max(most[name], now[name])
            met.wait(10)
            with lock:
                now[name] -= 1
            return name

        return answer

    limits = {"a": 3, "b": 3, "c": 5, "d": 5}
    pool = Pool([(member(k), n) for k, n in limits.items()])
    with ThreadPoolExecutor(16) as threads:
        assert Counter(threads.map(pool, ["x"] * 32)) == {k: 2 * n for k, n in limits.items()}
    assert dict(most) == limits and not any(pool.busy.values())
    assert Counter("abcd"[pool.home(i)] for i in range(100, 116)) == limits


def test_pool_in_tasks(spark):
    """Each of the tasks of a job asks the member of its slot."""
    from repolens.plans.describe import generate

    pool = Pool([((lambda p, n, k=k: k), slots) for k, slots in (("a", 1), ("b", 3))])
    out = generate(spark.range(40).selectExpr("cast(id as string) prompt").repartition(1), pool, 4)
    rows = out.groupBy(F.spark_partition_id().alias("task")).agg(F.collect_set("description").alias("d")).collect()
    assert sorted(x for r in rows for x in r["d"]) == ["a", "b", "b", "b"]


def test_http_generator():
    import http.server
    import threading

    from repolens.sources.generators import HttpGenerator, http_pool

    codes = [429, 200, 400, 200]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: ANN202, N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code = codes.pop(0)
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"content": [{"type": "text", "text": f" {asked['model']}: {asked['messages'][0]['content']} "}]}).encode())

        def log_message(self, *a):  # noqa: ANN002, ANN202
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    pool = http_pool(url, "k", {"m": 2, "n": 1})
    pool.pause = lambda s: None
    assert pool("hi") == "n: hi"  # the first model was busy
    assert HttpGenerator(url, "m", "k")("bad") is None
    assert HttpGenerator(url, "m", "k")("again") == "m: again"
    assert HttpGenerator(url, "m")("no key") is None
    server.shutdown()
    with pytest.raises(TransientError):
        HttpGenerator("http://127.0.0.1:9/", "m", "k", 1)("x")


def test_mcp_session(spark, tmp_path):
    """A client's session: handshake, list, calls good and bad."""
    import inspect

    from repolens import mcp

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.js").write_text("function moor() { tie(); }\nfunction tie() {}\n")
    graph = Lens(spark, str(tmp_path / "store"))
    ask = lambda method, id_=1, **params: {"jsonrpc": "2.0", "id": id_, "method": method, "params": params}
    lines = [
        ask("initialize", protocolVersion="2024-11-05", capabilities={}, clientInfo={"name": "x", "version": "0"}), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask("tools/list", 2),
        ask("tools/call", 3, name="add_code_to_graph", arguments={"path": str(tmp_path / "src")}), ask("tools/call", "four", name="analyze_code_relationships", arguments={"query_type": "find_callers", "target": "tie"}),
        ask("tools/call", 5, name="execute_cypher_query", arguments={"query": "MATCH (f) DELETE f"}), ask("tools/call", 6, name="find_code"), ask("tools/call", 7, name="no_such_tool"), ask("no/such", 8), ask("ping", 9), [1],
        ask("tools/call", 10, name="find_code", arguments={"query": "x", "odd": 1}),
    ]
    said: list[str] = []
    cli.serve(graph, [json.dumps(x) for x in lines] + ["", "{"], said.append)
    made = [json.loads(x) for x in said]
    assert [m.get("id") for m in made] == [1, 2, 3, "four", 5, 6, 7, 8, 9, None, 10, None]
    assert made[0]["result"]["protocolVersion"] == "2024-11-05" and "tools" in made[0]["result"]["capabilities"]
    listed = made[1]["result"]["tools"]
    assert [t["name"] for t in listed] == list(TOOLS)
    for t in listed:  # the schemas agree with the methods
        named = inspect.signature(getattr(Lens, t["name"])).parameters
        assert set(t["inputSchema"]["properties"]) == set(named) - {"self"}
        assert set(t["inputSchema"].get("required", ())) == {k for k, v in named.items() if k != "self" and v.default is inspect.Parameter.empty}
        assert all(v.get("default") == named[k].default for k, v in t["inputSchema"]["properties"].items() if "default" in v)
    assert json.loads(made[2]["result"]["content"][0]["text"])["status"] == "completed" and not made[2]["result"]["isError"]
    assert json.loads(made[3]["result"]["content"][0]["text"])[0]["caller_name"] == "moor"
    assert made[4]["result"]["isError"] and [m["error"]["code"] for m in made[5:8]] == [-32602, -32602, -32601]
    assert made[8]["result"] == {} and made[9]["error"]["code"] == -32600 and made[10]["error"]["code"] == -32602 and "error" in made[11]
    assert mcp.handle(graph, ask("initialize", protocolVersion="1999-01-01"))["result"]["protocolVersion"] == mcp.VERSIONS[0]


def test_vector_index(spark, tmp_path):
    """Exact with all buckets, high recall with some, and only their folders are read."""
    import random

    from repolens.operators.search import VectorIndex, vector_topk

    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in middles[i % 12]]) for i in range(900)] + [(900, None), (901, []), (902, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path / "v"), 16, 4)
    index.write(df)
    queries = [rows[i][1] for i in range(0, 900, 150)]
    for q in queries[:2]:
        assert [r["id"] for r in index.topk(q, 7, 16, ("id",)).collect()] == [r["id"] for r in vector_topk(df, q, 7, order=("id",)).collect()]
    assert index.recall(queries, 10, 16, "id") == 1.0
    some = index.recall(queries, 10, 4, "id")
    assert 0.8 <= some <= 1.0
    assert len(index.topk(queries[0], 5, 4).inputFiles()) <= len(spark.read.parquet(str(tmp_path / "v")).inputFiles())
    plan = index.topk(queries[0], 5, 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stored_names_are_searched(spark, tmp_path):
    """After files change, come and go, the stored index gives what one built anew does."""
    from repolens.operators import search

    root = tmp_path / "code"
    root.mkdir()
    graph = Lens(spark, str(tmp_path / "store"))
    for k in range(3):
        (root / f"f{k}.ts").write_text(f"function load_part{k}() {{}}\nclass PartLoad {{}}\nconst part_{k} = 1;\n")
    graph.add_code_to_graph(str(root))
    (root / "f0.ts").write_text("function load_all() {}\n")
    (root / "f1.ts").unlink()
    (root / "f3.ts").write_text("const load_late = 1;\n")
    graph.add_code_to_graph(str(root))
    tables = graph.tables()
    anew = {k: v for k, v in tables.items() if k != "name_postings"}
    for text in ("load", "part 2", "nothing", "load part all"):
        own = [tuple(r) for r in search.fulltext(tables, text, 50).collect()]
        assert own == [tuple(r) for r in search.fulltext(anew, text, 50).collect()] and (own or text == "nothing")
    found = graph.store.ensure_schema()
    assert all(not x["twice"] and not x["odd"] for x in found) and {x["table"] for x in found} >= set(KEYS)
    graph.delete_repository(str(root))
    assert search.fulltext(graph.tables(), "load", 50).count() == 0


def test_snapshots_of_two_writers(spark, tmp_path):
    """Of two publishes on one base the second fails and changes nothing."""
    from repolens.sources.store import SnapshotStore

    a, b = SnapshotStore(spark, str(tmp_path / "s")), SnapshotStore(spark, str(tmp_path / "s"))
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    a.publish({"modules": rows("x")})
    pointers = b._pointers()
    a.publish({"modules": rows("x", "y")})
    b._pointers = lambda: pointers
    with pytest.raises(RuntimeError, match="another writer"):
        b.publish({"modules": rows("z")})
    assert sorted(r["name"] for r in a.load("modules").collect()) == ["x", "y"]


def test_globs_on_files(spark, tmp_path):
    from repolens.sources.files import glob

    for p in ("a.ts", "src/b.ts", "src/deep/c.d.ts", "src/deep/d.js", "out/e.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    names = lambda *a, **k: sorted(r["path"] for r in glob(spark, str(tmp_path), *a, **k).collect())
    assert names("**/*.ts", ["out/**", "**/*.d.ts"], absolute=False) == ["a.ts", "src/b.ts"]
    assert names(["src/**/*.{js,ts}"]) == [f"{tmp_path}/src/b.ts", f"{tmp_path}/src/deep/c.d.ts", f"{tmp_path}/src/deep/d.js"]
    assert len(names()) == 5 and names("?.ts", absolute=False) == ["a.ts"]


def test_pooled_vectors():
    import numpy as np

    from repolens.functions.vectors import pooled

    made = pooled(np.array([[3.0, 0.0], [0.0, 4.0], [100.0, 100.0]]), np.array([1, 1, 0]))
    assert made == pytest.approx([0.6, 0.8]) and pooled(np.zeros((2, 3)), np.array([1, 1])) == [] and pooled(np.ones((2, 3)), np.array([0, 0])) == []


def test_results_of_too_many_rows_are_errors(spark, tmp_path, monkeypatch):
    from repolens import api

    monkeypatch.setattr(api, "MOST_ROWS", 3)
    graph = Lens(spark, str(tmp_path / "s"))
    assert len(json.loads(graph.call("execute_query", {"query": "SELECT id FROM range(3)"}))) == 3
    assert "more than 3 rows" in json.loads(graph.call("execute_query", {"query": "SELECT id FROM range(4)"}))["error"]


def test_config(tmp_path):
    g, l = tmp_path / "g", tmp_path / "l"  # noqa: E741
    config.write_env(g, {"REPOLENS_STORE": "/s", "MY_API_KEY": "k"})
    config.write_env(l, {"REPOLENS_STORE": "/t"})
    made = config.load_config(g, l, {"REPOLENS_SLOTS": "3"})
    assert (made["REPOLENS_STORE"], made["REPOLENS_SLOTS"]) == ("/t", "3")
    assert config.masked(made)["MY_API_KEY"] == "***"


def test_registered_queries_have_sql():
    from repolens import queries

    assert set(queries.queries()) == set(queries.oracle_sql())
