from __future__ import annotations

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from repolens.functions import text, vectors
from repolens.operators import analyze, graph, resolve, search
from repolens.operators.traverse import reachable, trails, trails_sql
from repolens.sources.schema import TABLES
from pyspark.sql import functions as F

FUNCTION = "id string, name string, path string, line_number int, cyclomatic_complexity int, kind string, repo_path string"
CALL = "src_id string, dst_id string, line_number int"


@pytest.fixture(scope="module")
def code(spark):  # noqa: ANN001, ANN201
    f = spark.createDataFrame(
        [("a", "a", "/1", 1, 3, None, "/"), ("b", "b", "/1", 5, None, "getter", "/"), ("c", "c", "/2", 1, 3, None, "/"), ("d", "d", "/2", 9, 1, "constructor", "/r"), ("e", "e", "/3", 1, 7, None, "/r")],
        FUNCTION,
    )
    calls = spark.createDataFrame([("a", "b", 1), ("a", "b", 9), ("b", "c", 2), ("c", "a", 3), ("c", "d", 4)], CALL)
    return f, calls


def rows(df) -> list[tuple]:  # noqa: ANN001
    return [tuple(r) for r in df.collect()]


def test_callers_and_callees(code):
    assert rows(analyze.find_callers(*code, "b")) == [("a", "/1", 1, 1), ("a", "/1", 1, 9)]
    assert rows(analyze.find_callees(*code, "c")) == [("a", "/1", 1, 3), ("d", "/2", 9, 4)]
    assert rows(analyze.find_callers(*code, "b", 1)) == [("a", "/1", 1, 1)]


def test_chain_with_cycle_and_parallel_edges(code):
    found = rows(analyze.call_chain(*code, "a", 5, 100))
    names = sorted("".join(n) for _, n in found)
    assert names == ["ab", "ab", "abc", "abc", "abca", "abca", "abcab", "abcab", "abcd", "abcd"]
    assert rows(analyze.call_chain(*code, "a", 5, 3)) == [(1, ["a", "b"]), (1, ["a", "b"]), (2, ["a", "b", "c"])]
    with pytest.raises(ValueError):
        trails(*code, "a", 1000)


def test_recursive_sql_is_the_same(code, spark):
    code[0].createOrReplaceTempView("t_nodes")
    code[1].createOrReplaceTempView("t_edges")
    assert sorted(rows(trails_sql(spark, "t_nodes", "t_edges", "a", 4))) == sorted(rows(trails(*code, "a", 4)))


def brute_trails(edges: list[tuple], start: str, depth: int) -> list[str]:
    out, states = [], [((), start, start)]
    for _ in range(depth):
        states = [(used + (i,), e[1], names + e[1]) for used, at, names in states for i, e in enumerate(edges) if e[0] == at and i not in used]
        out += [s[2] for s in states]
    return sorted(out)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd")), min_size=1, max_size=6), st.integers(1, 3))
def test_trails_against_enumeration(spark, pairs, depth):
    edges = [(a, b, i) for i, (a, b) in enumerate(pairs)]
    nodes = spark.createDataFrame([(x, x) for x in "abcd"], "id string, name string")
    found = trails(nodes, spark.createDataFrame(edges, CALL), "a", depth)
    assert sorted("".join(n) for _, n in rows(found)) == brute_trails(edges, "a", depth)


def test_hierarchy_starts_with_the_class(spark):
    c = spark.createDataFrame([("1", "Dog"), ("2", "Animal"), ("3", "Thing")], "id string, name string")
    e = spark.createDataFrame([("1", "2"), ("2", "3")], "src_id string, dst_id string")
    assert rows(analyze.class_hierarchy(c, e, "Dog", 5)) == [(0, ["Dog"]), (1, ["Dog", "Animal"]), (2, ["Dog", "Animal", "Thing"])]
    assert rows(analyze.class_hierarchy(c, e, "Dog", 0)) == [(0, ["Dog"])]


def test_dead_code_and_complexity(code, spark):
    assert rows(analyze.dead_code(*code)) == [("e", "/3", 1)]
    assert rows(analyze.dead_code(*code, repo_path="/")) == []
    assert [r[0] for r in rows(analyze.most_complex(code[0]))] == ["b", "e", "a", "c", "d"]  # null first
    assert rows(analyze.find_complexity(code[0], "a")) == [("a", "/1", 3)]
    assert rows(analyze.calculate_complexity(code[0], "e", "/3")) == [("e", "/3", 1, 7)]
    self_call = spark.createDataFrame([("e", "e", 1)], CALL)
    assert "e" not in {r[0] for r in rows(analyze.dead_code(code[0], self_call))}


def test_imports(spark):
    i = spark.createDataFrame([("/a", "react", "useState", 1), ("/b", "./use", "x", 2), ("/a", "react", "y", 3)], "path string, module string, imported_name string, line_number int")
    assert rows(analyze.find_importers(i, "x")) == [("/b", "./use", "x", 2)]
    assert len(rows(analyze.find_importers(i, "react"))) == 2
    assert rows(analyze.module_deps(i, "a")) == [("/a", "react")]


def test_dispatch(code):
    with pytest.raises(ValueError):
        analyze.analyze({}, "nope")
    with pytest.raises(ValueError):
        analyze.analyze({"functions": code[0], "calls": code[1]}, "find_callers")


def test_reachable(code, spark):
    start = spark.createDataFrame([("b",)], "id string")
    assert {r[0] for r in rows(reachable(code[1], start))} == {"a", "b", "c", "d"}
    assert {r[0] for r in rows(graph.delete_reachable(code[0].select("id"), code[1], start))} == {"e"}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "x", "p"), (2, "y", None)], "k int, a string, b string")
    new = spark.createDataFrame([(1, None), (2, "z"), (3, "w"), (3, "w")], "k int, a string")
    assert sorted(rows(graph.upsert_nodes(old, new, ["k"]))) == [(1, "x", "p"), (2, "z", None), (3, "w", None)]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "zz")], "src_id string, dst_id string")
    assert rows(graph.upsert_edges(e.limit(0), e, nodes, nodes)) == [("a", "b")]


def test_diff(spark):
    now = spark.createDataFrame([("/a", "1"), ("/b", "2"), ("/c", "3")], "path string, content_hash string")
    old = spark.createDataFrame([("/a", "1"), ("/b", "x"), ("/d", "4")], "path string, content_hash string")
    assert dict(rows(graph.diff(now, old))) == {"/a": "skipped", "/b": "dirty", "/c": "dirty", "/d": "deleted"}


def test_directories(spark):
    files = spark.createDataFrame([("/r/a/b/x.ts", "a/b/x.ts"), ("/r/y.ts", "y.ts")], "path string, rel string")
    assert sorted(rows(graph.directory_tree(files, "/r")), key=lambda r: r[3]) == [("/r", None, "r", 0), ("/r/a", "/r", "a", 1), ("/r/a/b", "/r/a", "b", 2)]
    assert {(r[0], r[1], r[2]) for r in rows(graph.directory_groups(files))} == {("/r/a/b", 1, "x.ts"), ("/r", 1, "y.ts")}


SYMBOL_CASES = [
    ("foo", [("/f", "foo", "./foo", None)], [("foo", "/src/foo.ts", 1)], ("/src/foo.ts", 1)),
    ("bar", [], [("bar", "/src/bar.ts", 3)], ("/src/bar.ts", 3)),
    ("baz", [], [("baz", "/f", 1), ("baz", "/z.ts", 7)], ("/z.ts", 7)),
    ("baz", [], [("baz", "/f", 1)], ("/f", 1)),
    ("nope", [], [("bar", "/b", 1)], (None, None)),
    ("local", [("/f", "local", "./o", "original")], [("original", "/src/original.ts", 4)], ("/src/original.ts", 4)),
    ("original", [("/f", "local", "./o", "original")], [("original", "/f", 1), ("original", "/x", 2)], ("/f", 1)),
]


@pytest.mark.parametrize(("name", "imports", "symbols", "expected"), SYMBOL_CASES)
def test_resolve(spark, name, imports, symbols, expected):
    calls = spark.createDataFrame([("/f", name)], "path string, name string")
    i = spark.createDataFrame([(p, n, a, 1) for p, n, _, a in imports], "path string, imported_name string, alias string, line_number int")
    s = spark.createDataFrame([(*x, k) for k, x in enumerate(symbols)], "name string, path string, line_number int, ord int")
    out = resolve.resolve_symbols(calls, i, s).select("resolved_path", "resolved_line")
    assert rows(out) == [expected]


def _compared(df) -> bool:  # noqa: ANN001
    """Whether a plan shuffles links to compare them, which are the square of a group's size."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Aggregate [src_id" in plan or "Distinct" in plan


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from([None, *"123456789"]), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, "r", "s", ""]), st.lists(st.sampled_from([None, "a", "b", "c"]), max_size=3)), max_size=14),
    st.booleans(), st.booleans(),
)
def test_links_of_bases_are_all_and_once(spark, classes, exclude_self, same_repo):
    """Null and repeated ids too, under one name or several."""
    c = spark.createDataFrame(classes, "id string, name string, repo_path string, bases array<string>")
    expected = {
        (a[0], b[0]) for a in classes for b in classes
        if b[1] is not None and b[1] in a[3] and (not exclude_self or None not in (a[0], b[0]) and a[0] != b[0]) and (not same_repo or a[2] == b[2])
    }
    found = rows(resolve.link_bases(c, "bases", exclude_self, same_repo))
    assert len(found) == len(expected) and set(found) == expected


def test_links_of_large_groups(spark):
    """Groups of several blocks: every pair once, and no pair is shuffled."""
    n = 2 * resolve.BLOCK + 3
    c = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("name"), F.lit(None).cast("string").alias("repo_path"), F.array(F.lit("a"), F.lit("a")).alias("bases"))
    df = resolve.link_bases(c, "bases", True)
    assert not _compared(df)
    assert df.count() == df.distinct().count() == n * (n - 1)
    f = c.select("id", "name", F.lit("/1").alias("path"), F.col("id").cast("int").alias("line_number"))
    calls = spark.range(40).select(F.lit("/1").alias("path"), F.lit("a").alias("name"), F.lit("a").alias("caller_name"), F.col("id").cast("int").alias("line_number"))
    calls = calls.unionByName(calls.limit(1)).unionByName(calls.limit(1).withColumn("line_number", F.lit(None).cast("int")))
    imports = spark.createDataFrame([], "path string, imported_name string, alias string, line_number int")
    symbols = f.select("name", "path", "line_number").withColumn("ord", F.struct("path", "line_number"))
    df = resolve.link_calls(calls, imports, f, symbols)
    assert not _compared(df)
    assert df.agg(F.count("*"), F.count_distinct("src_id", "dst_id"), F.count("line_number")).first()[:] == (n * n * 41, n * n, n * n * 40)
    local = resolve.link_calls(calls, imports, f, symbols.limit(0))
    assert not _compared(local)
    assert local.agg(F.count("*"), F.min("dst_id"), F.max("dst_id")).first()[:] == (n * 41, "0", "0")


def _shuffled(spark, df) -> tuple[int, int]:
    """Bytes that a run of ``df`` writes to shuffles, and its rows."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)
    stages = lambda: (x.apply(i) for x in [store.stageList(None, False, False, none, None)] for i in range(x.size()))
    seen = {s.stageId() for s in stages()}
    n = df.count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(s.shuffleWriteBytes() for s in stages() if s.stageId() not in seen), n


def test_what_links_shuffle_grows_with_the_ids(spark, monkeypatch):
    """Four times the ids are sixteen times the links, but not of what is shuffled to make them."""
    monkeypatch.setattr(resolve, "LINKS_PER_CELL", 1 << 14, raising=False)
    monkeypatch.setattr(resolve, "MOST_CELLS", 16, raising=False)
    imports = spark.createDataFrame([], "path string, imported_name string, alias string, line_number int")
    calls = spark.createDataFrame([("/1", "a", "a", 7)], "path string, name string, caller_name string, line_number int")
    bytes_of = {}
    for n in (1_500, 6_000):
        c = spark.range(n).select(F.xxhash64("id").alias("id"), F.lit("a").alias("name"), F.lit(None).cast("string").alias("repo_path"), F.array(F.lit("a")).alias("bases"), F.lit("/1").alias("path"), F.col("id").cast("int").alias("line_number"))
        symbols = c.select("name", "path", "line_number").withColumn("ord", F.struct("path", "line_number"))
        for kind, df in (("bases", resolve.link_bases(c, "bases", False)), ("calls", resolve.link_calls(calls, imports, c, symbols))):
            bytes_of[kind, n], found = _shuffled(spark, df)
            assert found == n * n
    for kind in ("bases", "calls"):
        assert bytes_of[kind, 6_000] < 6 * bytes_of[kind, 1_500], bytes_of


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from([None, *"12345"]), st.sampled_from(["a", "b", "c"]), st.sampled_from(["/1", "/2"]), st.integers(1, 40)), max_size=9),
    st.lists(st.tuples(st.sampled_from(["/1", "/2"]), st.sampled_from("abc"), st.sampled_from([None, "a", "b"]), st.sampled_from([None, 1, 2, 40])), max_size=9),
)
def test_links_of_calls_are_all_and_once(spark, functions, calls):
    f = spark.createDataFrame(functions, "id string, name string, path string, line_number int")
    c = spark.createDataFrame(calls, "path string, name string, caller_name string, line_number int")
    imports = spark.createDataFrame([], "path string, imported_name string, alias string, line_number int")
    symbols = f.where("name <> 'b'").select("name", "path", "line_number").withColumn("ord", F.struct("path", "line_number"))
    expected = set()
    for path, name, caller, line in calls:
        places = sorted((p == path, p, n) for _, x, p, n in functions if x == name and x != "b")
        if places:
            ends = [i for i, x, p, _ in functions if x == name and p == places[0][1]]
        else:
            ends = [min((n, j) for j, (_, x, p, n) in enumerate(functions) if (x, p) == (name, path))] if any((x, p) == (name, path) for _, x, p, _ in functions) else []
            ends = [functions[j][0] for _, j in ends]
        expected |= {(i, e, line) for i, x, p, _ in functions if caller is not None and (x, p) == (caller, path) for e in ends}
    found = rows(resolve.link_calls(c, imports, f, symbols))
    assert len(found) == len(set(found))
    lines = [n for *_, n in functions]
    if len(set(lines)) == len(lines):  # else which of two functions on a line is first is open
        assert set(found) == expected


def test_link_bases(spark):
    c = spark.createDataFrame([("1", "A", "/r", ["A", "B"]), ("2", "B", "/r", []), ("3", "B", "/q", None)], "id string, name string, repo_path string, bases array<string>")
    assert sorted(rows(resolve.link_bases(c, "bases", True))) == [("1", "2"), ("1", "3")]
    assert sorted(rows(resolve.link_bases(c, "bases", False))) == [("1", "1"), ("1", "2"), ("1", "3")]
    assert sorted(rows(resolve.link_bases(c, "bases", True, same_repo=True))) == [("1", "2")]


def test_search(spark):
    t = {k: spark.createDataFrame([], TABLES[k]) for k in TABLES}
    t["functions"] = spark.createDataFrame([("load user", "/a", 1), ("load_file", "/b", 2), ("save", "/c", 3)], "name string, path string, line_number int")
    assert [r["name"] for r in search.fulltext(t, "load FILE").collect()] == ["load_file", "load user"]
    assert [(r["name"], r["score"]) for r in search.fulltext(t, "_").collect()] == [("load_file", None)]
    assert rows(search.fulltext(t, "zzz")) == []


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, []), (5, None), (6, [0.0, 0.0])], "id int, embedding array<float>")
    out = rows(search.vector_topk(df, [2.0, 0.0], 10, order=("id",)).select("id", F.round("score", 4)))
    assert out == [(1, 1.0), (2, 0.8536), (3, 0.0)]
    e = vectors.HashingEmbedder(64)
    assert e("readFile") == e("read file") and abs(sum(x * x for x in e("abc")) - 1) < 1e-9 and e("") == []


@pytest.mark.parametrize("sql", ["CREATE TABLE x (a INT)", "INSERT INTO x VALUES (1)", "DROP TABLE x", "  drop view v", "TRUNCATE TABLE x", "SET a = 1", "WITH q AS (SELECT 1) INSERT INTO x SELECT * FROM q", "CREATE TEMP VIEW v AS SELECT 1"])
def test_read_only(spark, sql):
    with pytest.raises(PermissionError):
        search.read_only_sql(spark, sql)


def test_read_only_allows_queries(spark):
    assert rows(search.read_only_sql(spark, "SELECT :x + 1 AS y", {"x": 2})) == [(3,)]


def test_text_functions(spark):
    df = spark.createDataFrame([("/a/b.ts", "x" * 1600, ""), ("c", "", "n"), (None, None, None)], "p string, s string, n string")
    out = df.select(text.basename(F.col("p")), F.char_length(text.truncated(F.col("s"))), text.display_name(F.col("n"), F.col("p")), text.dirname(F.col("p")))
    assert rows(out) == [("b.ts", 1517, "b.ts", "/a"), ("c", None, "n", "c"), (None, None, "unknown", None)]
    kinds = spark.createDataFrame([(["Class", "Interface"],), (["Odd"],), ([],)], "l array<string>")
    assert rows(kinds.select(text.kind_of_label(F.col("l")))) == [("class",), ("unknown",), ("unknown",)]


def test_stats_and_deletion(spark):
    t = {k: spark.createDataFrame([], TABLES[k]) for k in TABLES}

    def table(name, *values):  # noqa: ANN001, ANN202
        cols = [x.split()[0] for x in TABLES[name].split(", ")]
        return spark.createDataFrame([tuple(v.get(c) for c in cols) for v in values], TABLES[name])

    t["repositories"] = table("repositories", {"path": "/r"}, {"path": "/q"})
    t["files"] = table("files", {"path": "/r/a", "repo_path": "/r"}, {"path": "/q/b", "repo_path": "/q"})
    t["functions"] = table("functions", {"id": "1", "name": "f", "path": "/r/a", "repo_path": "/r"}, {"id": "2", "name": "g", "path": "/q/b", "repo_path": "/q"})
    t["calls"] = table("calls", {"src_id": "2", "dst_id": "1", "repo_path": "/q"})
    t["imports"] = table("imports", {"path": "/r/a", "module": "m"}, {"path": "/q/b", "module": "n"})
    t["modules"] = table("modules", {"name": "m"}, {"name": "n"})
    assert rows(graph.stats(t)) == [(2, 2, 2, 0, 0, 2 + 2 + 1 + 2)]
    assert rows(graph.stats(t, "/q")) == [(1, 1, 1, 0, 0, 2)]
    left = t | graph.delete_repository(t, "/r")
    assert rows(graph.stats(left)) == [(1, 1, 1, 0, 0, 1 + 1 + 1)]
    assert rows(left["modules"]) == [("n",)] and rows(left["calls"]) == []


def test_combinations_of_gitignore():
    import re

    from repolens.sources.files import gitignore_regex

    cases = {("*.gen.ts", "a/b.gen.ts"): True, ("/x.ts", "x.ts"): True, ("/x.ts", "a/x.ts"): False, ("build/", "a/build/q.ts"): True, ("build/", "build"): False, ("a/**/c", "a/x/y/c"): True, ("a/**/c", "a/c"): True, ("docs/*.ts", "docs/a/b.ts"): False, ("[ab].ts", "b.ts"): True, ("[!ab].ts", "b.ts"): False}
    for (pattern, path), expected in cases.items():
        assert bool(re.search(gitignore_regex(pattern), path)) == expected, (pattern, path)
    assert list(itertools.chain.from_iterable([[gitignore_regex(x)] for x in ("", "# c")])) == [None, None]
