from __future__ import annotations

import pytest

from repolens.plans.cypher import CypherError, run
from repolens.sources.schema import TABLES


@pytest.fixture(scope="module")
def tables(spark):  # noqa: ANN001, ANN201
    def table(name, *values):  # noqa: ANN001, ANN202
        cols = [x.split()[0] for x in TABLES[name].split(", ")]
        return spark.createDataFrame([tuple(v.get(c) for c in cols) for v in values], TABLES[name])

    t = {k: spark.createDataFrame([], TABLES[k]) for k in TABLES}
    f = lambda name, path, line, c, kind=None: {"id": f"{path}#{name}#{line}", "name": name, "path": path, "line_number": line, "cyclomatic_complexity": c, "kind": kind, "repo_path": "/r"}
    t["functions"] = table("functions", f("a", "/1", 1, 3), f("b", "/1", 5, None, "getter"), f("c", "/2", 1, 2), f("d", "/2", 9, 1, "constructor"))
    call = lambda s, d, n: {"src_id": s, "dst_id": d, "line_number": n, "repo_path": "/r"}
    t["calls"] = table("calls", call("/1#a#1", "/1#b#5", 2), call("/1#a#1", "/1#b#5", 3), call("/1#b#5", "/2#c#1", 6), call("/2#c#1", "/1#a#1", 2))
    t["files"] = table("files", {"path": "/1", "name": "1", "repo_path": "/r"}, {"path": "/2", "name": "2", "repo_path": "/r"})
    t["imports"] = table("imports", {"path": "/1", "module": "m", "imported_name": "c", "line_number": 1})
    t["modules"] = table("modules", {"name": "m"})
    t["classes"] = table("classes", {"id": "k", "name": "K", "path": "/1", "is_interface": True}, {"id": "l", "name": "L", "path": "/2", "is_interface": False})
    t["implements"] = table("implements", {"src_id": "l", "dst_id": "k"})
    t["parameters"] = table("parameters", {"name": "x", "function_name": "a", "path": "/1", "line_number": 1})
    return t


CASES = [
    ("MATCH (x:Function)-[r:CALLS]->(f:Function {name: $n}) RETURN x.name AS x, r.line_number AS l ORDER BY l", [("a", 2), ("a", 3)]),
    ("MATCH (f:Function)<-[:CALLS]-(x:Function {name: 'b'}) RETURN f.name", [("c",)]),
    ("MATCH p = (s:Function {name: 'a'})-[:CALLS*1..2]->(e:Function) RETURN [n IN nodes(p) | n.name] AS chain, length(p) AS n ORDER BY n, chain", [(["a", "b"], 1), (["a", "b"], 1), (["a", "b", "c"], 2), (["a", "b", "c"], 2)]),
    ("MATCH p = (s:Function {name: 'd'})-[:CALLS*0..3]->(e:Function) RETURN [n IN nodes(p) WHERE n.line_number > 1 | n.name] AS chain", [(["d"],)]),
    ("MATCH (a:Function)-[:CALLS]->(b:Function)-[:CALLS]->(c:Function)-[:CALLS]->(a) RETURN a.name AS a ORDER BY a DESC", [("c",), ("c",), ("b",), ("b",), ("a",), ("a",)]),
    ("MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) RETURN f.name", [("d",)]),
    ("MATCH (f:Function) WHERE (f)-[:CALLS]->() AND f.path = '/1' RETURN f.name AS n ORDER BY n", [("a",), ("b",)]),
    ("MATCH (f:Function) WHERE f.kind IS NULL OR f.kind <> 'constructor' RETURN f.name AS n, f.cyclomatic_complexity AS c ORDER BY c DESC, n", [("b", None), ("a", 3), ("c", 2)]),
    ("MATCH (f:Function) RETURN f.name AS n ORDER BY f.cyclomatic_complexity, n SKIP 1 LIMIT toInteger(2)", [("c",), ("a",)]),
    ("MATCH (f:Function) OPTIONAL MATCH (f)-[:CALLS]->(c:Function) WITH f, collect(DISTINCT c.name)[..5] AS out RETURN f.name AS n, out ORDER BY n", [("a", ["b"]), ("b", ["c"]), ("c", ["a"]), ("d", [])]),
    ("MATCH (f:Function) WITH f.path AS path, count(*) AS n WHERE n > 1 RETURN DISTINCT n", [(2,)]),
    ("MATCH (n) WHERE (n:Function OR n:Class) AND n.name IN ['a', 'L'] RETURN labels(n) AS l, n.name AS n ORDER BY n", [(["Class"], "L"), (["Function"], "a")]),
    ("MATCH (i:Interface) RETURN i.name", [("K",)]),
    ("MATCH (c:Class)-[:IMPLEMENTS]->(i:Interface) RETURN c.name, i.name", [("L", "K")]),
    ("MATCH (f:File)-[r:IMPORTS]->(m:Module) WHERE r.imported_name = 'zz' OR m.name CONTAINS 'm' RETURN f.path, m.name, r.imported_name", [("/1", "m", "c")]),
    ("MATCH (f:Function)-[:HAS_PARAMETER]->(p) RETURN f.name, p.name", [("a", "x")]),
    ("MATCH (f:File)-[:CONTAINS]->(x:Function) RETURN f.path AS p, count(x) AS n ORDER BY p", [("/1", 2), ("/2", 2)]),
    ("MATCH (n)-[r]->() RETURN type(r) AS t, count(r) AS c ORDER BY t", [("CALLS", 4), ("CONTAINS", 6), ("HAS_PARAMETER", 1), ("IMPLEMENTS", 1), ("IMPORTS", 1)]),
    ("MATCH (a:Function {name: 'a'}), (d:Function {name: 'd'}) RETURN a.name, d.name", [("a", "d")]),
    ("MATCH (f:Function {name: 'a'})-[:CALLS]-(x:Function) RETURN DISTINCT x.name AS x ORDER BY x", [("b",), ("c",)]),
    ("MATCH (f:Function) WHERE f.name STARTS WITH 'a' OR f.name ENDS WITH 'd' OR f.name =~ '[c]' RETURN count(*) AS n", [(3,)]),
    ("UNWIND [1, 2] AS x RETURN x * 2 + 1 AS y, CASE WHEN x > 1 THEN 'big' ELSE 'small' END AS z", [(3, "small"), (5, "big")]),
    ("RETURN 1 AS ok UNION RETURN 1 AS ok", [(1,)]),
    ("CALL db.index.fulltext.queryNodes('code_search', 'a') YIELD node, score RETURN node.name AS n", [("a",)]),
    ("MATCH (f:Function) WHERE f.`name` = 'a' // a comment\nRETURN f.name AS n", [("a",)]),
    ("MATCH (f:Nothing) RETURN f.name", []),
    ("CALL { MATCH (f:Function {name: 'a'}) RETURN f UNION MATCH (f:Function {name: 'b'}) RETURN f } RETURN f.name AS n, labels(f)[0] AS l ORDER BY n", [("a", "Function"), ("b", "Function")]),
    ("CALL { RETURN 1 AS x UNION ALL RETURN 1 AS x UNION ALL RETURN 2 AS x } RETURN x, count(*) AS n ORDER BY x", [(1, 2), (2, 1)]),
    ("MATCH (f:Function), (g:Function) WHERE f.line_number = g.line_number AND f.path = g.path AND f.name = 'a' RETURN g.name", [("a",)]),
    ("CALL db.index.vector.queryNodes('variable_embeddings', 3, [1.0, 0.0]) YIELD node, score RETURN node.name AS n", []),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_queries(spark, tables, text, expected):
    assert [tuple(r) for r in run(spark, tables, text, {"n": "b"}).collect()] == expected


def test_whole_nodes(spark, tables):
    row = run(spark, tables, "MATCH (f:Function {name: 'a'}) RETURN f").first()["f"].asDict()
    assert row["labels"] == ["Function"] and row["line_number"] == 1 and "_id" not in row


@pytest.mark.parametrize("text", ["CALL { MATCH (f:Function) DELETE f RETURN 1 AS x } RETURN x", "MATCH (f) DETACH DELETE f", "CREATE (f:Function)", "MERGE (f:Function {name: 'x'})", "MATCH (f:Function) SET f.x = 1", "match (f) remove f.x", "MATCH (f) DELETE f RETURN 1"])
def test_writes_are_refused(spark, tables, text):
    with pytest.raises(PermissionError):
        run(spark, tables, text)


@pytest.mark.parametrize("text", ["MATCH (f:Function), (g:Function) RETURN count(*) AS n", "MATCH (f:Function), (g:Function) WHERE f.line_number < g.line_number RETURN f.name", "CALL { RETURN 1 AS x", "CALL db.index.vector.queryNodes('no_such_index', 3, [1.0]) YIELD node RETURN node", "", "MATCH (f:Function)", "MATCH (f:Function) RETURN x", "MATCH (f:Function) RETURN nosuch(f)", "MATCH (f:Function) WHERE f.name = $missing RETURN f", "MATCH (f RETURN f", "MATCH (f:Function)-[:CALLS*1..99]->(g) RETURN g", "RETURN 1 2", "MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) OR f.name = 'a' RETURN f"])
def test_errors(spark, tables, text):
    with pytest.raises(CypherError):
        run(spark, tables, text)


def test_unbounded_paths_are_whole(spark, tables):
    """A chain of 18 calls: all its trails, none cut at 15 edges."""
    functions = [{"id": str(i), "name": f"f{i}", "path": "/c", "line_number": i} for i in range(19)]
    calls = [{"src_id": str(i), "dst_id": str(i + 1), "line_number": 1} for i in range(18)]
    make = lambda name, rows: spark.createDataFrame([tuple(r.get(x.split()[0]) for x in TABLES[name].split(", ")) for r in rows], TABLES[name]).coalesce(1)
    t = tables | {"functions": make("functions", functions), "calls": make("calls", calls)}
    for pattern, lengths in (("*", range(1, 19)), ("*17..", (17, 18)), ("*19..", ())):
        out = run(spark, t, f"MATCH p = (s:Function {{name: 'f0'}})-[:CALLS{pattern}]->(e:Function) RETURN length(p) AS n, e.name AS e").collect()
        assert sorted(tuple(r) for r in out) == [(n, f"f{n}") for n in lengths]
    with pytest.raises(CypherError):
        run(spark, t, "MATCH (s:Function {name: 'f0'})-[:CALLS*..16]->(e:Function) RETURN e.name AS e")


def test_full_text_procedure_has_no_hidden_limit(spark, tables):
    """1,500 hits, of which WHERE keeps those that a limit of 1,000 could lose."""
    rows = [{"id": str(i), "name": f"load item {i}", "path": f"/p{i % 3}", "line_number": i} for i in range(1500)]
    t = tables | {"functions": spark.createDataFrame([tuple(r.get(x.split()[0]) for x in TABLES["functions"].split(", ")) for r in rows], TABLES["functions"])}
    text = "CALL db.index.fulltext.queryNodes('code_search', 'load') YIELD node, score WITH node, score WHERE node.line_number % 2 = 0 RETURN count(*) AS n"
    assert run(spark, t, text).first()["n"] == 750
    assert run(spark, t, "CALL db.index.fulltext.queryNodes('code_search', 'load') YIELD node RETURN node.name AS n").count() == 1500


def test_vector_search_over_all_labels(spark, tables):
    """The union of the five indexes in one query, as the facade's own search gives it."""
    from repolens.operators.search import vector_search

    def make(name, rows):  # noqa: ANN001, ANN202
        return spark.createDataFrame([tuple(r.get(x.split()[0]) for x in TABLES[name].split(", ")) for r in rows], TABLES[name])

    own = {
        "functions": [{"id": str(i), "name": f"f{i}", "path": "/a", "line_number": i, "embedding": [1.0, i / 10]} for i in range(5)],
        "classes": [{"id": "c", "name": "C", "path": "/a", "line_number": 1, "is_interface": False, "embedding": [1.0, -0.05]}],
        "variables": [{"id": "v", "name": "v", "path": "/b", "line_number": 2, "embedding": [1.0, 0.01], "description": "a value"}],
        "files": [{"path": "/x/y.js", "name": "", "embedding": [0.0, 1.0]}], "directories": [{"path": "/x", "name": "x", "embedding": [1.0, 0.3]}],
    }
    t = tables | {k: make(k, v) for k, v in own.items()}
    names = ("function", "class", "variable", "file", "directory")
    text = "CALL { " + " UNION ".join(f"CALL db.index.vector.queryNodes('{n}_embeddings', $limit, $v) YIELD node, score RETURN node, score" for n in names)
    text += " } RETURN node.name AS name, labels(node) AS labels, node.path AS path, score ORDER BY score DESC LIMIT 4"
    made = [(r["name"], r["labels"], r["path"], r["score"]) for r in run(spark, t, text, {"limit": 3, "v": [1.0, 0.0]}).collect()]
    found = vector_search(t, [1.0, 0.0], 4).collect()
    assert [(m[0], m[1][0].lower(), m[2]) for m in made] == [(r["name"], r["kind"], r["path"]) for r in found]
    assert [m[0] for m in made] == ["f0", "v", "C", "f1"] and made[0][3] == pytest.approx(1.0)
    assert vector_search(t, [0.0, 1.0], 1).first()["name"] == "y.js"
