"""What read-only SQL refuses, and writing pattern queries that can't run."""

from __future__ import annotations

import pytest

from repolens.operators.search import read_only_sql
from repolens.plans import mutate
from repolens.plans.cypher import CypherError
from repolens.sources.store import SnapshotStore


def test_what_read_only_sql_refuses(spark):
    spark.range(3).createOrReplaceTempView("guarded")
    for text in (
        "SELECT reflect('java.lang.System', 'nanoTime')", "SELECT (SELECT java_method('java.lang.System', 'nanoTime'))", "WITH a AS (SELECT try_reflect('a', 'b') AS x) SELECT * FROM a",
        "SELECT id FROM guarded ORDER BY reflect('a', 'b')", "SELECT transform(array(1), v -> reflect('a', 'b')) FROM guarded", "SELECT unknown_to_spark(id) FROM guarded", "CACHE TABLE guarded",
        "EXECUTE IMMEDIATE 'DROP VIEW guarded'", "BEGIN SELECT 1; END", "SELECT TRANSFORM(id) USING 'cat' FROM guarded", "SELECT * FROM text.`/etc/hosts`", "DROP VIEW guarded",
    ):
        with pytest.raises(PermissionError):
            read_only_sql(spark, text)
    rows = read_only_sql(spark, "SELECT transform(array(id), v -> v + 1)[0] AS x, row_number() OVER (ORDER BY id) AS n FROM guarded WHERE id IN (SELECT max(id) FROM guarded)").collect()
    assert [tuple(r) for r in rows] == [(3, 1)]


def test_writing_that_cannot_be_done_changes_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    mutate.write(spark, store, "MERGE (m:Module {name: 'a'})")
    base = store.snapshot()
    for text in ("MATCH (m:Module) RETURN m.name", "MERGE (f:Function {name: 'x'})", "MATCH (m:Module) SET m.name = 'b'", "CREATE (m:Module {name: 'c'})", "MATCH (a:File), (b:Module) WHERE a.path = b.name MERGE (a)-[:IMPORTS]->(b)"):
        with pytest.raises(CypherError):
            mutate.write(spark, store, text)
    mutate.write(spark, store, "MERGE (m:Module {name: 'b'})", base=base)
    with pytest.raises(RuntimeError, match="another writer"):
        mutate.write(spark, store, "MATCH (m:Module) DETACH DELETE m", base=base)
    assert sorted(r["name"] for r in store.load("modules").collect()) == ["a", "b"]
    mutate.write(spark, store, "MATCH (m:Module {name: 'a'}) DELETE m")
    assert [r["name"] for r in store.load("modules").collect()] == ["b"]
