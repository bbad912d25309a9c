"""The registered queries of the engine's own operators and their SQL, over the projections of the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import text
from repolens.operators import analyze, graph, resolve, search
from repolens.operators.traverse import reachable
from repolens.plans import ask, cypher, describe
from repolens.plans.index import parse_files, prescan
from repolens.plans.projections import SQL, Projection
from repolens.sources.schema import TABLES
from repolens.streaming.watch import debounced

Query = Callable[[Projection], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NAME = "hot plate"
#: Calls of lines above this quantity make a sparse graph, in which some functions are never called.
SPARSE = 45


def query(sql: str, *parts: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query with its SQL, after the named projections."""
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = ("WITH " + "RECURSIVE " * recursive + ",\n".join([SQL[p] for p in parts]) + "\n" if parts else "") + sql
        return f

    return add


def sql_of(name: str) -> str:
    return _SQL[name]


def _chain(df: DataFrame) -> DataFrame:
    return df.select(F.col("length").cast("long").alias("length"), F.array_join("names", ">").alias("chain"))


@query("SELECT name, path, line_number, cyclomatic_complexity AS complexity FROM functions ORDER BY 4 DESC NULLS FIRST, 1, 2, 3 LIMIT 10", "functions")
def most_complex(p: Projection) -> DataFrame:
    return analyze.most_complex(p.functions(), 10)


@query("SELECT name, path, complexity FROM (SELECT name, path, cyclomatic_complexity AS complexity, line_number FROM functions WHERE contains(name, 'plate') ORDER BY 3 DESC NULLS FIRST, 1, 2, 4 LIMIT 20)", "functions")
def find_complexity(p: Projection) -> DataFrame:
    return analyze.find_complexity(p.functions(), "plate", 20)


@query(f"SELECT name, path, line_number, cyclomatic_complexity AS complexity FROM functions WHERE name = '{NAME}'", "functions")
def calculate_complexity(p: Projection) -> DataFrame:
    return analyze.calculate_complexity(p.functions(), NAME)


@query(f"""SELECT s.name AS caller_name, s.path AS caller_path, s.line_number AS caller_line, c.line_number AS call_line
  FROM calls c JOIN functions s ON s.id = c.src_id JOIN functions d ON d.id = c.dst_id WHERE d.name = '{NAME}' ORDER BY 2, 3, 1, 4 LIMIT 50""", "functions", "calls")
def callers(p: Projection) -> DataFrame:
    return analyze.find_callers(p.functions(), p.calls(), NAME, 50)


@query(f"""SELECT d.name AS callee_name, d.path AS callee_path, d.line_number AS callee_line, c.line_number AS call_line
  FROM calls c JOIN functions s ON s.id = c.src_id JOIN functions d ON d.id = c.dst_id WHERE s.name = '{NAME}' ORDER BY 2, 3, 1, 4 LIMIT 50""", "functions", "calls")
def callees(p: Projection) -> DataFrame:
    return analyze.find_callees(p.functions(), p.calls(), NAME, 50)


_WALK = """, walk(node, names, edges, length) AS (
    SELECT id, [name], CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM {nodes} WHERE name = '{name}'
    UNION ALL
    SELECT n.id, list_append(w.names, n.name), list_append(w.edges, concat_ws('>', e.src_id, e.dst_id, {line})), w.length + 1
    FROM walk w JOIN {edges} e ON e.src_id = w.node JOIN {nodes} n ON n.id = e.dst_id
    WHERE w.length < {depth} AND NOT list_contains(w.edges, concat_ws('>', e.src_id, e.dst_id, {line}))
  ) SELECT length, array_to_string(names, '>') AS chain FROM (SELECT * FROM walk WHERE length >= {least} ORDER BY length, names, edges {limit})"""


@query(_WALK.format(nodes="functions", edges="calls", line="e.line_number", name=NAME, depth=2, least=1, limit="LIMIT 200"), "functions", "calls", recursive=True)
def call_chain(p: Projection) -> DataFrame:
    return _chain(analyze.call_chain(p.functions(), p.calls(), NAME, 2, 200))


@query(_WALK.format(nodes="classes", edges="inherits", line="NULL", name="12_6", depth=10, least=0, limit=""), "classes", recursive=True)
def class_hierarchy(p: Projection) -> DataFrame:
    return _chain(analyze.class_hierarchy(p.classes(), p.inherits(), "12_6", 10))


@query("""SELECT name, path, line_number FROM functions WHERE (kind IS NULL OR kind <> 'constructor') AND id NOT IN (SELECT dst_id FROM calls) ORDER BY 2, 3, 1 LIMIT 50""", "functions", "sparse")
def dead_code(p: Projection) -> DataFrame:
    return analyze.dead_code(p.functions(), p.calls(SPARSE), 50)


@query("SELECT path, module, imported_name, line_number FROM imports WHERE imported_name = 'the' OR contains(module, 'the') ORDER BY 1, 4, 2, 3 LIMIT 50", "imports")
def find_importers(p: Projection) -> DataFrame:
    return analyze.find_importers(p.imports(), "the", 50)


@query("SELECT DISTINCT path, module FROM imports WHERE contains(path, 'example.org') ORDER BY 1, 2 LIMIT 200", "imports")
def module_deps(p: Projection) -> DataFrame:
    return analyze.module_deps(p.imports(), "example.org", 200)


@query("""SELECT CAST((SELECT count(*) FROM region) AS BIGINT) AS repositories, CAST((SELECT count(*) FROM files) AS BIGINT) AS files,
  CAST((SELECT count(*) FROM functions) AS BIGINT) AS functions, CAST((SELECT count(*) FROM classes) AS BIGINT) AS classes, CAST((SELECT count(*) FROM supplier) AS BIGINT) AS variables,
  CAST((SELECT count(*) FROM supplier) + (SELECT count(*) FROM files) + (SELECT count(*) FROM functions) + (SELECT count(*) FROM classes) + (SELECT count(*) FROM calls) + (SELECT count(*) FROM inherits) + (SELECT count(*) FROM imports) AS BIGINT) AS relationships""",
  "functions", "calls", "classes", "imports", "files")
def stats(p: Projection) -> DataFrame:
    return graph.stats(p.graph_tables())


@query("""SELECT CAST(1 AS BIGINT) AS repositories, CAST(count(*) FILTER (WHERE r_name = 'ASIA') AS BIGINT) AS files, CAST((SELECT count(*) FROM functions WHERE kind = 'economy') AS BIGINT) AS functions,
  CAST(0 AS BIGINT) AS classes, CAST(0 AS BIGINT) AS variables, CAST((SELECT count(*) FROM functions WHERE kind = 'economy') AS BIGINT) AS relationships FROM files""", "functions", "files")
def stats_of_repository(p: Projection) -> DataFrame:
    return graph.stats(p.graph_tables(), "/world/ASIA")


@query("""SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'Function' AS label FROM functions UNION ALL SELECT 'Class' FROM classes UNION ALL SELECT 'File' FROM files UNION ALL SELECT 'Repository' FROM region UNION ALL SELECT 'Variable' FROM supplier) GROUP BY 1""", "functions", "classes", "files")
def count_by_label(p: Projection) -> DataFrame:
    return graph.all_nodes(p.graph_tables()).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT '/world/' || r_name AS path, r_name AS name FROM region")
def list_repositories(p: Projection) -> DataFrame:
    return graph.list_repositories(p.graph_tables()["repositories"])


@query("SELECT path, CASE WHEN c.content_hash IS NULL THEN 'deleted' WHEN s.content_hash = c.content_hash THEN 'skipped' ELSE 'dirty' END AS state FROM current c FULL OUTER JOIN stored s USING (path)", "hashes")
def diff(p: Projection) -> DataFrame:
    return graph.diff(*p.hashes())


@query("""SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(c_name, s_name) AS name, coalesce(c_nationkey, s_nationkey) AS nation, s_acctbal AS balance
  FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey""")
def upsert_nodes(p: Projection) -> DataFrame:
    old = p.table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    new = p.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return graph.upsert_nodes(old, new, ["key"])


@query("SELECT DISTINCT o_custkey AS src_id, l_partkey AS dst_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = o_custkey JOIN part ON p_partkey = l_partkey")
def upsert_edges(p: Projection) -> DataFrame:
    o, li = p.table("orders"), p.table("lineitem")
    new = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    return graph.upsert_edges(new.limit(0), new, p.table("supplier").select(F.col("s_suppkey").alias("id")), p.table("part").select(F.col("p_partkey").alias("id")))


@query(""", reach(id) AS (SELECT id FROM functions WHERE path = 'Brand#1' UNION SELECT c.dst_id FROM reach r JOIN calls c ON c.src_id = r.id) SELECT id FROM reach""", "functions", "calls", recursive=True)
def reachability(p: Projection) -> DataFrame:
    return reachable(p.calls(), p.functions().where(F.col("path") == "Brand#1").select("id"))


@query("""SELECT id FROM classes c WHERE NOT EXISTS (SELECT 1 FROM classes s WHERE s.conv_id = c.conv_id AND s.path = 'assistant' AND s.turn % 5 = 3 AND c.turn <= s.turn)""", "classes")
def delete_closure(p: Projection) -> DataFrame:
    """What is left when some classes and all that they extend, directly or not, go."""
    c = p.classes()
    return graph.delete_reachable(c.select("id"), p.inherits(), c.where("path = 'assistant' AND turn % 5 = 3").select("id"))


@query("""SELECT src_id, dst_id, line_number FROM calls WHERE src_id NOT IN (SELECT id FROM functions WHERE path = 'Brand#1') AND dst_id NOT IN (SELECT id FROM functions WHERE path = 'Brand#1')""", "functions", "calls")
def delete_file_edges(p: Projection) -> DataFrame:
    t = p.graph_tables()
    return graph.delete_files(t, t["functions"].where(F.col("path") == "Brand#1").select("path").distinct())["calls"].select("src_id", "dst_id", "line_number")


@query("""SELECT DISTINCT path, parent_path, name, CAST(depth AS INTEGER) AS depth FROM (
  SELECT '/world' AS path, NULL AS parent_path, 'world' AS name, 0 AS depth FROM files UNION ALL SELECT '/world/' || r_name, '/world', r_name, 1 FROM files
  UNION ALL SELECT '/world/' || r_name || '/' || n_name, '/world/' || r_name, n_name, 2 FROM files)""", "files")
def dir_hierarchy(p: Projection) -> DataFrame:
    return graph.directory_tree(p.files(), "/world")


@query("""SELECT '/world/' || r_name || '/' || n_name AS dir_path, CAST(count(*) AS BIGINT) AS n_files, sha256(string_agg(c_name, chr(10) ORDER BY c_name)) AS list_hash FROM files GROUP BY 1""", "files")
def dir_groups(p: Projection) -> DataFrame:
    return graph.directory_groups(p.files()).select("dir_path", "n_files", "list_hash")


_RANKED = ["functions", "calls", "named_imports", "parsed_calls", "resolved"]


@query("SELECT path, name, resolved_path, resolved_line FROM resolved", *_RANKED)
def resolve_symbol(p: Projection) -> DataFrame:
    asked = p.parsed_calls().select("path", "name").distinct()
    return resolve.resolve_symbols(asked, p.named_imports(), p.symbols()).select("path", "name", "resolved_path", "resolved_line")


@query("""SELECT DISTINCT s.id AS src_id, d.id AS dst_id, c.line_number FROM parsed_calls c JOIN resolved r USING (path, name)
  JOIN functions s ON s.path = c.path AND s.name = c.caller_name JOIN functions d ON d.path = r.resolved_path AND d.name = c.name""", "functions", "calls", "named_imports", "parsed_calls", "resolved")
def link_calls(p: Projection) -> DataFrame:
    return resolve.link_calls(p.parsed_calls(), p.named_imports(), p.functions(), p.symbols())


@query("""SELECT DISTINCT a.id AS src_id, b.id AS dst_id FROM functions a JOIN functions b ON b.name = string_split(a.name, ' ')[1] || ' widget' WHERE a.id <> b.id""", "functions")
def link_inherits(p: Projection) -> DataFrame:
    base = F.concat(F.substring_index("name", " ", 1), F.lit(" widget"))
    classes = p.functions().select("id", "name", F.lit(None).cast("string").alias("repo_path"), F.array(base).alias("bases"))
    return resolve.link_bases(classes, "bases", True)


@query(r"""SELECT docs.label, docs.name, docs.path, docs.line_number, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * docs.len / n.mean))), 6) AS score
  FROM (SELECT *, len(words) AS len FROM docs0) docs JOIN (SELECT label, name, path, line_number, term, count(*) AS tf FROM (SELECT label, name, path, line_number, unnest(words) AS term FROM docs0) GROUP BY ALL) t
    USING (label, name, path, line_number) JOIN (SELECT term, count(DISTINCT (label, name, path, line_number)) AS df FROM (SELECT label, name, path, line_number, unnest(words) AS term FROM docs0) GROUP BY 1) df USING (term),
    (SELECT count(*) AS n, avg(len(words)) AS mean FROM docs0) n
  WHERE term IN ('hot', 'plate') GROUP BY docs.label, docs.name, docs.path, docs.line_number ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 100""", "functions", "classes")
def fulltext(p: Projection) -> DataFrame:
    out = search.fulltext(p.graph_tables(), NAME, 100)
    return out.select(F.element_at("labels", 1).alias("label"), "name", "path", "line_number", F.round("score", 6).alias("score"))


_SQL["fulltext"] = _SQL["fulltext"].replace("\nSELECT docs.label", r""", docs0 AS (SELECT *, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS words
  FROM (SELECT 'Function' AS label, name, path, line_number FROM functions UNION ALL SELECT 'Class', name, path, line_number FROM classes UNION ALL SELECT 'Variable', s_name, 'Supplier', s_suppkey FROM supplier))
SELECT docs.label""", 1)


@query("""SELECT label, name, path, line_number, CAST(NULL AS DOUBLE) AS score FROM (SELECT 'Function' AS label, name, path, line_number FROM functions UNION ALL SELECT 'Class', name, path, line_number FROM classes UNION ALL SELECT 'Variable', s_name, 'Supplier', s_suppkey FROM supplier)
  WHERE contains(name, 'pla') ORDER BY 1, 2, 3, 4 LIMIT 100""", "functions", "classes")
def contains_search(p: Projection) -> DataFrame:
    out = search.contains_search(search.symbols(p.graph_tables()), "pla", 100)
    return out.select(F.element_at("labels", 1).alias("label"), "name", "path", "line_number", "score")


@query("""SELECT vec_id, label, round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))) / 2, 6) AS score
  FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) DESC, vec_id LIMIT 10""")
def vector_topk(p: Projection) -> DataFrame:
    e = p.table("embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    return search.vector_topk(e, list(first[0]), 10, order=("vec_id",)).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""SELECT path, arg_max(op, (ts, event_id)) AS op, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, CAST(count(*) AS BIGINT) AS n_events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS session FROM (
    SELECT 'user/' || user_id AS path, event_type AS op, ts, event_id,
      CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY path, session""")
def watch_sessions(p: Projection) -> DataFrame:
    out = debounced(p.events(), "2 hours")
    return out.select("path", "op", F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "n_events")


@query("""SELECT f.name, f.path, array_to_string(list_sort((SELECT list(DISTINCT d.name) FROM calls c JOIN functions d ON d.id = c.dst_id WHERE c.src_id = f.id))[1:5], ', ') AS callees,
  array_to_string(list_sort((SELECT list(DISTINCT s.name) FROM calls c JOIN functions s ON s.id = c.src_id WHERE c.dst_id = f.id))[1:5], ', ') AS callers, f.source
  FROM (SELECT *, row_number() OVER (PARTITION BY name, path ORDER BY line_number) AS nth FROM functions) f WHERE nth = 1""", "functions", "calls")
def enrich_function(p: Projection) -> DataFrame:
    t = p.graph_tables()
    results = p.functions().select(F.lit("function").alias("kind"), "name", "path").distinct()
    none = {k: t[k].limit(0).withColumn("source", F.lit(None).cast("string")) if k == "classes" else t[k].limit(0) for k in ("classes", "inherits", "implements")}
    out = ask.enrich(results, t | none)
    return out.select("name", "path", F.array_join("callees", ", ").alias("callees"), F.array_join("callers", ", ").alias("callers"), "source")


@query("""SELECT c.name, c.path, (SELECT string_agg(DISTINCT d.name, ', ') FROM inherits i JOIN classes d ON d.id = i.dst_id WHERE i.src_id = c.id) AS parents FROM classes c""", "classes")
def enrich_class(p: Projection) -> DataFrame:
    t = p.graph_tables()
    t["classes"] = t["classes"].withColumn("source", F.lit(None).cast("string"))
    none = {k: p.spark.createDataFrame([], TABLES[k]) for k in ("functions", "calls")}
    results = p.classes().select(F.lit("class").alias("kind"), "name", "path").distinct()
    return ask.enrich(results, t | none).select("name", "path", F.array_join("parents", ", ").alias("parents"))


@query("""SELECT '/src/' || p_partkey || '.js' AS path, 'f' || p_partkey AS name, 3 AS line_number, 5 + p_size AS end_line, 'a,b,...c' AS args, 1 + p_size AS complexity, NULL AS kind, NULL AS class_context FROM part
  UNION ALL SELECT '/src/' || p_partkey || '.js', 'run', 6 + p_size, 6 + p_size, '', 2, NULL, 'C' || p_partkey FROM part""")
def parse_functions(p: Projection) -> DataFrame:
    f = parse_files(p.sources(), only=("functions",)).select("path", F.explode("functions").alias("f"))
    return f.select("path", "f.name", "f.line_number", "f.end_line", F.array_join("f.args", ",").alias("args"), F.col("f.cyclomatic_complexity").alias("complexity"), "f.kind", "f.class_context")


@query("""SELECT '/src/' || p_partkey || '.js' AS path, 'C' || p_partkey AS name, upper(p_type[1]) || lower(p_type[2:]) AS bases, 6 + p_size AS line_number FROM part""")
def parse_classes(p: Projection) -> DataFrame:
    c = parse_files(p.sources(), only=("classes",)).select("path", F.explode("classes").alias("c"))
    return c.select("path", "c.name", F.array_join("c.bases", ",").alias("bases"), "c.line_number")


@query("""SELECT '/src/' || p_partkey || '.js' AS path, 'g' || p_partkey AS name, 'g' || p_partkey AS full_call_name, 'f' || p_partkey AS caller_name, 4 + p_size AS line_number FROM part
  UNION ALL SELECT '/src/' || p_partkey || '.js', 'f' || p_partkey, 'this.f' || p_partkey, 'run', 6 + p_size FROM part""")
def parse_calls(p: Projection) -> DataFrame:
    c = parse_files(p.sources(), only=("calls",)).select("path", F.explode("calls").alias("c"))
    return c.select("path", "c.name", "c.full_call_name", "c.caller_name", "c.line_number")


@query("""SELECT '/src/' || p_partkey || '.js' AS path, replace(p_name, ' ', '_') AS name, './' || lower(p_type) AS source, 1 AS line_number FROM part""")
def parse_imports(p: Projection) -> DataFrame:
    i = parse_files(p.sources(), only=("imports",)).select("path", F.explode("imports").alias("i"))
    return i.select("path", "i.name", "i.source", "i.line_number")


@query("""SELECT 'f' || p_partkey AS name, '/src/' || p_partkey || '.js' AS path, 3 AS line_number FROM part UNION ALL SELECT 'C' || p_partkey, '/src/' || p_partkey || '.js', 6 + p_size FROM part""")
def prescan_symbols(p: Projection) -> DataFrame:
    return prescan(parse_files(p.sources(), only=("functions", "classes")))


@query("""SELECT '/src/' || s_suppkey || '.php' AS path, 'make' AS name, 'static' AS kind, 'S' || s_suppkey AS class_context, '$a,...$b' AS args, 1 + 2 * s_nationkey AS complexity, 'Base' AS bases, 'Api' AS implements,
  'App\\Models\\M' || s_suppkey AS import_source, 'new M' || s_suppkey AS call, CAST(s_nationkey AS VARCHAR) AS constant FROM supplier""".replace("\\\\", "\\"))
def parse_php(p: Projection) -> DataFrame:
    one = lambda c: F.element_at(c, 1)
    f, c, i, k, v = (one(F.col(x)) for x in ("functions", "classes", "imports", "calls", "variables"))
    return parse_files(p.php_sources()).select(
        "path", f["name"].alias("name"), f["kind"].alias("kind"), f["class_context"].alias("class_context"), F.array_join(f["args"], ",").alias("args"),
        f["cyclomatic_complexity"].alias("complexity"), F.array_join(c["bases"], ",").alias("bases"), F.array_join(c["implements"], ",").alias("implements"),
        i["source"].alias("import_source"), k["full_call_name"].alias("call"), v["value"].alias("constant"),
    )


@query("""SELECT doc_id, sha256(text) AS content_hash, CASE WHEN length(text) > 1500 THEN text[1:1500] || chr(10) || '// ... truncated' WHEN text = '' THEN NULL ELSE text END AS short FROM documents""")
def truncated_sources(p: Projection) -> DataFrame:
    return p.table("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), text.truncated(F.col("text")).alias("short"))


@query("""SELECT path, 'Say in one or two plain sentences what this code is for.' || chr(10) || chr(10) || 'File: ' || path || chr(10) || 'Symbol: function ' || name || chr(10) || chr(10) || 'Code:' || chr(10) || source[1:2000] AS prompt, id FROM functions""", "functions")
def symbol_prompts(p: Projection) -> DataFrame:
    prompt = describe.symbol_prompt(F.lit("function"), F.col("name"), F.col("path"), F.col("source"))
    return p.functions().select("path", prompt.alias("prompt"), "id")


@query("""SELECT event_id, split_part('user/' || user_id || '/' || event_type, '/', 3) AS base, 'user/' || user_id AS dir, printf('%.3f', value) AS shown FROM events""")
def path_functions(p: Projection) -> DataFrame:
    path = F.concat_ws("/", F.lit("user"), F.col("user_id").cast("string"), "event_type")
    return p.table("events").select("event_id", text.basename(path).alias("base"), text.dirname(path).alias("dir"), text.fixed(F.col("value"), 3).alias("shown"))


@query(_SQL["callers"])
def cypher_callers(p: Projection) -> DataFrame:
    text = """MATCH (caller:Function)-[r:CALLS]->(f:Function {name: $name})
      RETURN caller.name AS caller_name, caller.path AS caller_path, caller.line_number AS caller_line, r.line_number AS call_line
      ORDER BY caller_path, caller_line, caller_name, call_line LIMIT 50"""
    return cypher.run(p.spark, p.graph_tables(), text, {"name": NAME})


@query("SELECT length, replace(chain, '>', ' < ') AS hierarchy FROM (" + _SQL["class_hierarchy"] + ")")
def cypher_hierarchy(p: Projection) -> DataFrame:
    text = "MATCH path = (c:Class {name: '12_6'})-[:INHERITS*0..6]->(x:Class) RETURN length(path) AS length, [n IN nodes(path) | n.name] AS names"
    return cypher.run(p.spark, p.graph_tables(), text).select(F.col("length").cast("long"), F.array_join("names", " < ").alias("hierarchy"))


@query("""SELECT f.name, CAST(count(DISTINCT d.id) AS BIGINT) AS n_callees FROM functions f LEFT JOIN calls c ON c.src_id = f.id AND c.line_number = 1 LEFT JOIN functions d ON d.id = c.dst_id
  WHERE f.kind IS NULL OR f.kind <> 'constructor' GROUP BY f.name""", "functions", "calls")
def cypher_optional(p: Projection) -> DataFrame:
    text = """MATCH (f:Function) WHERE f.kind IS NULL OR f.kind <> 'constructor' OPTIONAL MATCH (f)-[r:CALLS]->(d:Function) WHERE r.line_number = 1
      RETURN f.name AS name, count(DISTINCT d.id) AS n_callees"""
    return cypher.run(p.spark, p.graph_tables(), text)


@query("SELECT name, path, line_number FROM functions WHERE (kind IS NULL OR kind <> 'constructor') AND id NOT IN (SELECT dst_id FROM calls)", "functions", "sparse")
def cypher_dead_code(p: Projection) -> DataFrame:
    tables = p.graph_tables() | {"calls": p.calls(SPARSE)}
    text = "MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) AND (f.kind IS NULL OR f.kind <> 'constructor') RETURN f.name AS name, f.path AS path, f.line_number AS line_number"
    return cypher.run(p.spark, tables, text)


def _all() -> None:
    """Register the queries of the other modules, which use what is above."""
    from repolens import queries_source, queries_store  # noqa: F401, PLC0415


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return {name: (lambda spark, sf_dir, f=f: f(Projection(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
