"""Registered queries of extraction and indexing, over source files made from the standard tables.

What a parser must find in a file is stated in SQL from the template of that file, row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators import graph
from repolens.plans.index import parse_files, prescan, tables_of
from repolens.plans.projections import CODE_ROOT, Projection
from repolens.queries import query
from repolens.sources.files import ignored, language

#: The path of a supplier's file, its key and the lines that fill it up.
_FILE = "SELECT '/code/' || s_nationkey || '/s' || s_suppkey || '.{ext}' AS path, CAST(s_suppkey AS VARCHAR) AS k, s_nationkey AS n FROM supplier"
_TS, _PHP = _FILE.format(ext="ts"), _FILE.format(ext="php")


def _exploded(sources: DataFrame, column: str, is_dependency: bool = False) -> DataFrame:
    return parse_files(sources, is_dependency, (column,)).select("path", F.explode(column).alias("x")).select("path", "x.*")


# -- TypeScript ---------------------------------------------------------------------------------------

#: name, line after the filling, args, docstring, complexity, context, class, async, kind; # stands for the key.
_TS_FUNCTIONS = """(VALUES ('outer#', 25, 'x', NULL, 2, NULL, NULL, false, NULL), ('inner#', 25, 'y', NULL, 2, 'outer#', NULL, false, NULL), ('arrow#', 21, 'a,b', NULL, 2, NULL, NULL, true, NULL),
  ('lost', 25, 'z', NULL, 1, 'outer#', NULL, false, NULL), ('constructor', 13, 'label,n', NULL, 1, NULL, 'Figure#', false, 'constructor'), ('title', 14, '', NULL, 1, NULL, 'Figure#', false, 'getter'),
  ('title', 15, 'v', NULL, 1, NULL, 'Figure#', false, 'setter'), ('of', 16, '...xs', NULL, 1, NULL, 'Figure#', false, 'static'),
  ('draw', 18, 'pen,scale', '/** Draws. */', 3, NULL, 'Figure#', true, NULL), ('go', 24, '', NULL, 1, NULL, 'Made#', false, NULL)) v(name, line, args, doc, cx, ctx, cls, isa, kind)"""


@query(f"""SELECT path, replace(name, '#', k) AS name, line + n AS line_number, line + n AS end_line, args, doc AS docstring, cx AS complexity, replace(ctx, '#', k) AS context, replace(cls, '#', k) AS class_context, isa AS is_async, kind
  FROM ({_TS}) s, {_TS_FUNCTIONS}""")
def parse_ts_functions(p: Projection) -> DataFrame:
    f = _exploded(p.ts_sources(), "functions")
    return f.select("path", "name", "line_number", "end_line", F.array_join("args", ",").alias("args"), "docstring", F.col("cyclomatic_complexity").alias("complexity"), "context", "class_context", "is_async", "kind")


@query(f"""SELECT path, replace(name, '#', k) AS name, replace(replace(bases, '#', k), '%', CAST(n AS VARCHAR)) AS bases, replace(implements, '#', k) AS implements, replace(doc, '#', k) AS docstring, abstract AS is_abstract, interface AS is_interface, low + n AS line_number, high + n AS end_line
  FROM ({_TS}) s, (VALUES ('Shape#', 'Base%,Named', '', '/** Shape number #. */', false, true, 6, 8), ('Figure#', 'Root%', 'Shape#,Comparable', '/** Figure #. */', true, false, 11, 20),
    ('Made#', 'Figure#', '', NULL, false, false, 24, 24)) v(name, bases, implements, doc, abstract, interface, low, high)""")
def parse_ts_classes(p: Projection) -> DataFrame:
    c = _exploded(p.ts_sources(), "classes")
    return c.select("path", "name", F.array_join("bases", ",").alias("bases"), F.array_join("implements", ",").alias("implements"), "docstring", "is_abstract", "is_interface", "line_number", "end_line")


_TS_VARIABLES = """(VALUES ('fs#', 'require(''fs'')', 'const', 4, 0), ('Id#', 'string | number', 'type', 9, 1), ('bound#', '%', 'const', 22, 1), ('note#', '"x#"', 'let', 23, 1)) v(name, value, type, line, after)"""


@query(f"SELECT path, replace(name, '#', k) AS name, replace(replace(value, '#', k), '%', CAST(n AS VARCHAR)) AS value, type, line + after * n AS line_number, CAST(NULL AS VARCHAR) AS context FROM ({_TS}) s, {_TS_VARIABLES}")
def parse_ts_variables(p: Projection) -> DataFrame:
    return _exploded(p.ts_sources(), "variables").select("path", "name", "value", "type", "line_number", "context")


@query(f"""SELECT path, replace(name, '#', k) AS name, source, alias, line AS line_number, is_default, is_namespace FROM ({_TS}) s,
  (VALUES ('Kind#', './kinds', NULL, 1, false, false), ('base#', '../lib/small', NULL, 2, true, false), ('beta#', '../lib/small', 'alpha', 2, false, false), ('ns#', 'ns-small', NULL, 3, false, true),
    ('fs#', 'fs', NULL, 4, false, false)) v(name, source, alias, line, is_default, is_namespace)""")
def parse_ts_imports(p: Projection) -> DataFrame:
    return _exploded(p.ts_sources(), "imports").select("path", "name", "source", "alias", "line_number", "is_default", "is_namespace")


@query(f"""SELECT path, replace(name, '#', k) AS name, replace(full_name, '#', k) AS full_call_name, args, replace(caller, '#', k) AS caller_name, line + n AS caller_line_number, line + n AS line_number, replace(obj, '#', k) AS inferred_obj_type FROM ({_TS}) s,
  (VALUES ('Leaf#', 'new Leaf#', 'xs[0]', 'of', 16, NULL), ('paint', 'pen.paint', 'scale', 'draw', 18, 'pen'), ('tidy', 'ns#.tidy', 'a', 'arrow#', 21, 'ns#'), ('inner#', 'inner#', 'z', 'outer#', 25, NULL),
    ('inner#', 'inner#', 'x', 'outer#', 25, NULL)) v(name, full_name, args, caller, line, obj)""")
def parse_ts_calls(p: Projection) -> DataFrame:
    c = _exploded(p.ts_sources(), "calls")
    return c.select("path", "name", "full_call_name", F.array_join("args", ",").alias("args"), "caller_name", "caller_line_number", "line_number", "inferred_obj_type")


@query(f"""SELECT path, CAST(10 AS BIGINT) AS functions, CAST(0 AS BIGINT) AS with_source, CAST(3 AS BIGINT) AS classes, 'Id' || k AS variables FROM ({_TS}) s""")
def parse_dependency(p: Projection) -> DataFrame:
    """A file of a dependency: no sources, and of variables only type aliases."""
    f = parse_files(p.ts_sources(), True)
    some = F.size(F.filter("functions", lambda x: x["source"].isNotNull())) + F.size(F.filter("classes", lambda x: x["source"].isNotNull()))
    return f.select("path", F.size("functions").cast("long").alias("functions"), some.cast("long").alias("with_source"), F.size("classes").cast("long").alias("classes"), F.array_join(F.transform("variables", lambda v: v["name"]), ",").alias("variables"))


@query(f"""SELECT replace(name, '#', k) AS name, path, line + n AS line_number FROM ({_TS}) s, (VALUES ('outer#', 25), ('arrow#', 21), ('Shape#', 6), ('Figure#', 11), ('Made#', 24)) v(name, line)""")
def prescan_ts(p: Projection) -> DataFrame:
    return prescan(parse_files(p.ts_sources(), only=("functions", "classes")))


# -- PHP ----------------------------------------------------------------------------------------------


@query(f"""SELECT path, replace(name, '#', k) AS name, args, cx + (name = 'build') * n AS complexity, replace(cls, '#', k) AS class_context, kind, line + after * n AS line_number, doc AS docstring FROM ({_PHP}) s,
  (VALUES ('start#', '$a,...$b', 2, NULL, NULL, 19, 1, NULL), ('__construct', '$name,$rest', 1, 'Box#', 'constructor', 10, 0, NULL), ('build', '$a', 1, 'Box#', 'static', 12, 0, '/** Builds. */'),
    ('size', '', 1, NULL, NULL, 17, 1, NULL), ('shared', '', 1, NULL, NULL, 18, 1, NULL)) v(name, args, cx, cls, kind, line, after, doc)""".replace("(name = 'build') * n", "CASE WHEN name = 'build' THEN n ELSE 0 END"))
def parse_php_functions(p: Projection) -> DataFrame:
    """Methods of interfaces and traits have no class context, as those are no classes to it."""
    f = _exploded(p.php_files(), "functions")
    return f.select("path", "name", F.array_join("args", ",").alias("args"), F.col("cyclomatic_complexity").alias("complexity"), "class_context", "kind", "line_number", "docstring")


@query(f"""SELECT path, replace(name, '#', k) AS name, bases, replace(implements, '#', k) AS implements, is_abstract, is_interface, line + after * n AS line_number FROM ({_PHP}) s,
  (VALUES ('Box#', 'Base', 'Sized#,Countable', false, false, 7, 0), ('Sized#', 'Whole', '', false, true, 17, 1), ('Shared#', '', '', false, false, 18, 1)) v(name, bases, implements, is_abstract, is_interface, line, after)""")
def parse_php_classes(p: Projection) -> DataFrame:
    c = _exploded(p.php_files(), "classes")
    return c.select("path", "name", F.array_join("bases", ",").alias("bases"), F.array_join("implements", ",").alias("implements"), "is_abstract", "is_interface", "line_number")


@query(f"""SELECT path, replace(name, '#', k) AS name, replace(source, '#', k) AS source, replace(alias, '#', k) AS alias, line AS line_number FROM ({_PHP}) s,
  (VALUES ('Part#', 'Shop\\Parts\\Part#', NULL, 2), ('Other#', 'Shop\\Other\\Thing#', 'Thing#', 3), ('lib/tools.php', 'lib/tools.php', NULL, 4)) v(name, source, alias, line)""")
def parse_php_imports(p: Projection) -> DataFrame:
    return _exploded(p.php_files(), "imports").select("path", "name", "source", "alias", "line_number")


@query(f"""SELECT path, replace(name, '#', k) AS name, replace(full_name, '#', k) AS full_call_name, args, replace(caller, '#', k) AS caller_name, line + n AS line_number FROM ({_PHP}) s,
  (VALUES ('Part#', 'new Part#', '$a', 'build', 13), ('save', '$part->save', '1,''x''', 'start#', 19), ('find', 'Box#::find', '', 'start#', 19), ('helper#', 'helper#', '$a', 'start#', 19)) v(name, full_name, args, caller, line)""")
def parse_php_calls(p: Projection) -> DataFrame:
    c = _exploded(p.php_files(), "calls")
    return c.select("path", "name", "full_call_name", F.array_join("args", ",").alias("args"), "caller_name", "line_number")


@query(f"""SELECT path, name, replace(value, '%', CAST(n AS VARCHAR)) AS value, type, 'Box' || k AS class_context, line AS line_number FROM ({_PHP}) s, (VALUES ('LIMIT', '%', 'const', 8), ('$open', 'true', NULL, 9)) v(name, value, type, line)""")
def parse_php_variables(p: Projection) -> DataFrame:
    return _exploded(p.php_files(), "variables").select("path", "name", "value", "type", "class_context", "line_number")


# -- languages, ignore rules --------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 9 IN (0, 1, 2, 3) THEN 'javascript' WHEN doc_id % 9 IN (4, 5) THEN 'typescript' WHEN doc_id % 9 = 6 THEN 'php' END AS lang FROM documents""")
def language_of_path(p: Projection) -> DataFrame:
    """The language of a path by its extension, in any case of letters."""
    ends = F.array(*[F.lit(x) for x in (".js", ".JSX", ".mjs", ".cjs", ".ts", ".Tsx", ".php", ".py", "")])
    path = F.concat(F.lit("/a.js/b"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 9 + 1).cast("int")))
    return p.table("documents").select("doc_id", language(path).alias("lang"))


_RULES = "# notes\n*.min.js\n/out/\nsrc/**/gen\nlog?.ts\n!keep.min.js\n[ab]x.php\n"


@query("""SELECT page_id, CAST(page_id % 12 IN (0, 2, 3, 5, 6, 8, 9, 10) AS BOOLEAN) AS ignored FROM pages""")
def gitignore_paths(p: Projection) -> DataFrame:
    """Paths against ignore rules: globs, anchors, directories, ``**``, character sets, and rules that take paths back in."""
    paths = ("a/x.min.js", "a/keep.min.js", "out/x.js", "src/a/b/gen/x.js", "a/out/x.js", "log1.ts", "c/node_modules/x.js", "log12.ts", "dist/y.ts", "a/bx.php", "x/.git/y.js", "src/genx/y.js")
    rel = F.element_at(F.array(*[F.lit(x) for x in paths]), (F.col("page_id") % 12 + 1).cast("int"))
    return p.table("pages").select("page_id", ignored(rel, _RULES).alias("ignored"))


@query("SELECT path, lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'ts' AS path, 'typescript' AS lang FROM supplier UNION ALL SELECT 'php', 'php' FROM supplier UNION ALL SELECT 'js', 'javascript' FROM part) GROUP BY ALL")
def parse_dispatch(p: Projection) -> DataFrame:
    """Sources of three languages in one pass, and one that none reads."""
    every = p.ts_sources().select("path", "source").unionByName(p.php_files().select("path", "source")).unionByName(p.sources())
    every = every.unionByName(p.table("nation").select(F.concat(F.lit("/x/"), "n_name", F.lit(".py")).alias("path"), F.lit("def f(): pass").alias("source")))
    ext = F.regexp_extract("path", r"([a-z]+)$", 1)
    return parse_files(every, only=()).groupBy(ext.alias("path"), "lang").agg(F.count("*").alias("n"))


# -- indexing -----------------------------------------------------------------------------------------


def _indexed(p: Projection) -> dict[str, DataFrame]:
    sources = p.ts_sources()
    return tables_of(parse_files(sources).where("error is null").drop("error"), sources, CODE_ROOT)


@query(f"""SELECT path || '#' || replace(name, '#', k) || '#' || (line + n) AS id, '[' || array_to_string(list_transform(string_split(args, ','), lambda x: '"' || x || '"'), ',') || ']' AS args, 'typescript' AS lang, '/code' AS repo_path, cx AS cyclomatic_complexity
  FROM ({_TS}) s, {_TS_FUNCTIONS} WHERE args <> '' UNION ALL SELECT path || '#' || name || '#' || (line + n), '[]', 'typescript', '/code', cx FROM ({_TS}) s, {_TS_FUNCTIONS} WHERE args = ''""")
def index_functions(p: Projection) -> DataFrame:
    return _indexed(p)["functions"].select("id", F.to_json("args").alias("args"), "lang", "repo_path", "cyclomatic_complexity")


@query(f"""SELECT DISTINCT path, replace(name, '#', k) AS function_name, unnest(string_split(args, ',')) AS name, CAST(line + n AS INTEGER) AS line_number FROM ({_TS}) s, {_TS_FUNCTIONS} WHERE args <> ''""")
def index_parameters(p: Projection) -> DataFrame:
    return _indexed(p)["parameters"].select("path", "function_name", "name", "line_number")


@query("SELECT unnest(['./kinds', '../lib/small', 'ns-small', 'fs']) AS name")
def index_modules(p: Projection) -> DataFrame:
    return _indexed(p)["modules"].select("name")


@query(f"SELECT path, 's' || k || '.ts' AS name, CAST(n AS VARCHAR) AS dir, 'typescript' AS lang, sha256('file ' || k) AS content_hash FROM ({_TS}) s")
def index_files(p: Projection) -> DataFrame:
    t = _indexed(p)
    parent = t["contains_file"].select("path", F.element_at(F.split("dir_path", "/"), -1).alias("dir"))
    return t["files"].join(parent, "path").select("path", "name", "dir", "lang", "content_hash")


@query("SELECT DISTINCT '/code/' || s_nationkey AS path, CAST(s_nationkey AS VARCHAR) AS name, '/code' AS parent FROM supplier UNION ALL SELECT '/code', '.', NULL FROM (SELECT count(*) AS c FROM supplier) WHERE c > 0")
def index_directories(p: Projection) -> DataFrame:
    t = _indexed(p)
    return t["directories"].join(t["contains_dir"].select("path", F.col("parent_path").alias("parent")), "path", "left").select("path", "name", "parent")


@query(f"""SELECT * FROM (SELECT 'CONTAINS' AS type, 'File' AS src_label, 'Function' AS dst_label, CAST(10 * count(*) AS BIGINT) AS n FROM ({_TS}) s UNION ALL SELECT 'CONTAINS', 'File', 'Class', 3 * count(*) FROM ({_TS}) s
  UNION ALL SELECT 'CONTAINS', 'File', 'Variable', 4 * count(*) FROM ({_TS}) s UNION ALL SELECT 'CONTAINS', 'Repository', 'File', count(*) FROM ({_TS}) s UNION ALL SELECT 'IMPORTS', 'File', 'Module', 5 * count(*) FROM ({_TS}) s
  UNION ALL SELECT 'CONTAINS_FILE', 'Directory', 'File', count(*) FROM ({_TS}) s UNION ALL SELECT 'CONTAINS_DIR', 'Directory', 'Directory', count(DISTINCT n) FROM ({_TS}) s
  UNION ALL SELECT 'HAS_PARAMETER', 'Function', 'Parameter', sum(len(string_split(args, ','))) FROM ({_TS}) s, {_TS_FUNCTIONS} WHERE args <> '') WHERE n > 0""")
def index_edges(p: Projection) -> DataFrame:
    """Every edge that a set of files makes, by kind and ends."""
    t = p.graph_tables()
    made = _indexed(p)
    none = {k: t[k].limit(0) for k in ("calls", "inherits", "implements")}
    return graph.all_edges(t | none | made).groupBy("type", "src_label", "dst_label").agg(F.count("*").alias("n"))
