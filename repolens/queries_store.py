"""Registered queries of upkeep, linking, descriptions, search by vector and text, and ad hoc queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import text
from repolens.functions.vectors import HashingEmbedder, dot, mean_pooled
from repolens.operators import analyze, graph, resolve, search, segments
from repolens.operators.traverse import durable, shared_folder
from repolens.plans import ask, cypher, describe, mutate
from repolens.plans.index import carry_over
from repolens.plans.projections import CODE_ROOT, Projection
from repolens.queries import NAME, query, sql_of
from repolens.sources.files import fits_globs, write_files
from repolens.sources.schema import TABLES
from repolens.sources.store import Change, SnapshotStore, duplicates
from repolens.streaming.watch import debounced, relevant

# -- lookups and upkeep -------------------------------------------------------------------------------


@query(f"SELECT id, line_number, kind FROM functions WHERE path = 'Brand#1' AND name = '{NAME}'", "functions")
def lookup(p: Projection) -> DataFrame:
    return graph.lookup(p.functions(), path="Brand#1", name=NAME).select("id", "line_number", "kind")


@query("""SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 4 = 1 THEN sha256(text) ELSE 'none' END AS content_hash FROM documents WHERE lang = 'en' AND doc_id % 4 IN (1, 2)""")
def file_hashes(p: Projection) -> DataFrame:
    """The hashes of one repository's files, without the empty and missing ones."""
    d = p.table("documents")
    kind = F.col("doc_id") % 4
    digest = F.when(kind == 0, "").when(kind == 1, F.sha2("text", 256)).when(kind == 2, "none")
    return graph.content_hashes(d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("repo_path"), digest.alias("content_hash")), "en")


@query("""SELECT name, path, line_number FROM functions WHERE path IN ('Brand#2', 'Brand#4') UNION ALL SELECT name, path, line_number FROM classes WHERE path IN ('Brand#2', 'user')
  UNION ALL SELECT s_name, 'Variable', s_suppkey FROM supplier WHERE false""", "functions", "classes")
def symbols_of_files(p: Projection) -> DataFrame:
    """The symbols that given files hold, functions, classes and variables together."""
    paths = p.spark.createDataFrame([("Brand#2",), ("Brand#4",), ("user",)], "path string")
    found = search.symbols(p.graph_tables()).join(paths, "path", "left_semi")
    return found.where("label <> 'Function' OR path <> 'user'").select("name", "path", "line_number")


@query("""SELECT DISTINCT o_custkey AS src_id, l_partkey AS dst_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE l_linenumber = 1 OR (o_custkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO'))""")
def upsert_edges_into(p: Projection) -> DataFrame:
    """Edges onto a table that has some: old ones stay, each new one with both ends comes in once."""
    both = p.table("orders").join(p.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = both.select(F.col("o_custkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), "l_linenumber")
    targets = p.table("part").where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("id"))
    return graph.upsert_edges(edges.where("l_linenumber = 1").drop("l_linenumber"), edges.drop("l_linenumber"), p.table("supplier").select(F.col("s_suppkey").alias("id")), targets)


@query("""SELECT f.id, d.text AS description, sha256(d.text) AS described_hash FROM functions f LEFT JOIN (SELECT doc_id, min(text) AS text FROM documents GROUP BY 1) d ON d.doc_id = f.id""", "functions")
def set_embeddings(p: Projection) -> DataFrame:
    d = p.table("documents").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("description"))
    new = d.withColumn("described_hash", F.sha2("description", 256)).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("description", "string"), ("described_hash", "string"), ("embedding", "array<float>"))]
    return graph.set_embeddings(p.functions().select("id", *none), new, ["id"]).select("id", "description", "described_hash")


@query("""SELECT t AS name, CAST(n AS BIGINT) AS n FROM (SELECT 'repositories' AS t, (SELECT count(*) FROM region WHERE r_name <> 'ASIA') AS n UNION ALL SELECT 'files', (SELECT count(*) FROM files WHERE r_name <> 'ASIA')
  UNION ALL SELECT 'functions', (SELECT count(*) FROM functions) UNION ALL SELECT 'contains_file', (SELECT count(*) FROM files WHERE r_name <> 'ASIA')
  UNION ALL SELECT 'directories', (SELECT count(DISTINCT n_name) FROM files WHERE r_name <> 'ASIA'))""", "functions", "files")
def delete_repository(p: Projection) -> DataFrame:
    """What is left of each table when one repository goes."""
    t = p.graph_tables()
    place = p.files().select("path", text.dirname(F.col("path")).alias("dir_path"), F.substring_index("path", "/", 3).alias("repo_path"))
    t["contains_file"] = place.select("dir_path", "path", "repo_path")
    dirs = place.select(F.col("dir_path").alias("path"), "repo_path").distinct()
    t["directories"] = dirs.select("path", text.basename(F.col("path")).alias("name"), "repo_path")
    left = graph.delete_repository(t, "/world/ASIA")
    parts = [left.get(k, t[k]).select(F.lit(k).alias("name")) for k in ("repositories", "files", "functions", "contains_file", "directories")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT name, path, line_number, CASE WHEN source_same THEN 'about ' || old_line END AS description FROM (
    SELECT n.name, n.path, n.line_number + 1000000 AS line_number, o.line_number AS old_line, o.line_number IS NOT NULL AS source_same
    FROM (SELECT *, row_number() OVER (PARTITION BY path, name, new_source ORDER BY line_number) AS nth FROM (SELECT *, CASE WHEN line_number % 3 = 0 THEN name || ' changed' ELSE name END AS new_source FROM functions)) n
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY line_number) AS nth FROM functions) o ON o.path = n.path AND o.name = n.name AND o.nth = n.nth AND n.new_source = n.name)""", "functions")
def carried_descriptions(p: Projection) -> DataFrame:
    """A third of the symbols changes, all move: those with the text they had keep the description of their rank."""
    f = p.functions().select("name", "path", "line_number")
    empty = [F.lit(None).cast("string").alias("described_hash"), F.lit(None).cast("array<float>").alias("embedding")]
    old = f.select("*", F.col("name").alias("source"), F.concat(F.lit("about "), F.col("line_number").cast("string")).alias("description"), *empty)
    changed = F.when(F.col("line_number") % 3 == 0, F.concat("name", F.lit(" changed"))).otherwise(F.col("name"))
    new = f.select("name", "path", (F.col("line_number") + 1_000_000).alias("line_number"), changed.alias("source"), F.lit(None).cast("string").alias("description"), *empty)
    return carry_over(new, old).select("name", "path", "line_number", "description")


@query("""SELECT CAST(1 + (SELECT count(DISTINCT p_brand) FROM part) AS BIGINT) AS files_in_both, CAST((SELECT count(*) FROM supplier) AS BIGINT) AS variables, CAST((SELECT count(*) FROM region) AS BIGINT) AS repositories,
  CAST(0 AS BIGINT) AS classes, CAST(0 AS BIGINT) AS twice""")
def snapshot_store(p: Projection) -> DataFrame:
    """Two publishes: the second replaces one table and leaves the other as it is; no key is there twice."""
    store = SnapshotStore(p.spark, f"{shared_folder(p.spark)}/store-{uuid.uuid4().hex}")

    def table(name: str, df: DataFrame) -> DataFrame:
        wanted = p.spark.createDataFrame([], TABLES[name]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

    brands = p.table("part").select(F.col("p_brand").alias("path")).distinct()
    store.publish({"files": table("files", brands), "repositories": table("repositories", p.graph_tables()["repositories"])})
    more = brands.unionByName(p.spark.createDataFrame([("one more",)], "path string"))
    store.publish({"files": table("files", more), "variables": table("variables", p.variables())})
    t = store.tables()
    one = lambda name: t[name].agg(F.count("*").alias(name))
    twice = duplicates(t["variables"], ["name", "path", "line_number"]).agg(F.count("*").alias("twice"))
    return one("files").withColumnRenamed("files", "files_in_both").crossJoin(one("variables")).crossJoin(one("repositories")).crossJoin(one("classes")).crossJoin(twice)  # one row each


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'purchase')")
def relevant_changes(p: Projection) -> DataFrame:
    """Changes of source files outside ignored directories."""
    names = {"view": "/src/a.TS", "purchase": "b.php", "click": "/dist/a.js", "signup": "/src/notes.md", "error": "/x/node_modules/y/a.tsx"}
    path = F.concat(F.lit("/home/"), F.col("user_id").cast("string"), F.lit("/"), F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")])
    return relevant(p.table("events").select("event_id", "user_id", path.alias("path"))).select("event_id", "user_id")


@query("SELECT name, CASE name WHEN 'modules' THEN (SELECT count(DISTINCT p_type) FROM part) ELSE CAST(0 AS BIGINT) END AS n FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") v(name)")
def ensure_schema(p: Projection) -> DataFrame:
    """A store with one table gets the others; none has a key twice or columns of another type."""
    store = SnapshotStore(p.spark, f"{shared_folder(p.spark)}/store-{uuid.uuid4().hex}")
    store.publish({"modules": p.table("part").select(F.col("p_type").alias("name")).distinct()})
    found = store.ensure_schema()
    return p.spark.createDataFrame([(x["table"], x["rows"]) for x in found if not x["twice"] and not x["odd"]], "name string, n long")


_PATHS = ("src/a.test.ts", "lib/x.js", "src/deep/er/b.tsx", "src/a.d.ts", "b.ts", "src/deep/node_modules/c.ts")


@query("""SELECT event_id, event_id % 6 IN (0, 2, 4) AS fits FROM events""")
def glob_paths(p: Projection) -> DataFrame:
    """Paths against globs and globs to ignore."""
    rel = F.element_at(F.array(*[F.lit(x) for x in _PATHS]), (F.col("event_id") % 6 + 1).cast("int"))
    return p.table("events").select("event_id", fits_globs(rel, ["src/**/*.{ts,tsx}", "[a-c].ts"], ["**/node_modules/**", "**/*.d.ts"]).alias("fits"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/base/u/' || user_id || '.Tar.gz' WHEN 1 THEN '/' || event_type WHEN 2 THEN '/base/.hidden' ELSE '/' END AS whole, CASE event_id % 4 WHEN 0 THEN '.gz' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '' END AS ext,
  CASE event_id % 4 WHEN 0 THEN '../u/' || user_id || '.Tar.gz' WHEN 1 THEN '../../' || event_type WHEN 2 THEN '../.hidden' ELSE '../..' END AS way FROM events""")
def path_forms(p: Projection) -> DataFrame:
    """Absolute paths, extensions, and ways from one directory."""
    case = F.col("event_id") % 4
    raw = F.when(case == 0, F.concat(F.lit("./u//x/../"), F.col("user_id").cast("string"), F.lit(".Tar.gz"))).when(case == 1, F.concat(F.lit("/../a/.././"), F.col("event_type"))).when(case == 2, ".hidden").otherwise("../../..")
    whole = text.resolved(raw, "/base")
    return p.table("events").select("event_id", whole.alias("whole"), text.extension(whole).alias("ext"), text.relative(whole, "/base/code").alias("way"))


# -- linking ------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT a.id AS src_id, b.id AS dst_id FROM functions a JOIN functions b ON b.name = a.name OR b.name = string_split(a.name, ' ')[1] || ' widget'""", "functions")
def link_implements(p: Projection) -> DataFrame:
    """Two interfaces each, a symbol's own name among them: itself is not left out."""
    base = F.concat(F.substring_index("name", " ", 1), F.lit(" widget"))
    classes = p.functions().select("id", "name", F.lit(None).cast("string").alias("repo_path"), F.array("name", base).alias("implements"))
    return resolve.link_bases(classes, "implements", False)


@query("""SELECT DISTINCT a.id AS src_id, b.id AS dst_id FROM functions a JOIN functions b ON b.name = a.name AND a.path = b.path AND a.id <> b.id""", "functions")
def link_inherits_of_repository(p: Projection) -> DataFrame:
    classes = p.functions().select("id", "name", F.col("path").alias("repo_path"), F.array("name").alias("bases"))
    return resolve.link_bases(classes, "bases", True, same_repo=True)


@query("""SELECT DISTINCT s.id AS src_id, d.id AS dst_id, c.line_number FROM parsed_calls c JOIN functions s ON s.path = c.path AND s.name = c.caller_name
  JOIN (SELECT path, name, arg_min(id, line_number) AS id FROM functions GROUP BY path, name) d ON d.path = c.path AND d.name = c.name""", "functions", "calls", "parsed_calls")
def link_calls_locally(p: Projection) -> DataFrame:
    """Names that no import and no symbol has link with the first function of that name in the caller's file."""
    none = p.named_imports().limit(0)
    return resolve.link_calls(p.parsed_calls(), none, p.functions(), p.symbols().limit(0))


# -- descriptions and prompts -------------------------------------------------------------------------


@query("""SELECT 'doc/' || doc_id AS path, sha256(text) AS hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def changed_rows(p: Projection) -> DataFrame:
    """What a generator is asked: rows whose hash is not the one last described."""
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    rows = p.table("documents").select(path.alias("path"), F.sha2("text", 256).alias("hash"))
    old = p.table("labels").join(p.table("documents").select("doc_id", "text"), "doc_id")
    table = old.select(path.alias("path"), F.when(F.col("quality") == 1, F.sha2("text", 256)).alias("described_hash"))
    return describe.changed(rows, table, ["path"])


@query("""SELECT id, 'function ' || name || '.' AS description, sha256(source) AS described_hash, CAST(384 AS INTEGER) AS dimensions, CAST(1 AS DOUBLE) AS norm FROM functions""", "functions")
def described(p: Projection) -> DataFrame:
    """Generated descriptions with their vectors, which have length 1."""
    f = p.functions()
    rows = f.select("id", F.sha2("source", 256).alias("hash"), describe.symbol_prompt(F.lit("function"), F.col("name"), F.col("path"), F.col("source")).alias("prompt"))
    table = f.select("id", F.lit(None).cast("string").alias("described_hash"))
    out = describe.describe(rows, table, ["id"], describe.first_line_generator, HashingEmbedder(), 4)
    return out.select("id", "description", "described_hash", F.size("embedding").alias("dimensions"), F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query("""SELECT f.path, f.path || '!' AS hash, 'Say in one or two plain sentences what this file is for.' || chr(10) || chr(10) || 'Symbols: ' || f.names || chr(10) || 'File: ' || f.path || chr(10) || chr(10) || 'Code:' || chr(10) || repeat(f.path, 400)[1:2000] AS prompt
  FROM (SELECT path, array_to_string(list_concat(['C ' || path], list_sort(list(DISTINCT name))), ', ') AS names FROM functions GROUP BY path) f""", "functions")
def file_prompts(p: Projection) -> DataFrame:
    f = p.functions()
    paths = f.select("path").distinct()
    files = paths.withColumn("content_hash", F.concat("path", F.lit("!")))
    return describe.file_rows(files, paths.withColumn("source", F.repeat("path", F.lit(400))), f, paths.withColumn("name", F.concat(F.lit("C "), F.col("path"))))


@query("""SELECT '/world/' || r_name || '/' || n_name AS path, sha256(string_agg(c_name, chr(10) ORDER BY c_name)) AS hash,
  'Say in one or two plain sentences what this directory is for.' || chr(10) || chr(10) || 'Files: ' || string_agg(c_name, chr(10) ORDER BY c_name) || chr(10) || 'Directory: /world/' || r_name || '/' || n_name AS prompt FROM files GROUP BY r_name, n_name""", "files")
def directory_prompts(p: Projection) -> DataFrame:
    return describe.directory_rows(p.files())


@query("""SELECT id, '### function `' || name || '` ' || path || ':' || CASE WHEN id % 3 = 0 THEN '?' ELSE CAST(line_number AS VARCHAR) END || chr(10) || 'Description: ' || CASE WHEN id % 2 = 0 THEN name ELSE '' END || chr(10) ||
  CASE WHEN id % 5 = 0 THEN 'Called by: x, y' || chr(10) ELSE '' END || CASE WHEN id % 7 = 0 THEN 'Extends: ' || path || chr(10) ELSE '' END || '```' || chr(10) || source || chr(10) || '```' AS block FROM functions""", "functions")
def ask_blocks(p: Projection) -> DataFrame:
    """The text on each symbol in the prompt of a question."""
    f = p.functions().withColumn("number", F.col("id"))
    none = F.array().cast("array<string>")
    rows = f.select(
        "id", F.lit("function").alias("kind"), "name", "path", F.when(F.col("id") % 3 != 0, F.col("line_number")).alias("line_number"), F.when(F.col("id") % 2 == 0, F.col("name")).alias("description"),
        F.when(F.col("id") % 5 == 0, F.array(F.lit("x"), F.lit("y"))).alias("callers"), none.alias("callees"), F.when(F.col("id") % 7 == 0, F.array("path")).otherwise(none).alias("parents"), F.lit(None).cast("array<string>").alias("interfaces"), "source",
    )
    return rows.select("id", ask.context_block().alias("block"))


@query("""SELECT c.name, (SELECT string_agg(DISTINCT b.name, ', ' ORDER BY b.name) FROM classes b WHERE b.conv_id = c.conv_id AND b.turn < c.turn) AS interfaces FROM classes c""", "classes")
def enrich_interfaces(p: Projection) -> DataFrame:
    """The interfaces of a class; here all turns before a turn."""
    t = p.graph_tables()
    t["classes"] = t["classes"].withColumn("source", F.lit(None).cast("string"))
    up = t["classes"].select("conv_id", F.col("turn").alias("before"), F.col("id").alias("dst_id"))
    t["implements"] = t["classes"].select("conv_id", "turn", F.col("id").alias("src_id")).join(up, "conv_id").where("before < turn").select("src_id", "dst_id")
    none = {k: p.spark.createDataFrame([], TABLES[k]) for k in ("functions", "calls", "inherits")}
    out = ask.enrich(p.classes().select(F.lit("class").alias("kind"), "name", "path").distinct(), t | none)
    return out.select("name", F.array_join("interfaces", ", ").alias("interfaces"))


# -- search -------------------------------------------------------------------------------------------

_NEAR = "round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))) / 2, 6)"
_KINDS = "['function', 'class', 'variable', 'file', 'directory']"


@query(f"""SELECT kind, CASE WHEN vec_id % 2 = 0 THEN 'v' || vec_id ELSE 'p' || vec_id END AS name, '/e/p' || vec_id AS path, score FROM (
    SELECT *, row_number() OVER (PARTITION BY kind ORDER BY exact DESC, '/e/p' || vec_id) AS nth FROM (SELECT vec_id, ({_KINDS})[1 + vec_id % 5] AS kind, {_NEAR} AS score,
      list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS exact FROM embeddings)) WHERE nth <= 12 ORDER BY exact DESC, path LIMIT 12""")
def vector_labels(p: Projection) -> DataFrame:
    """The nearest of five labels together; a node without a name is shown by its path."""
    e = p.table("embeddings")
    path = F.concat(F.lit("/e/p"), F.col("vec_id").cast("string"))
    name = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("v"), F.col("vec_id").cast("string"))).otherwise("")
    rows = e.select("vec_id", name.alias("name"), path.alias("path"), F.lit(None).cast("int").alias("line_number"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("repo_path"), "embedding")
    tables = {t: rows.where(F.col("vec_id") % 5 == k) for k, t in enumerate(search.VECTOR_TABLES)}
    first = e.where("vec_id = 0").select("embedding").first()
    return search.vector_search(tables, list(first[0]), 12).select("kind", "name", "path", F.round("score", 6).alias("score"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'leaf' WHEN 2 THEN 'alone' ELSE 'unknown' END AS name, CASE event_id % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'file' ELSE 'unknown' END AS kind,
  '[' || printf('%.3f', value) || '] ' || event_type || ':' || user_id AS line, '["' || event_type || '","' || user_id || '"]' AS args FROM events""")
def shown_names(p: Projection) -> DataFrame:
    """Names with their fallbacks, kinds of labels, lines of text output, and arrays as JSON."""
    case = F.col("event_id") % 4
    name = F.when(case == 0, F.col("event_type")).when(case == 1, "").when(case == 2, F.lit(None))
    path = F.when(case == 1, "/a/leaf").when(case == 2, "alone").when(case == 3, F.lit(None))
    labels = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("Odd"), F.lit("Class"), F.lit("Interface"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("File"))).otherwise(F.array(F.lit("Module")))
    user = F.col("user_id").cast("string")
    return p.table("events").select(
        "event_id", text.display_name(name, path).alias("name"), text.kind_of_label(labels).alias("kind"), F.concat(F.lit("["), text.fixed(F.col("value"), 3), F.lit("] "), F.col("event_type"), F.lit(":"), user).alias("line"),
        F.to_json(F.array("event_type", user)).alias("args"),
    )


@query("""SELECT vec_id, CAST(len(v) AS INTEGER) AS dimensions, round(v[1] / norm, 4) AS first, round(v[16] / norm, 4) AS last FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (
  SELECT vec_id, list_transform(range(1, 17), lambda j: list_sum(list_transform(list_filter(range(0, 4), lambda i: (vec_id + i) % 3 <> 0), lambda i: CAST(embedding[i * 16 + j] AS DOUBLE)))) AS v FROM embeddings))""")
def mean_pooled_vectors(p: Projection) -> DataFrame:
    """Each vector as four token states of 16 numbers, of which a mask leaves some out: their mean, scaled to length 1."""
    states = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("vec_id") + i) % 3 != 0).cast("int"))
    rows = p.table("embeddings").select("vec_id", mean_pooled(states, mask).alias("v"))
    return rows.select("vec_id", F.size("v").alias("dimensions"), F.round(F.element_at("v", 1), 4).alias("first"), F.round(F.element_at("v", 16), 4).alias("last"))


@query(sql_of("fulltext"))
def fulltext_indexed(p: Projection) -> DataFrame:
    """The same search from a stored index."""
    tables = p.graph_tables()
    tables["name_postings"] = durable(search.name_postings(search.symbols(tables)))
    out = search.fulltext(tables, NAME, 100)
    return out.select(F.element_at("labels", 1).alias("label"), "name", "path", "line_number", F.round("score", 6).alias("score"))


@query(sql_of("vector_topk"))
def vector_indexed(p: Projection) -> DataFrame:
    """The nearest vectors from an index by random planes, all of its buckets read."""
    e = p.table("embeddings")
    index = search.VectorIndex(p.spark, f"{shared_folder(p.spark)}/vectors-{uuid.uuid4().hex}", 64)
    index.write(e)
    first = e.where("vec_id = 0").select("embedding").first()
    return index.topk(list(first[0]), 10, 1 << len(index.planes), ("vec_id",)).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT vec_id, CAST(10 AS BIGINT) AS found, CAST(1.0 AS DOUBLE) AS best, true AS recalled, true AS pruned FROM embeddings WHERE vec_id % 20 = 0")
def vector_segments(p: Projection) -> DataFrame:
    """The ten nearest of every twentieth vector from an index kept by the store: trained on what came first, a segment each for
    what came and went later; whether recall is 0.9 or more against all rows, and whether only a part of the cells is read."""
    store = SnapshotStore(p.spark, f"{shared_folder(p.spark)}/store-{uuid.uuid4().hex}")
    e = p.table("embeddings")
    number = F.col("vec_id").cast("string")
    none = F.lit(None).cast("string")
    rows = e.select("vec_id", F.lit("Function").alias("label"), number.alias("node"), number.alias("name"), F.concat(F.lit("/e/"), number).alias("path"), F.col("vec_id").alias("line_number"), none.alias("description"), none.alias("repo_path"), "embedding")
    early, late = rows.where("vec_id % 10 < 7").drop("vec_id"), rows.where("vec_id % 10 >= 7").drop("vec_id")
    centroids = durable(segments.train(early, 64))
    centers = segments.centers_of(centroids)
    store.publish({"centroids": centroids, "vectors": segments.assigned(early, centers)})
    store.publish({"vectors": Change(segments.assigned(late, centers), p.spark.createDataFrame([], "unit string"))})
    store.publish({"vectors": Change(store.load("vectors").limit(0), rows.where("vec_id % 50 = 49").select("path"))})
    vectors = durable(store.load("vectors"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    found = segments.nearest_many(vectors, centroids, asked, 10, "node")
    share = segments.recall(vectors, centroids, asked, 10, "node")
    out = found.groupBy(F.col("query").alias("vec_id")).agg(F.count("*").alias("found"), F.round(F.max("score"), 6).alias("best"))
    return out.withColumn("recalled", F.lit(share >= 0.9)).withColumn("pruned", F.lit(segments.probes_of(centroids) < len(centers)))


@query(f"""SELECT s.name AS caller_name, s.path AS caller_path, s.line_number AS caller_line, c.line_number AS call_line FROM calls c JOIN functions s ON s.id = c.src_id JOIN functions d ON d.id = c.dst_id WHERE d.name = '{NAME}'
  ORDER BY 2, 3, 1, 4 LIMIT 20""", "functions", "calls")
def analyze_by_name(p: Projection) -> DataFrame:
    return analyze.analyze({"functions": p.functions(), "calls": p.calls()}, "find_callers", NAME)


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS n, max(cyclomatic_complexity) AS most FROM functions WHERE name <> '{NAME}' AND line_number >= 10 GROUP BY kind", "functions")
def read_only_sql(p: Projection) -> DataFrame:
    """A query in SQL with parameters, over views of the tables."""
    search.register_views({"functions": p.functions()}, "q_")
    return search.read_only_sql(p.spark, "SELECT kind, count(*) AS n, max(cyclomatic_complexity) AS most FROM q_functions WHERE name <> :name AND line_number >= :least GROUP BY kind", {"name": NAME, "least": 10})


# -- pattern queries ----------------------------------------------------------------------------------


@query("""SELECT path, CAST(n AS BIGINT) AS n, CAST(n_callers AS BIGINT) AS callers FROM (SELECT d.path, count(*) AS n, count(DISTINCT s.name) AS n_callers FROM calls c JOIN functions s ON s.id = c.src_id JOIN functions d ON d.id = c.dst_id GROUP BY d.path) WHERE n > 100""", "functions", "calls")
def cypher_with(p: Projection) -> DataFrame:
    """Groups in WITH, filtered and returned."""
    return cypher.run(p.spark, p.graph_tables(), "MATCH (s:Function)-[:CALLS]->(d:Function) WITH d.path AS path, count(*) AS n, count(DISTINCT s.name) AS callers WHERE n > 100 RETURN path, n, callers")


@query("SELECT DISTINCT d.name AS name FROM calls c JOIN functions s ON s.id = c.src_id JOIN functions d ON d.id = c.dst_id WHERE s.path IN ('Brand#1', 'Brand#3') AND s.cyclomatic_complexity >= 40", "functions", "calls")
def cypher_distinct(p: Projection) -> DataFrame:
    """DISTINCT results, IN with a list parameter, and a string made a number."""
    query_text = "MATCH (s:Function)-[:CALLS]->(d:Function) WHERE s.path IN $paths AND s.cyclomatic_complexity >= toInteger('40') RETURN DISTINCT d.name AS name"
    return cypher.run(p.spark, p.graph_tables(), query_text, {"paths": ["Brand#1", "Brand#3"]})


@query("SELECT path, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, 'Function' AS label FROM functions GROUP BY path", "functions")
def cypher_collect(p: Projection) -> DataFrame:
    out = cypher.run(p.spark, p.graph_tables(), "MATCH (f:Function) RETURN f.path AS path, collect(DISTINCT f.name) AS names, labels(f)[0] AS label")
    return out.select("path", F.array_join(F.sort_array("names"), ",").alias("names"), "label")


@query("""SELECT src, CAST(length AS BIGINT) AS length, dst FROM (SELECT a.id AS src, a.turn - b.turn AS length, b.id AS dst FROM classes a JOIN classes b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.turn <= 25)""", "classes")
def cypher_unbounded(p: Projection) -> DataFrame:
    """Paths without an upper bound; each class extends the one before."""
    t = p.graph_tables()
    return cypher.run(p.spark, t, "MATCH path = (a:Class)-[:INHERITS*]->(b:Class) WHERE a.turn <= 25 RETURN a.id AS src, length(path) AS length, b.id AS dst").withColumn("length", F.col("length").cast("long"))


@query("""SELECT CAST(1 AS BIGINT) AS one, CAST((SELECT count(*) FROM functions WHERE contains(name, 'plate')) AS BIGINT) AS hits""", "functions")
def cypher_fulltext(p: Projection) -> DataFrame:
    """All hits of the full-text procedure, beside RETURN 1."""
    tables = p.graph_tables()
    tables |= {t: p.spark.createDataFrame([], TABLES[t]) for t in ("classes", "variables")}
    hits = cypher.run(p.spark, tables, "CALL db.index.fulltext.queryNodes('code_search', 'Plate') YIELD node RETURN count(*) AS hits")
    return cypher.run(p.spark, tables, "RETURN 1 AS one").withColumn("one", F.col("one").cast("long")).crossJoin(hits)  # one row each


@query(f"""SELECT name, kind, score FROM (SELECT 'v' || vec_id AS name, ({_KINDS})[1 + vec_id % 5] AS kind, {_NEAR} AS score,
  list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS exact FROM embeddings) ORDER BY exact DESC, name LIMIT 15""")
def cypher_vector_union(p: Projection) -> DataFrame:
    """The five vector indexes in one subquery of unions."""
    e = p.table("embeddings")
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    rows = e.select(F.col("vec_id").alias("id"), name.alias("name"), name.alias("path"), "embedding", F.lit(False).alias("is_interface"))
    tables = p.graph_tables() | {t: rows.where(F.col("id") % 5 == k) for k, t in enumerate(search.VECTOR_TABLES)}
    union = " UNION ".join(f"CALL db.index.vector.queryNodes('{k}_embeddings', 15, $v) YIELD node, score RETURN node, score" for k in ("function", "class", "variable", "file", "directory"))
    out = cypher.run(p.spark, tables, f"CALL {{ {union} }} RETURN node.name AS name, toLower(labels(node)[0]) AS kind, score ORDER BY score DESC, name LIMIT 15", {"v": list(e.where("vec_id = 0").select("embedding").first()[0])})
    return out.withColumn("score", F.round("score", 6))


# -- writing pattern queries --------------------------------------------------------------------------


def _writable(p: Projection) -> SnapshotStore:
    """A store with a function for each part, each of which calls that of the next number divided by three, and one module."""
    store = SnapshotStore(p.spark, f"{shared_folder(p.spark)}/store-{uuid.uuid4().hex}")
    part = p.table("part").select(F.col("p_partkey").cast("int").alias("line_number"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("path"))
    functions = durable(part.withColumn("id", F.concat_ws("#", "path", "name", F.col("line_number").cast("string"))))
    other = functions.select(F.col("line_number").alias("to"), F.col("id").alias("dst_id"))
    calls = functions.select(F.col("id").alias("src_id"), F.expr("line_number div 3 + 1").alias("to"), "line_number").join(other.hint("merge"), "to").drop("to")
    full = lambda t, df: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in p.spark.createDataFrame([], TABLES[t]).schema])
    store.publish({"functions": full("functions", functions), "calls": full("calls", calls), "modules": p.spark.createDataFrame([("old",)], "name string")})
    return store


_PARTS = "f AS (SELECT CAST(p_partkey AS INTEGER) AS line_number, 'f' || p_partkey AS name, p_brand AS path FROM part), c AS (SELECT a.line_number AS a, b.line_number AS b, a.path AS a_path, b.path AS b_path FROM f a JOIN f b ON b.line_number = a.line_number // 3 + 1)"


@query(f"WITH {_PARTS} SELECT name, CASE WHEN path IN ('Brand#11', 'Brand#13') THEN path END AS docstring, CASE WHEN path IN ('Brand#11', 'Brand#13') THEN line_number + 1 END AS complexity FROM f")
def cypher_set(p: Projection) -> DataFrame:
    """SET of two properties on the functions that match, others unchanged."""
    store = _writable(p)
    mutate.write(p.spark, store, "MATCH (f:Function) WHERE f.path IN $paths SET f.docstring = f.path, f.cyclomatic_complexity = f.line_number + 1", {"paths": ["Brand#11", "Brand#13"]})
    return store.load("functions").select("name", "docstring", F.col("cyclomatic_complexity").alias("complexity"))


@query(f"""WITH {_PARTS} SELECT f.name, CAST(count(c.a) AS BIGINT) AS calls FROM f LEFT JOIN c ON c.a = f.line_number AND c.b_path <> 'Brand#13' AND c.a_path <> c.b_path WHERE f.path <> 'Brand#13' GROUP BY f.name""")
def cypher_delete(p: Projection) -> DataFrame:
    """DETACH DELETE of nodes with all their edges, then DELETE of the edges within a file: what is left."""
    store = _writable(p)
    mutate.write(p.spark, store, "MATCH (f:Function {path: 'Brand#13'}) DETACH DELETE f")
    mutate.write(p.spark, store, "MATCH (a:Function)-[c:CALLS]->(b:Function) WHERE a.path = b.path DELETE c")
    out = store.load("functions").join(store.load("calls"), F.col("id") == F.col("src_id"), "left")
    return out.groupBy("name").agg(F.count("src_id").alias("calls"))


@query(f"""WITH {_PARTS} SELECT name, path, docstring, calls FROM (
  SELECT name, path, CASE WHEN line_number <= 3 THEN 'met' END AS docstring, CAST(1 + (line_number <= 3)::INT AS BIGINT) AS calls FROM f
  UNION ALL SELECT 'f1', 'new', 'made', 0 UNION ALL SELECT name, 'module', NULL, 0 FROM (VALUES ('old'), ('x'), ('y')) v(name))""")
def cypher_merge(p: Projection) -> DataFrame:
    """MERGE of nodes that are there and that are not, of nodes from a list, and of edges: what is there after it."""
    store = _writable(p)
    first = {r["line_number"]: r["path"] for r in store.load("functions").where("line_number <= 3").select("line_number", "path").collect()}
    for n, path in [*first.items(), (1, "new")]:
        mutate.write(p.spark, store, "MERGE (f:Function {name: $name, path: $path, line_number: $n}) ON CREATE SET f.docstring = 'made' ON MATCH SET f.docstring = 'met'", {"name": f"f{n}", "path": path, "n": n})
    mutate.write(p.spark, store, "UNWIND $names AS n MERGE (m:Module {name: n})", {"names": ["x", "y", "x", "old"]})
    # twice: a merged edge is there once
    for _ in range(2):
        mutate.write(p.spark, store, "MATCH (a:Function {docstring: 'met'}), (b:Function {docstring: 'made'}) WHERE b.line_number = 1 MERGE (a)-[:CALLS {line_number: 99}]->(b)")
    f, c = store.load("functions"), store.load("calls")
    out = f.join(c, F.col("id") == F.col("src_id"), "left").groupBy("name", "path", "docstring").agg(F.count("src_id").alias("calls"))
    modules = store.load("modules").select("name", F.lit("module").alias("path"), F.lit(None).cast("string").alias("docstring"), F.lit(0).cast("long").alias("calls"))
    return out.unionByName(modules)


# -- whole runs ---------------------------------------------------------------------------------------


@query("""SELECT name, CASE name WHEN 'repositories' THEN 1 WHEN 'functions' THEN 10 * n WHEN 'classes' THEN 3 * n WHEN 'variables' THEN 4 * n WHEN 'imports' THEN 5 * n WHEN 'directories' THEN d + 1 WHEN 'after' THEN 0 ELSE n END AS n
  FROM (SELECT CAST(count(*) AS BIGINT) AS n, count(DISTINCT s_nationkey) AS d FROM supplier), (VALUES ('repositories'), ('files'), ('functions'), ('classes'), ('variables'), ('imports'), ('calls'), ('inherits'), ('implements'), ('directories'), ('completed'), ('after')) v(name)""")
def index_run(p: Projection) -> DataFrame:
    """A directory of files indexed from disk, links and job included: the rows of each table, the files that the job names,
    and what is left when all is deleted.

    Of a file's calls one finds a function, in the same file; of its bases and interfaces those that the file itself has.
    """
    from repolens.api import Lens  # noqa: PLC0415

    root = f"{shared_folder(p.spark)}/code-{uuid.uuid4().hex}"
    write_files(p.ts_sources().select("rel", "source"), root)  # files are what this starts from
    lens = Lens(p.spark, f"{root}-store")
    job = lens.add_code_to_graph(root)
    tables = lens.tables()
    names = ("repositories", "files", "functions", "classes", "variables", "imports", "calls", "inherits", "implements", "directories")
    rows = [(t, tables[t].count()) for t in names] + [(job["status"], job["files_processed"])]
    lens.delete_repository(all=True)
    return p.spark.createDataFrame([*rows, ("after", sum(lens.tables()[t].count() for t in names))], "name string, n long")


@query("""SELECT name, CASE name WHEN 'functions' THEN 10 * (n - gone) + changed WHEN 'classes' THEN 3 * (n - gone) WHEN 'variables' THEN 4 * (n - gone) WHEN 'imports' THEN 5 * (n - gone) WHEN 'changed' THEN changed WHEN 'runs' THEN 2 WHEN 'replaced' THEN changed + gone ELSE n - gone END AS n
  FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (s_suppkey % 10 = 1) AS BIGINT) AS gone, CAST(count(*) FILTER (s_suppkey % 10 = 0) AS BIGINT) AS changed FROM supplier),
  (VALUES ('files'), ('functions'), ('classes'), ('variables'), ('imports'), ('calls'), ('inherits'), ('implements'), ('changed'), ('runs'), ('replaced')) v(name)""")
def index_delta(p: Projection) -> DataFrame:
    """All files indexed, then a tenth changed and a tenth removed as one change: the rows of each table, and what the second
    publish wrote of files: a run of the changed ones that replaces those and the removed."""
    from repolens.plans.index import Indexer  # noqa: PLC0415

    store = SnapshotStore(p.spark, f"{shared_folder(p.spark)}/store-{uuid.uuid4().hex}")
    indexer, root = Indexer(p.spark, store), CODE_ROOT
    files = durable(p.ts_sources())
    indexer.index_files(root, files)
    key = F.regexp_extract("rel", "s([0-9]+)[.]", 1).cast("long") % 10
    more = F.concat("source", F.lit("\nexport function extraOne(a: number) { return a; }\n"))
    changed = files.where(key == 0).withColumn("source", more).withColumn("content_hash", F.sha2("source", 256))
    indexer.index_files(root, changed, files.where(key == 1).select("path"))
    tables, runs = store.tables(), store.snapshot().runs["files"]
    names = ("files", "functions", "classes", "variables", "imports", "calls", "inherits", "implements")
    rows = [(t, tables[t].count()) for t in names] + [("changed", runs[-1].rows), ("runs", len(runs)), ("replaced", runs[-1].gone)]
    return p.spark.createDataFrame(rows, "name string, n long")


@query("""SELECT '12 blocks' AS answer, 'function' AS kind, 'v' || vec_id AS name, '/e' AS path, CAST(vec_id AS INTEGER) AS line_number, 'about ' || vec_id AS description FROM embeddings
  ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) DESC, vec_id LIMIT 12""")
def ask_sources(p: Projection) -> DataFrame:
    """A question answered from the twelve nearest symbols; the answer counts the blocks of its prompt."""
    e = p.table("embeddings")
    number = F.col("vec_id").cast("string")
    rows = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), number).alias("name"), F.lit("/e").alias("path"), F.col("vec_id").cast("int").alias("line_number"), F.concat(F.lit("about "), number).alias("description"), "embedding")
    tables = {t: p.spark.createDataFrame([], TABLES[t]) for t in TABLES}
    tables["functions"] = rows.withColumn("source", F.lit("x")).withColumn("repo_path", F.lit(None).cast("string"))
    near = list(e.where("vec_id = 0").select("embedding").first()[0])
    found = ask.ask(tables, "what is near?", lambda _: near, lambda prompt, most: f"{prompt.count('### ')} blocks")  # noqa: ARG005
    rows = [(found["answer"], s["kind"], s["name"], s["path"], s["line_number"], s["description"]) for s in found["sources"]]
    return p.spark.createDataFrame(rows, "answer string, kind string, name string, path string, line_number int, description string")


_READ = ("SELECT 1 AS drop_me", "  select r_name from q_guard", "WITH a AS (SELECT r_name FROM q_guard) SELECT * FROM a", "SELECT upper(r_name), row_number() OVER (ORDER BY r_name) FROM q_guard WHERE r_regionkey >= (SELECT min(r_regionkey) FROM q_guard)")
_REFUSED = (
    "DROP TABLE q_guard", "INSERT INTO q_guard VALUES (1)", "CREATE VIEW x AS SELECT 1", "DELETE FROM q_guard", "SET spark.x = 1", "CACHE TABLE q_guard", "SELECT reflect(r_name, r_name) FROM q_guard",
    "SELECT * FROM q_guard WHERE r_name IN (SELECT java_method(r_name, r_name) FROM q_guard)", "WITH a AS (SELECT try_reflect(r_name, r_name) AS x FROM q_guard) SELECT x FROM a", "SELECT own_function(r_name) FROM q_guard", "SELECT * FROM text.`/etc/hosts`",
)


@query("SELECT text, CASE WHEN text LIKE '%drop_me' THEN 1 WHEN allowed THEN (SELECT count(*) FROM region) END AS n FROM (VALUES " + ", ".join(f"('{x}', {x in _READ})" for x in (*_READ, *_REFUSED)) + ") v(text, allowed)")
def read_only_guard(p: Projection) -> DataFrame:
    """The rows that statements give, null for those that are refused: what their plans and expressions do decides, not their
    first word."""
    search.register_views({"guard": p.table("region")}, "q_")

    def rows(text: str) -> int | None:
        try:
            return search.read_only_sql(p.spark, text).count()
        except PermissionError:
            return None

    return p.spark.createDataFrame([(x, rows(x)) for x in (*_READ, *_REFUSED)], "text string, n long")


@query("SELECT component, status, message FROM (VALUES ('engine', 'ok', NULL), ('generator', 'skipped', NULL), ('embedder', 'ok', NULL), ('store', 'ok', (SELECT count(DISTINCT p_brand) || ' files, ' || count(DISTINCT p_type) || ' modules' FROM part))) v(component, status, message)")
def health(p: Projection) -> DataFrame:
    """The parts of an engine whose store holds a file for each brand and a module for each type."""
    from repolens.api import Lens  # noqa: PLC0415

    lens = Lens(p.spark, f"{shared_folder(p.spark)}/store-{uuid.uuid4().hex}")
    part = p.table("part")
    files = part.select(F.col("p_brand").alias("path")).distinct()
    wanted = p.spark.createDataFrame([], TABLES["files"]).schema
    lens.store.publish({"files": files.select(*[(F.col(f.name) if f.name == "path" else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]), "modules": part.select(F.col("p_type").alias("name")).distinct()})
    found = lens.doctor()
    return p.spark.createDataFrame([(x["component"], x["status"], x["message"] if x["component"] == "store" else None) for x in found], "component string, status string, message string")


@query(f"""SELECT path, op, session_end, n_events FROM ({sql_of("watch_sessions")}) WHERE session_end <= (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') FROM events)""")
def watch_stream(p: Projection) -> DataFrame:
    """The sessions of changes as a stream gives them: those that the watermark has closed."""
    events = p.table("events")
    # a pattern, since a stream takes a plain path for a folder, and the table may be one file
    stream = p.spark.readStream.schema(events.schema).parquet(f"{p.sf_dir}/events.parquet*")
    stream = stream.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("seq"))
    place = f"{shared_folder(p.spark)}/stream-{uuid.uuid4().hex}"
    writer = debounced(stream, "2 hours", "0 seconds").writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{place}/state")
    writer.trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    out = p.spark.read.parquet(f"{place}/out")
    return out.select("path", "op", F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "n_events")
