"""Maintenance of the graph's tables: scans, lookups, upserts, deletions, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.operators.traverse import reachable
from repolens.sources.schema import LABELS


def equal_keys(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def upsert_nodes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` with the non-null properties of ``new`` set, plus the rows that are only in ``new``.

    Of several new rows of a key, each property takes its largest non-null value, so the result has one row per key.
    """
    props = [c for c in new.columns if c not in key]
    new = new.groupBy(*key).agg(*[F.max(c).alias(c) for c in props]) if props else new.select(*key).distinct()
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]), "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in old.columns else F.col(f"n.{c}").alias(c)

    return joined.select(*[value(c) for c in old.columns])


def upsert_edges(old: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``old`` plus the rows of ``new`` (src_id, dst_id, ...) whose ends exist, each distinct tuple once."""
    src, dst = sources.select(F.col("id").alias("src_id")), targets.select(F.col("id").alias("dst_id"))
    return old.unionByName(new.join(src, "src_id", "left_semi").join(dst, "dst_id", "left_semi").select(*old.columns)).distinct()


def lookup(table: DataFrame, **key: object) -> DataFrame:
    """Rows with these property values."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), key.items(), table)


def node_id(label: str, columns: list[str]) -> Column:
    """What edges name a node by: its id, or the key of a label that has none."""
    if "id" in columns:
        return F.col("id").cast("string")
    if label == "Parameter":
        return F.concat_ws("#", "path", "function_name", "name")
    return F.col("name") if label == "Module" else F.col("path")


def all_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """label, id, name, path, line_number, repo_path of every node."""
    parts = []
    for name, label in LABELS.items():
        df = tables[name]
        has = lambda c, kind, df=df: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
        own = [has("name", "string"), has("path", "string"), has("line_number", "long"), has("repo_path", "string")]
        parts.append(df.select(F.lit(label).alias("label"), node_id(label, df.columns).alias("id"), *own))
    return reduce(DataFrame.unionByName, parts)


def all_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """type, src_label, src_id, dst_label, dst_id (both text), repo_path (of the source node) of every edge.

    Containment and parameters follow from the node tables; they are not stored twice.
    """
    def edge(df: DataFrame, kind: str, src_label: str, src: Column, dst_label: str, dst: Column, repo: Column | None = None) -> DataFrame:
        owner = F.col("repo_path") if repo is None else repo
        return df.select(F.lit(kind).alias("type"), F.lit(src_label).alias("src_label"), src.cast("string").alias("src_id"), F.lit(dst_label).alias("dst_label"), dst.cast("string").alias("dst_id"), owner.alias("repo_path"))

    none = F.lit(None).cast("string")
    c = F.col
    parts = [
        edge(tables["files"], "CONTAINS", "Repository", c("repo_path"), "File", c("path"), none),
        *[edge(tables[t], "CONTAINS", "File", c("path"), LABELS[t], c("id")) for t in ("functions", "classes", "variables")],
        edge(tables["contains_dir"], "CONTAINS_DIR", "Directory", c("parent_path"), "Directory", c("path"), none),
        edge(tables["contains_file"], "CONTAINS_FILE", "Directory", c("dir_path"), "File", c("path"), none),
        edge(tables["parameters"], "HAS_PARAMETER", "Function", F.concat_ws("#", "path", "function_name", F.col("line_number").cast("string")), "Parameter", F.concat_ws("#", "path", "function_name", "name")),
        edge(tables["imports"], "IMPORTS", "File", c("path"), "Module", c("module")),
        edge(tables["inherits"], "INHERITS", "Class", c("src_id"), "Class", c("dst_id")),
        edge(tables["implements"], "IMPLEMENTS", "Class", c("src_id"), "Class", c("dst_id")),
        edge(tables["calls"], "CALLS", "Function", c("src_id"), "Function", c("dst_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def stats(tables: dict[str, DataFrame], repo_path: str | None = None) -> DataFrame:
    """One row: repositories, files, functions, classes, variables, relationships.

    Interfaces count as classes; parameters and modules do not count.  With a repository only its own nodes count, and
    relationships from nodes that belong to it.  Every table is counted by itself and read once, without what a count does
    not need.
    """
    names = ("repositories", "files", "functions", "classes", "variables")
    owner = {t: "path" if t == "repositories" else "repo_path" for t in names}
    own = lambda df, c: df if repo_path is None else df.where(F.col(c) == repo_path)
    parts = [own(tables[t], owner[t]).agg(F.count("*").alias("n")).select(F.lit(t).alias("kind"), "n") for t in names]
    parts.append(own(all_edges(tables), "repo_path").agg(F.count("*").alias("n")).select(F.lit("relationships").alias("kind"), "n"))
    counts = reduce(DataFrame.unionByName, parts)
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in (*names, "relationships")])


def list_repositories(repositories: DataFrame) -> DataFrame:
    return repositories.select("path", "name").orderBy("path")


def content_hashes(files: DataFrame, repo_path: str) -> DataFrame:
    """path, content_hash of a repository's files that have one."""
    return files.where((F.col("repo_path") == repo_path) & (F.col("content_hash") != "")).select("path", "content_hash")


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, state: ``dirty`` (new or changed), ``skipped`` (same hash) or ``deleted`` (no longer there)."""
    c, s = current.alias("c"), stored.alias("s")
    both = c.join(s, F.col("c.path") == F.col("s.path"), "full_outer")
    state = F.when(F.col("c.path").isNull(), "deleted").when(F.col("s.content_hash").eqNullSafe(F.col("c.content_hash")), "skipped").otherwise("dirty")
    return both.select(F.coalesce("c.path", "s.path").alias("path"), state.alias("state"))


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables that change when the files ``paths`` (path) and all they contain go, edges on either end too."""
    gone = lambda df, col="path": df.join(paths.select(F.col("path").alias(col)), col, "left_anti")
    out = {t: gone(tables[t]) for t in ("files", "functions", "classes", "variables", "parameters", "imports", "contains_file", "parsed_calls")}
    for t in ("calls", "inherits", "implements"):
        dead = tables["functions" if t == "calls" else "classes"].join(paths, "path", "left_semi").select("id")
        kept = tables[t].join(dead.select(F.col("id").alias("src_id")), "src_id", "left_anti")
        out[t] = kept.join(dead.select(F.col("id").alias("dst_id")), "dst_id", "left_anti").select(*tables[t].columns)
    out = {t: df.select(*tables[t].columns) for t, df in out.items()}
    for t in ("name_postings", "vectors"):
        if t in tables:
            out[t] = gone(tables[t]).select(*tables[t].columns)
    used = out["imports"].select(F.col("module").alias("name")).distinct()
    return out | {"modules": tables["modules"].join(used, "name", "left_semi")}


def delete_repository(tables: dict[str, DataFrame], repo_path: str) -> dict[str, DataFrame]:
    """The tables without a repository: its own files and directories, never those of another."""
    paths = tables["files"].where(F.col("repo_path") == repo_path).select("path")
    out = delete_files(tables, paths)
    rest = lambda t: (out.get(t, tables[t])).where(~F.col("repo_path").eqNullSafe(F.lit(repo_path)))
    out |= {t: rest(t) for t in ("directories", "contains_dir", "contains_file", "vectors") if t in tables}
    return out | {"repositories": tables["repositories"].where(F.col("path") != repo_path)}


def delete_reachable(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes (id) that stay when ``start`` (id) and everything reachable from it goes."""
    return nodes.join(reachable(edges, start), "id", "left_anti")


def set_embeddings(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Set description, described_hash and embedding on all rows of a key; others keep theirs."""
    props = ("description", "described_hash", "embedding")
    n = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in props]).dropDuplicates(key)
    joined = table.join(n, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in props else F.col(c) for c in table.columns])


def directory_tree(files: DataFrame, root: str) -> DataFrame:
    """path, parent_path, name, depth of every directory above the files (path, rel), the root itself as depth 0.

    A file in the root has the root as its directory.
    """
    parts = F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1)
    steps = files.select(F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    at = lambda n: F.when(n <= 0, F.lit(root)).otherwise(F.concat(F.lit(root + "/"), F.array_join(F.slice("parts", F.lit(1), n), "/")))
    depth = F.col("depth")
    return steps.select(
        at(depth).alias("path"), F.when(depth > 0, at(depth - 1)).alias("parent_path"),
        F.when(depth > 0, F.try_element_at("parts", depth)).otherwise(F.element_at(F.split(F.lit(root), "/"), -1)).alias("name"), "depth",
    ).distinct()


def directory_groups(files: DataFrame) -> DataFrame:
    """dir_path, n_files, file_list (sorted names joined by line breaks) and its hash."""
    named = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir_path"), F.element_at(F.split("path", "/"), -1).alias("name"))
    out = named.groupBy("dir_path").agg(F.count("*").alias("n_files"), F.array_join(F.sort_array(F.collect_list("name")), "\n").alias("file_list"))
    return out.withColumn("list_hash", F.sha2("file_list", 256))
