"""Indexing: source files to the graph's tables, incrementally.

One Arrow pass parses the changed files; everything after is set-based.  A file that changes takes the descriptions of its
unchanged symbols along, vanished files go, and the calls and bases that the change may concern are linked again over all
files, so edges from unchanged files into changed ones survive.  What is written is what changes: the rows of the changed
files, and the links of the sources that are linked again.
"""

from __future__ import annotations

import logging
import secrets
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from repolens.functions.parsers import parse
from repolens.functions.parsers.tokens import MAX_SOURCE
from repolens.functions.text import basename, dirname, symbol_id
from repolens.operators import graph, resolve, search, segments
from repolens.operators.traverse import durable, few_broadcasts, swept
from repolens.plans import describe
from repolens.sources.files import exists, read_sources, rooted
from repolens.sources.schema import NODES, PARSED_FILE
from repolens.sources.store import Change, Snapshot, SnapshotStore, Units, together


PARSED_BYTES = 8 << 20
#: What is parsed goes on in batches of about so many characters of source.
BATCH_CHARS = 1 << 21
#: A change of more files is written in a bucket for so many of them, up to ``MOST_BUCKETS``.
FILES_PER_BUCKET, MOST_BUCKETS = 2_000, 1_024


def parse_files(sources: DataFrame, is_dependency: bool = False, only: tuple[str, ...] = ("functions", "classes", "imports", "calls", "variables")) -> DataFrame:
    """path, lang and the five arrays of each source file (path, source), or ``only`` some of them; ``error`` for a file that
    can't be read."""
    kinds = {f.name: f.dataType for f in StructType.fromDDL(f"{PARSED_FILE}, error string")}
    names = ["path", "lang", *only, "error"]
    schema = StructType([StructField(c, kinds[c]) for c in names])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, source in zip(batch["path"].to_pylist(), batch["source"].to_pylist(), strict=True):
                try:
                    row = parse(path, source, is_dependency)
                    if row is None:
                        continue
                    row["error"] = None
                except Exception as e:  # noqa: BLE001  one odd file does not stop the others
                    row = {"path": path, "lang": None, "error": str(e)[:500]} | {k: [] for k in only}
                rows.append(row)
                size += len(source or "")
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], arrow.field(c).type) for c in names], schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], arrow.field(c).type) for c in names], schema=arrow)

    # parsing takes far longer than moving a source, and a few blocks may hold all of them: at least two tasks a core, and
    # no more than about PARSED_BYTES in one
    size = sources.agg(F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()[0]
    tasks = max(2 * sources.sparkSession.sparkContext.defaultParallelism, size // PARSED_BYTES)
    spread = sources.select("path", "source").repartition(tasks, "path")
    return spread.mapInArrow(run, schema)


def prescan(parsed: DataFrame) -> DataFrame:
    """name, path, line_number of the symbols that other files may mean: top-level functions and all classes.

    Both come from one pass over ``parsed``, which Spark would parse once for each.
    """
    place = lambda x: F.struct(x["name"].alias("name"), x["line_number"].alias("line_number"))
    top = F.filter("functions", lambda x: x["context"].isNull() & x["class_context"].isNull())
    both = F.concat(F.transform(top, place), F.transform("classes", place))
    return parsed.select("path", F.explode(both).alias("x")).select("x.name", "path", "x.line_number").distinct()


def tables_of(parsed: DataFrame, sources: DataFrame, repo_path: str) -> dict[str, DataFrame]:
    """Node and import tables of parsed files; links come later."""
    repo = F.lit(repo_path).alias("repo_path")
    lang = parsed.select("path", "lang")
    none = [F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("described_hash"), F.lit(None).cast("array<float>").alias("embedding")]
    rows = lambda c: parsed.select("path", "lang", F.explode(c).alias("x")).select("path", "lang", "x.*")
    ident = symbol_id(F.col("path"), F.col("name"), F.col("line_number")).alias("id")
    cut = F.substring("source", 1, MAX_SOURCE).alias("source")
    key = ["name", "path", "line_number"]
    functions = rows("functions").dropDuplicates(key).select(
        ident, "name", "path", "line_number", "end_line", "args", cut, "docstring", "cyclomatic_complexity", "context", "class_context", "is_async", "kind", "decorators", "lang", repo, *none
    )
    classes = rows("classes").dropDuplicates(key).select(ident, "name", "path", "line_number", "end_line", "bases", "implements", cut, "docstring", "is_abstract", "is_interface", "lang", repo, *none)
    variables = rows("variables").dropDuplicates(key).select(ident, "name", "path", "line_number", "value", "type", "context", "class_context", "lang", repo, *none)
    parameters = rows("functions").select(F.explode("args").alias("name"), F.col("name").alias("function_name"), "path", "line_number", repo)
    parameters = parameters.groupBy("name", "function_name", "path").agg(F.min("line_number").alias("line_number"), F.first("repo_path").alias("repo_path"))
    imports = rows("imports").select("path", F.col("source").alias("module"), F.col("name").alias("imported_name"), "alias", "line_number", "is_default", "is_namespace", repo).distinct()
    files = sources.join(lang, "path", "left_semi").select("path", basename(F.col("path")).alias("name"), "lang", repo, "content_hash", *none)
    tree = graph.directory_tree(sources.select("path", "rel"), repo_path)
    return {
        "functions": functions, "classes": classes, "variables": variables, "parameters": parameters, "imports": imports, "files": files,
        "parsed_calls": rows("calls").select("path", "name", "line_number", "args", "caller_name", "caller_line_number", "full_call_name", "inferred_obj_type", repo),
        "modules": imports.select(F.col("module").alias("name")).distinct(),
        "directories": tree.where("depth > 0").select("path", "name", repo, *none).unionByName(tree.where("depth = 0").select("path", F.lit(".").alias("name"), repo, *none)),
        "contains_dir": tree.where("depth > 0").select("parent_path", "path", repo).distinct(),
        "contains_file": files.select(dirname(F.col("path")).alias("dir_path"), "path", repo),
    }


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` symbols with the description of an old symbol of the same file, name and source; the nth of a name takes the
    nth's."""
    def ranked(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(_window("path", "name", "digest"))
        return df.withColumn("digest", F.sha2(F.coalesce("source", F.lit("")), 256)).withColumn("nth", rank)

    texts = ["description", "described_hash", "embedding"]
    kept = ranked(old).select("path", "name", "digest", "nth", *texts).where("description is not null")
    return ranked(new).drop(*texts).join(kept, ["path", "name", "digest", "nth"], "left").select(*new.columns)


def _window(*keys: str):  # noqa: ANN202
    from pyspark.sql import Window  # noqa: PLC0415

    return Window.partitionBy(*keys).orderBy("line_number")


log = logging.getLogger("repolens")


@dataclass
class Job:
    """The state of one indexing run."""

    id: str
    path: str
    status: str = "running"
    files_total: int = 0
    files_processed: int = 0
    started_at: float = field(default_factory=time.time)
    completed_at: float | None = None
    error: str | None = None


class JobStore:
    """Jobs of this session; an update of an unknown id does nothing."""

    def __init__(self) -> None:
        self._jobs: dict[str, Job] = {}

    def create(self, path: str) -> Job:
        job = Job(f"job_{int(time.time() * 1000)}_{secrets.token_hex(3)}", path)
        self._jobs[job.id] = job
        return job

    def get(self, job_id: str) -> Job | None:
        return self._jobs.get(job_id)

    def all(self) -> list[Job]:
        return list(self._jobs.values())

    def update(self, job_id: str, **changes: object) -> None:
        if (job := self._jobs.get(job_id)) is not None:
            for k, v in changes.items():
                setattr(job, k, v)


class Indexer:
    """Keeps a snapshot store in step with source trees."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, generator: describe.Generator | None = None, embed=None, slots: int = 16, same_repo: bool = False) -> None:  # noqa: ANN001
        self.spark, self.store, self.generator, self.embed, self.slots, self.same_repo = spark, store, generator, embed, slots, same_repo
        self.jobs = JobStore()

    def index_directory(self, path: str, is_dependency: bool = False) -> str:
        """Bring the store in step with a directory; returns the job's id."""
        root = rooted(self.spark, path)
        job = self.jobs.create(root)
        try:
            if not exists(self.spark, root):
                raise FileNotFoundError(root)
            # hashes first: only what changed is read a second time and kept
            current = read_sources(self.spark, root)
            hashes = durable(current.select("path", "rel", "content_hash"))
            total = hashes.count()
            self.jobs.update(job.id, files_total=total)
            with swept(self.spark), few_broadcasts(self.spark):
                self._apply(root, current, None, is_dependency, hashes)
            self.jobs.update(job.id, status="completed", files_processed=total, completed_at=time.time())
            log.info("indexed %s: %d files", root, total)
        except Exception as e:  # noqa: BLE001  the job keeps the reason
            log.error("indexing %s failed: %s", root, e)
            self.jobs.update(job.id, status="failed", error=str(e), completed_at=time.time())
        return job.id

    def index_files(self, root: str, sources: DataFrame, removed: DataFrame | None = None, is_dependency: bool = False) -> None:
        """Upsert single files (path, rel, lang, source, content_hash) and remove others (path)."""
        with swept(self.spark), few_broadcasts(self.spark):
            self._apply(rooted(self.spark, root), sources, removed if removed is not None else self.spark.createDataFrame([], "path string"), is_dependency)

    def remove_file(self, path: str) -> None:
        paths = self.spark.createDataFrame([(path,)], "path string")
        self.store.publish(graph.delete_files(self.store.tables(), paths))

    def _apply(self, root: str, current: DataFrame, removed: DataFrame | None, is_dependency: bool, hashes: DataFrame | None = None) -> None:
        """``removed`` None: what the store has of this root and ``current`` has not is gone.  ``hashes`` (path,
        content_hash) of ``current``, if they are known."""
        base = self.store.snapshot()
        tables = self.store.tables(base)
        state = durable(graph.diff((current if hashes is None else hashes).select("path", "content_hash"), graph.content_hashes(tables["files"], root)))
        gone = state.where("state = 'deleted'").select("path") if removed is None else removed
        paths = state.where("state = 'dirty'").select("path").unionByName(gone)
        paths = state.where("state in ('dirty', 'deleted')").select("path") if removed is None else durable(paths)
        n = paths.count()
        known = not tables["repositories"].where(F.col("path") == root).isEmpty()
        if not n and known and self.generator is None:
            return
        dirty = durable(current.join(state.where("state = 'dirty'").select("path"), "path", "left_semi"))
        read = durable(parse_files(dirty, is_dependency))
        for r in read.where("error is not null").select("path", "error").limit(20).collect():
            log.warning("%s was not parsed: %s", r["path"], r["error"])
        made = tables_of(read.where("error is null").drop("error"), dirty, root)
        changes = self._changes(made, tables, paths, self.store.write_units(paths) if base.number else Units("", 0))
        if not known:
            repo = self.spark.createDataFrame([(root, root.rpartition("/")[2])], NODES["repositories"])
            changes["repositories"] = Change(repo, self._none())
        buckets = min(MOST_BUCKETS, 1 + n // FILES_PER_BUCKET)
        names = list(changes)
        runs = dict(zip(names, ([r] for r in together(self.spark, [lambda t=t: self.store.write(t, changes[t], buckets, not base.runs.get(t)) for t in names])), strict=True))
        ahead = Snapshot(base.number, base.runs | {t: base.runs.get(t, []) + r for t, r in runs.items()})
        for t, change in self._described(self.store.tables(ahead), dirty).items():
            runs[t] = runs.get(t, []) + [self.store.write(t, change, buckets)]
            ahead.runs[t] = base.runs.get(t, []) + runs[t]
        now = self.store.tables(ahead)
        rest = self.relinked(now, tables, paths) | self._vectors(now, tables, paths)
        if "name_postings" not in changes:  # a store of an earlier version has no index yet
            rest["name_postings"] = search.name_postings(search.symbols(now))
        self.store.publish(runs | rest, base, buckets)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "unit string")

    def _changes(self, made: dict[str, DataFrame], tables: dict[str, DataFrame], paths: DataFrame, units: Units) -> dict[str, Change]:
        """What the files ``paths`` change in the tables that follow from parsing: their rows, and names and directories that
        come or go.  ``units`` are the paths as the store has written them."""
        held = lambda t: tables[t].join(paths, "path", "left_semi")
        for t in ("functions", "classes"):
            made[t] = carry_over(made[t], held(t))
        out = {t: Change(made[t], units) for t in ("functions", "classes", "variables", "parameters", "imports", "files", "parsed_calls", "contains_file")}
        if "name_postings" in tables or tables["files"].isEmpty():
            out["name_postings"] = Change(search.name_postings(search.symbols({t: made[t] for t in search.SYMBOL_TABLES})), units)
        used = tables["imports"].join(paths, "path", "left_anti").select("module").unionByName(made["imports"].select("module"))
        left = held("imports").select("module").distinct().join(used, "module", "left_anti")
        out["modules"] = Change(made["modules"].join(tables["modules"], "name", "left_anti"), left)
        out["contains_dir"] = Change(made["contains_dir"].join(tables["contains_dir"], ["parent_path", "path"], "left_anti"), self._none())
        keys = ["path", "name", "repo_path"]
        new = made["directories"].select(*keys)
        both = graph.upsert_nodes(tables["directories"].join(new, "path", "left_semi"), new, ["path"])
        out["directories"] = Change(both.join(tables["directories"].select(*keys), keys, "left_anti"), self._none())
        return out

    def relinked(self, tables: dict[str, DataFrame], old: dict[str, DataFrame], paths: DataFrame) -> dict[str, Change]:
        """What changes in the link tables once the files ``paths`` have changed from ``old`` to ``tables``: the links that the
        change may concern are made again.  Links are replaced by source, so a source that keeps others takes them along."""
        held = lambda t, kind: t[kind].join(paths, "path", "left_semi")
        moved = [held(t, kind).select(F.lit(kind).alias("kind"), "name") for t in (old, tables) for kind in ("functions", "classes")]
        moved = durable(reduce(DataFrame.unionByName, moved).distinct())
        class_names, names = moved.where("kind = 'classes'").select("name"), moved.select("name").distinct()
        f, c = tables["functions"], tables["classes"]
        parsed = tables["parsed_calls"].select("path", "name", "caller_name", "line_number")
        redone = durable(parsed.join(resolve.affected_calls(parsed, tables["imports"], paths, names), ["path", "name"], "left_semi"))
        again = redone.select("path", "name").distinct()
        callers = redone.select("path", F.col("caller_name").alias("name")).distinct()
        sources = f.join(callers, ["path", "name"], "left_semi").select(F.col("id").alias("src_id"), "path")
        ends = old["calls"].join(sources.join(paths, "path", "left_anti"), "src_id")
        ends = ends.join(f.join(paths, "path", "left_anti").select(F.col("id").alias("dst_id"), "name"), "dst_id")
        kept = ends.join(again, ["path", "name"], "left_anti").select("src_id", "dst_id", "line_number", "repo_path")
        made = self.linked(tables | {"parsed_calls": redone}, class_names, paths)
        ids = lambda t: held(old, t).select(F.col("id").alias("unit"))
        out = {"calls": Change(kept.unionByName(made["calls"]), ids("functions").unionByName(sources.select(F.col("src_id").alias("unit"))))}
        for t, column in (("inherits", "bases"), ("implements", "implements")):
            concerned = self._concerned(c, column, class_names, paths).select(F.col("id").alias("unit"))
            out[t] = Change(made[t], ids("classes").unionByName(concerned))
        return out

    @staticmethod
    def _concerned(classes: DataFrame, column: str, names: DataFrame, paths: DataFrame) -> DataFrame:
        """id of the classes in the files ``paths``, and of those that list one of ``names``."""
        listed = classes.select("id", F.explode(column).alias("name")).join(names, "name", "left_semi").select("id")
        return classes.join(paths, "path", "left_semi").select("id").unionByName(listed).distinct()

    def linked(self, tables: dict[str, DataFrame], names: DataFrame | None = None, paths: DataFrame | None = None) -> dict[str, DataFrame]:
        """The link tables over all files; of classes, if ``names`` and ``paths`` are given, only those that they concern."""
        only = lambda column: None if names is None else self._concerned(tables["classes"], column, names, paths)
        f, c = tables["functions"], tables["classes"]
        owner = lambda df, t: df.join(t.select(F.col("id").alias("src_id"), "repo_path"), "src_id")
        calls = resolve.link_calls(tables["parsed_calls"].select("path", "name", "caller_name", "line_number"), tables["imports"], f, resolve.symbols_of(f, c))
        return {
            "calls": owner(calls, f).select("src_id", "dst_id", "line_number", "repo_path"),
            "inherits": owner(resolve.link_bases(c, "bases", True, self.same_repo, only("bases")), c).select("src_id", "dst_id", "repo_path"),
            "implements": owner(resolve.link_bases(c, "implements", False, self.same_repo, only("implements")), c).select("src_id", "dst_id", "repo_path"),
        }

    def _described(self, tables: dict[str, DataFrame], dirty: DataFrame) -> dict[str, Change]:
        """New texts, with all else that stands under the same paths."""
        if self.generator is None:
            return {}
        symbols = describe.symbol_rows(tables["functions"], tables["classes"])
        wanted = {t: (symbols.where(F.col("kind") == kind).drop("kind"), "id") for t, kind in (("functions", "function"), ("classes", "class"))}
        wanted["files"] = (describe.file_rows(tables["files"], dirty, tables["functions"], tables["classes"]), "path")
        wanted["directories"] = (describe.directory_rows(tables["files"]), "path")
        out = {}
        for t, (rows, key) in wanted.items():
            texts = self._texts(rows, tables[t], [key])
            touched = tables[t].join(texts.select(key), key, "left_semi").select("path").distinct()
            out[t] = Change(graph.set_embeddings(tables[t].join(touched, "path", "left_semi"), texts, [key]), self._none())
        return out

    def _vectors(self, tables: dict[str, DataFrame], old: dict[str, DataFrame], paths: DataFrame) -> dict[str, Change | DataFrame]:
        """The segment of the vector index for the files that changed and whatever else got a text, or, when the index has grown
        so much that its cells don't fit any more, the whole index by new ones."""
        if self.generator is None and "vectors" not in old:
            return {}
        labels = search.VECTOR_TABLES
        rows = segments.vector_rows(tables, labels)
        n, trained = rows.count(), old["centroids"].agg(F.max("trained")).first()[0] if "vectors" in old else None
        if not n and trained is None:
            return {}
        if trained is None or n > segments.REGROWN * max(trained, segments.FEW):
            dimensions = rows.select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.col("count").desc(), "n").first()["n"]
            centroids = durable(segments.train(rows, dimensions))
            return {"centroids": centroids, "vectors": segments.assigned(rows, segments.centers_of(centroids))}
        rows = segments.usable(rows, segments.centers_of(old["centroids"]).shape[1])
        key = ["label", "node", "path"]
        # new texts are found by comparing: a description may come long after its file
        was = old["vectors"].select(*key, F.col("embedding").alias("was"))
        moved = rows.select(*key, "embedding").join(was, key, "left").where(~F.col("embedding").eqNullSafe(F.col("was"))).select("path")
        touched = durable(paths.select("path").unionByName(moved).distinct())
        made = segments.vector_rows(tables, labels, touched)
        return {"vectors": Change(segments.assigned(made, segments.centers_of(old["centroids"])), touched)}

    def _texts(self, rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
        return durable(describe.describe(rows, table, key, self.generator, self.embed, self.slots))
