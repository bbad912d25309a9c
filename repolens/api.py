"""The facade: fifteen tools by name over one store, with jobs, health checks and text output."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from repolens.functions.vectors import HashingEmbedder
from repolens.operators import analyze, graph, search
from repolens.plans import cypher, mutate
from repolens.plans.ask import ask
from repolens.plans.describe import Generator
from repolens.plans.index import Indexer
from repolens.sources.files import rooted
from repolens.sources.store import SnapshotStore
from repolens.streaming.watch import Watcher


#: A call by name that has more rows is an error, never a part of the result.
MOST_ROWS = 100_000


class Lens:
    """One snapshot store and everything that can be asked of it."""

    def __init__(self, spark: SparkSession, path: str, generator: Generator | None = None, embed: Callable[[str], list[float]] | None = None, slots: int = 16, same_repo: bool = False) -> None:
        self.spark, self.generator, self.embed = spark, generator, embed or HashingEmbedder()
        self.store = SnapshotStore(spark, path)
        self.indexer = Indexer(spark, self.store, generator, self.embed, slots, same_repo)
        self._watcher: Watcher | None = None

    @property
    def watcher(self) -> Watcher:
        if self._watcher is None:
            self._watcher = Watcher(self.spark, self.indexer)
        return self._watcher

    def tables(self) -> dict[str, DataFrame]:
        return self.store.tables()

    # -- the tools ---------------------------------------------------------------------------------

    def add_code_to_graph(self, path: str, is_dependency: bool = False) -> dict:
        job = self.indexer.jobs.get(self.indexer.index_directory(path, is_dependency))
        return asdict(job)

    def find_code(self, query: str, limit: int = 20) -> DataFrame:
        return search.fulltext(self.tables(), query, limit)

    def semantic_search(self, query: str, limit: int = 10) -> DataFrame:
        return search.vector_search(self.tables(), self.embed(query), limit).drop("repo_path")

    def analyze_code_relationships(self, query_type: str, target: str | None = None, limit: int = 20, depth: int = 5) -> DataFrame:
        return analyze.analyze(self.tables(), query_type, target, limit, depth)

    def execute_cypher_query(self, query: str, params: dict | None = None) -> DataFrame:
        """A reading query in the Cypher subset of ``plans.cypher``."""
        return cypher.run(self.spark, self.tables(), query, params)

    def write_cypher(self, query: str, params: dict | None = None) -> dict:
        """A writing query (``plans.mutate``); the number of the snapshot that it made.  Not a tool: the tools only read."""
        return {"snapshot": mutate.write(self.spark, self.store, query, params).number}

    def execute_query(self, query: str, params: dict | None = None) -> DataFrame:
        """Read-only SQL over views named after the tables, plus ``nodes`` and ``rels``."""
        tables = self.tables()
        search.register_views(tables | {"nodes": graph.all_nodes(tables), "rels": graph.all_edges(tables)})
        return search.read_only_sql(self.spark, query, params)

    def watch_directory(self, path: str) -> dict:
        self.watcher.watch(path)
        return {"watching": path}

    def unwatch_directory(self, path: str) -> dict:
        return {"stopped": self.watcher.unwatch(path)}

    def list_watched_paths(self) -> list[str]:
        return self._watcher.watched() if self._watcher else []

    def calculate_cyclomatic_complexity(self, function_name: str, path: str | None = None) -> DataFrame:
        return analyze.calculate_complexity(self.tables()["functions"], function_name, path)

    def find_most_complex_functions(self, limit: int = 10, repo_path: str | None = None) -> DataFrame:
        return analyze.most_complex(self.tables()["functions"], limit, repo_path)

    def find_dead_code(self, limit: int = 50, repo_path: str | None = None) -> DataFrame:
        t = self.tables()
        return analyze.dead_code(t["functions"], t["calls"], limit, repo_path)

    def ask_codebase(self, question: str, limit: int = 12, repo_path: str | None = None) -> dict:
        return ask(self.tables(), question, self.embed, self.generator, limit, repo_path)

    def list_indexed_repositories(self) -> DataFrame:
        return graph.list_repositories(self.tables()["repositories"])

    def delete_repository(self, path: str | None = None, all: bool = False) -> dict:  # noqa: A002
        if path is None and not all:
            raise ValueError("give a path or all")
        tables = self.tables()
        changed = {t: df.limit(0) for t, df in tables.items()} if all else graph.delete_repository(tables, rooted(self.spark, path))
        self.store.publish(changed)
        return {"deleted": "all" if all else path}

    def check_job_status(self, job_id: str | None = None) -> list[dict]:
        jobs = self.indexer.jobs.all() if job_id is None else [j for j in [self.indexer.jobs.get(job_id)] if j]
        if job_id is not None and not jobs:
            raise KeyError(f"no job {job_id}")
        return [asdict(j) for j in jobs]

    def stats(self, repo_path: str | None = None) -> DataFrame:
        return graph.stats(self.tables(), repo_path)

    def close(self) -> None:
        if self._watcher:
            self._watcher.close()

    # -- transport-free dispatch -------------------------------------------------------------------

    def call(self, tool: str, arguments: dict | None = None) -> str:
        """Call a tool by name; the result, or ``{"error": ...}``, as JSON text."""
        try:
            if tool not in (*TOOLS, "execute_query"):
                raise ValueError(f"unknown tool: {tool}")
            result = getattr(self, tool)(**(arguments or {}))
            if isinstance(result, DataFrame):
                rows = result.toJSON().take(MOST_ROWS + 1)
                if len(rows) > MOST_ROWS:
                    raise ValueError(f"the result has more than {MOST_ROWS} rows; ask for a part with SKIP and LIMIT")
                result = [json.loads(x) for x in rows]
            return json.dumps(result, indent=2, default=str, ensure_ascii=False)
        except Exception as e:  # noqa: BLE001  a tool's caller gets every failure as a result
            return json.dumps({"error": str(e)})

    def doctor(self) -> list[dict]:
        """component, status (ok, error or skipped), message, ms of the engine, the generator, the embedder and the store."""
        def check(component: str, probe: Callable[[], str] | None) -> dict:
            if probe is None:
                return {"component": component, "status": "skipped", "message": "not configured", "ms": 0}
            start = time.time()
            try:
                return {"component": component, "status": "ok", "message": probe(), "ms": round(1000 * (time.time() - start))}
            except Exception as e:  # noqa: BLE001
                return {"component": component, "status": "error", "message": str(e), "ms": round(1000 * (time.time() - start))}

        generator = None if self.generator is None else (lambda: "answers" if self.generator("File: probe", 5) else "no answer")
        return [
            check("engine", lambda: f"answered {self.spark.sql('SELECT 1 AS one').first()['one']}"),
            check("generator", generator),
            check("embedder", lambda: f"{len(self.embed('probe'))} dimensions"),
            check("store", lambda: f"{self.store.load('files').count()} files, {self.store.load('modules').count()} modules"),
        ]


TOOLS = (
    "add_code_to_graph", "find_code", "semantic_search", "analyze_code_relationships", "execute_cypher_query", "watch_directory", "unwatch_directory",
    "list_watched_paths", "calculate_cyclomatic_complexity", "find_most_complex_functions", "find_dead_code", "ask_codebase",
    "list_indexed_repositories", "delete_repository", "check_job_status",
)


def create_graph(spark: SparkSession, settings: dict[str, str] | None = None, generator: Generator | None = None) -> Lens:
    """A graph from settings (see ``config.load_config``)."""
    from repolens.config import load_config  # noqa: PLC0415

    s = load_config() if settings is None else settings
    return Lens(spark, s["REPOLENS_STORE"], generator, HashingEmbedder(int(s["REPOLENS_DIMENSIONS"])), int(s["REPOLENS_SLOTS"]))
