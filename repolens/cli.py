"""``python -m repolens.cli``: index, list, delete, stats, repo, watch, search, ask, config, doctor, analyze, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from repolens import config, mcp
from repolens.api import Lens, create_graph


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="repolens")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, to=sub) -> argparse.ArgumentParser:  # noqa: ANN001
        p = to.add_parser(name)
        for names, options in args:
            p.add_argument(*names, **options)
        return p

    path = (("path",), {})
    limit = lambda n: (("--limit",), {"type": int, "default": n})
    add("index", path, (("--dependency",), {"action": "store_true"}))
    add("list")
    add("delete", (("path",), {"nargs": "?"}), (("--all",), {"action": "store_true"}))
    add("stats", (("--repo",), {}))
    repo = sub.add_parser("repo").add_subparsers(dest="action", required=True)
    add("list", to=repo)
    add("delete", path, to=repo)
    add("watch", path)
    add("search", (("query",), {}), limit(5))
    add("ask", (("question",), {}), limit(12))
    add("config", (("pairs",), {"nargs": "*", "help": "KEY=value"}), (("--local",), {"action": "store_true"}))
    add("doctor")
    an = sub.add_parser("analyze").add_subparsers(dest="action", required=True)
    add("callers", (("target",), {}), limit(50), to=an)
    add("callees", (("target",), {}), limit(50), to=an)
    add("hierarchy", (("target",), {}), (("--depth",), {"type": int, "default": 10}), to=an)
    add("dead-code", limit(20), to=an)
    add("complexity", limit(10), to=an)
    add("serve")
    return top


def run(graph: Lens, a: argparse.Namespace, out=print) -> int:  # noqa: ANN001
    """Run one command and print its lines."""
    def rows(df) -> None:  # noqa: ANN001
        for r in df.toLocalIterator():
            out("  ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else " -> ".join(v) if isinstance(v, list) else str(v) for v in r))

    if a.command == "index":
        job = graph.add_code_to_graph(os.path.abspath(a.path), a.dependency)
        out(f"{job['status']}: {job['files_processed']} of {job['files_total']} files in {job['completed_at'] - job['started_at']:.1f} s" + (f" ({job['error']})" if job["error"] else ""))
        return int(job["status"] != "completed")
    if a.command == "list" or (a.command == "repo" and a.action == "list"):
        rows(graph.list_indexed_repositories())
    elif a.command in ("delete", "repo"):
        out(graph.call("delete_repository", {"path": a.path and os.path.abspath(a.path), "all": getattr(a, "all", False)}))
    elif a.command == "stats":
        for k, v in graph.stats(a.repo).first().asDict().items():
            out(f"{k}: {v}")
    elif a.command == "watch":
        graph.watch_directory(os.path.abspath(a.path))
        try:
            while graph.list_watched_paths():
                time.sleep(1)
        except KeyboardInterrupt:
            graph.close()
    elif a.command == "search":
        for r in graph.semantic_search(a.query, a.limit).collect():
            out(f"[{r['score']:.3f}] {r['kind']} {r['name']}  {r['path']}:{r['line_number'] or '?'}")
    elif a.command == "ask":
        found = graph.ask_codebase(a.question, a.limit)
        out(found["answer"])
        for s in found["sources"]:
            out(f"[{s['score']:.3f}] {s['kind']} {s['name']}  {s['path']}:{s['line_number'] or '?'}")
    elif a.command == "doctor":
        for x in graph.doctor():
            out(f"{x['component']}: {x['status']} ({x['message']}, {x['ms']} ms)")
    elif a.command == "analyze":
        kind = {"callers": "find_callers", "callees": "find_callees", "hierarchy": "class_hierarchy", "dead-code": "dead_code"}.get(a.action)
        rows(graph.find_most_complex_functions(a.limit) if kind is None else graph.analyze_code_relationships(kind, getattr(a, "target", None), getattr(a, "limit", 20), getattr(a, "depth", 5)))
    elif a.command == "serve":
        serve(graph, sys.stdin, out)
    return 0


def serve(graph: Lens, lines, out=print) -> None:  # noqa: ANN001
    """The Model Context Protocol, a message a line; also plain requests ({"tool": ..., "arguments": {...}}), a result a line."""
    for line in lines:
        if line.strip():
            try:
                request = json.loads(line)
                if "tool" not in request:
                    if (answer := mcp.handle(graph, request)) is not None:
                        out(json.dumps(answer, ensure_ascii=False))
                    continue
                result = graph.call(request.get("tool", ""), request.get("arguments"))
            except ValueError as e:
                result = json.dumps({"error": str(e)})
            out(json.dumps(json.loads(result), ensure_ascii=False))


def settings_command(a: argparse.Namespace, out=print) -> int:  # noqa: ANN001
    file = config.LOCAL_FILE if a.local else config.GLOBAL_FILE
    if a.pairs:
        config.write_env(file, dict(p.split("=", 1) for p in a.pairs))
    for k, v in config.masked(config.load_config()).items():
        out(f"{k}={v}")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "config":
        return settings_command(a)
    from pyspark.sql import SparkSession  # noqa: PLC0415

    spark = SparkSession.builder.appName("repolens").getOrCreate()
    return run(create_graph(spark), a)


if __name__ == "__main__":
    sys.exit(main())
