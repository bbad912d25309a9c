"""Structural questions: callers, callees, chains, hierarchies, dead code, importers, dependencies, complexity.

Tables: functions and classes have id, name, path, line_number; calls and inherits have src_id and dst_id.  Every limited
result has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.operators.traverse import trails


def _ends(functions: DataFrame, calls: DataFrame, caller: Column | None = None, callee: Column | None = None) -> DataFrame:
    src = functions.select(F.col("id").alias("src_id"), F.col("name").alias("caller_name"), F.col("path").alias("caller_path"), F.col("line_number").alias("caller_line"))
    dst = functions.select(F.col("id").alias("dst_id"), F.col("name").alias("callee_name"), F.col("path").alias("callee_path"), F.col("line_number").alias("callee_line"))
    src = src if caller is None else src.where(caller)
    dst = dst if callee is None else dst.where(callee)
    edge = calls.select("src_id", "dst_id", F.col("line_number").alias("call_line"))
    return edge.join(dst, "dst_id").join(src, "src_id") if caller is None else edge.join(src, "src_id").join(dst, "dst_id")


def find_callers(functions: DataFrame, calls: DataFrame, name: str, limit: int = 20) -> DataFrame:
    out = _ends(functions, calls, callee=F.col("callee_name") == name)
    cols = ["caller_name", "caller_path", "caller_line", "call_line"]
    return out.select(*cols).orderBy("caller_path", "caller_line", "caller_name", "call_line").limit(limit)


def find_callees(functions: DataFrame, calls: DataFrame, name: str, limit: int = 20) -> DataFrame:
    out = _ends(functions, calls, caller=F.col("caller_name") == name)
    cols = ["callee_name", "callee_path", "callee_line", "call_line"]
    return out.select(*cols).orderBy("callee_path", "callee_line", "callee_name", "call_line").limit(limit)


def call_chain(functions: DataFrame, calls: DataFrame, name: str, depth: int = 5, limit: int = 20) -> DataFrame:
    """length, names of the call trails of 1 to ``depth`` calls."""
    return trails(functions, calls, name, depth, 1, limit)


def class_hierarchy(classes: DataFrame, inherits: DataFrame, name: str, depth: int = 5) -> DataFrame:
    """length, names of the inheritance trails of 0 to ``depth`` steps: the class alone comes first."""
    return trails(classes, inherits, name, depth, 0)


def dead_code(functions: DataFrame, calls: DataFrame, limit: int = 50, repo_path: str | None = None) -> DataFrame:
    """Functions that nothing calls and that are not constructors; calling itself counts."""
    df = functions if repo_path is None else functions.where(F.col("repo_path") == repo_path)
    df = df.where(F.col("kind").isNull() | (F.col("kind") != "constructor"))
    df = df.join(calls.select(F.col("dst_id").alias("id")), "id", "left_anti")
    return df.select("name", "path", "line_number").orderBy("path", "line_number", "name").limit(limit)


def find_importers(imports: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Imports of a name, or of a module whose name contains it."""
    hit = (F.col("imported_name") == name) | F.contains("module", F.lit(name))
    cols = ["path", "module", "imported_name", "line_number"]
    return imports.where(hit).select(*cols).orderBy("path", "line_number", "module", "imported_name").limit(limit)


def module_deps(imports: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """Modules that files whose path contains ``path`` import."""
    return imports.where(F.contains("path", F.lit(path))).select("path", "module").distinct().orderBy("path", "module").limit(limit)


def find_complexity(functions: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Functions whose name contains ``name``, the most complex first."""
    df = functions.where(F.contains("name", F.lit(name)))
    return _by_complexity(df).limit(limit).select("name", "path", "complexity")


def most_complex(functions: DataFrame, limit: int = 10, repo_path: str | None = None) -> DataFrame:
    df = functions if repo_path is None else functions.where(F.col("repo_path") == repo_path)
    return _by_complexity(df).limit(limit)


def calculate_complexity(functions: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """All functions of exactly this name, and path if given."""
    df = functions.where(F.col("name") == name)
    df = df if path is None else df.where(F.col("path") == path)
    return df.select("name", "path", "line_number", F.col("cyclomatic_complexity").alias("complexity"))


def _by_complexity(functions: DataFrame) -> DataFrame:
    df = functions.select("name", "path", "line_number", F.col("cyclomatic_complexity").alias("complexity"))
    return df.orderBy(F.col("complexity").desc_nulls_first(), "name", "path", "line_number")


#: Query types of ``analyze`` and the name of what each takes.
QUERIES = ("find_callers", "find_callees", "class_hierarchy", "call_chain", "dead_code", "find_importers", "module_deps", "find_complexity")


def analyze(tables: dict[str, DataFrame], query_type: str, target: str | None = None, limit: int = 20, depth: int = 5) -> DataFrame:
    """Dispatch by name; ValueError for an unknown one or a missing target."""
    if query_type not in QUERIES:
        raise ValueError(f"unknown query type: {query_type}")
    if target is None and query_type != "dead_code":
        raise ValueError("target is required")
    t = tables
    return {
        "find_callers": lambda: find_callers(t["functions"], t["calls"], target, limit),
        "find_callees": lambda: find_callees(t["functions"], t["calls"], target, limit),
        "class_hierarchy": lambda: class_hierarchy(t["classes"], t["inherits"], target, depth),
        "call_chain": lambda: call_chain(t["functions"], t["calls"], target, depth, limit),
        "dead_code": lambda: dead_code(t["functions"], t["calls"], limit),
        "find_importers": lambda: find_importers(t["imports"], target, limit),
        "module_deps": lambda: module_deps(t["imports"], target, limit),
        "find_complexity": lambda: find_complexity(t["functions"], target, limit),
    }[query_type]()
