"""Answering a question: nearest symbols, their surroundings, a prompt, an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.text import truncated
from repolens.operators.resolve import first_per
from repolens.operators.search import vector_search
from repolens.plans.describe import Generator

NOTHING_FOUND = "Nothing in the indexed code matches this question."
NO_ANSWER = "No answer could be generated."
MAX_NEIGHBOURS = 5
ANSWER_TOKENS = 1500


def _names(edges: DataFrame, nodes: DataFrame, own: str, other: str, column: str, most: int | None) -> DataFrame:
    """For each id on one end of the edges the distinct names on the other, sorted, at most ``most``.

    With a limit only the first names of an id are ever brought together, however many edges it has.
    """
    named = edges.select(F.col(own).alias("id"), F.col(other).alias("other")).join(nodes.select(F.col("id").alias("other"), "name"), "other")
    named = named.select("id", "name").distinct()
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("name"))
        named = named.withColumn("nth", rank).where(F.col("nth") <= most)
    return named.groupBy("id").agg(F.sort_array(F.collect_list("name")).alias(column))


def enrich(results: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``results`` (kind, name, path, ...) with source, callers, callees, parents and interfaces, all in one plan.

    Several symbols of one name and path count as the first by line.
    """
    f = first_per(tables["functions"], ["name", "path"], ["line_number"]).select(F.lit("function").alias("kind"), "name", "path", "id", "source")
    c = first_per(tables["classes"], ["name", "path"], ["line_number"]).select(F.lit("class").alias("kind"), "name", "path", "id", "source")
    wanted = results.select("kind", "name", "path").distinct()
    nodes = f.unionByName(c).join(wanted, ["kind", "name", "path"], "left_semi")
    ids = nodes.select("id")
    near = lambda t, own: tables[t].join(ids.withColumnRenamed("id", own), own, "left_semi")
    out = results.join(nodes, ["kind", "name", "path"], "left")
    for t, own, other, column, table, most in (
        ("calls", "src_id", "dst_id", "callees", "functions", MAX_NEIGHBOURS),
        ("calls", "dst_id", "src_id", "callers", "functions", MAX_NEIGHBOURS),
        ("inherits", "src_id", "dst_id", "parents", "classes", None),
        ("implements", "src_id", "dst_id", "interfaces", "classes", None),
    ):
        out = out.join(_names(near(t, own), tables[table], own, other, column, most), "id", "left")
    return out.withColumn("source", truncated(F.col("source"))).drop("id")


def context_block() -> Column:
    """The text on one enriched symbol."""
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}: "), F.array_join(c, ", ")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.col("kind"), F.lit(" `"), F.col("name"), F.lit("` "), F.col("path"), F.lit(":"), F.coalesce(F.col("line_number").cast("string"), F.lit("?"))),
        F.concat(F.lit("Description: "), F.coalesce("description", F.lit(""))),
        listed("Called by", "callers"), listed("Calls", "callees"), listed("Extends", "parents"), listed("Implements", "interfaces"),
        F.when(F.col("source").isNotNull(), F.concat(F.lit("```\n"), F.col("source"), F.lit("\n```"))),
    )


def prompt_of(question: str, blocks: list[str]) -> str:
    return (
        "Answer from the context below and nothing else. If it holds no evidence, say so. Cite symbols and file paths as file:line, "
        "invent no code, and answer in the language of the question.\n\n## Context\n\n" + "\n\n".join(blocks) + f"\n\n## Question\n\n{question}"
    )


def ask(tables: dict[str, DataFrame], question: str, embed: Callable[[str], list[float]], generator: Generator | None, limit: int = 12, repo_path: str | None = None) -> dict:
    """answer and sources (at most ``limit`` rows) for a question; with a repository only its symbols count."""
    if repo_path is not None:
        own = lambda df: df.where(F.col("repo_path") == repo_path)
        tables = tables | {t: own(tables[t]) for t in ("functions", "classes", "files", "directories")}
        # the cells nearest to a question may hold few nodes of one repository: all of them are compared
        tables.pop("vectors", None)
    found = vector_search(tables, embed(question), limit)
    rows = enrich(found, tables).withColumn("block", context_block()).orderBy(F.col("score").desc(), "path", "line_number", "name").collect()
    if not rows:
        return {"answer": NOTHING_FOUND, "sources": []}
    answer = generator(prompt_of(question, [r["block"] for r in rows]), ANSWER_TOKENS) if generator else None
    keep = ("kind", "name", "path", "line_number", "description", "score")
    return {"answer": answer or NO_ANSWER, "sources": [{k: r[k] for k in keep} for r in rows]}
