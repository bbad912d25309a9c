"""Search: names by BM25, substrings, vectors, and read-only SQL."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions.text import display_name, kind_of_label, tokens
from repolens.functions.vectors import cosine_score, dot
from repolens.operators import segments

K1, B = 1.2, 0.75
SYMBOL_TABLES = {"functions": "Function", "classes": "Class", "variables": "Variable"}


def symbols(tables: dict[str, DataFrame]) -> DataFrame:
    """label, labels, name, path, line_number of functions, classes and variables."""
    parts = []
    for t, label in SYMBOL_TABLES.items():
        labels = F.array(F.lit(label))
        if t == "classes" and "is_interface" in tables[t].columns:
            labels = F.when(F.col("is_interface"), F.array(F.lit("Class"), F.lit("Interface"))).otherwise(labels)
        parts.append(tables[t].select(F.lit(label).alias("label"), labels.alias("labels"), "name", "path", F.col("line_number").cast("long").alias("line_number")))
    return reduce(DataFrame.unionByName, parts)


_DOC = ("label", "labels", "name", "path", "line_number")


def name_postings(found: DataFrame) -> DataFrame:
    """The inverted index of symbols' names (``schema.INDEXES``): for each symbol its words, how often each occurs and how
    many there are, and a row of the empty word."""
    docs = found.dropDuplicates(["label", "name", "path", "line_number"])
    words = docs.select(*_DOC, tokens(F.coalesce("name", F.lit(""))).alias("words"))
    times = lambda w: F.size(F.filter("words", lambda x: x == w)).cast("long")
    terms = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), times(w).alias("tf")))
    whole = F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")))
    rows = words.select(*_DOC, F.size("words").cast("long").alias("length"), F.explode(F.concat(whole, terms)).alias("t"))
    return rows.select("t.term", *_DOC, "t.tf", "length")


def bm25(index: DataFrame, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """The symbols of an index that hold any of the terms, with their score."""
    hit = index.where(F.col("term").isin(sorted(set(terms))))
    total = index.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one row, and one row per query term
    rows = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return rows.groupBy(*_DOC).agg(F.sum(part).alias("score"))


def fulltext(tables: dict[str, DataFrame], query: str, limit: int | None = 20) -> DataFrame:
    """labels, name, path, line_number, score of symbols whose name matches any word of the query, best first; without a
    limit all of them, in no order.

    A query without a word falls back to names that contain it, with a null score.  The index that a store keeps
    (``name_postings``) is read where it is among the tables: only the rows of the query's words.
    """
    found = symbols(tables)
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if w]
    if not words:
        return contains_search(found, query, limit)
    out = bm25(tables["name_postings"] if "name_postings" in tables else name_postings(found), words)
    if limit is not None:
        out = out.orderBy(F.col("score").desc(), "label", "name", "path", "line_number").limit(limit)
    return out.select("labels", "name", "path", "line_number", "score")


def contains_search(found: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Symbols whose name contains the text, case-sensitive, without a score."""
    out = found.where(F.contains("name", F.lit(query))).withColumn("score", F.lit(None).cast("double"))
    if limit is not None:
        out = out.orderBy("label", "name", "path", "line_number").limit(limit)
    return out.select("labels", "name", "path", "line_number", "score")


def vector_topk(docs: DataFrame, query: list[float] | Column, limit: int, embedding: str = "embedding", order: tuple[str, ...] = ()) -> DataFrame:
    """The rows nearest to a query vector by cosine, with their score; rows without a vector of that length are left out."""
    vector = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    scored = docs.where(F.size(embedding) == F.size(vector)).withColumn("score", cosine_score(F.col(embedding), vector)).where("score is not null")
    return scored.orderBy(F.col("score").desc(), *order).limit(limit)


class VectorIndex:
    """Vectors in buckets by the sides of random planes, kept as one folder a bucket.

    A search reads the ``probes`` buckets that lie nearest to the query, those across the planes that it is closest to
    first, and compares exactly there; with all buckets as probes it is exact.  Recall for fewer is for the user to measure:
    ``recall`` does.
    """

    def __init__(self, spark: SparkSession, path: str, dimensions: int, planes: int = 6, seed: int = 17) -> None:
        import random  # noqa: PLC0415

        rng = random.Random(seed)
        self.spark, self.path, self.dimensions = spark, path, dimensions
        self.planes = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(planes)]

    def bucket(self, vector: Column) -> Column:
        """A bit for each plane: the side that the vector is on."""
        side = lambda p: dot(vector, F.array(*[F.lit(x) for x in p])) >= 0
        return sum((F.when(side(p), 1 << k).otherwise(0) for k, p in enumerate(self.planes)), F.lit(0))

    def write(self, rows: DataFrame, embedding: str = "embedding") -> None:
        """Index the rows that have a vector of the index's dimensions."""
        some = rows.where(F.size(embedding) == self.dimensions)
        # whole buckets to a task, but a large one is split by its bytes
        some.withColumn("bucket", self.bucket(F.col(embedding))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(self.path)

    def near(self, query: list[float], probes: int) -> list[int]:
        """The buckets to read: those with the least sum of distances to the planes that lie between."""
        sides = [sum(a * b for a, b in zip(p, query, strict=True)) for p in self.planes]
        far = lambda bucket: sum(abs(s) for k, s in enumerate(sides) if (s >= 0) != bool(bucket >> k & 1))
        return sorted(range(1 << len(self.planes)), key=lambda b: (far(b), b))[:probes]

    def topk(self, query: list[float], limit: int, probes: int = 8, order: tuple[str, ...] = (), embedding: str = "embedding") -> DataFrame:
        rows = self.spark.read.parquet(self.path).where(F.col("bucket").isin(self.near(query, probes)))
        return vector_topk(rows, query, limit, embedding, order).drop("bucket")

    def recall(self, queries: list[list[float]], limit: int, probes: int, key: str, embedding: str = "embedding") -> float:
        """The share of the exact nearest that a search with so many probes finds."""
        names = lambda q, n: {r[key] for r in self.topk(q, limit, n, (key,), embedding).select(key).collect()}
        exact = [names(q, 1 << len(self.planes)) for q in queries]
        hit = sum(len(a & names(q, probes)) for a, q in zip(exact, queries, strict=True))
        return hit / max(1, sum(len(a) for a in exact))


#: The tables whose rows may have vectors, and their labels.
VECTOR_TABLES = {"functions": "Function", "classes": "Class", "variables": "Variable", "files": "File", "directories": "Directory"}


def vector_search(tables: dict[str, DataFrame], query: list[float], limit: int = 10) -> DataFrame:
    """kind, name, path, line_number, description, score over all labels that have vectors: the best of each, then of all.

    Where the tables have the index that a store keeps, its cells nearest to the query are read and nothing else.
    """
    parts = []
    if query and "vectors" in tables:
        best = segments.nearest(tables["vectors"], tables["centroids"], query, limit, ("path", "line_number", "name"))
        kind, line = kind_of_label(F.array("label")), F.col("line_number").cast("int").alias("line_number")
        return best.select(kind.alias("kind"), display_name(F.col("name"), F.col("path")).alias("name"), "path", line, "description", "score", "repo_path")
    if not query:
        return tables["functions"].sparkSession.createDataFrame([], "kind string, name string, path string, line_number int, description string, score double")
    for t, label in VECTOR_TABLES.items():
        df = tables[t]
        line = F.col("line_number") if "line_number" in df.columns else F.lit(None).cast("int")
        repo = F.col("repo_path") if "repo_path" in df.columns else F.lit(None).cast("string")
        own = df.select(F.array(F.lit(label)).alias("labels"), "name", "path", line.alias("line_number"), "description", repo.alias("repo_path"), "embedding")
        parts.append(vector_topk(own, query, limit, order=("path", "line_number", "name")).drop("embedding"))
    best = reduce(DataFrame.unionByName, parts).distinct()
    best = best.orderBy(F.col("score").desc(), "path", "line_number", "name").limit(limit)
    return best.select(kind_of_label(F.col("labels")).alias("kind"), display_name(F.col("name"), F.col("path")).alias("name"), "path", "line_number", "description", "score", "repo_path")


#: Logical plans that a read-only query may not contain.
_WRITES = ("Command", "InsertInto", "CreateTable", "CreateView", "Drop", "AlterTable", "DeleteFrom", "Update", "Merge", "Truncate", "ReplaceTable", "Overwrite", "Append", "Cache", "ExecuteImmediate", "Compound", "SingleStatement", "Analyze", "Refresh", "Repair", "Call", "Set", "Load", "Create", "Rename", "Cluster")


#: Functions that reach outside the query, and table functions that only make rows of what they are given.
_OUTSIDE = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length"}
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
#: Plans that run other programs.
_PROGRAMS = ("Script",)


@functools.cache
def _known_functions(spark: SparkSession) -> frozenset[str]:
    """The names of Spark's own functions, without those that reach outside."""
    found = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().listFunction()
    return frozenset(found.apply(i).funcName() for i in range(found.size())) - _OUTSIDE


def _nodes_of(plan) -> Iterator:  # noqa: ANN001
    """All plans and expressions of a parsed plan: those of subqueries and of common tables too."""
    stack, seq = [plan], lambda x: [x.apply(i) for i in range(x.size())]
    while stack:
        node = stack.pop()
        yield node
        stack += seq(node.children())
        stack += [x for x in seq(node.innerChildren()) if "catalyst" in x.getClass().getName()]
        for method in ("expressions", "plan"):
            try:
                got = getattr(node, method)()
            except (Py4JError, TypeError):  # this kind of node has none
                continue
            stack += seq(got) if method == "expressions" else [got]


def _refusal(spark: SparkSession, plan) -> str | None:  # noqa: ANN001
    """Why a plan may not run, or None."""
    for node in _nodes_of(plan):
        kind = node.getClass().getSimpleName()
        if any(w in kind for w in (*_WRITES, *_PROGRAMS)):
            return kind
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedGenerator"):
            names = node.nameParts() if kind == "UnresolvedFunction" else node.name() if kind != "UnresolvedGenerator" else None
            parts = node.name().funcName() if names is None else names.apply(names.size() - 1)
            allowed = _TABLE_FUNCTIONS if kind == "UnresolvedTableValuedFunction" else _known_functions(spark)
            if parts.lower() not in allowed or (names is not None and names.size() > 1):
                return f"function {parts}"
        if kind == "UnresolvedRelation":
            names = node.multipartIdentifier()
            if any("/" in names.apply(i) or ":" in names.apply(i) for i in range(names.size())):
                return "reading files"
    return None


def read_only_sql(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    """Run a query that only reads the session's tables and views.

    Its parsed plan decides, with the expressions, subqueries and common tables in it: plans that write or command, that run
    programs or read files by path are refused before anything runs, and so is every function that is not Spark's own or that
    reaches outside the query.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    bad = _refusal(spark, plan)
    if bad:
        raise PermissionError(f"only reading is allowed, not {bad}")
    return spark.sql(query, args=args or {})


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
