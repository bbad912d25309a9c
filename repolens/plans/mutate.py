"""Writing pattern queries: MERGE, SET, REMOVE and DELETE as changes to tables, made current as one.

What stands before the first writing clause (MATCH, WHERE, UNWIND, WITH) is planned like any reading query, and returns the keys
and values that the writing clauses name.  Each clause then is a join on natural keys: rows of the units that it touches are
written anew, nothing else.  All clauses of a query read the snapshot that it began with and are published together; if another
writer has published since, the query fails and has changed nothing.

Clauses: ``MERGE (n:Label {key: value, ...}) [ON CREATE SET ...] [ON MATCH SET ...]`` with all of the label's natural key,
``MERGE (a)-[:CALLS|INHERITS|IMPLEMENTS {property: value}]->(b)``, ``SET n.property = value`` and ``SET n += map``, ``REMOVE n.property``,
``[DETACH] DELETE n`` or of an edge variable, ``CREATE CONSTRAINT`` and ``CREATE ... INDEX`` (which the store keeps by itself: they make its
tables).  Edges that follow from node tables are not written.  A node that still has edges is deleted only with DETACH.  Anything else is an error.

Of several rows that set one property of one node the largest value counts; nulls given to MERGE properties are an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions.text import symbol_id
from repolens.operators.traverse import durable
from repolens.plans import cypher
from repolens.plans.cypher import CypherError
from repolens.sources.schema import KEYS, LABELS, TABLES, UNITS
from repolens.sources.store import BROADCAST_UNITS, Change, Snapshot, SnapshotStore

_TABLE_OF = {label: table for table, label in LABELS.items()} | {"Interface": "classes"}
#: Edge types that have tables of their own, and the table of both ends.
_EDGES = {"CALLS": ("calls", "functions"), "INHERITS": ("inherits", "classes"), "IMPLEMENTS": ("implements", "classes")}
_WORDS = ("MERGE", "SET", "REMOVE", "DETACH", "DELETE", "ON", "CREATE")
_NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(?:\{(.*)\})?\s*\)\s*$", re.S)
_EDGE = re.compile(r"\(\s*(\w+)\s*\)\s*-\s*\[\s*(\w+)?\s*:\s*(\w+)\s*(?:\{(.*)\})?\s*\]\s*->\s*\(\s*(\w+)\s*\)\s*$", re.S)


@dataclass
class _Plan:
    """What the reading part has to return, and the steps over its rows."""

    returned: dict[str, str] = field(default_factory=dict)
    steps: list = field(default_factory=list)

    def column(self, expression: str) -> str:
        """The column of an expression's values."""
        return self.returned.setdefault(expression.strip(), f"v{len(self.returned)}")


def _clauses(query: str) -> list[tuple[str, str]]:
    """("", the reading part) and then (clause, its text), cut at writing words outside brackets and strings."""
    cuts, depth, last = [], 0, ""
    for m in cypher._LEX.finditer(query):
        word = m.group().upper()
        depth += (word in "([{") - (word in ")]}") if m.lastgroup == "punct" else 0
        if m.lastgroup == "name" and not depth and word in _WORDS and last not in (".", ":"):
            cuts.append((m.start(), m.end(), word))
        last = word if not word.isspace() else last
    ends = [*[c[0] for c in cuts[1:]], len(query)][: len(cuts)]
    return [("", query[: cuts[0][0]] if cuts else query), *[(word, query[b:end].strip().rstrip(";").strip()) for (_, b, word), end in zip(cuts, ends, strict=True)]]


def _split(text: str, mark: str = ",") -> list[str]:
    """The parts between commas outside brackets and strings."""
    parts, depth, start = [], 0, 0
    for m in cypher._LEX.finditer(text):
        c = m.group()
        if m.lastgroup == "punct":
            depth += (c in "([{") - (c in ")]}")
            if c == mark and not depth:
                parts.append(text[start : m.start()])
                start = m.end()
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def _map(text: str | None) -> dict[str, str]:
    pairs = [p.partition(":") for p in _split(text or "")]
    return {k.strip(): v.strip() for k, _, v in pairs}


class Mutation:
    """One writing query over a store."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, query: str, params: dict | None = None, base: Snapshot | None = None) -> None:
        self.spark, self.store, self.params = spark, store, params or {}
        self.base = base or store.snapshot()
        self.tables = store.tables(self.base)
        self.clauses = _clauses(query)
        self.reading = self.clauses[0][1]
        self.merged: dict[str, dict[str, str]] = {}
        self.labels = {m[1]: m[2] for m in re.finditer(r"\(\s*(\w+)\s*:\s*(\w+)", self.reading)}
        self.types = {m[2]: (m[1], m[3], m[4]) for m in re.finditer(r"\(\s*(\w+)[^()]*\)\s*-\s*\[\s*(\w+)\s*:\s*(\w+)[^\]]*\]\s*->\s*\(\s*(\w+)", self.reading)}
        self.rows: DataFrame | None = None

    # -- the reading part --------------------------------------------------------------------------

    def table_of(self, var: str) -> str:
        label = self.labels.get(var)
        if label not in _TABLE_OF:
            raise CypherError(f"{var} needs a label that has a table")
        return _TABLE_OF[label]

    def key_of(self, var: str, plan: _Plan) -> dict[str, str]:
        """key column -> the column of the read rows that holds it."""
        if var in self.merged:
            return self.merged[var]
        return {k: plan.column(f"{var}.{k}") for k in KEYS[self.table_of(var)]}

    def read(self, plan: _Plan) -> DataFrame:
        if not plan.returned:
            raise CypherError("nothing to write")
        returned = ", ".join(f"{e} AS {c}" for e, c in plan.returned.items())
        return cypher.run(self.spark, self.tables, f"{self.reading} RETURN {returned}", self.params)

    # -- clauses -----------------------------------------------------------------------------------

    def publish(self) -> Snapshot:
        """Plan the clauses, run the reading part once, and publish what changes."""
        plan = _Plan()
        kinds = [k for k, _ in self.clauses[1:]]
        if not kinds:
            raise CypherError("the query writes nothing")
        if kinds == ["CREATE"] and not self.reading.strip():
            if not re.match(r"(CONSTRAINT|(\w+\s+)?INDEX)\b", self.clauses[1][1], re.I):
                raise CypherError("CREATE makes constraints and indexes; nodes and edges are merged")
            self.store.ensure_schema()
            return self.store.snapshot()
        i = 1
        while i < len(self.clauses):
            kind, text = self.clauses[i]
            if kind == "MERGE":
                i += self._plan_merge(text, self.clauses[i + 1 :], plan)
            elif kind == "SET":
                plan.steps += [("set", *s) for s in self._sets(text, plan)]
            elif kind == "REMOVE":
                plan.steps += [("set", *s) for s in self._sets(", ".join(f"{p} = null" for p in _split(text)), plan)]
            elif kind in ("DELETE", "DETACH"):
                detach = kind == "DETACH"
                if detach:
                    i += 1
                    if i == len(self.clauses) or self.clauses[i][0] != "DELETE" or text:
                        raise CypherError("DETACH is followed by DELETE")
                for var in _split(self.clauses[i][1]):
                    plan.steps.append(self._plan_delete(var, detach, plan))
            else:
                raise CypherError(f"{kind} can't stand here")
            i += 1
        self.rows = durable(self.read(plan))
        self.changed: dict[str, DataFrame] = {}
        self.touched: dict[str, list[DataFrame]] = {}
        for kind, *args in plan.steps:
            getattr(self, f"_{kind}")(*args)
        out = {}
        for t, df in self.changed.items():
            units = durable(reduce(DataFrame.unionByName, [u.toDF("unit") for u in self.touched[t]]).where("unit is not null").distinct())
            few = units.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS
            kept = df.join(F.broadcast(units) if few else units, F.col(UNITS[t]) == F.col("unit"), "left_semi")
            out[t] = Change(kept, units)
        return self.store.publish(out, self.base)

    def now(self, t: str) -> DataFrame:
        return self.changed.get(t, self.tables[t])

    def change(self, t: str, df: DataFrame, units: DataFrame) -> None:
        self.changed[t] = df.select(*self.tables[t].columns)
        self.touched.setdefault(t, []).append(units)

    def _sets(self, text: str, plan: _Plan, only: str | None = None) -> list[tuple]:
        """(table, key columns, property, value column, when) of each assignment; a map's properties are given by parameter."""
        out = []
        for part in _split(text):
            m = re.match(r"(\w+)\s*\.\s*(\w+)\s*=(?!=)(.*)", part, re.S)
            spread = re.match(r"(\w+)\s*\+=\s*\{(.*)\}\s*$", part, re.S)
            if m:
                var, pairs = m[1], {m[2]: m[3]}
            elif spread:
                var, pairs = spread[1], _map(spread[2])
            else:
                raise CypherError(f"unexpected SET {part}")
            t = self.table_of(var)
            for prop, value in pairs.items():
                if prop in KEYS[t] or prop not in self.tables[t].columns or prop == "id":
                    raise CypherError(f"{prop} of {var} can't be set")
                out.append((t, self.key_of(var, plan), prop, plan.column(value), only))
        return out

    def _plan_merge(self, text: str, rest: list[tuple[str, str]], plan: _Plan) -> int:
        """Plans a MERGE with the ON clauses that follow; returns how many clauses those are."""
        edge, node, used = _EDGE.match(text), _NODE.match(text), 0
        if edge:
            a, _, kind, props, b = edge.groups()
            if kind not in _EDGES:
                raise CypherError(f"edges of type {kind} follow from node tables")
            t, ends = _EDGES[kind]
            own = {p: plan.column(v) for p, v in _map(props).items()}
            if {self.table_of(a), self.table_of(b)} != {ends} or set(own) - set(self.tables[t].columns):
                raise CypherError(f"unexpected MERGE {text}")
            plan.steps.append(("merge_edge", t, self.key_of(a, plan), self.key_of(b, plan), ends, own))
            return 0
        if not node or not node[2]:
            raise CypherError(f"unexpected MERGE {text}")
        var, label, props = node[1] or " merged", node[2], _map(node[3])
        self.labels[var] = label
        t = self.table_of(var)
        if set(props) - set(self.tables[t].columns) or not set(KEYS[t]) <= set(props):
            raise CypherError(f"MERGE of {label} needs {', '.join(KEYS[t])}")
        self.merged[var] = {k: plan.column(props[k]) for k in KEYS[t]}
        given = {p: plan.column(v) for p, v in props.items()}
        sets: list[tuple] = []
        while used + 1 < len(rest) and rest[used][0] == "ON" and rest[used + 1][0] in ("SET", "CREATE"):
            # ON CREATE SET is cut at CREATE and SET, ON MATCH SET at SET
            if rest[used + 1][0] == "CREATE" and used + 2 < len(rest) and rest[used + 2][0] == "SET":
                sets += self._sets(rest[used + 2][1], plan, "create")
                used += 3
            elif rest[used][1].upper() == "MATCH" and rest[used + 1][0] == "SET":
                sets += self._sets(rest[used + 1][1], plan, "match")
                used += 2
            else:
                raise CypherError("ON is followed by CREATE SET or MATCH SET")
        plan.steps.append(("merge_node", t, given, sets))
        return used

    def _plan_delete(self, var: str, detach: bool, plan: _Plan) -> tuple:
        if var in self.types:
            a, kind, b = self.types[var]
            if kind not in _EDGES:
                raise CypherError(f"edges of type {kind} follow from node tables")
            t, ends = _EDGES[kind]
            self.labels.setdefault(a, LABELS[ends])
            self.labels.setdefault(b, LABELS[ends])
            line = plan.column(f"{var}.line_number") if "line_number" in self.tables[t].columns else None
            return ("delete_edge", t, self.key_of(a, plan), self.key_of(b, plan), line)
        return ("delete_node", self.table_of(var), self.key_of(var, plan), detach)

    # -- steps -------------------------------------------------------------------------------------

    def _named(self, key: dict[str, str], **more: str) -> DataFrame:
        return self.rows.select(*[F.col(c).alias(k) for k, c in (key | more).items()])

    def _typed(self, t: str, df: DataFrame) -> DataFrame:
        kinds = dict(self.spark.createDataFrame([], TABLES[t]).dtypes)
        return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns])

    def _set(self, t: str, key: dict[str, str], prop: str, value: str, only: str | None = None) -> None:  # noqa: ARG002
        new = self._typed(t, self._named(key, **{prop: value})).groupBy(*key).agg(F.max(prop).alias("new value"))
        df = self.now(t).join(new.withColumn("is set", F.lit(True)), list(key), "left")
        df = df.withColumn(prop, F.when(F.col("is set"), F.col("new value")).otherwise(F.col(prop)))
        self.change(t, df, new.select(UNITS[t]))

    def _merge_node(self, t: str, given: dict[str, str], sets: list[tuple]) -> None:
        keys = KEYS[t]
        new = self._typed(t, self._named(given))
        if not new.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in given])).isEmpty():
            raise CypherError("a property of MERGE is null")
        others = [F.max(c).alias(c) for c in given if c not in keys]
        new = new.groupBy(*keys).agg(*others) if others else new.distinct()
        old = self.now(t)
        if not old.join(new, keys).where(reduce(lambda a, b: a | b, [~old[c].eqNullSafe(new[c]) for c in given if c not in keys], F.lit(False))).isEmpty():
            raise CypherError("a node of this key has other properties")
        made = new.join(old, keys, "left_anti")
        fresh = made.withColumn("id", symbol_id(F.col("path"), F.col("name"), F.col("line_number"))) if "id" in old.columns else made
        both = old.unionByName(fresh, allowMissingColumns=True)
        self.change(t, both, new.select(UNITS[t]))
        kept = self.rows
        for _, key, prop, value, only in sets:
            side = self._typed(t, self._named(key, **{prop: value}))
            some = side.join(made.select(*keys), keys, "left_semi" if only == "create" else "left_anti")
            self.rows = some.select(*[F.col(k).alias(c) for k, c in key.items()], F.col(prop).alias(value))
            self._set(t, key, prop, value)
            self.rows = kept

    def _merge_edge(self, t: str, a: dict[str, str], b: dict[str, str], ends: str, own: dict[str, str]) -> None:
        both = self._both(ends, a, b)
        columns = [F.col(c).alias(p) for p, c in own.items() if p != "repo_path"]
        new = both.select("src_id", "dst_id", F.col("repo of src_id").alias("repo_path"), *columns)
        new = self._typed(t, new).distinct()
        same = ["src_id", "dst_id", *[p for p in own if p != "repo_path"]]
        made = new.join(self.now(t).select(*same), same, "left_anti")
        self.change(t, self.now(t).unionByName(made, allowMissingColumns=True), made.select("src_id"))

    def _both(self, ends: str, a: dict[str, str], b: dict[str, str]) -> DataFrame:
        rows = self.rows
        for key, name in ((a, "src_id"), (b, "dst_id")):
            found = self.now(ends).select(*[F.col(k).alias(c) for k, c in key.items()], F.col("id").alias(name), F.col("repo_path").alias(f"repo of {name}"))
            rows = rows.join(found, list(key.values()))
        return rows

    def _delete_edge(self, t: str, a: dict[str, str], b: dict[str, str], line: str | None) -> None:
        both = self._both(_EDGES[next(k for k, v in _EDGES.items() if v[0] == t)][1], a, b)
        gone = both.select("src_id", "dst_id", *([F.col(line).cast("int").alias("line_number")] if line else [])).distinct()
        on = reduce(lambda x, y: x & y, [self.now(t)[c].eqNullSafe(gone[c]) for c in gone.columns])
        self.change(t, self.now(t).join(gone, on, "left_anti"), gone.select("src_id"))

    def _delete_node(self, t: str, key: dict[str, str], detach: bool) -> None:
        gone = self._typed(t, self._named(key)).distinct()
        if "id" in self.tables[t].columns:
            ids = self.now(t).join(gone, list(key), "left_semi").select("id")
            for e, (table, ends) in _EDGES.items():
                if ends != t:
                    continue
                edges = self.now(table)
                hit = edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(*edges.columns))
                if not detach and not hit.isEmpty():
                    raise CypherError(f"a node that has {e} edges is deleted with DETACH")
                kept = edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
                self.change(table, kept, hit.select("src_id"))
        self.change(t, self.now(t).join(gone, list(key), "left_anti"), gone.select(UNITS[t]))


def write(spark: SparkSession, store: SnapshotStore, query: str, params: dict | None = None, base: Snapshot | None = None) -> Snapshot:
    """Run a writing query; the snapshot that it made."""
    return Mutation(spark, store, query, params, base).publish()

