"""Graph pattern queries: a reading subset of Cypher, planned as DataFrame joins.

Clauses: MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND, RETURN [DISTINCT], ORDER BY, SKIP, LIMIT, UNION [ALL], subqueries CALL { ... } that
come first, and CALL of the procedures ``db.index.fulltext.queryNodes`` and ``db.index.vector.queryNodes``.  Patterns that share no
variable, meet in no equality and fix no property are refused, since every pair of their rows would be a result.  Patterns: labels, property maps, directed or undirected edges with types,
variable lengths with or without an upper bound, path variables.  Each variable is a column: a node or edge is a struct, a path an array of nodes.  A query's
edges differ from one another within one MATCH, as do the edges of one path.

Anything that would write is refused; anything outside the subset is an error, never another meaning.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from repolens.operators import segments
from repolens.operators.graph import all_edges, all_nodes, node_id
from repolens.operators.search import VECTOR_TABLES, fulltext, vector_topk
from repolens.operators.traverse import checkpointed
from repolens.sources.schema import LABELS

MAX_LENGTH = 15
_LEX = re.compile(
    r"""\s+|//[^\n]*|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?!\.\d))|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
      |(?P<punct><>|<=|>=|=~|\.\.|->|<-|[-+*/%^=<>()\[\]{}:,.|])""",
    re.X,
)
_WRITES = {"CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "LOAD", "FOREACH"}
_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "UNWIND", "RETURN", "ORDER", "SKIP", "LIMIT", "UNION", "CALL", "YIELD"}
_AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
#: The names of the vector indexes (fixed values).
_VECTOR_INDEXES = {
    "function_embeddings": "functions", "class_embeddings": "classes", "variable_embeddings": "variables", "file_embeddings": "files",
    "directory_embeddings": "directories",
}
_PRODUCT = re.compile("CartesianProduct|BroadcastNestedLoopJoin")
_TABLE_OF = {label: table for table, label in LABELS.items()}


class CypherError(ValueError):
    """The query is outside the subset."""


@dataclass
class NodePattern:
    name: str
    labels: list[str]
    props: list[tuple[str, Callable]]


@dataclass
class EdgePattern:
    name: str
    types: list[str]
    props: list[tuple[str, Callable]]
    direction: str  # ">", "<" or "-"
    length: tuple[int, int | None] | None


@dataclass
class Path:
    name: str | None
    nodes: list[NodePattern]
    edges: list[EdgePattern]


@dataclass
class Scope:
    """The columns that expressions may use."""

    df: DataFrame

    def column(self, name: str) -> Column:
        if name not in self.df.columns:
            raise CypherError(f"unknown variable: {name}")
        return F.col(f"`{name}`")

    def prop(self, name: str, prop: str) -> Column:
        kind = self.df.schema[name].dataType if name in self.df.columns else None
        if not isinstance(kind, StructType):
            raise CypherError(f"{name} is no node or relationship")
        return F.col(f"`{name}`")[prop] if prop in kind.fieldNames() else F.lit(None).cast("string")


@dataclass
class Expr:
    """A parsed expression: how to make its column, and whether it aggregates."""

    make: Callable[[Scope], Column]
    aggregate: bool = False
    text: str = ""
    pattern: tuple[Path, bool] | None = None  # a pattern predicate and whether it is negated
    parts: list[Expr] = field(default_factory=list)  # the terms of a conjunction


class Query:
    """Parser and planner for one query text."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], text: str, params: dict | None = None) -> None:
        self.spark, self.tables, self.params = spark, tables, params or {}
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise CypherError(f"unexpected text: {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0].strip("`") if m.lastgroup == "name" else m[0]))
            at = m.end()
        self.i, self.fresh = 0, 0
        #: subqueries around what is parsed, and whether patterns were joined that share no variable
        self.depth, self.unconnected = 0, False
        open_: list[bool] = []  # for each bracket whether it holds an expression or a pattern, not a subquery
        for k, (kind, t) in enumerate(self.tokens):
            if kind == "punct" and t in "([{":
                open_.append(t != "{" or k == 0 or self.tokens[k - 1][1].upper() != "CALL")
            elif kind == "punct" and t in ")]}" and open_:
                open_.pop()
            if kind == "name" and t.upper() in _WRITES and not any(open_) and self.tokens[k - 1][1] not in (".", ":"):
                raise PermissionError(f"only reading is allowed, not {t.upper()}")

    # -- tokens --------------------------------------------------------------------------------------

    def word(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.tokens[k][1].upper() if k < len(self.tokens) and self.tokens[k][0] == "name" else ""

    def is_(self, text: str, ahead: int = 0) -> bool:
        k = self.i + ahead
        return k < len(self.tokens) and self.tokens[k] == ("punct", text)

    def take(self, text: str) -> bool:
        if self.is_(text) or (text.isalpha() and self.word() == text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise CypherError(f"expected {text} at {' '.join(t for _, t in self.tokens[self.i : self.i + 4])!r}")

    def name(self) -> str:
        if self.i >= len(self.tokens) or self.tokens[self.i][0] != "name":
            raise CypherError("expected a name")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def anonymous(self) -> str:
        self.fresh += 1
        return f" {self.fresh}"

    # -- expressions ---------------------------------------------------------------------------------

    def expression(self) -> Expr:
        start = self.i
        out = self.disjunction()
        out.text = " ".join(t for _, t in self.tokens[start : self.i])
        return out

    def _binary(self, left: Expr, right: Expr, op: Callable[[Column, Column], Column]) -> Expr:
        if left.pattern or right.pattern:
            raise CypherError("a pattern may only stand as a term of AND")
        return Expr(lambda s: op(left.make(s), right.make(s)), left.aggregate or right.aggregate)

    def disjunction(self) -> Expr:
        left = self.conjunction()
        while self.word() in ("OR", "XOR"):
            op = (lambda a, b: a | b) if self.word() == "OR" else (lambda a, b: a != b)
            self.i += 1
            left = self._binary(left, self.conjunction(), op)
        return left

    def conjunction(self) -> Expr:
        terms = [self.negation()]
        while self.take("AND"):
            terms.append(self.negation())
        if len(terms) == 1:
            return terms[0]
        plain = [t for t in terms if not t.pattern]
        make = lambda s: reduce(lambda a, b: a & b, [t.make(s) for t in plain])
        return Expr(make, any(t.aggregate for t in terms), parts=terms)

    def negation(self) -> Expr:
        if self.take("NOT"):
            inner = self.negation()
            if inner.pattern:
                return Expr(inner.make, pattern=(inner.pattern[0], not inner.pattern[1]))
            if any(t.pattern for t in inner.parts):
                raise CypherError("a pattern may only stand as a term of AND")
            return Expr(lambda s: ~inner.make(s), inner.aggregate)
        return self.comparison()

    def comparison(self) -> Expr:
        left = self.sum()
        while True:
            word = self.word()
            if word == "IS":
                self.i += 1
                no = self.take("NOT")
                self.need("NULL")
                left = (lambda x: Expr(lambda s: x.make(s).isNotNull() if no else x.make(s).isNull(), x.aggregate))(left)
            elif word == "IN":
                self.i += 1
                left = self._binary(left, self.sum(), lambda a, b: F.array_contains(b, a))
            elif word == "CONTAINS":
                self.i += 1
                left = self._binary(left, self.sum(), lambda a, b: a.contains(b))
            elif word in ("STARTS", "ENDS"):
                self.i += 1
                self.need("WITH")
                left = self._binary(left, self.sum(), (lambda a, b: a.startswith(b)) if word == "STARTS" else (lambda a, b: a.endswith(b)))
            elif op := next((o for o in ("<>", "<=", ">=", "=~", "=", "<", ">") if self.is_(o)), None):
                self.i += 1
                act = {
                    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
                    ">=": lambda a, b: a >= b, "=~": lambda a, b: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
                }[op]
                left = self._binary(left, self.sum(), act)
            else:
                return left

    def sum(self) -> Expr:
        left = self.product()
        while self.is_("+") or self.is_("-"):
            minus = self.is_("-")
            self.i += 1
            left = self._binary(left, self.product(), (lambda a, b: a - b) if minus else (lambda a, b: a + b))
        return left

    def product(self) -> Expr:
        left = self.postfix()
        while op := next((o for o in "*/%" if self.is_(o)), None):
            self.i += 1
            left = self._binary(left, self.postfix(), {"*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b}[op])
        return left

    def postfix(self) -> Expr:
        out = self.atom()
        while self.is_("["):
            self.i += 1
            low = None if self.is_("..") else self.sum()
            if self.take(".."):
                high = None if self.is_("]") else self.sum()
                zero = Expr(lambda s: F.lit(0))
                out = (lambda x, a, b: Expr(lambda s: F.slice(x.make(s), a.make(s) + 1, (b.make(s) if b else F.size(x.make(s))) - a.make(s)), x.aggregate))(out, low or zero, high)
            else:
                out = (lambda x, a: Expr(lambda s: F.get(x.make(s), a.make(s)), x.aggregate))(out, low)
            self.need("]")
        return out

    def atom(self) -> Expr:
        if self.i >= len(self.tokens):
            raise CypherError("expected an expression")
        kind, text = self.tokens[self.i]
        if self.is_("("):
            mark = self.i
            try:
                path = self.path()
                if path.edges:
                    return Expr(lambda s: F.lit(True), pattern=(path, False))
            except CypherError:
                pass
            self.i = mark + 1
            inner = self.expression()
            self.need(")")
            return inner
        if self.is_("["):
            return self.list_()
        if self.is_("-"):
            self.i += 1
            inner = self.postfix()
            return Expr(lambda s: -inner.make(s), inner.aggregate)
        self.i += 1
        if kind == "number":
            value = float(text) if "." in text else int(text)
            return Expr(lambda s: F.lit(value))
        if kind == "string":
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
            return Expr(lambda s: F.lit(value))
        if kind == "param":
            if text[1:] not in self.params:
                raise CypherError(f"no value for {text}")
            value = self.params[text[1:]]
            return Expr(lambda s: F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value))
        if kind != "name":
            raise CypherError(f"unexpected {text}")
        if self.is_("("):
            return self.call(text)
        if text.upper() in ("TRUE", "FALSE", "NULL"):
            value = {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
            return Expr(lambda s: F.lit(value))
        if text.upper() == "CASE":
            return self.case()
        if self.take("."):
            prop = self.name()
            return Expr(lambda s: s.prop(text, prop))
        if self.is_(":"):
            labels = []
            while self.take(":"):
                labels.append(self.name())
            return Expr(lambda s: reduce(lambda a, b: a & b, [F.array_contains(s.prop(text, "labels"), F.lit(x)) for x in labels]))
        return Expr(lambda s: s.column(text))

    def case(self) -> Expr:
        branches, other, aggregate = [], None, False
        while self.take("WHEN"):
            condition = self.expression()
            self.need("THEN")
            branches.append((condition, self.expression()))
        if self.take("ELSE"):
            other = self.expression()
        self.need("END")
        aggregate = any(c.aggregate or v.aggregate for c, v in branches)
        return Expr(lambda s: reduce(lambda rest, b: F.when(b[0].make(s), b[1].make(s)).otherwise(rest), reversed(branches), other.make(s) if other else F.lit(None)), aggregate)

    def list_(self) -> Expr:
        """A list, or a comprehension ``[x IN list WHERE condition | expression]``."""
        self.need("[")
        if self.word(1) == "IN" and self.tokens[self.i][0] == "name":
            var = self.name()
            self.need("IN")
            source = self.sum()
            where = self.expression() if self.take("WHERE") else None
            body = self.expression() if self.take("|") else None
            self.need("]")

            def make(s: Scope) -> Column:
                column = source.make(s)
                kind = s.df.select(column.alias("x")).schema["x"].dataType
                inner = kind.elementType if isinstance(kind, ArrayType) else kind
                column = F.filter(column, lambda x: where.make(_Element(s, var, x, inner))) if where else column
                return F.transform(column, lambda x: body.make(_Element(s, var, x, inner))) if body else column

            return Expr(make)
        items = []
        while not self.is_("]"):
            items.append(self.expression())
            if not self.take(","):
                break
        self.need("]")
        return Expr(lambda s: F.array(*[x.make(s) for x in items]), any(x.aggregate for x in items))

    def call(self, name: str) -> Expr:
        self.need("(")
        low = name.lower()
        if low == "count" and self.is_("*"):
            self.i += 1
            self.need(")")
            return Expr(lambda s: F.count(F.lit(1)), True)
        distinct = self.take("DISTINCT")
        args = []
        while not self.is_(")"):
            args.append(self.expression())
            if not self.take(","):
                break
        self.need(")")
        one = args[0] if args else None
        if low in _AGGREGATES:
            act = {
                "count": F.count_distinct if distinct else F.count, "sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max,
                # encounter order is not defined here, so distinct values come sorted
                "collect": (lambda c: F.sort_array(F.collect_set(c))) if distinct else F.collect_list,
            }[low]
            return Expr(lambda s: act(one.make(s)), True)
        functions: dict[str, Callable[..., Column]] = {
            "labels": lambda c: c["labels"], "type": lambda c: c["type"], "id": lambda c: c["_id"], "elementid": lambda c: c["_id"], "nodes": lambda c: c, "size": F.size,
            "length": lambda c: F.size(c) - 1, "tointeger": lambda c: c.try_cast("long"), "tofloat": lambda c: c.try_cast("double"), "tostring": lambda c: c.cast("string"),
            "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "coalesce": F.coalesce, "abs": F.abs, "round": F.round, "head": lambda c: F.get(c, 0),
            "last": lambda c: F.try_element_at(c, F.lit(-1)), "split": lambda a, b: F.split(a, b), "replace": F.replace, "reverse": F.reverse,
            "substring": lambda a, b, c=None: F.substr(a, b + 1, c) if c is not None else F.substr(a, b + 1), "exists": lambda c: c.isNotNull(), "range": F.sequence,
        }
        if low not in functions:
            raise CypherError(f"unknown function: {name}")
        return Expr(lambda s: functions[low](*[x.make(s) for x in args]), any(x.aggregate for x in args))

    # -- patterns ------------------------------------------------------------------------------------

    def props(self) -> list[tuple[str, Callable]]:
        out = []
        if self.take("{"):
            while not self.is_("}"):
                key = self.name()
                self.need(":")
                out.append((key, self.expression().make))
                if not self.take(","):
                    break
            self.need("}")
        return out

    def node(self) -> NodePattern:
        self.need("(")
        name = self.name() if self.tokens[self.i][0] == "name" else self.anonymous()
        labels = []
        while self.take(":") or (labels and self.take("|")):
            labels.append(self.name())
        out = NodePattern(name, labels, self.props())
        self.need(")")
        return out

    def number(self) -> int | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] == "number":
            self.i += 1
            return int(self.tokens[self.i - 1][1])
        return None

    def edge(self) -> EdgePattern:
        left = self.take("<-")
        if not left:
            self.need("-")
        name, types, props, length = self.anonymous(), [], [], None
        if self.take("["):
            if self.tokens[self.i][0] == "name":
                name = self.name()
            while self.take(":") or (types and self.take("|")):
                self.take(":")
                types.append(self.name())
            if self.take("*"):
                low = self.number()
                if self.take(".."):
                    high = self.number()
                    length = (1 if low is None else low, high)
                else:
                    length = (low, low) if low is not None else (1, None)
            props = self.props()
            self.need("]")
        right = self.take("->")
        if not right:
            self.need("-")
        if left and right:
            raise CypherError("an edge has one direction")
        return EdgePattern(name, types, props, "<" if left else ">" if right else "-", length)

    def path(self) -> Path:
        name = None
        if self.tokens[self.i][0] == "name" and self.is_("=", 1):
            name = self.name()
            self.need("=")
        nodes, edges = [self.node()], []
        while self.is_("-") or self.is_("<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return Path(name, nodes, edges)

    def scan(self, labels: list[str]) -> DataFrame:
        """One struct column ``n``: the nodes that have all labels."""
        base = [x for x in labels if x != "Interface"]
        if len(base) == 1 or "Interface" in labels and not base:
            label = base[0] if base else "Class"
            if label not in _TABLE_OF:
                return self.scan([]).where("false")
            df = self.tables[_TABLE_OF[label]]
            own = F.array(F.lit(label))
            if label == "Class":
                own = F.when(F.col("is_interface"), F.array(F.lit("Class"), F.lit("Interface"))).otherwise(own)
                df = df.where("is_interface") if "Interface" in labels else df
            return df.select(F.struct(own.alias("labels"), node_id(label, df.columns).alias("_id"), F.lit(label).alias("_label"), *df.columns).alias("n"))
        df = all_nodes(self.tables)
        df = df.where(F.lit(False)) if len(base) > 1 else df
        return df.select(F.struct(F.array("label").alias("labels"), F.col("id").alias("_id"), F.col("label").alias("_label"), "name", "path", "line_number", "repo_path").alias("n"))

    def rels(self, e: EdgePattern) -> DataFrame:
        """src_label, src_id, dst_label, dst_id and the struct ``r`` of edges of the pattern's types."""
        props = {"CALLS": ["line_number"], "IMPORTS": ["imported_name", "alias", "line_number", "is_default", "is_namespace"]}
        if len(e.types) == 1 and e.types[0] in props:
            t = e.types[0]
            df = self.tables[t.lower()]
            src, dst, a, b = ("src_id", "dst_id", "Function", "Function") if t == "CALLS" else ("path", "module", "File", "Module")
            df = df.select(F.lit(a).alias("src_label"), F.col(src).cast("string").alias("src_id"), F.lit(b).alias("dst_label"), F.col(dst).cast("string").alias("dst_id"), F.struct(F.lit(t).alias("type"), *props[t]).alias("r"))
        else:
            df = all_edges(self.tables)
            df = df.where(F.col("type").isin(e.types)) if e.types else df
            df = df.select("src_label", "src_id", "dst_label", "dst_id", F.struct("type", "repo_path").alias("r"))
        if e.direction == "<":
            df = df.select(F.col("dst_label").alias("src_label"), F.col("dst_id").alias("src_id"), F.col("src_label").alias("dst_label"), F.col("src_id").alias("dst_id"), "r")
        elif e.direction == "-":
            df = df.unionByName(df.select(F.col("dst_label").alias("src_label"), F.col("dst_id").alias("src_id"), F.col("src_label").alias("dst_label"), F.col("src_id").alias("dst_id"), "r"))
        return df.select(F.struct("src_label", "src_id", "dst_label", "dst_id", "r").alias("e"))

    def bind(self, df: DataFrame | None, node: NodePattern) -> DataFrame:
        """``df`` with the node's variable, and its labels and properties checked."""
        if df is None or node.name not in df.columns:
            found = self.scan(node.labels).withColumnRenamed("n", node.name)
            self.unconnected |= df is not None and not node.props
            df = found if df is None else df.crossJoin(found)
        elif node.labels:
            df = df.where(reduce(lambda a, b: a & b, [F.array_contains(F.col(f"`{node.name}`")["labels"], F.lit(x)) for x in node.labels]))
        for key, value in node.props:
            s = Scope(df)
            df = df.where(s.prop(node.name, key) == value(s))
        return df

    def match(self, df: DataFrame | None, paths: list[Path]) -> DataFrame:
        used: list[str] = []
        for path in paths:
            bound = next((k for k, n in enumerate(path.nodes) if df is not None and n.name in df.columns), None)
            if bound is None:
                bound = next((k for k, n in enumerate(path.nodes) if n.props), 0)
            if path.name and (len(path.edges) != 1 or bound):
                bound = 0
            df = self.bind(df, path.nodes[bound])
            steps = [(k, k + 1, path.edges[k]) for k in range(bound, len(path.edges))] + [(k + 1, k, path.edges[k]) for k in reversed(range(bound))]
            for a, b, e in steps:
                flipped = EdgePattern(e.name, e.types, e.props, {">": "<", "<": ">", "-": "-"}[e.direction], e.length) if b < a else e
                if e.length:
                    df = self.walk(df, path.nodes[a], flipped, path.nodes[b], path.name)
                else:
                    df = self.step(df, path.nodes[a], flipped, path.nodes[b], used)
            if path.name and path.name not in df.columns:
                df = df.withColumn(path.name, F.array(*[_plain(f"`{n.name}`", df.schema[n.name].dataType) for n in path.nodes]))
        return df.drop(*[c for c in df.columns if c.startswith(" e")])

    def step(self, df: DataFrame, a: NodePattern, e: EdgePattern, b: NodePattern, used: list[str]) -> DataFrame:
        key = f" e{self.anonymous()}"
        rels = self.rels(e).withColumnRenamed("e", key)
        here, there = F.col(f"`{a.name}`"), F.col(f"`{key}`")
        df = df.join(rels, (here["_id"] == there["src_id"]) & (here["_label"] == there["src_label"]))
        for other in used:
            df = df.where(~(F.col(f"`{other}`").eqNullSafe(there)))
        used.append(key)
        if b.name in df.columns:
            end = F.col(f"`{b.name}`")
            df = self.bind(df.where((end["_id"] == there["dst_id"]) & (end["_label"] == there["dst_label"])), b)
        else:
            found = self.scan(b.labels).withColumnRenamed("n", b.name)
            end = F.col(f"`{b.name}`")
            df = df.join(found, (end["_id"] == there["dst_id"]) & (end["_label"] == there["dst_label"]))
            for p, value in b.props:
                s = Scope(df)
                df = df.where(s.prop(b.name, p) == value(s))
        df = df.withColumn(e.name, there["r"])
        for p, value in e.props:
            s = Scope(df)
            df = df.where(s.prop(e.name, p) == value(s))
        return df

    def walk(self, df: DataFrame, a: NodePattern, e: EdgePattern, b: NodePattern, path_name: str | None) -> DataFrame:
        """Trails of the given lengths: one join a step, no edge twice; without an upper bound, until there is no longer one."""
        low, high = e.length
        if high is not None and high > MAX_LENGTH:
            raise CypherError(f"paths are bounded to {MAX_LENGTH} edges")
        rels = self.rels(e).select(F.col("e.src_label").alias(" sl"), F.col("e.src_id").alias(" si"), F.col("e.dst_label").alias(" dl"), F.col("e.dst_id").alias(" di"), F.to_json("e").alias(" key"))
        ends = self.scan([]).select(F.col("n").alias(" end"))
        hop = rels.join(ends, (F.col("` end`")["_id"] == F.col("` di`")) & (F.col("` end`")["_label"] == F.col("` dl`")))
        own = df.columns
        state = df.withColumn(" trail", F.array(_plain(f"`{a.name}`", df.schema[a.name].dataType))).withColumn(" edges", F.array().cast("array<string>"))
        found = [state] if low == 0 else []
        for k in count(1) if high is None else range(1, high + 1):
            at = F.element_at(F.col("` trail`"), -1)
            state = state.join(hop, (at["_id"] == F.col("` si`")) & (at["_label"] == F.col("` sl`"))).where(~F.array_contains(F.col("` edges`"), F.col("` key`")))
            state = state.select(*[f"`{c}`" for c in own], F.array_append(F.col("` trail`"), F.col("` end`")).alias(" trail"), F.array_append(F.col("` edges`"), F.col("` key`")).alias(" edges"))
            if high is None or k % 2 == 0:
                state = checkpointed(state)  # longer lengths go on from it
            if high is None:
                if state.isEmpty():
                    found = found or [state]
                    break
            if k >= low:
                found.append(state)
        out = reduce(DataFrame.unionByName, found)
        last = F.element_at(F.col("` trail`"), -1)
        if b.name in own:
            out = out.where((F.col(f"`{b.name}`")["_id"] == last["_id"]) & (F.col(f"`{b.name}`")["_label"] == last["_label"]))
        else:
            out = out.withColumn(" last", last)
            full = self.scan(b.labels).withColumnRenamed("n", b.name)
            out = out.join(full, (F.col(f"`{b.name}`")["_id"] == F.col("` last`")["_id"]) & (F.col(f"`{b.name}`")["_label"] == F.col("` last`")["_label"])).drop(" last")
        for p, value in b.props:
            s = Scope(out)
            out = out.where(s.prop(b.name, p) == value(s))
        return (out.withColumn(path_name, F.col("` trail`")) if path_name else out).drop(" trail", " edges")

    def filtered(self, df: DataFrame, e: Expr) -> DataFrame:
        for term in e.parts or [e]:
            if term.pattern:
                path, negated = term.pattern
                shared = [n.name for n in path.nodes if n.name in df.columns]
                if len(set(shared)) != 1:
                    raise CypherError("a pattern in WHERE shares one variable with the rest")
                var = shared[0]
                hits = self.match(self.scan([x for n in path.nodes if n.name == var for x in n.labels]).withColumnRenamed("n", var), [path])
                hits = hits.select(F.col(f"`{var}`")["_id"].alias(" i"), F.col(f"`{var}`")["_label"].alias(" l")).distinct()
                here = F.col(f"`{var}`")
                df = df.join(hits, (here["_id"] == F.col("` i`")) & (here["_label"] == F.col("` l`")), "left_anti" if negated else "left_semi")
            else:
                df = df.where(term.make(Scope(df)))
        return df

    # -- clauses -------------------------------------------------------------------------------------

    def items(self) -> list[tuple[Expr, str]]:
        out = []
        while True:
            if self.take("*"):
                out.append((None, "*"))
            else:
                e = self.expression()
                out.append((e, self.name() if self.take("AS") else re.sub(r" ?([.()\[\],]) ?", r"\1", e.text)))
            if not self.take(","):
                return out

    def project(self, df: DataFrame | None, returning: bool) -> DataFrame:
        df = self.spark.range(1).select(F.lit(1).alias(" one")) if df is None else df
        distinct = self.take("DISTINCT")
        items = self.items()
        s = Scope(df)
        items = [x for e, n in items for x in ([(Expr((lambda c: lambda s: s.column(c))(c)), c) for c in df.columns if not c.startswith(" ")] if n == "*" else [(e, n)])]
        # while sorting, results stand beside the variables, under names that no variable has
        shown = [f" out{k}" for k in range(len(items))]
        if any(e.aggregate for e, _ in items):
            keys = [e.make(s).alias(c) for (e, _), c in zip(items, shown, strict=True) if not e.aggregate]
            values = [e.make(s).alias(c) for (e, _), c in zip(items, shown, strict=True) if e.aggregate]
            out = df.groupBy(*keys).agg(*values)
        else:
            own = [e.make(s).alias(c) for (e, _), c in zip(items, shown, strict=True)]
            out = df.select(*own).distinct() if distinct else df.select("*", *own)
        if self.take("ORDER"):
            self.need("BY")
            by = {e.text: c for (e, _), c in zip(items, shown, strict=True) if e.text} | {n: c for (_, n), c in zip(items, shown, strict=True)}
            order = []
            while True:
                e = self.expression()
                column = F.col(f"`{by[e.text]}`") if e.text in by else e.make(Scope(out))
                down = self.take("DESC") or self.take("DESCENDING")
                if not down:
                    _ = self.take("ASC") or self.take("ASCENDING")
                # nulls are the largest values
                order.append(column.desc_nulls_first() if down else column.asc_nulls_last())
                if not self.take(","):
                    break
            out = out.orderBy(*order)
        for word in ("SKIP", "LIMIT"):
            if self.take(word):
                count = self.expression().make(Scope(out))
                n = self.spark.range(1).select(count.cast("int")).first()[0]
                out = out.offset(n) if word == "SKIP" else out.limit(n)
        out = out.select(*[F.col(f"`{c}`").alias(n) for (_, n), c in zip(items, shown, strict=True)])
        return _shown(out) if returning else out

    def plan(self) -> DataFrame:
        out = self.union()
        if self.i < len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.i][1]}")
        if self.unconnected and _PRODUCT.search(out._jdf.queryExecution().executedPlan().toString()):
            raise CypherError("patterns share a variable or meet in an equality")
        return out

    def union(self) -> DataFrame:
        out = self.single()
        while self.take("UNION"):
            keep = self.take("ALL")
            out = out.unionByName(self.single())
            out = out if keep else out.distinct()
        return out

    def subquery(self, df: DataFrame | None) -> DataFrame:
        """The rows of CALL { ... }, whose columns are variables of the rest."""
        if df is not None:
            raise CypherError("a subquery comes first")
        self.depth += 1
        out = self.union()
        self.depth -= 1
        self.need("}")
        return out

    def single(self) -> DataFrame:
        df = None
        while self.i < len(self.tokens):
            word = self.word()
            self.i += 1
            if word == "MATCH":
                df = self.match(df, self.paths())
            elif word == "OPTIONAL":
                self.need("MATCH")
                df = self.optional(df, self.paths())
                continue
            elif word == "WHERE":
                df = self.filtered(df, self.expression())
            elif word == "WITH":
                df = self.project(df, False)
            elif word == "UNWIND":
                e = self.expression()
                self.need("AS")
                base = self.spark.range(1).select(F.lit(1).alias(" one")) if df is None else df
                df = base.withColumn(self.name(), F.explode(e.make(Scope(base))))
            elif word == "CALL":
                df = self.subquery(df) if self.take("{") else self.procedure(df)
            elif word == "RETURN":
                return self.project(df, self.depth == 0)
            else:
                raise CypherError(f"unexpected {word or self.tokens[self.i - 1][1]}")
        raise CypherError("a query ends with RETURN")

    def paths(self) -> list[Path]:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def optional(self, df: DataFrame | None, paths: list[Path]) -> DataFrame:
        if df is None:
            raise CypherError("OPTIONAL MATCH needs something before it")
        shared = [c for c in dict.fromkeys(n.name for p in paths for n in p.nodes) if c in df.columns]
        if not shared:
            raise CypherError("OPTIONAL MATCH shares a variable with what comes before")
        found = self.match(df.select(*[f"`{c}`" for c in shared]).distinct(), paths)
        if self.take("WHERE"):
            found = self.filtered(found, self.expression())
        new = [c for c in found.columns if c not in df.columns and not c.startswith(" ")]
        side = found.select(*[F.col(f"`{c}`")[k].alias(f" {c}{k}") for c in shared for k in ("_id", "_label")], *[f"`{c}`" for c in new])
        on = reduce(lambda x, y: x & y, [F.col(f"`{c}`")[k] == F.col(f"` {c}{k}`") for c in shared for k in ("_id", "_label")])
        return df.join(side, on, "left").drop(*[f" {c}{k}" for c in shared for k in ("_id", "_label")])

    def procedure(self, df: DataFrame | None) -> DataFrame:
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        self.need("(")
        args = []
        while not self.is_(")"):
            args.append(self.expression().make(Scope(self.spark.range(1))))
            if not self.take(","):
                break
        self.need(")")
        if df is not None:
            raise CypherError("a procedure comes first")
        values = [self.spark.range(1).select(a.alias("v")).first()["v"] for a in args]
        if name == "db.index.fulltext.queryNodes" and len(values) == 2:
            hits = fulltext(self.tables, values[1], None)
            rows = hits.select(F.struct("labels", F.concat_ws("#", "path", "name", F.col("line_number").cast("string")).alias("_id"), F.col("labels")[0].alias("_label"), "name", "path", "line_number").alias("node"), "score")
        elif name == "db.index.vector.queryNodes" and len(values) == 3 and values[0] in _VECTOR_INDEXES:
            rows = self.nearest(_VECTOR_INDEXES[values[0]], int(values[1]), list(values[2] or []))
        else:
            raise CypherError(f"unknown procedure: {name}")
        names = {"node": "node", "score": "score"}
        if self.take("YIELD"):
            names = {}
            while True:
                own = self.name()
                names[own] = self.name() if self.take("AS") else own
                if not self.take(","):
                    break
        return rows.select(*[F.col(k).alias(v) for k, v in names.items()])


    def nearest(self, table: str, limit: int, vector: list[float]) -> DataFrame:
        """node, score: the ``limit`` nodes of a table that are nearest to a vector."""
        label, df = VECTOR_TABLES[table], self.tables[table]
        if not vector or "embedding" not in df.columns:
            df, vector = df.withColumn("embedding", F.lit(None).cast("array<float>")), vector or [0.0]
        if vector and "vectors" in self.tables:
            own = self.tables["vectors"].where(F.col("label") == label)
            hits = segments.nearest(own, self.tables["centroids"], vector, limit, ("path", "name"))
            props = ("name", "path", "line_number", "description", "repo_path")
            return hits.select(F.struct(F.array("label").alias("labels"), F.col("node").alias("_id"), F.col("label").alias("_label"), *props).alias("node"), "score")
        hits = vector_topk(df, vector, limit, order=("path", "name"))
        has = lambda c, t: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
        props = [has(c, t) for c, t in (("name", "string"), ("path", "string"), ("line_number", "long"), ("description", "string"), ("repo_path", "string"))]
        return hits.select(F.struct(F.array(F.lit(label)).alias("labels"), node_id(label, df.columns).alias("_id"), F.lit(label).alias("_label"), *props).alias("node"), "score")


class _Element(Scope):
    """A scope with the variable of a comprehension."""

    def __init__(self, outer: Scope, var: str, value: Column, kind: object) -> None:
        super().__init__(outer.df)
        self.outer, self.var, self.value, self.kind = outer, var, value, kind

    def column(self, name: str) -> Column:
        return self.value if name == self.var else self.outer.column(name)

    def prop(self, name: str, prop: str) -> Column:
        if name != self.var:
            return self.outer.prop(name, prop)
        return self.value[prop] if isinstance(self.kind, StructType) and prop in self.kind.fieldNames() else F.lit(None).cast("string")


def _plain(name: str, kind: StructType) -> Column:
    """A node as paths hold it: the properties that any node may have."""
    has = lambda c, t: F.col(name)[c].cast(t) if c in kind.fieldNames() else F.lit(None).cast(t)
    return F.struct(F.col(name)["labels"].alias("labels"), has("_id", "string").alias("_id"), has("_label", "string").alias("_label"), has("name", "string").alias("name"), has("path", "string").alias("path"), has("line_number", "long").alias("line_number"), has("repo_path", "string").alias("repo_path"))


def _shown(df: DataFrame) -> DataFrame:
    """Nodes without the fields that only planning needs."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StructType) and "_id" in f.dataType.fieldNames():
            c = c.dropFields("_id", "_label")
        out.append(c.alias(f.name))
    return df.select(*out)


def run(spark: SparkSession, tables: dict[str, DataFrame], query: str, params: dict | None = None) -> DataFrame:
    """The result of a reading query over the graph's tables."""
    return Query(spark, tables, query, params).plan()
