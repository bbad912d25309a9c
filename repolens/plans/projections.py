"""The graph concepts as projections of the standard tables, for queries that need no source code.

Each projection is stated twice, as a DataFrame and as SQL (``SQL``), so results can be compared engine against engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE_ROOT = "/code"
#: @k@ and @n@ stand for a row's key and number.
TYPESCRIPT = """import type { Kind@k@ } from "./kinds";
import base@k@, { alpha as beta@k@ } from '../lib/small';
import * as ns@k@ from "ns-small";
const fs@k@ = require('fs');
@filling@/** Shape number @k@. */
export interface Shape@k@ extends Base@n@, Named {
  area(): number;
}
export type Id@k@ = string | number;
/** Figure @k@. */
export abstract class Figure@k@ extends Root@n@<string> implements Shape@k@, Comparable<Figure@k@> {
  private size: number = @n@;
  constructor(public label: string, readonly n?: number) { super(label); }
  get title(): string { return this.label; }
  set title(v: string) { this.label = v; }
  static of(...xs: string[]) { return new Leaf@k@(xs[0]); }
  /** Draws. */
  async draw(pen: Pen, scale = 1): Promise<void> { if (scale > 1 && pen) { pen.paint(scale); } }
  abstract grow(): void;
}
const arrow@k@ = async (a: number, b?: string) => { while (a) { a--; } return ns@k@.tidy(a)(b); };
const bound@k@: number = @n@;
let note@k@ = "x@k@";
var Made@k@ = class extends Figure@k@ { go() { return 1; } };
function outer@k@(x) { const lost = function (z) { return inner@k@(z); }; function inner@k@(y) { return y || x; } return inner@k@(x); }
"""
PHP = """<?php
use Shop\\Parts\\Part@k@;
use Shop\\Other\\Thing@k@ as Other@k@;
require 'lib/tools.php';
# if ($a)

class Box@k@ extends Base implements Sized@k@, Countable {
  const LIMIT = @n@;
  public $open = true;
  public function __construct(private $name, $rest = 1) { }
  /** Builds. */
  public static function build($a) {
@branches@    return new Part@k@($a);
  }
}

interface Sized@k@ extends Whole { public function size(); }
trait Shared@k@ { function shared() { } }
function start@k@($a, ...$b) { $part->save(1, 'x'); Box@k@::find(); return $a ? helper@k@($a) : 1; }
"""


class Projection:
    """Lazily read tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def functions(self) -> DataFrame:
        """Parts as functions: brand as path, size as complexity, type as kind (PROMO as constructor)."""
        kind = F.when(F.col("p_type") == "PROMO", "constructor").when(F.col("p_type") != "SMALL", F.lower("p_type"))
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_number"),
            F.col("p_size").alias("cyclomatic_complexity"), kind.alias("kind"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("source"),
        )

    def calls(self, min_quantity: float = 0) -> DataFrame:
        """The part of an order's line calls the part of the next line."""
        li = self.table("lineitem")
        a = li.where(F.col("l_quantity") > min_quantity).select("l_orderkey", F.col("l_partkey").alias("src_id"), F.col("l_linenumber").alias("line_number"))
        b = li.select("l_orderkey", F.col("l_partkey").alias("dst_id"), (F.col("l_linenumber") - 1).alias("line_number"))
        return a.join(b, ["l_orderkey", "line_number"]).select("src_id", "dst_id", "line_number").distinct()

    def classes(self) -> DataFrame:
        """Turns of conversations as classes: each extends the turn before."""
        c = self.table("conversations")
        name = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
        return c.select(name.alias("id"), name.alias("name"), F.col("role").alias("path"), F.col("turn").alias("line_number"), "conv_id", "turn").distinct()

    def inherits(self) -> DataFrame:
        c = self.classes()
        up = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("id").alias("dst_id"))
        return c.select("conv_id", "turn", F.col("id").alias("src_id")).join(up, ["conv_id", "turn"]).select("src_id", "dst_id").distinct()

    def imports(self) -> DataFrame:
        """Links of pages as imports."""
        links = F.regexp_extract_all("html", F.lit('<a href="/([^"/]+)"'), F.lit(1))
        rows = self.table("pages").select(F.col("url").alias("path"), F.col("page_id").alias("line_number"), F.explode(links).alias("module"))
        return rows.select("path", "module", F.lower("module").alias("imported_name"), "line_number").distinct()

    def variables(self) -> DataFrame:
        """Suppliers as variables of one file."""
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Supplier").alias("path"), F.col("s_suppkey").alias("line_number"), F.col("s_acctbal").cast("string").alias("value"))

    def hashes(self) -> tuple[DataFrame, DataFrame]:
        """(current, stored) path and content_hash: documents as files of now; stored are those with labels, changed where
        the quality is 0, and the pages, which are gone."""
        d = self.table("documents").select("doc_id", "text")
        path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
        current = d.select(path.alias("path"), F.sha2("text", 256).alias("content_hash"))
        old = self.table("labels").join(d, "doc_id").select(
            path.alias("path"), F.sha2(F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash")
        )
        pages = self.table("pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("content_hash"))
        return current, old.unionByName(pages)

    def named_imports(self) -> DataFrame:
        """Suppliers as imports of a part's name into a brand, some renamed: path, imported_name, alias, line_number."""
        s, p = self.table("supplier"), self.table("part").select("p_partkey", "p_name", "p_type")
        rows = s.join(p, F.col("s_suppkey") == F.col("p_partkey"))
        return rows.select(
            F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("path"), F.col("p_name").alias("imported_name"),
            F.when(F.col("p_type") == "SMALL", F.lit("hot plate")).when(F.col("p_type") == "LARGE", F.lit("no such name")).alias("alias"),
            F.col("s_suppkey").alias("line_number"),
        )

    def parsed_calls(self, min_quantity: float = 0) -> DataFrame:
        """The calls as a parser sees them, by names: path, name, caller_name, line_number."""
        f = self.functions()
        src = f.select(F.col("id").alias("src_id"), F.col("name").alias("caller_name"), "path")
        dst = f.select(F.col("id").alias("dst_id"), "name")
        return self.calls(min_quantity).join(src, "src_id").join(dst, "dst_id").select("path", "name", "caller_name", "line_number").distinct()

    def symbols(self) -> DataFrame:
        f = self.functions().select("name", "path", "line_number")
        return f.withColumn("ord", F.struct("path", "line_number"))

    def sources(self) -> DataFrame:
        """A JavaScript file for each part: as many branches as its size, a call, a class and an import."""
        p = self.table("part")
        key, size = F.col("p_partkey").cast("string"), F.col("p_size")
        branches = F.repeat(F.lit("  if (a) { b++; }\n"), size)
        text = F.concat(
            F.lit("import { "), F.translate("p_name", " ", "_"), F.lit(' } from "./'), F.lower("p_type"), F.lit('";\n'),
            F.lit("// a comment with if (x) { }\nfunction f"), key, F.lit("(a, b = 'if (', ...c) {\n"), branches, F.lit("  return g"), key, F.lit("(b);\n}\nclass C"), key,
            F.lit(" extends "), F.initcap("p_type"), F.lit(" { run() { return this.f"), key, F.lit("() || 0; } }\n"),
        )
        return p.select(F.concat(F.lit("/src/"), key, F.lit(".js")).alias("path"), text.alias("source"))

    def php_sources(self) -> DataFrame:
        """The same in PHP for each supplier."""
        s = self.table("supplier")
        key = F.col("s_suppkey").cast("string")
        text = F.concat(
            F.lit("<?php\nuse App\\Models\\M"), key, F.lit(";\n# if (\nclass S"), key, F.lit(" extends Base implements Api {\n  const N = "), F.col("s_nationkey").cast("string"),
            F.lit(";\n  public static function make($a, ...$b) {\n"), F.repeat(F.lit("    if ($a && $b) { }\n"), F.col("s_nationkey")), F.lit("    return new M"), key, F.lit("($a);\n  }\n}\n"),
        )
        return s.select(F.concat(F.lit("/src/"), key, F.lit(".php")).alias("path"), text.alias("source"))

    def ts_sources(self) -> DataFrame:
        """A TypeScript file for each supplier, with as many filling lines as its nation's number: path, rel, lang, source,
        content_hash."""
        s = self.table("supplier")
        text = F.lit(TYPESCRIPT)
        for mark, value in (("@filling@", F.repeat(F.lit("// filling\n"), F.col("s_nationkey"))), ("@n@", F.col("s_nationkey").cast("string")), ("@k@", F.col("s_suppkey").cast("string"))):
            text = F.replace(text, F.lit(mark), value)
        return self._files(s, text, "ts", "typescript")

    def php_files(self) -> DataFrame:
        """A PHP file for each supplier, with all kinds of symbols; its static method has as many branches as its nation's
        number."""
        s = self.table("supplier")
        text = F.lit(PHP)
        for mark, value in (("@branches@", F.repeat(F.lit("    if ($a) { }\n"), F.col("s_nationkey"))), ("@n@", F.col("s_nationkey").cast("string")), ("@k@", F.col("s_suppkey").cast("string"))):
            text = F.replace(text, F.lit(mark), value)
        return self._files(s, text, "php", "php")

    def _files(self, s: DataFrame, text: Column, ext: str, lang: str) -> DataFrame:
        rel = F.concat(F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(f".{ext}"))
        digest = F.sha2(F.concat(F.lit("file "), F.col("s_suppkey").cast("string")), 256)
        return s.select(F.concat(F.lit(CODE_ROOT + "/"), rel).alias("path"), rel.alias("rel"), F.lit(lang).alias("lang"), text.alias("source"), digest.alias("content_hash"))

    def graph_tables(self) -> dict[str, DataFrame]:
        """All tables of the graph, from projections; those without one are empty."""
        from repolens.sources.schema import TABLES  # noqa: PLC0415

        out = {t: self.spark.createDataFrame([], TABLES[t]) for t in TABLES}
        files = self.files().select("path", F.substring_index("path", "/", 3).alias("repo_path"))
        owner = F.concat(F.lit("/world/"), F.lit("ASIA"))
        return out | {
            "repositories": self.table("region").select(F.concat(F.lit("/world/"), F.col("r_name")).alias("path"), F.col("r_name").alias("name")),
            "files": files.withColumn("name", F.element_at(F.split("path", "/"), -1)),
            "functions": self.functions().withColumn("repo_path", F.when(F.col("kind") == "economy", owner)).withColumn("context", F.lit(None).cast("string")),
            "variables": self.variables().withColumn("repo_path", F.lit(None).cast("string")),
            "classes": self.classes().withColumn("repo_path", F.lit(None).cast("string")).withColumn("is_interface", F.col("path") == "system"),
            "calls": self.calls().withColumn("repo_path", F.lit(None).cast("string")),
            "inherits": self.inherits().withColumn("repo_path", F.lit(None).cast("string")),
            "imports": self.imports().withColumn("repo_path", F.lit(None).cast("string")),
        }

    def files(self) -> DataFrame:
        """Customers as files under their region and nation."""
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        rel = F.concat_ws("/", "r_name", "n_name", "c_name")
        rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(F.concat(F.lit("/world/"), rel).alias("path"), rel.alias("rel"))

    def events(self) -> DataFrame:
        """Events as file changes of their users."""
        e = self.table("events")
        return e.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("seq"))


#: The projections as common table expressions.
SQL = {
    "functions": """functions AS (SELECT p_partkey AS id, p_name AS name, p_brand AS path, p_partkey AS line_number, p_size AS cyclomatic_complexity,
      CASE WHEN p_type = 'PROMO' THEN 'constructor' WHEN p_type <> 'SMALL' THEN lower(p_type) END AS kind,
      concat_ws(' ', p_name, p_type, p_brand) AS source FROM part)""",
    "calls": """calls AS (SELECT DISTINCT a.l_partkey AS src_id, b.l_partkey AS dst_id, a.l_linenumber AS line_number
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)""",
    "sparse": """calls AS (SELECT DISTINCT a.l_partkey AS src_id, b.l_partkey AS dst_id, a.l_linenumber AS line_number
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity > 45)""",
    "classes": """classes AS (SELECT DISTINCT conv_id || '_' || turn AS id, conv_id || '_' || turn AS name, role AS path, turn AS line_number, conv_id, turn FROM conversations),
      inherits AS (SELECT DISTINCT a.id AS src_id, b.id AS dst_id FROM classes a JOIN classes b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)""",
    "imports": """imports AS (SELECT DISTINCT url AS path, module, lower(module) AS imported_name, page_id AS line_number
      FROM (SELECT url, page_id, unnest(regexp_extract_all(html, '<a href="/([^"/]+)"', 1)) AS module FROM pages))""",
    "hashes": """current AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS content_hash FROM documents),
      stored AS (SELECT 'doc/' || doc_id AS path, sha256(CASE WHEN quality = 0 THEN text || '!' ELSE text END) AS content_hash FROM labels JOIN documents USING (doc_id)
        UNION ALL SELECT 'page/' || page_id, sha256(html) FROM pages)""",
    "named_imports": """named_imports AS (SELECT 'Brand#' || (s_nationkey + 1) AS path, p_name AS imported_name,
      CASE WHEN p_type = 'SMALL' THEN 'hot plate' WHEN p_type = 'LARGE' THEN 'no such name' END AS alias, s_suppkey AS line_number FROM supplier JOIN part ON s_suppkey = p_partkey)""",
    "parsed_calls": """parsed_calls AS (SELECT DISTINCT s.path, d.name, s.name AS caller_name, c.line_number FROM calls c JOIN functions s ON s.id = c.src_id JOIN functions d ON d.id = c.dst_id)""",
    "resolved": """asked AS (SELECT DISTINCT path, name FROM parsed_calls),
      first_import AS (SELECT * FROM (SELECT a.path, a.name, i.imported_name, i.alias, row_number() OVER (PARTITION BY a.path, a.name ORDER BY i.line_number) AS nth
        FROM asked a JOIN named_imports i ON i.path = a.path AND (i.imported_name = a.name OR i.alias = a.name)) WHERE nth = 1),
      lowest AS (SELECT name, path AS p, line_number AS l FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line_number) AS nth FROM functions) WHERE nth = 1),
      by_import AS (SELECT path, name, p, l FROM (SELECT f.path, f.name, lo.p, lo.l, row_number() OVER (PARTITION BY f.path, f.name ORDER BY k.rank) AS nth
        FROM first_import f, (VALUES (0), (1), (2)) k(rank), lowest lo WHERE lo.name = CASE k.rank WHEN 0 THEN f.name WHEN 1 THEN f.imported_name ELSE f.alias END) WHERE nth = 1),
      by_name AS (SELECT path, name, p, l FROM (SELECT a.path, a.name, s.path AS p, s.line_number AS l,
        row_number() OVER (PARTITION BY a.path, a.name ORDER BY s.path = a.path, s.path, s.line_number) AS nth FROM asked a JOIN functions s ON s.name = a.name) WHERE nth = 1),
      resolved AS (SELECT a.path, a.name, coalesce(i.p, n.p) AS resolved_path, coalesce(i.l, n.l) AS resolved_line
        FROM asked a LEFT JOIN by_import i USING (path, name) LEFT JOIN by_name n USING (path, name))""",
    "files": """files AS (SELECT '/world/' || r_name || '/' || n_name || '/' || c_name AS path, r_name || '/' || n_name || '/' || c_name AS rel, r_name, n_name, c_name
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
}
