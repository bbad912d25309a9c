"""URL filtering by association rules.

A URL becomes a set of tokens: its scheme, the labels of its host, the host itself, words inside host labels, path
segments (numbers as one token), its query keys and whether it has a fragment.  Spark's FP-growth mines token sets from
labelled URLs, each with its class as one more token; rules ``tokens -> block`` stay if enough URLs support them, if they
are confident, lift the base rate, and no sub-rule is as confident.  Rules are matched through an inverted index: each is
posted under its rarest token, a URL meets the rules of its tokens, and a rule fires if it needs no token the URL lacks.

Tokens that exactly the same labelled URLs have are mined as one, but other URLs may have only some of them: each token of
a rule comes with its equals, and a URL that has any of them has it.

Before the method, fixed rules decide: a rule (host, path) fits its host and all subdomains if the URL's path starts with
the rule's path; the longest wins.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens, so no rule fits and it is
allowed; repeated rows each get a row; URLs with equal text are matched once; without labels no rules are mined and
everything else is allowed; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm.common import materialise, small, spread_join

#: (verdict, host, path)
FIXED_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 30, 0.6, 2.0
BLOCK = "=block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = FIXED_RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, both null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; an empty array without ``://``."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    words = F.filter(F.split(host, r"[.\-_]"), lambda x: x != "")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    steps = F.transform(steps, lambda x: F.regexp_replace(x, r"[0-9]+", "0"))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    tag = lambda name, values: F.transform(values, lambda x: F.concat(F.lit(name), x))
    every = F.concat(
        F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("scheme:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        tag("label:", F.filter(labels, lambda x: x != "")), tag("word:", words), tag("step:", steps), tag("key:", keys),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    empty = F.array().cast("array<string>")
    return F.when(F.contains(url, F.lit("://")), F.array_sort(F.array_distinct(every))).otherwise(empty)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """rule (sorted tokens), confidence, support, same (for each token of the rule, all that may stand in its place) from
    ``labelled`` (url, bad boolean).

    Before mining, tokens that fewer than ``min_count`` bad URLs have drop out, and of tokens that exactly the same URLs
    have one stays: their sets would only repeat each other's rules.  ``same`` has the others, no more than a URL's tokens.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("bad"))
    rows = rows.select(F.xxhash64("url").alias("key"), "bad", F.explode(tokens(F.col("url"))).alias("token"))
    rows = materialise(rows, "url-tokens")
    total, n_bad = rows.select("key", "bad").distinct().agg(F.count("*"), F.count_if("bad")).first()
    each = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor("key").alias("urls"))
    each = each.where(F.col("n_bad") >= min_count).groupBy("n", "urls").agg(F.min("token").alias("token"), F.sort_array(F.collect_list("token")).alias("equal"))
    kept = materialise(each.select("token", "equal"), "url-kept")
    items = rows.join(small(kept.select("token")), "token").groupBy("key", "bad").agg(F.sort_array(F.collect_list("token")).alias("own"))
    rows = materialise(items.select(F.when(F.col("bad"), F.concat("own", F.array(F.lit(BLOCK)))).otherwise(F.col("own")).alias("items")), "url-items")
    if not n_bad or rows.isEmpty():
        return spark.createDataFrame([], "rule array<string>, confidence double, support double, same array<array<string>>")
    seen = rows.count()
    parts = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    support = max(min_support * total, min_count) / seen
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence, numPartitions=parts).fit(rows)
    # lift over the share of bad URLs among all, of which some have no token left
    lift = F.col("confidence") / F.lit(n_bad / total)
    found = model.associationRules.where(F.array_contains("consequent", BLOCK) & (lift >= min_lift))
    found = materialise(found.select(F.array_sort("antecedent").alias("rule"), "confidence", "support"), "url-rules")
    # a rule with a shorter one inside that is as confident says nothing new
    inner = found.select(F.col("rule").alias("less"), F.col("confidence").alias("sure"), F.explode("rule").alias("token"))
    outer = found.select("rule", "confidence", F.explode("rule").alias("token")).join(inner, "token")
    outer = outer.where((F.size("less") < F.size("rule")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "rule")) == 0))
    found = found.join(outer.select("rule").distinct(), "rule", "left_anti")
    same = found.select("rule", F.explode("rule").alias("token")).join(small(kept), "token")
    same = same.groupBy("rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("token", "equal"))), lambda x: x["equal"]).alias("same"))
    return materialise(found.join(same, "rule").select("rule", "confidence", "support", "same"), "url-mined")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url of those among distinct ``urls`` that some rule fits, with the most confident (``mined_rule``, its tokens joined
    by " & ", and ``confidence``; of equals the one that sorts last)."""
    seen = rules.select(F.explode("rule").alias("token"), "support").groupBy("token").agg(F.sum("support").alias("common"))
    posts = rules.select("rule", F.explode("rule").alias("token")).join(seen, "token")
    posts = posts.groupBy("rule").agg(F.min_by("token", F.struct("common", "token")).alias("token")).join(rules.select("rule", "same", "confidence"), "rule")
    # under the rarest token and all its equals
    posts = posts.select("rule", "confidence", "same", F.explode(F.element_at("same", F.array_position("rule", F.col("token")).cast("int"))).alias("token"))
    own = urls.select("url", tokens(F.col("url")).alias("own"))
    met = own.select("url", "own", F.explode("own").alias("token")).join(small(posts), "token")
    met = met.where(F.forall("same", lambda x: F.arrays_overlap(x, "own")))
    best = met.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("rule", " & ").alias("mined_rule"))).alias("best"))
    return best.select("url", "best.mined_rule", "best.confidence")


def judge(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page; mined_rule and confidence, if a mined rule blocks it."""
    rules = mine(labelled)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, fixed = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), fixed.alias("fixed"))
    if rules.isEmpty():
        rows = rows.withColumn("mined_rule", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        open_urls = rows.where("fixed is null and url is not null").select("url").distinct()
        # a URL that a fixed rule decides is not among these, however many pages have it
        found = materialise(fired(open_urls, rules), "url-fired")
        rows = spread_join(rows, found, ["url"], by="page_id", how="left")
    verdict = F.coalesce("fixed", F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "confidence")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: a page's path ends in the number of the document it was made from; that document's label is the page's."""
    number = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})(?:[./].*)?$", 1)
    rows = pages.where("url is not null").select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return rows.join(bad, "doc_id").select("url", "bad")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``pages``, with rules mined from ``labels``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, page_labels(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
