"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced code point.

Words are near by a replacement exactly if they share a group (position, prefix, suffix): all words that are equal but for
the code point at one position.  Two such words share exactly one group, so the sizes of a word's groups add up to the
number of its near words.  A group holds at most one word per letter of the alphabet; it keeps its size and its two
most frequent words, which is all that each member needs: the best of the others is the first, or the second for the first
itself.  No pair is ever built.  Words are near by an insertion or deletion exactly if one is the other less one code
point: each word's distinct deletions are joined with the vocabulary.  A word has at most as many as it has code points,
and what is found counts for both ends.  Everything a word has met is then combined in one aggregation.

Occurrences are counted with map-side aggregation, so a word that makes up a third of all rows is one row per task.

A word's form is its most frequent near word if that is ``TIMES`` as frequent or more, else null; frequencies grow along forms,
so chains end after fewer steps than the logarithm of the corpus, and roots are found by pointer jumping over the words that
have a form.

Defined results: a null text has no words, a null doc_id counts as empty in the damaging hash; texts are read whole; of near
words that are equally frequent the smallest in code-point order is the form; repeated rows count each; an empty table
gives no rows; extra columns are ignored.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm.common import CRC_STEPS_SQL, crc32_sql, materialise, small

#: Words of at least so many code points, so many times in the corpus, are grouped.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Stands for any code point; it is in no word.
ANY = "*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, run: every maximal run of letters of at least that many code points, A-Z lower-cased (deleting only shortens)."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    return docs.select(F.col("doc_id"), F.explode(runs).alias("run"))


def damaged(doc_id: Column, run: Column, one_in: int = 199) -> Column:
    """The run less its code point h % length where ``one_in`` divides h, the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words (``word``) long and frequent enough."""
    long_enough = words.where(F.char_length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _without(i: Column, put: str) -> Column:
    """The word with its code point ``i`` (from 1) replaced by ``put``."""
    return F.concat(F.substring("word", F.lit(1), i - 1), F.lit(put), F.substring("word", i + 1, F.char_length("word")))


def _places() -> Column:
    return F.sequence(F.lit(1), F.char_length("word"))


def _ordered(word: str, n: str) -> Column:
    """Least for the most frequent word, then for the smallest."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (-n, word): how many words are near each word of ``words`` (word, n) that has any, and the best."""
    keys = words.select("word", "n", F.explode(F.transform(_places(), lambda i: _without(i, ANY))).alias("key"))
    # a group has no more words than the alphabet has letters
    groups = keys.groupBy("key").agg(F.sort_array(F.collect_list(_ordered("word", "n"))).alias("words")).where(F.size("words") > 1)
    first, second = F.col("words")[0], F.col("words")[1]
    mine = groups.select((F.size("words") - 1).cast("long").alias("n_near"), first.alias("first"), second.alias("second"), F.explode("words.word").alias("word"))
    replaced = mine.select("word", "n_near", F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))

    shorter = words.select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(F.array_distinct(F.transform(_places(), lambda i: _without(i, "")))).alias("word"))
    met = shorter.join(words, "word")
    ends = F.array(
        F.struct(F.col("word"), F.struct((-F.col("long_n")).alias("less"), F.col("long").alias("word")).alias("best")),
        F.struct(F.col("long").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")).alias("best")),
    )
    one_off = met.select(F.explode(ends).alias("end")).select("end.word", F.lit(1).cast("long").alias("n_near"), "end.best")
    return replaced.unionByName(one_off).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms of each word of ``forms`` (word, form).

    Each round doubles the length of all steps, until none moves on.
    """
    steps = materialise(forms.select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(steps.join(small(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n)."""
    words = materialise(words, "spelling-words")
    near = words.join(near_words(words), "word", "left")
    form_n = -F.col("best.less")
    good = form_n >= times * F.col("n")
    rows = materialise(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(good, F.col("best.word")).alias("form"),
            F.when(good, form_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(rows.where("form is not null"))
    return rows.join(small(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``documents``."""
    found = occurrences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return variants(vocabulary(found.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))))


OP12_SQL = f"""
WITH RECURSIVE {CRC_STEPS_SQL},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]{{{LEAST_LENGTH},}}')) AS run
  FROM documents),
hashed AS (SELECT run, times, {crc32_sql("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS times FROM runs GROUP BY id, run), crc_steps),
damaged AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times
  FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS key FROM cut),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS shorter FROM cut),
links AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.shorter
  UNION ALL SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.shorter),
met AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM links GROUP BY word),
best AS (SELECT word, n_near, best_n, min(other) AS best FROM met JOIN links USING (word) WHERE other_n = best_n GROUP BY word, n_near, best_n),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * n THEN best END AS form, CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chains AS (
  SELECT word, word AS place, 0 AS step FROM formed
  UNION ALL SELECT c.word, r.form, c.step + 1 FROM chains c JOIN formed r ON r.word = c.place WHERE r.form IS NOT NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM formed JOIN (SELECT word, arg_max(place, step) AS root FROM chains GROUP BY word) USING (word)
"""
