"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared folder
and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolens.llm.common import scratch_path
from repolens.llm.decontaminate import drop_contaminated
from repolens.llm.mixing import copies
from repolens.llm.near_dedup import drop_near_duplicates
from repolens.llm.quality import keep_good
from repolens.llm.sharding import with_shards
from repolens.operators.traverse import remove, swept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more.

    A null text is scored like an empty one; ids and other columns play no part, so equal texts stay or go together and
    repeated rows are each decided alike.  Without labels every score is 0.5, and all stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets that are 80 % alike: that with the smallest doc_id, null last.

    Decided by row: rows of one doc_id but different texts go each by its own text, and of repeated rows one stays.  Null
    and empty texts have no shingles and all stay.
    """
    return drop_near_duplicates(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; each row by its own text, so repeated rows stay or go together.

    Null and empty texts hold nothing, and null or empty items are found nowhere.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of weights 1, 2, 3 takes it, to the nearest whole copy.

    A null source is one of its own, the last in the order of weights.  Documents without words, null texts among them, are
    in no mix and leave.  Repeated rows are documents of their own that share their copies.
    """
    return copies(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard (0 to 39) and place in the shard, which replace columns ``shard`` and ``slot`` if there are.

    Null texts and ids have shards like others, and repeated rows a place each.
    """
    return with_shards(docs, 40)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier, the MinHash search and the hashed order of the mix have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage writes for itself goes when its result is written, and that when the
    next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
