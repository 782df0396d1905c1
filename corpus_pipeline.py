"""The corpus pipeline: quality, near copies, leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir), where docs has the columns of
documents, and returns a DataFrame; all but the last return those columns.
Each works on everything that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typedlake.llm.common import discard, made, small_batches, stash
from typedlake.llm.decontaminate import without_leaks
from typedlake.llm.jaccard_join import one_of_each
from typedlake.llm.mixing import mixed_texts
from typedlake.llm.quality import keep_sampled
from typedlake.llm.sharding import shard


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the importance sample takes; those that it rejects go."""
    small_batches(spark)
    return keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    small_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each round a document's drawn words, so a document may come up to three times."""
    return mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with their shard and slot."""
    return shard(docs, carry=("text", "lang", "source"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The stages learn, search and draw at random: SQL can't express them. tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage leaves there beside its result is removed when the result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(made)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stash(docs, name)
            discard(spark, made[before:-1])
    return docs
