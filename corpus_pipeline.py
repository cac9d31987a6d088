"""From documents to shards of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents that the
quality model keeps; one of each group of near copies; those that no benchmark has
contaminated; the mix of sources, with a row for each time a document is taken; and
these rows with their shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thalweg.llm import decontamination, mixing, near_duplicates, quality, sharding
from thalweg.llm.tables import table
from thalweg.session import discard, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicate removal", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("source mixing", mixed),
    ("sharding", sharded),
]

#: The model's perplexities and the random rounding have no SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
