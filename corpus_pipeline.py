"""The corpus pipeline: each stage takes the documents that its predecessor kept, as a written table.

``run(spark, sf_dir)`` applies the stages to ``documents`` and returns the rows of the last one: a row
per sequence of tokens in training order. All stages but the last return the columns of documents.
SQL cannot express them (a fitted model, random rounding, a tokeniser); each is tested against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import chosen_path, decontaminate, pivotal_mix, ppm_language, training_order
from undula.llm.common import crc_part, scratch, table


def identified_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters) go; those with one stay, whatever their lang says."""
    return ppm_language.keep_identified(docs, crc_part("doc_id", 4) != 2)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by similarity 0.8 or more, the one with the smallest doc_id stays."""
    return chosen_path.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more occurs in the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it: never, once or twice."""
    return pivotal_mix.mixed_documents(docs)


def token_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards in training order, read back: a row per slot."""
    found = training_order.ordered(docs)
    return found.select("slot", "shard", "sequence", "n_tokens", "doc_ids", "tokens_sha256")


STAGES = [
    ("language identification", identified_languages),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("token ids in training order", token_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
