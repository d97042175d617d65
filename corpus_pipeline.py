"""From raw documents to sharded training data: quality, near-duplicates, benchmark leaks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import decontam, mixing, quality, sharding, simhash
from siltworks.llm.common import free_name, remove_path, shared_path, table

#: Documents that score below this go.
QUALITY = 0.5
#: Target shares of the tokens; sources and the languages and topics that aren't named share the rest by their observed shares to POWER.
TARGETS, POWER, FRACTION = {"lang": {"en": 0.57, "de": 0.16, "fr": 0.15, "es": 0.11}, "topic": {"prose": 0.87}}, 0.85, 0.9


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    name = free_name(docs, "_quality")
    return quality.score(docs, model, rest, name).filter(F.col(name) >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that the tokens meet the target shares; at most FRACTION of the tokens stay."""
    names = {n: free_name(docs, f"_mix_{n}") for n in mixing.MADE}
    return mixing.mix(docs, TARGETS, POWER, FRACTION, names=names).filter(names["selected"]).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its shard and slot; the input's columns stay, and new ones with a name of theirs get underscores."""
    return sharding.shard_rows(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]
#: The classifier, near-duplicates and the mixture have no SQL form; tests compare run() with plain Python versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again.

    A stage's table is deleted once the next one's is written; the last stays for the caller.
    """
    docs, old = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            remove_path(spark, old)
        docs, old = spark.read.parquet(path), path
    return docs
