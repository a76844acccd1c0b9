"""A training corpus from ``documents``: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import quality, simhash
from skyledger.llm.common import scratch, table
from skyledger.llm.decontaminate import decontaminate
from skyledger.llm.mixing import mix
from skyledger.llm.pseudonyms import KINDS, pseudonymize
from skyledger.llm.queries import WEIGHTS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality classifier keeps."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return simhash.keep_one(docs).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with format-preserving pseudonyms; ``n_chars`` follows."""
    hidden = pseudonymize(docs).drop(*(f"n_{k}" for k in KINDS))
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the Pfair mixture."""
    return mix(docs, WEIGHTS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
]

#: Fitted models, fingerprints and keyed permutations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
