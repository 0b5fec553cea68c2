"""From raw documents to training sequences, in five stages of the ``llm`` operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyloom.llm.lines import without_boilerplate
from polyloom.llm.mixing import sampled
from polyloom.llm.packing import pack
from polyloom.llm.simhash import without_near
from polyloom.llm.toxicity import without_toxic
from polyloom.plans.shared import materialize


#: The share of tokens that mixing keeps: it is the stage that samples, so it drops clean documents by design.
KEEP = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; null texts stay."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sites or more carry stay in one place; a document of which no line is left goes."""
    return without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return without_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by raked probabilities."""
    return sampled(docs, keep=KEEP)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, by bucket and batch."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A trained model and SimHash aren't SQL: tests/llm holds what each stage keeps, and the whole, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table of documents; each result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
