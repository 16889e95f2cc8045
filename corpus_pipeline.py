"""A training corpus from raw documents: five stages, each one operator of
``covary.llm`` applied to all rows that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents`` as they are, whatever they are called; the
last returns what the tokenizer made of the documents that remain. Null texts
count as empty, an empty table passes through, and rows that repeat an id and
a text leave one row at the exact stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covary.llm import decontaminate, exact_dedup, simhash, toxicity
from covary.llm._common import saved
from covary.llm.bpe import bpe_round_trip
from covary.llm.queries import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. The model is learned
    from the labelled documents that are not held out."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"), threshold=0.3)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays: four-word shingles,
    at most four differing bits."""
    return simhash.drop_near_copies(docs, words=4, radius=4)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every remaining document and the hash of their decoding."""
    return bpe_round_trip(docs, vocabulary("byte_bpe_50k.json"), ids=True)


STAGES = [("toxicity", toxic), ("exact dedup", exact_copies), ("simhash near-dedup", near_copies), ("benchmark decontamination", contaminated), ("bpe encoding and decoding", tokens)]

#: Fingerprints and merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
