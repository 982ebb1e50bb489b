"""The corpus pipeline: five stages, each on all that the one before it kept.

A stage takes (spark, docs, folder of tables) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. Every stage but the last returns the
columns of documents. The last one returns them with ``taken``, the words that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontaminate, lines, mixing, simhash, toxicity
from shelfwise.operators.lineage import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from the labels of these documents."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that most pages of their source share."""
    return lines.drop_boilerplate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by three-word shingles and at most three differing bits."""
    return simhash.drop_near_copies(docs, shingle=simhash.SHINGLE, distance=simhash.DISTANCE)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with a benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with the number of words taken."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("line dedup", boilerplate),
    ("near copies", near_copies),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
]

#: A trained classifier and hashed orders have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
