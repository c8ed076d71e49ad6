"""From documents to a training mix: STAGES in order, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns
the mix. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, lines, minhash, mixing, toxicity
from fleetlens.session import stored


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not call toxic; it learns from the labels outside the held-out fold."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, net).where("predicted = 0").select(docs.columns)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut; a document that loses all its words by that is dropped."""
    rows = lines.dedup_lines(docs)
    changed = F.col("n_removed_lines") > 0
    rows = rows.where(~changed | (F.length(F.translate("text", lines.BLANK + "\n", "")) > 0))
    return rows.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.dedup(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, source_size, target, copies and taken words; those that the mix leaves out have 0 copies."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("near_dedup", _near_dedup),
    ("decontamination", _decontaminate),
    ("mixing", _mix),
]

#: The stages draw, train and hash; SQL cannot express them. They are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
