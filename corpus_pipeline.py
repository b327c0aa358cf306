"""A corpus from raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontaminate, minhash, mixing, secrets, toxicity
from parlance.llm.common import scratch, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return minhash.without_near_duplicates(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials replaced; n_chars follows the new text."""
    redacted = secrets.redact(docs.withColumn("_text", F.col("text")))
    new = F.when(F.col("text") != F.col("_text"), F.length("text")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", new.cast(docs.schema["n_chars"].dataType)).drop("_text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with the weights that bring each cell to its target."""
    return mixing.mix(docs).where("kept").drop("kept")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mix", mix_sources),
]
#: Not a query: a trained tagger, components of unknown depth and iterative fitting.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, as a stored table; the tables of the stages before it go when they have been read.

    Null and repeated ids, null texts and further columns pass through all stages but for the rows that a stage drops; without documents
    there are no rows.
    """
    docs = _table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", result=name == STAGES[-1][0])
    return docs
