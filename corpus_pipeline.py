"""A training corpus from raw documents: five stages, each over all that the one before has kept.

1. language: documents whose language is rejected go (null or letterless texts among them).
2. near_duplicates: of documents that are alike on five-word shingles at 0.8 or more, one stays.
3. decontamination: documents with benchmark items go.
4. secrets: found secrets are masked in the text; no document goes, and ``n_chars`` follows.
5. pieces: sampled segmentations of every text, a row per document and sample.

All but the last return the columns of the documents. Each stage's result is written as Parquet
below the shared folder and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import decontaminate, language, neardup, pieces, secrets
from marquee.llm.shipping import ship
from marquee.session import stored


def prepared(spark: SparkSession) -> SparkSession:
    """A session that has the package and sends the Python workers few documents at a time.

    Documents are long: ten thousand, as many as Spark sends by default, are tens of megabytes, in the
    executor, on the way and in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return ship(spark)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return language.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return neardup.drop_copies(docs, neardup.Options(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return pieces.sample(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("pieces", segmentation),
]

# Trained models, signatures and lattice sampling are beyond SQL; tests hold every stage against a
# brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
