"""One query per operation over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import ann, chat, codebooks, decontaminate, language, neardup, negatives, packing, pieces, quality, secrets, sql, substrings, urls
from marquee.llm.shipping import ship


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return ann.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Pages are labelled by the quality and toxicity labels of their number."""
    labels = urls.page_labels(_table(spark, folder, "labels"))
    return urls.judge(_table(spark, folder, "pages"), labels)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(packing.pack(_table(spark, folder, "documents")))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(_table(spark, folder, "documents"))


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(_table(spark, folder, "documents"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document and benchmark item found in it; clean documents have none."""
    return decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(_table(spark, folder, "documents"))


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.report(_table(spark, folder, "documents"))


# A text made of the template's own control strings.
_OWN_MARKS = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", _OWN_MARKS), (-7, 1, "assistant", _OWN_MARKS)], "conv_id long, turn long, role string, text string")
    return chat.report(chat.windows(turns.union(own)))


def op10_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.group(_table(spark, folder, "documents"), neardup.Options(shingle=3, percent=85))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; labels of every seventh id are moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, folder, "embeddings").withColumn("label", moved)
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_codebooks(spark: SparkSession, folder: str) -> DataFrame:
    return codebooks.compress(_table(spark, folder, "embeddings"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_ann,
        op2_urls,
        op3_packing,
        op4_secrets,
        op5_pieces,
        op6_decontaminate,
        op7_language,
        op8_substrings,
        op9_chat,
        op10_neardup,
        op11_negatives,
        op12_codebooks,
        op13_quality,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.QUERIES)
