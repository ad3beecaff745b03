"""Stored insights: upsert on the natural key, kept as versions of periods on plain files.

Plain Parquet has no update in place. An upsert writes new folders for the periods it touches
and then adds one row per period to a small pointer table; readers take the newest version of
each period. Periods that are not touched are neither read nor written, so the cost of a run
does not grow with the history. A version that was not finished has no pointer and is never
read, and a folder that is being read is never written.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.schemas import INSIGHT
from marquee.session import exists, stored

KEY = ["scope_type", "scope_value", "period_start", "period_end"]
# When an incoming row has arrived, above 0; the column may be missing.
ARRIVED = "_arrived"
POINTER = T.StructType(
    [
        T.StructField("period_end", T.DateType()),
        T.StructField("version", T.LongType()),
        T.StructField("folder", T.StringType()),
    ]
)


def conform(frame: DataFrame, schema: T.StructType = INSIGHT) -> DataFrame:
    """Bring rows of an older layout to the present one: missing columns are null, the key is not."""
    have = set(frame.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return (
        frame.select(*columns)
        .withColumn("scope_type", F.coalesce("scope_type", F.lit("global")))
        .withColumn("scope_value", F.coalesce("scope_value", F.lit("")))
    )


def _arriving(frame: DataFrame) -> DataFrame:
    """Incoming rows in the present layout, with their time of arrival where they have one."""
    if ARRIVED not in frame.columns:
        return conform(frame)
    return conform(frame, T.StructType([*INSIGHT.fields, T.StructField(ARRIVED, T.LongType())]))


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or overwrite by key. The newest row wins, the incoming one where two are as new, and of
    incoming ones the one that has arrived last; the creation time stays that of the first row."""
    come = F.col(ARRIVED) if ARRIVED in incoming.columns else F.lit(1)
    both = conform(existing).withColumn("_new", F.lit(0).cast("long"))
    both = both.unionByName(_arriving(incoming.withColumn(ARRIVED, come)).withColumnRenamed(ARRIVED, "_new"))
    rest = [c for c in INSIGHT.fieldNames() if c not in KEY and c != "created_at"]
    return (
        both.groupBy(*KEY)
        .agg(
            F.max_by(F.struct(*rest), F.struct("updated_at", "_new")).alias("row"),
            F.min("created_at").alias("created_at"),
        )
        .select(*KEY, "row.*", "created_at")
        .select(*INSIGHT.fieldNames())
    )


class SnapshotStore:
    """The insight table under one folder that all executors can reach. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _newest(self) -> dict[date, tuple[int, str]]:
        """The newest version of each period and its folder: one entry per day that a run has ended on."""
        if not exists(self.spark, f"{self.root}/pointer"):
            return {}
        pointer = self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer")
        newest = pointer.groupBy("period_end").agg(F.max_by(F.struct("version", "folder"), "version").alias("x"))
        return {r["period_end"]: (r["x"]["version"], r["x"]["folder"]) for r in newest.collect()}

    def read(self, periods: set[date] | None = None) -> DataFrame:
        """All insights, or those of periods that end on the given days."""
        newest = self._newest()
        folders = [
            f"{self.root}/data/version={folder}/period_end={day}"
            for day, (_, folder) in newest.items()
            if periods is None or day in periods
        ]
        if not folders:
            return self.spark.createDataFrame([], INSIGHT)
        data = f"{self.root}/data"
        return conform(self.spark.read.options(basePath=data, mergeSchema="true").parquet(*folders))

    def upsert(self, incoming: DataFrame) -> int:
        """Write the merged periods as a new version and point readers to it."""
        # Written once, because it is used twice: for its periods and for its rows.
        rows = stored(_arriving(incoming), "incoming")
        touched = {r["period_end"] for r in rows.select("period_end").distinct().collect()}
        version = max((number for number, _ in self._newest().values()), default=0)
        if not touched:
            return version
        version += 1
        merged = merge(self.read(touched), rows)
        # A name of its own: a second writer, or a run that is repeated, never touches these files.
        folder = f"{version:08d}-{uuid.uuid4().hex}"
        data = merged.write.mode("errorifexists").partitionBy("period_end")
        data.parquet(f"{self.root}/data/version={folder}")
        pointers = self.spark.createDataFrame([(day, version, folder) for day in touched], POINTER)
        pointers.coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")
        return version
