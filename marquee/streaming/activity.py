"""Incremental forms: activity per hour of event time, and upsert of arriving insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.schemas import EVENTS, INSIGHT
from marquee.session import exists, new_folder, stored
from marquee.sources.snapshots import ARRIVED, SnapshotStore

# What tells the rows of a table of hours apart.
HOUR = ["window_start", "window_end", "event_type"]


def event_stream(spark: SparkSession, path_glob: str, files: int = 1000) -> DataFrame:
    """Events as they arrive in files; ``path_glob`` is a pattern of files or folders."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(files)).parquet(path_glob)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_activity(events: DataFrame, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and value per hour of event time and type; ``slide`` makes the hours overlap.

    State is one row per open hour and type, whatever the number of events.
    """
    hour = F.window("ts", "1 hour", slide) if slide else F.window("ts", "1 hour")
    return (
        events.withWatermark("ts", late)
        .groupBy(hour.alias("w"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(F.col("value").cast("decimal(18,4)")).alias("total_value"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "event_type",
            "events",
            "total_value",
        )
    )


def run_append(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """Process all that has arrived and append the finished hours to files; read these back.

    An hour is finished once the watermark has passed its end; rows later than that are dropped.
    """
    out, state = new_folder(spark, purpose), new_folder(spark, f"{purpose}-state")
    query = (
        frame.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def run_complete(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """Process all that has arrived and write the whole result, finished hours and open ones.

    Each micro-batch writes a folder of its own; the last one is the answer.
    """
    out, state = new_folder(spark, purpose), new_folder(spark, f"{purpose}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        frame.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not exists(spark, out):  # no micro-batch has run
        return spark.createDataFrame([], frame.schema)
    rows = spark.read.parquet(out)
    newest = rows.agg(F.max("batch").alias("batch")).scalar()
    return rows.filter(F.col("batch") == newest).drop("batch")


def merge_hours(batch: DataFrame, batch_id: int, out: str) -> None:
    """Put changed hours into the folders of their days; of each hour and type the newest batch stays.

    Only days that the batch touches are read and written. A batch that runs twice gives the same table.
    """
    spark = batch.sparkSession
    day = F.to_date("window_start").alias("day")
    # Written once: state is not asked again, and the days are known before their folders are replaced.
    rows = stored(batch.select("*", F.lit(batch_id).cast("long").alias("batch"), day), "changes")
    if exists(spark, out):
        old = spark.read.schema(rows.schema).parquet(out)
        rows = rows.unionByName(old.join(rows.select("day").distinct(), "day", "left_semi"))
    rest = [c for c in rows.columns if c not in (*HOUR, "day")]
    newest = rows.groupBy("day", *HOUR).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    merged = stored(newest.select("day", *HOUR, "row.*"), "hours")
    merged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)


def run_update(spark: SparkSession, frame: DataFrame, purpose: str, state: str | None = None, out: str | None = None) -> DataFrame:
    """Process all that has arrived, and merge what has changed into a table of hours by day.

    State holds open hours only: the watermark drops an hour once no row of it is awaited, and rows
    later than that are dropped. ``state`` and ``out`` continue an earlier run.
    """
    out, state = out or new_folder(spark, purpose), state or new_folder(spark, f"{purpose}-state")
    query = (
        frame.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: merge_hours(batch, batch_id, out))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not exists(spark, out):  # no micro-batch has run
        return spark.createDataFrame([], frame.schema)
    return spark.read.schema(frame.schema).parquet(out).select(*frame.columns)


def upsert_stream(
    spark: SparkSession, landing: str, store: SnapshotStore, files: int | None = None, state: str | None = None
) -> DataFrame:
    """Merge insights that arrive as files into the store, one new version per micro-batch.

    A micro-batch takes all files that have arrived, or at most ``files``. Each one reads and writes the
    periods that it touches, so a run of many files in few micro-batches costs its rows and not its rows
    times its files. Of rows with one key and time the one of the newest file stays, however the files
    are dealt over micro-batches. ``state`` continues an earlier run.

    A micro-batch that runs twice gives the same table: rows are merged by key and time.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch)

    arriving = spark.readStream.schema(INSIGHT)
    if files is not None:
        arriving = arriving.option("maxFilesPerTrigger", str(files))
    query = (
        arriving.parquet(landing)
        .select("*", F.unix_micros("_metadata.file_modification_time").alias(ARRIVED))
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", state or new_folder(spark, "upsert-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store.read()
