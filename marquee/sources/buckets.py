"""Shows and tickets in buckets of the show, so that sums and the fact join move no row.

Both tables are partitioned by the date of the show and bucketed by ``schedule_id`` with one number
of buckets: a bucket of tickets is summed, and joined with its shows, in the task that reads it. A
bucket is one task, so the tickets of shows with more than ``hot_rows`` of them, at most one show
per ``hot_rows`` tickets, lie in a table of their own, in files of a bounded size; these are summed
by a shuffle of one row per show and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.schemas import BASE_TABLES
from marquee.session import stored
from marquee.sources.tables import FILE_ROWS, Tables

HOT = "tiket_hot"


def _bucketed(frame: DataFrame, table: str, buckets: int, order: list[str], file_rows: int) -> None:
    # The shuffle's hash is the buckets' hash, so each task writes one bucket of all dates.
    rows = frame.repartition(buckets, "schedule_id").sortWithinPartitions("show_date", *order)
    writer = rows.write.option("maxRecordsPerFile", file_rows).partitionBy("show_date")
    writer.bucketBy(buckets, "schedule_id").sortBy(*order).saveAsTable(table)


def write_bucketed(
    tables: Tables, database: str, buckets: int, location: str | None = None, hot_rows: int = FILE_ROWS, file_rows: int = FILE_ROWS
) -> None:
    """Store the tables in a new database of the session's catalog, below ``location`` if one is given.

    ``buckets`` should hold a date's or a window's tickets in partitions that fit into tasks; a date
    has up to as many files.
    """
    spark = tables.spark
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE {database}{place}")
    for name in ("movies", "studio", "cinema"):
        getattr(tables, name).write.saveAsTable(f"{database}.{name}")
    _bucketed(tables.schedules, f"{database}.schedules", buckets, ["schedule_id"], file_rows)
    dates = tables.schedules.select("schedule_id", "show_date")
    tickets = tables.tiket.drop("show_date").join(dates, "schedule_id", "left")
    hot = tables.tiket.groupBy("schedule_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = stored(hot.select("schedule_id"), "hot")
    plain = tickets.join(hot, "schedule_id", "left_anti")
    _bucketed(plain, f"{database}.tiket", buckets, ["schedule_id", "trans_time"], file_rows)
    keys = ["show_date", "schedule_id", "trans_time", "tiket_id"]
    many = tickets.join(hot, "schedule_id", "left_semi").repartitionByRange(*keys).sortWithinPartitions(*keys)
    many.write.option("maxRecordsPerFile", file_rows).partitionBy("show_date").saveAsTable(f"{database}.{HOT}")


def read_bucketed(spark: SparkSession, database: str) -> Tables:
    """The tables of a database that :func:`write_bucketed` made."""

    def columns(table: str, name: str, *more: str) -> DataFrame:
        return spark.table(f"{database}.{table}").select(*[f.name for f in BASE_TABLES[name].fields], *more)

    frames = {name: columns(name, name) for name in BASE_TABLES if name != "tiket"}
    packed, hot = (columns(table, "tiket", "show_date") for table in ("tiket", HOT))
    return Tables(spark=spark, tiket=packed.union(hot), packed=packed, hot=hot, **frames)
