"""The five base tables, from Parquet in their own layout or from a JDBC database."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marquee.schemas import BASE_TABLES


@dataclass(frozen=True)
class Tables:
    """Handles on the star schema. All are lazy; operators read only the columns they name."""

    spark: SparkSession
    tiket: DataFrame
    schedules: DataFrame
    movies: DataFrame
    studio: DataFrame
    cinema: DataFrame
    # Tickets in buckets of their show, and those of shows that are too large for one, where the
    # tables are stored that way (see sources.buckets).
    packed: DataFrame | None = None
    hot: DataFrame | None = None
    # Rolled-up shows of a window, where they have been stored (see plans.facts.with_rollup).
    rollup: DataFrame | None = None
    rollup_days: tuple[date, date] | None = None
    # Tickets by the day of their sale and the newest such day, where they are stored that way (see
    # sources.ledger).
    sales: DataFrame | None = None
    last_sale: date | None = None

    def register_views(self) -> None:
        """Make the tables available to ``spark.sql``."""
        for name in BASE_TABLES:
            getattr(self, name).createOrReplaceTempView(name)


def read_parquet(spark: SparkSession, root: str) -> Tables:
    """Read ``<root>/<table>`` with the declared schemas.

    Dates are stored as DATE, so a date window reaches the scan; tables that are partitioned by
    ``show_date`` are pruned by directory. Tickets have the date of their show where the folder is
    partitioned by it, which a look at the folder's names tells.
    """
    frames = {
        name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in BASE_TABLES.items()
    }
    if "show_date" in spark.read.parquet(f"{root}/tiket").columns:
        dated = T.StructType([*BASE_TABLES["tiket"].fields, T.StructField("show_date", T.DateType())])
        frames["tiket"] = spark.read.schema(dated).parquet(f"{root}/tiket")
    return Tables(spark=spark, **frames)


# Rows of a file, at most, in the stored layout.
FILE_ROWS = 5_000_000


def write_parquet(tables: Tables, root: str, file_rows: int = FILE_ROWS) -> None:
    """Store the tables in their own layout.

    Shows and tickets are partitioned by the date of the show, so that a window of dates opens the
    folders of its days only. Within a date, rows are in order of show and sale time: one task adds
    up most of a show's tickets, and file statistics tell which shows and times a file has. Rows
    are range-partitioned by date, show, time and ticket, so that neither a busy date, a show with
    a third of all tickets nor the minute in which a sale opens is one task; a file has a bounded
    number of rows whatever the size of the date.
    """
    for name in BASE_TABLES:
        frame = getattr(tables, name)
        if name == "schedules":
            keys = ["show_date", "schedule_id"]
            frame = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
        if name == "tiket":
            dates = tables.schedules.select("schedule_id", "show_date")
            plain = frame.drop("show_date")
            frame = plain.join(dates, "schedule_id", "left").select(*plain.columns, "show_date")
            keys = ["show_date", "schedule_id", "trans_time", "tiket_id"]
            frame = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
        writer = frame.write.mode("errorifexists").option("maxRecordsPerFile", file_rows)
        if name in ("schedules", "tiket"):
            writer = writer.partitionBy("show_date")
        writer.parquet(f"{root}/{name}")


def read_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], slices: dict[str, list[str]] | None = None
) -> Tables:
    """Read the tables from a database, with columns in the declared types.

    ``slices`` has, by table, conditions that part its rows, such as ranges of dates; each is read
    over a connection of its own. A table without an entry is read over one connection.
    """
    frames = {}
    for name, schema in BASE_TABLES.items():
        parts = (slices or {}).get(name)
        rows = spark.read.jdbc(url=url, table=name, properties=properties, **({"predicates": parts} if parts else {}))
        frames[name] = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    return Tables(spark=spark, **frames)


def date_slices(column: str, first: date, last: date, days: int = 7) -> list[str]:
    """Conditions for :func:`read_jdbc`: spans of days, what lies outside them, and rows without a date."""
    edges = [first + timedelta(days=i) for i in range(0, (last - first).days + 1, days)]
    spans = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(edges, edges[1:])]
    ends = [f"{column} < '{edges[0]}' OR {column} IS NULL", f"{column} >= '{edges[-1]}'"]
    return [*ends, *spans]
