"""Tickets by the day of their sale, for reports that go by sale time.

Tickets in their own layout lie by the date of the show, and a ticket sold today may be for any show
to come. The ledger is a second copy in folders of the sale's day: a window of sale times opens the
folders of its days, and the newest hour is found in the newest folder, whose name tells it.

A day is that of the sale in UTC, so that the folders mean the same in every session's time zone.
Readers open a day more at either end and compare the times themselves.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.schemas import TIKET
from marquee.session import drop_folder, folder_names, stored
from marquee.sources.tables import FILE_ROWS, Tables

_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def sale_date() -> Column:
    """The day of the sale in UTC; null without a time."""
    return F.expr("date_from_unix_date(cast(floor(unix_seconds(trans_time) / 86400D) as int))")


def days_of(tickets: DataFrame) -> list[date | None]:
    """The sale days of some tickets; a row per day goes through the driver."""
    return [r["day"] for r in tickets.select(sale_date().alias("day")).distinct().collect()]


class SalesLedger:
    """The ledger below ``root``, with one writer at a time.

    A refresh replaces the folders of its days when all their rows have been written. Frames that were
    read before are out of date then; ``tables`` gives new ones.
    """

    def __init__(self, spark: SparkSession, root: str, file_rows: int = FILE_ROWS):
        self.spark, self.root, self.file_rows = spark, root, file_rows

    def _write(self, tickets: DataFrame, mode: str) -> None:
        # Neither a busy day nor the minute in which a sale opens is one task.
        keys = ["sale_date", "trans_time", "schedule_id", "tiket_id"]
        rows = tickets.select(*TIKET.names, sale_date().alias("sale_date"))
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", self.file_rows)
        writer.partitionBy("sale_date").parquet(self.root)

    def build(self, t: Tables) -> None:
        """Write all tickets; the folder must be new."""
        self._write(t.tiket, "errorifexists")

    def append(self, tickets: DataFrame) -> None:
        """Add new tickets in files of their own; other files stay as they are.

        Adding the same tickets again would count them twice: where a run may be repeated, use ``refresh``.
        """
        self._write(tickets, "append")

    def refresh(self, t: Tables, days: Iterable[date | None]) -> None:
        """Write some sale days again, from the tickets as they are now, cancellations left out.

        A day without tickets loses its folder. The same days once more change nothing.
        """
        days = set(days)
        if not days:
            return
        known = sorted(d for d in days if d is not None)
        here = sale_date().isin(known) if known else F.lit(False)
        here = here | F.col("trans_time").isNull() if None in days else here
        rows = stored(t.tiket.filter(here).select(*TIKET.names), "sales")
        self._write(rows, "overwrite")
        for day in days - set(days_of(rows)):
            drop_folder(self.spark, f"{self.root}/sale_date={_NO_DAY if day is None else day}")

    def newest(self) -> date | None:
        """The newest day that has tickets, by the names of the folders alone."""
        days = [name.split("=", 1)[1] for name in folder_names(self.spark, self.root) if name.startswith("sale_date=")]
        return max((date.fromisoformat(d) for d in days if d != _NO_DAY), default=None)

    def tables(self, t: Tables) -> Tables:
        """``t`` with this ledger."""
        schema = T.StructType([*TIKET.fields, T.StructField("sale_date", T.DateType())])
        return replace(t, sales=self.spark.read.schema(schema).parquet(self.root), last_sale=self.newest())
