"""A stored rollup of shows by date that follows late tickets and cancellations.

A row per show, in a folder per show date. When tickets come or go, only the dates of their shows
are summed again, from the folders of these dates, and only their folders are replaced. Reports that
start from the rollup read no ticket.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.plans.facts import ROLLUP_COLUMNS, rolled_up
from marquee.plans.filters import Filters
from marquee.session import drop_folder, stored
from marquee.sources.tables import Tables

_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


class DailyRollup:
    """The rollup below ``root``, with one writer at a time.

    A refresh replaces the folders of its dates when all its rows have been written. Frames that were
    read before are out of date then; ``tables`` gives new ones.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A date with many shows is several tasks and files.
        rows = rows.repartitionByRange("show_date", "schedule_id").sortWithinPartitions("show_date", "schedule_id")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("show_date").parquet(self.root)

    def build(self, t: Tables) -> None:
        """Sum all shows; the folder must be new."""
        self._write(rolled_up(t, Filters()).select(*ROLLUP_COLUMNS), "errorifexists")

    def refresh(self, t: Tables, dates: Iterable[date | None]) -> None:
        """Sum the shows of some dates again, from ``t`` as it is now.

        A show that has moved needs both of its dates. A date that has no show left loses its folder.
        """
        dates = set(dates)
        if not dates:
            return
        here = _on(dates)
        dated = {name: x.filter(here) for name in ("tiket", "packed", "hot") if (x := getattr(t, name)) is not None and "show_date" in x.columns}
        part = replace(t, schedules=t.schedules.filter(here), rollup=None, rollup_days=None, **dated)
        rows = stored(rolled_up(part, Filters()).select(*ROLLUP_COLUMNS), "refresh")
        self._write(rows, "overwrite")
        left = {r["show_date"] for r in rows.select("show_date").distinct().collect()}
        for day in dates - left:
            drop_folder(self.spark, f"{self.root}/show_date={_NO_DATE if day is None else day}")

    def tables(self, t: Tables) -> Tables:
        """``t`` with this rollup, which covers every window."""
        schema = rolled_up(replace(t, rollup=None), Filters()).select(*ROLLUP_COLUMNS).schema
        return replace(t, rollup=self.spark.read.schema(schema).parquet(self.root), rollup_days=(None, None))


def _on(dates: set[date | None]) -> Column:
    days = sorted(d for d in dates if d is not None)
    here = F.col("show_date").isin(days) if days else F.lit(False)
    return here | F.col("show_date").isNull() if None in dates else here


def dates_of(t: Tables, tickets: DataFrame) -> list[date | None]:
    """The show dates of some tickets, for instance of those that have come or gone since the last
    refresh; a row per day goes through the driver."""
    shows = tickets.select("schedule_id").distinct().join(t.schedules.select("schedule_id", "show_date"), "schedule_id")
    return [r["show_date"] for r in shows.select("show_date").distinct().collect()]
