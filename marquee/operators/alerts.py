"""Four alerts for every scope, their read state and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.expr import fill
from marquee.functions.frames import page, totals
from marquee.operators import kpi, scopes
from marquee.operators.scopes import SCOPE, by_scope
from marquee.plans.facts import all_shows, session_facts
from marquee.plans.filters import Filters
from marquee.sources.tables import Tables


def _overview(t: Tables, f: Filters) -> DataFrame:
    """Per scope: the sales overview of the window, and over all time the venues with shows
    and those of them with tickets. One pass over all shows gives both."""
    rooms = scopes.room_windows(t, f, session_facts(t, Filters()), F.sum("tickets").alias("sold"))
    return scopes.scope_overview(
        t,
        f,
        rooms,
        total_cinemas=F.count_distinct("cinema_id"),
        active_cinemas=F.count_distinct(F.when(F.col("sold") > 0, F.col("cinema_id"))),
    )


def _recent(t: Tables) -> DataFrame:
    rows = by_scope(kpi.last_hour_tickets(t).join(all_shows(t), "schedule_id"))
    return rows.groupBy(*SCOPE).agg(F.sum("tickets").alias("tickets_last_hour"))


def alerts(t: Tables, f: Filters, system_active: bool = True) -> DataFrame:
    """Health, revenue, occupancy and activity of every scope; the global rows are those of the network.

    ``alert_id`` is the plain id for the network and has the scope in front elsewhere.
    """
    rows = _overview(t, f).join(_recent(t), SCOPE, "left").fillna(0, ["tickets_last_hour"])
    revenue, full = F.col("growth_revenue"), F.col("avg_occupancy")
    active, known = F.col("active_cinemas"), F.col("total_cinemas")
    up = F.lit(system_active)
    texts: dict[str, tuple[Column, Column, Column]] = {
        "system-health": (
            F.when(up, C.HEALTH_UP).otherwise(C.HEALTH_DOWN),
            F.when(up, "success").otherwise("critical"),
            F.col("tickets_last_hour"),
        ),
        "revenue-growth": (
            F.when(revenue < 0, C.REVENUE_DOWN).otherwise(C.REVENUE_OK),
            F.when(revenue < -10, "warning").otherwise("info"),
            revenue,
        ),
        "occupancy-level": (
            F.when(full < 25, C.OCCUPANCY_LOW).otherwise(C.OCCUPANCY_OK),
            F.when(full < 20, "warning").otherwise("info"),
            full,
        ),
        "cinema-activity": (
            fill("{a} of {n} cinemas are active.", a=active, n=known),
            F.when(active == known, "success").otherwise("warning"),
            active,
        ),
    }
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("type"),
                F.lit(title).alias("title"),
                texts[name][0].alias("what_happened"),
                texts[name][1].alias("severity"),
                texts[name][2].cast("double").alias("impact_size"),
                F.lit(advice).alias("recommended_action"),
            )
            for name, title, advice in C.ALERTS
        ]
    )
    return (
        rows.select(*SCOPE, F.col("label").alias("where"), F.explode(items).alias("a"))
        .select(*SCOPE, "where", "a.*")
        .withColumn(
            "alert_id",
            F.when(F.col("scope_type") == "global", F.col("type")).otherwise(F.concat_ws("/", *SCOPE, "type")),
        )
    )


def with_read_state(rows: DataFrame, read_log: DataFrame) -> DataFrame:
    """``status`` is read for alerts in the log; an alert that is in it twice stays one row."""
    seen = read_log.groupBy(F.col("notification_id").alias("alert_id")).agg(F.max("read_at").alias("read_at"))
    return rows.join(seen, "alert_id", "left").withColumn(
        "status", F.when(F.col("read_at").isNotNull(), "read").otherwise("unread")
    )


def alerts_filtered(
    rows: DataFrame,
    read_log: DataFrame,
    status: str = "all",
    severity: str | None = None,
    page_number: int | None = None,
    limit: int = 20,
) -> DataFrame:
    out = with_read_state(rows, read_log)
    if status != "all":
        out = out.filter(F.col("status") == status)
    if severity:
        out = out.filter(F.col("severity") == severity)
    return page(out, [F.asc(c) for c in (*SCOPE, "type")], page_number, limit)


def alerts_count(
    rows: DataFrame, read_log: DataFrame, status: str = "all", severity: str | None = None, limit: int = 20
) -> DataFrame:
    """Alerts that the same filters leave, and their pages of ``limit``."""
    return totals(alerts_filtered(rows, read_log, status, severity), limit)


def alert_summary(rows: DataFrame, read_log: DataFrame) -> DataFrame:
    """Alerts by severity and unread, per kind of scope; the global row is the network's."""
    severity = F.col("severity")
    return (
        with_read_state(rows, read_log)
        .groupBy("scope_type")
        .agg(
            *[F.count_if(severity == s).alias(s) for s in ("critical", "warning", "info")],
            F.count_if(F.col("status") == "unread").alias("unread"),
        )
    )
