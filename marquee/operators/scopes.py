"""Figures for every scope at once: the network, each city, each venue, each room.

A show belongs to four scopes. Tickets are summed to shows and shows to rooms before anything
is multiplied by four, and the sums per scope are combined inside the tasks, so the scope that
holds everything costs no more than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.expr import growth, money, rounded_ratio
from marquee.functions.frames import top_per
from marquee.operators import orders, rules, sales
from marquee.operators.kpi import PARTS, window_parts, with_occupancy
from marquee.plans.facts import session_facts, shows, venues
from marquee.plans.filters import Filters
from marquee.session import stored
from marquee.sources.tables import Tables

SCOPE = ["scope_type", "scope_value"]


SCOPE_TYPES = ("global", "city", "cinema", "studio")


def by_scope(frame: DataFrame, types: tuple[str, ...] = SCOPE_TYPES, label: bool = False) -> DataFrame:
    """Each row once per scope it belongs to; ``frame`` has city, cinema_id and studio_id.

    ``label`` adds the name of the scope, from the names in the row.
    """
    values = {
        "global": F.lit(""),
        "city": F.col("city"),
        "cinema": F.col("cinema_id").cast("string"),
        "studio": F.col("studio_id").cast("string"),
    }
    names = {
        "global": F.lit("Global"),
        "city": F.col("city"),
        "cinema": F.coalesce("cinema_name", values["cinema"]) if label else None,
        "studio": F.coalesce("studio_name", values["studio"]) if label else None,
    }
    fields = [*SCOPE, "label"] if label else SCOPE
    scopes = F.array(
        *[
            F.struct(
                F.lit(kind).alias("scope_type"),
                values[kind].alias("scope_value"),
                *([names[kind].alias("label")] if label else []),
            )
            for kind in types
        ]
    )
    named = F.col("scope_value").isNotNull() & ((F.col("scope_type") != "city") | (F.col("scope_value") != ""))
    return (
        frame.withColumn("_scope", F.explode(scopes))
        .select("*", *[f"_scope.{name}" for name in fields])
        .drop("_scope")
        .filter(named)
    )


def scope_list(t: Tables) -> DataFrame:
    """All scopes with their label and the venue and room they stand for."""
    none = F.lit(None).cast("string")

    def text(name: str):
        return F.col(name).cast("string").alias(name)

    columns = ["scope_type", "scope_value", "label", "city", "cinema_id", "cinema_name", "studio_id", "studio_name"]
    everything = t.spark.range(1).select(
        F.lit("global").alias("scope_type"),
        F.lit("").alias("scope_value"),
        F.lit("Global").alias("label"),
        *[none.alias(c) for c in columns[3:]],
    )
    cities = (
        t.cinema.filter(F.col("city").isNotNull() & (F.col("city") != ""))
        .select("city")
        .distinct()
        .select(
            F.lit("city").alias("scope_type"),
            F.col("city").alias("scope_value"),
            F.col("city").alias("label"),
            "city",
            *[none.alias(c) for c in columns[4:]],
        )
    )
    cinemas = t.cinema.select(
        F.lit("cinema").alias("scope_type"),
        F.col("cinema_id").cast("string").alias("scope_value"),
        F.coalesce("cinema_name", F.col("cinema_id").cast("string")).alias("label"),
        "city",
        text("cinema_id"),
        "cinema_name",
        none.alias("studio_id"),
        none.alias("studio_name"),
    )
    studios = venues(t).select(
        F.lit("studio").alias("scope_type"),
        F.col("studio_id").cast("string").alias("scope_value"),
        F.coalesce("studio_name", F.col("studio_id").cast("string")).alias("label"),
        "city",
        text("cinema_id"),
        "cinema_name",
        text("studio_id"),
        "studio_name",
    )
    return everything.unionByName(cities).unionByName(cinemas).unionByName(studios)


def scope_expand(t: Tables, f: Filters) -> DataFrame:
    """Shows of the window, once per scope, with the label of the scope.

    The labels come from the row: a join by scope would bring all shows of the network together.
    """
    return by_scope(shows(t, f), label=True).select("schedule_id", *SCOPE, "label")


ROOM = ["studio_id", "cinema_id", "city"]


def room_windows(t: Tables, f: Filters, facts: DataFrame, *more: Column) -> DataFrame:
    """Sums of both windows per room, and the further aggregates ``more``."""
    return facts.groupBy(*ROOM).agg(*window_parts(f), *more)


def scope_metrics(t: Tables, f: Filters) -> DataFrame:
    """Sales overview of every scope; a scope without shows has zeros."""
    return scope_overview(t, f, room_windows(t, f, session_facts(t, f.with_previous())))


def scope_overview(t: Tables, f: Filters, rooms: DataFrame, **more: Column) -> DataFrame:
    """The overview from sums per room, with the further aggregates ``more`` over the rooms."""
    sums = by_scope(rooms).groupBy(*SCOPE).agg(
        *[F.sum(name).alias(name) for name in PARTS], *[column.alias(name) for name, column in more.items()]
    )
    rows = scope_list(t).join(sums, SCOPE, "left")
    for name in [*PARTS, *more]:
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast(sums.schema[name].dataType)))
    rows = with_occupancy(rows)
    return rows.select(
        *SCOPE,
        "label",
        F.lit(f.start).alias("period_start"),
        F.lit(f.end).alias("period_end"),
        F.col("tickets").alias("total_tickets"),
        money("revenue").alias("total_revenue"),
        rounded_ratio("revenue", "tickets").alias("avg_ticket_price"),
        rounded_ratio("revenue", "capacity").alias("revenue_per_seat"),
        F.col("occupancy").alias("avg_occupancy"),
        growth("tickets", "previous_tickets").alias("growth_tickets"),
        growth("revenue", "previous_revenue").alias("growth_revenue"),
        growth("occupancy", "previous_occupancy").alias("growth_occupancy"),
        *more,
    )


def _room_sums(t: Tables, f: Filters, *keys: str) -> DataFrame:
    """Shows of the window summed per room and ``keys``, under the names the shows have."""
    return (
        session_facts(t, f)
        .groupBy(*ROOM, *keys)
        .agg(
            F.count(F.lit(1)).alias("shows"),
            *[F.sum(name).alias(name) for name in ("tickets", "revenue", "total_capacity")],
        )
    )


def scope_time_slots(t: Tables, f: Filters) -> DataFrame:
    return sales.slot_scores(by_scope(_room_sums(t, f, "time_slot")), *SCOPE)


def scope_peak_quiet(t: Tables, f: Filters) -> DataFrame:
    return sales.peak_and_quiet(scope_time_slots(t, f), *SCOPE)


def scope_pricing(t: Tables, f: Filters, top_n: int = 5, slots: DataFrame | None = None) -> DataFrame:
    """The first price actions of every scope; ``slots`` is :func:`scope_time_slots` where it is known."""
    slots = slots or scope_time_slots(t, f)
    return top_per(rules.price_actions(slots, *SCOPE), SCOPE, orders.prices(), top_n)


def scope_pricing_summary(t: Tables, f: Filters, slots: DataFrame | None = None) -> DataFrame:
    """Per scope: start hours looked at, changes proposed, the best and the weakest hour.

    ``slots`` is :func:`scope_time_slots` where it is known.
    """
    slots = slots or scope_time_slots(t, f)
    changes = (
        rules.price_actions(slots, *SCOPE)
        .groupBy(*SCOPE)
        .agg(F.count_if(F.col("suggested_action") != C.PRICE_HOLD).alias("recommended_changes"))
    )
    counted = slots.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("total_slots_analyzed"))
    return (
        counted.join(changes, SCOPE, "left")
        .fillna(0, ["recommended_changes"])
        .join(sales.peak_and_quiet(slots, *SCOPE), SCOPE)
        .select(
            *SCOPE,
            "total_slots_analyzed",
            "recommended_changes",
            "peak_time_slot",
            "peak_revenue",
            "quiet_time_slot",
            "quiet_revenue",
        )
    )


SALTS = 64


def scope_ad_slots(t: Tables, f: Filters, top_n: int = 3) -> DataFrame:
    """The first advertising slots of every scope.

    The sums are written once, since the extremes of a scope are an aggregate of them that is joined
    back. Rooms are many and small and are joined by scope. The others are few, so that their
    extremes are sent to the tasks and their titles stay where they are; should they be too many for
    that, the titles of one scope may be many as well, so the join key has a salt: the extremes are
    repeated once per salt, and the titles of a scope spread over as many tasks.
    """
    sums = rules.ad_sums(by_scope(_room_sums(t, f, "movie_id", "time_slot")), *SCOPE, shows=F.sum("shows"))
    titled = stored(sums.join(t.movies.select("movie_id", "title", "genre"), "movie_id"), "titles")
    rooms, others = titled.filter("scope_type = 'studio'"), titled.filter("scope_type <> 'studio'")
    in_rooms = rooms.join(rules.ad_span(rooms, *SCOPE), SCOPE)
    salted = others.withColumn("_salt", F.pmod(F.xxhash64("movie_id", "time_slot"), F.lit(SALTS)))
    span = stored(rules.ad_span(others, *SCOPE), "spans").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    spanned = in_rooms.unionByName(salted.join(span, [*SCOPE, "_salt"]).drop("_salt"))
    scored = rules.ad_scores(spanned, *SCOPE, "total_candidates")
    return top_per(scored, SCOPE, orders.ad_slots(), top_n)
