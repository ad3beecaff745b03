"""Inputs that are no base table, derived from the given tables for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.retail import read_events
from marquee.sources.tables import Tables


def responses(spark: SparkSession, root: str) -> DataFrame:
    """One raw response per event: fenced, bare, with prose around it, broken, missing, or with wrong values."""
    kind = F.col("event_id") % 6
    title = F.concat(F.lit('"title": " Insight '), "event_type", F.lit(' "'))
    text = F.concat(F.lit('"description": "Text of '), F.col("event_id").cast("string"), F.lit('"'))
    items = F.lit('"action_items": [" first ", "", "second"]')
    good = F.concat_ws(", ", title, text, items, F.lit('"impact_level": "HIGH", "category": "Tickets"'))
    actions = F.lit(
        '"action_items": [], "impact_level": "urgent", "category": "tickets", "recommended_actions": '
        '[{"title": "Act", "description": "Do it", "priority": "soon"}, {"title": "", "description": "none"}]'
    )
    fence = F.lit("```")
    raw = (
        F.when(kind == 0, F.concat(fence, F.lit("json\n{"), good, F.lit("}\n"), fence))
        .when(kind == 1, F.concat(F.lit("Here it is: {"), good, F.lit("} as asked")))
        .when(kind == 2, F.concat(F.lit("{"), F.concat_ws(", ", title, text, actions), F.lit("}")))
        .when(kind == 3, F.concat(F.lit("{"), good))
        .when(kind == 4, F.lit(None))
        .otherwise(F.concat(F.lit("{"), title, F.lit(", "), text, F.lit(', "impact_level": "low", "category": "weather"}')))
    )
    return read_events(spark, root).select(
        F.col("event_id").alias("response_id"),
        raw.alias("raw_text"),
        F.concat(F.lit("Fallback "), "event_type").alias("title"),
        F.lit("Fallback text").alias("description"),
        F.lit("Fallback advice").alias("recommendation"),
        F.array(F.lit("review")).alias("action_items"),
        F.lit("medium").alias("impact_level"),
        F.lit("growth").alias("category"),
    )


def read_log(t: Tables) -> DataFrame:
    """Somebody has read the occupancy alert of every city and the health alert of every venue."""
    read_at = F.lit("2024-02-26 08:00:00").cast("timestamp").alias("read_at")
    cities = t.cinema.select(F.concat(F.lit("city/"), "city", F.lit("/occupancy-level")).alias("notification_id")).distinct()
    cinemas = t.cinema.select(
        F.concat(F.lit("cinema/"), F.col("cinema_id").cast("string"), F.lit("/system-health")).alias("notification_id")
    )
    return cities.unionByName(cinemas).select("notification_id", read_at)


def filter_requests(t: Tables) -> DataFrame:
    """One request per room; some name an unknown venue or room, or places that do not belong together."""
    key = F.col("studio_id")
    cities = t.cinema.select(F.col("cinema_id").alias("_id"), F.col("city").alias("_city"))
    return t.studio.join(cities, F.col("_id") == key % 25, "left").select(
        key.alias("request_id"),
        F.when(key % 4 != 0, F.col("_city")).alias("city"),
        F.when(key % 10 == 0, key + 1000).when(key % 10 != 1, F.col("cinema_id")).alias("cinema_id"),
        F.when(key % 7 == 0, -key - 1).when(key % 7 == 1, F.floor(key / 2)).when(key % 7 != 2, key).alias("studio_id"),
    )
