"""Action candidates of every scope: larger room, fewer shows, promotion, premium price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.expr import fill, money, number_text, percent, round2, start_seconds
from marquee.functions.frames import top_per
from marquee.operators import sales, scopes
from marquee.operators.scopes import SCOPE, by_scope
from marquee.plans.facts import rolled, session_facts, venues
from marquee.plans.filters import Filters
from marquee.session import stored
from marquee.sources.tables import Tables

ACTION_COLUMNS = [
    *SCOPE,
    "action_type",
    "priority",
    "title",
    "description",
    "reason",
    "expected_impact",
    "city",
    "cinema_name",
    "studio_name",
    "movie_title",
    "schedule_time",
    "occupancy",
    "score",
    "schedule_id",
    "_order",
]


def _show_rows(t: Tables, f: Filters) -> DataFrame:
    """Shows with title, rounded figures and the sort keys "latest date, latest hour, id"."""
    return (
        session_facts(t, f)
        .join(t.movies.select("movie_id", F.col("title").alias("movie_title")), "movie_id")
        .select(
            "schedule_id",
            "studio_id",
            F.coalesce("studio_name", F.col("studio_id").cast("string")).alias("studio_name"),
            "cinema_id",
            F.coalesce("cinema_name", F.col("cinema_id").cast("string")).alias("cinema_name"),
            "city",
            "movie_title",
            F.col("start_time").cast("string").alias("start_time"),
            F.substring("start_time", 1, 5).alias("schedule_time"),
            F.coalesce("total_capacity", F.lit(0)).alias("total_capacity"),
            "tickets",
            money("revenue").alias("revenue"),
            percent("tickets", "total_capacity").alias("occupancy"),
            (-F.unix_date("show_date")).alias("_date"),
            (-start_seconds()).alias("_time"),
        )
    )


# Pricing takes part in the actions with its first five slots.
PRICED = 5
KINDS = [name for name, *_ in C.ACTION_BADGES]
LATEST = ["_date", "_time", "schedule_id"]


def _priority(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 60, "medium").otherwise("low")


def _candidates(rows: DataFrame, kind: str, score: Column, hour: str, studio_name: str, place: Column) -> DataFrame:
    """Attach the texts of an action to shows; ``place`` is the position in the list of its type."""
    text = C.ACTION_TEXT[kind]
    fields = {
        "t": F.col("movie_title"),
        "h": F.col(hour),
        "v": F.col("cinema_name"),
        "r": F.col("studio_name"),
        "n": F.col(studio_name),
        "o": number_text("occupancy"),
        "k": F.col("tickets"),
    }
    return rows.withColumn("score", score).select(
        *SCOPE,
        F.lit(kind).alias("action_type"),
        _priority(F.col("score")).alias("priority"),
        *[fill(text[part], **fields).alias(part) for part in ("title", "description", "reason")],
        F.lit(C.EXPECTED_IMPACT[kind]).alias("expected_impact"),
        "city",
        "cinema_name",
        F.col(studio_name).alias("studio_name"),
        "movie_title",
        "schedule_time",
        "occupancy",
        "score",
        "schedule_id",
        F.struct(F.lit(KINDS.index(kind)).alias("kind"), place.cast("int").alias("place"), *LATEST).alias("_order"),
    )


def larger_rooms(t: Tables, f: Filters, most_occupancy: float = 60) -> DataFrame:
    """For every venue and capacity: the best room with **more** seats that is not too full.

    Best is the lowest occupancy, then the most seats. The answer depends on venue and
    capacity alone, so rooms are not paired with shows: the best room of each capacity is an
    aggregate, and a running minimum over the capacities of a venue gives the best of all
    larger ones. A venue has few capacities, however many rooms and shows it has.
    """
    stats = sales.studio_sales(t, f.scoped(movie_id=None)).select("studio_id", F.col("occupancy").alias("fill"))
    rooms = venues(t).join(stats, "studio_id", "left").withColumn("fill", F.coalesce("fill", F.lit(0.0)))
    best = F.when(
        F.col("fill") <= most_occupancy,
        F.struct("fill", (-F.col("total_capacity")).alias("less"), "studio_name", "studio_id"),
    )
    larger = Window.partitionBy("cinema_id").orderBy(F.desc("total_capacity")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rooms.groupBy("cinema_id", "total_capacity")
        .agg(F.min(best).alias("best"))
        .select("cinema_id", "total_capacity", F.min("best").over(larger).alias("target"))
        .filter(F.col("target").isNotNull())
        .select(
            "cinema_id",
            "total_capacity",
            F.col("target.studio_name").alias("target_name"),
            (-F.col("target.less")).alias("target_capacity"),
        )
    )


def move_to_larger_studio(t: Tables, f: Filters, least_occupancy: float = 82) -> DataFrame:
    """Full shows with a larger, less used room in the same venue.

    The scope of a single room holds no other room and has no such candidates.
    """
    full = _show_rows(t, f).filter((F.col("occupancy") >= least_occupancy) & (F.col("total_capacity") > 0))
    matched = full.join(larger_rooms(t, f), ["cinema_id", "total_capacity"])
    score = F.col("occupancy") + F.greatest(F.lit(0), F.col("target_capacity") - F.col("total_capacity"))
    scoped = by_scope(matched, ("global", "city", "cinema"))
    return _candidates(scoped, C.MOVE, score, "start_time", "target_name", F.lit(0))


def _first(rows: DataFrame, order: list[Column], n: int, *more: str) -> DataFrame:
    return top_per(rows, [*SCOPE, *more], [*order, *[F.asc(c) for c in LATEST]], n, "_place")


def reduce_showtimes(t: Tables, f: Filters) -> DataFrame:
    """The four weakest shows of each scope with little occupancy and few tickets."""
    weak = by_scope(_show_rows(t, f).filter((F.col("occupancy") <= 22) & (F.col("tickets") <= 25)))
    score = (F.lit(100) - F.col("occupancy")) + F.greatest(F.lit(0), F.lit(30) - F.col("tickets"))
    rows = _first(weak, [F.asc("occupancy"), F.asc("revenue")], 4)
    return _candidates(rows, C.REDUCE, score, "schedule_time", "studio_name", F.col("_place"))


def _first_in_slots(rows: DataFrame, pricing: DataFrame, action: str, order: Column, n: int) -> DataFrame:
    """The first ``n`` shows of each scope that start in a slot which ``pricing`` gives ``action``.

    The first shows of every slot are taken before
    slots are compared, so that only ``n`` shows per scope and slot take part in the join.
    """
    slots = pricing.filter(F.col("suggested_action") == action)
    slots = slots.select(*SCOPE, F.col("time_slot").alias("schedule_time"))
    leading = _first(by_scope(rows), [order], n, "schedule_time").drop("_place")
    return _first(leading.join(slots, [*SCOPE, "schedule_time"], "left_semi"), [order], n)


def promotion_opportunity(t: Tables, f: Filters, pricing: DataFrame | None = None) -> DataFrame:
    """The four emptiest shows of each scope in discount slots, of those worth a promotion."""
    t = rolled(t, f)
    rows = _show_rows(t, f).filter((F.col("occupancy") > 20) & (F.col("occupancy") <= 45))
    rows = _first_in_slots(rows, pricing or scopes.scope_pricing(t, f, PRICED), C.PRICE_DOWN, F.asc("occupancy"), 4)
    return _candidates(rows, C.PROMO, F.lit(75) - F.col("occupancy"), "schedule_time", "studio_name", F.col("_place"))


def premium_pricing(t: Tables, f: Filters, pricing: DataFrame | None = None) -> DataFrame:
    """The three fullest shows of each scope in slots whose price should rise."""
    t = rolled(t, f)
    rows = _show_rows(t, f).filter(F.col("occupancy") >= 78)
    rows = _first_in_slots(rows, pricing or scopes.scope_pricing(t, f, PRICED), C.PRICE_UP, F.desc("occupancy"), 3)
    return _candidates(rows, C.PREMIUM, F.col("occupancy") + 12, "schedule_time", "studio_name", F.col("_place"))


def badge(part: int) -> Column:
    """Colour (0) or icon (1) of an action type."""
    chosen = F
    for name, *looks in C.ACTION_BADGES:
        chosen = chosen.when(F.col("action_type") == name, looks[part])
    return chosen.otherwise(C.DEFAULT_BADGE[part])


def candidate_actions(t: Tables, f: Filters, top_n: int = 6, pricing: DataFrame | None = None) -> DataFrame:
    """The best actions of every scope; ``pricing`` is :func:`scopes.scope_pricing` where it is known.

    Equal actions (type, place, title, hour) count once with their highest score, in the
    place of the first of them. All four lists start from one rollup of the shows.
    """
    t = rolled(t, f)
    pricing = pricing or stored(scopes.scope_pricing(t, f, PRICED), "pricing")
    everything = (
        move_to_larger_studio(t, f)
        .unionByName(reduce_showtimes(t, f))
        .unionByName(promotion_opportunity(t, f, pricing))
        .unionByName(premium_pricing(t, f, pricing))
    )
    key = [*SCOPE, "action_type", "city", "cinema_name", "studio_name", "movie_title", "schedule_time"]
    rest = [c for c in ACTION_COLUMNS if c not in key and c != "_order"]
    unique = everything.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col("score"), F.col("_order"))).alias("item"),
        F.min("_order").alias("_order"),
    )
    best = top_per(
        unique.select(*key, "item.*", "_order"), SCOPE, [F.desc("score"), F.asc("_order")], top_n
    )
    return best.join(scopes.scope_list(t).select(*SCOPE, F.col("label").alias("scope_label")), SCOPE).select(
        *SCOPE,
        "scope_label",
        "position",
        "action_type",
        "priority",
        "title",
        "description",
        "reason",
        "expected_impact",
        "city",
        "cinema_name",
        "studio_name",
        "movie_title",
        "schedule_time",
        "occupancy",
        round2("score").alias("score"),
        badge(0).alias("color"),
        badge(1).alias("icon"),
    )


def public(candidates: DataFrame) -> DataFrame:
    """Candidates of one type as a table, without the sort key."""
    return candidates.drop("_order")


def scope_insight(metrics: DataFrame, candidates: DataFrame) -> DataFrame:
    """Title, text, impact and category of every scope, from its first action or its figures.

    ``metrics`` is :func:`scopes.scope_metrics`, ``candidates`` is :func:`candidate_actions`.
    """
    fields = ["position", "action_type", "priority", "title", "description", "reason", "expected_impact", "city",
              "cinema_name", "studio_name", "movie_title", "schedule_time", "occupancy", "color", "icon"]
    # At most three actions per scope reach the list.
    first = (
        candidates.filter(F.col("position") <= 3)
        .groupBy(*SCOPE)
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("recommended_actions"))
    )
    rows = metrics.join(first, SCOPE, "left").withColumn("top", F.get("recommended_actions", F.lit(0)))
    has_action = F.col("top").isNotNull()
    empty = F.col("avg_occupancy") < 35
    falling = (F.col("growth_revenue") < 0) | (F.col("growth_tickets") < 0)
    values = {
        "s": F.col("label"),
        "o": number_text("avg_occupancy"),
        "k": number_text("growth_tickets"),
        "r": number_text("growth_revenue"),
    }

    def rule(of) -> Column:
        texts = C.INSIGHT_TEXT
        return F.when(empty, of(texts["occupancy"])).when(falling, of(texts["growth"])).otherwise(of(texts["revenue"]))

    def text(part: str) -> Column:
        return rule(lambda texts: fill(texts[part], **values))

    theme = F.when(empty, "occupancy").when(falling, "growth").otherwise("revenue")
    for name, category in C.ACTION_THEME.items():
        theme = F.when(F.col("top.action_type") == name, category).otherwise(theme)
    items = rule(lambda texts: F.array(*[F.lit(x) for x in texts["action_items"]]))
    return rows.select(
        *metrics.columns,
        F.when(has_action, fill(C.INSIGHT_ACTION_TITLE, **values)).otherwise(text("title")).alias("title"),
        F.when(has_action, F.col("top.description")).otherwise(text("description")).alias("description"),
        F.when(has_action, F.col("top.reason")).otherwise(text("recommendation")).alias("recommendation"),
        F.when(has_action, F.transform("recommended_actions", lambda a: a["title"])).otherwise(items).alias("action_items"),
        F.when(has_action, F.col("top.priority")).otherwise(rule(lambda x: F.lit(x["impact_level"]))).alias("impact_level"),
        theme.alias("category"),
        F.coalesce("recommended_actions", F.array().cast(rows.schema["recommended_actions"].dataType)).alias(
            "recommended_actions"
        ),
    )
