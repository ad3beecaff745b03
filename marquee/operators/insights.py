"""Stored insights of every scope: building, reading, and cleaning of raw responses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.expr import round2
from marquee.functions.frames import first_per, page, totals
from marquee.operators import actions, scopes
from marquee.operators.scopes import SCOPE
from marquee.plans.facts import rolled
from marquee.plans.filters import Filters
from marquee.schemas import INSIGHT, INSIGHT_PAYLOAD
from marquee.session import stored
from marquee.sources.tables import Tables

SUMMARY = ["total_tickets", "total_revenue", "avg_ticket_price", "revenue_per_seat", "avg_occupancy"]


def _listed(frame: DataFrame, fields: list[str], name: str) -> DataFrame:
    """Rows of a scope as an array in order of position; a scope has at most three."""
    return frame.groupBy(*SCOPE).agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias(name))


def insight_records(t: Tables, as_of: date | str, run_at: datetime) -> DataFrame:
    """The insight of every scope over the 14 days up to ``as_of``, as rows to store.

    All scopes come from one rollup of the shows of this period and the one before it. The
    source is the rules; ``run_at`` is the time of the run.
    """
    f = Filters.rolling(as_of)
    t = rolled(t, f.with_previous())
    hours = stored(scopes.scope_time_slots(t, f), "hours")
    pricing = stored(scopes.scope_pricing(t, f, actions.PRICED, slots=hours), "pricing")
    best = stored(actions.candidate_actions(t, f, pricing=pricing), "actions")
    insight = actions.scope_insight(scopes.scope_metrics(t, f), best)
    slots = scopes.scope_pricing_summary(t, f, slots=hours)
    first_ads = stored(scopes.scope_ad_slots(t, f), "ads")
    candidates = first_ads.filter("position = 1").select(
        *SCOPE, "total_candidates", F.lit(C.AD_FORMULA).alias("scoring_formula")
    )
    ads = _listed(
        first_ads,
        ["title", "genre", "time_slot", "total_shows", "audience_size", "total_revenue", "revenue_per_show",
         "occupancy", "ad_score"],
        "top_slots",
    )
    prices = _listed(
        pricing.filter("position <= 3"),
        ["time_slot", "demand", "revenue", "occupancy", "optimization_score", "suggested_action",
         "suggested_price_change_pct", "reason", "confidence"],
        "recommendations",
    )
    meta = scopes.scope_list(t).select(
        *SCOPE,
        F.to_json(F.struct("label", "city", "cinema_id", "cinema_name", "studio_id", "studio_name")).alias("scope_meta"),
    )
    rows = insight.join(meta, SCOPE)
    for part in (ads, candidates, prices, slots):
        rows = rows.join(part, SCOPE, "left")
    ad_summary = F.struct(F.coalesce("total_candidates", F.lit(0)).alias("total_candidates"), "scoring_formula")
    slot_summary = F.struct(
        F.coalesce("total_slots_analyzed", F.lit(0)).alias("total_slots_analyzed"),
        F.coalesce("recommended_changes", F.lit(0)).alias("recommended_changes"),
        F.struct(F.col("peak_time_slot").alias("time_slot"), F.col("peak_revenue").alias("revenue")).alias("peak_sales_hour"),
        F.struct(F.col("quiet_time_slot").alias("time_slot"), F.col("quiet_revenue").alias("revenue")).alias("quiet_hour"),
    )
    growth = F.struct(*[F.col(f"growth_{c}").alias(c) for c in ("tickets", "revenue", "occupancy")]).alias("growth")
    text = F.struct(
        "title", "description", "recommendation", "action_items", "impact_level", "category", "recommended_actions"
    )
    source, model = F.lit("fallback"), F.lit("fallback-local")
    moment = F.lit(run_at).cast("timestamp")
    return rows.select(
        *SCOPE,
        "scope_meta",
        "period_start",
        "period_end",
        F.to_json(F.struct("period_start", "period_end", *SUMMARY, growth)).alias("summary_snapshot"),
        F.to_json(F.struct(ad_summary.alias("summary"), "top_slots")).alias("ad_score_snapshot"),
        F.to_json(F.struct(slot_summary.alias("summary"), "recommendations")).alias("pricing_snapshot"),
        F.to_json(F.struct(source.alias("source"), model.alias("model"), text.alias("insight"))).alias("ai_payload"),
        "title",
        "description",
        "recommendation",
        F.to_json("action_items").alias("action_items"),
        "impact_level",
        "category",
        source.alias("ai_source"),
        model.alias("ai_model"),
        moment.alias("created_at"),
        moment.alias("updated_at"),
    ).select(*INSIGHT.fieldNames())


def insight_runs(t: Tables, runs: Iterable[tuple[date | str, datetime]]) -> Iterator[DataFrame]:
    """The records of several runs over the same tables, each ``as_of, run_at``.

    The shows of all their windows are rolled up together, so that tickets are summed once.
    """
    runs = list(runs)
    windows = [Filters.rolling(as_of).with_previous() for as_of, _ in runs]
    if windows:
        t = rolled(t, Filters(start=min(w.start for w in windows), end=max(w.end for w in windows)))
    for as_of, run_at in runs:
        yield insight_records(t, as_of, run_at)


def newest_first() -> list[Column]:
    return [
        F.desc_nulls_last("period_end"),
        F.desc_nulls_last("updated_at"),
        F.asc("scope_type"),
        F.asc("scope_value"),
        F.desc_nulls_last("period_start"),
    ]


def insight_history(
    stored: DataFrame,
    scope_type: str | None = None,
    scope_value: str | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    page_number: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Stored insights of a scope whose period lies inside the dates; a missing part means all."""
    condition = F.lit(True)
    if scope_type is not None:
        condition = condition & (F.col("scope_type") == scope_type)
    if scope_value is not None:
        condition = condition & (F.col("scope_value") == scope_value)
    if start is not None:
        condition = condition & (F.col("period_start") >= F.lit(start).cast("date"))
    if end is not None:
        condition = condition & (F.col("period_end") <= F.lit(end).cast("date"))
    return page(stored.filter(condition), newest_first(), page_number, limit)


def insight_history_count(
    stored: DataFrame,
    scope_type: str | None = None,
    scope_value: str | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Rows and pages of the same history."""
    return totals(insight_history(stored, scope_type, scope_value, start, end), limit)


def insight_latest_page(
    stored: DataFrame, scope_type: str | None = None, page_number: int | None = None, limit: int = 20
) -> DataFrame:
    """The newest insight of every scope, the latest updated first."""
    order = [F.desc_nulls_last("updated_at"), F.asc("scope_type"), F.asc("scope_value")]
    return page(insight_latest(stored, scope_type), order, page_number, limit)


def insight_latest(stored: DataFrame, scope_type: str | None = None) -> DataFrame:
    """The newest stored insight of every scope."""
    rows = stored if scope_type is None else stored.filter(F.col("scope_type") == scope_type)
    rest = [c for c in INSIGHT.fieldNames() if c not in SCOPE]
    order = [-F.unix_date("period_end"), -F.unix_micros("updated_at"), -F.unix_date("period_start")]
    return first_per(rows, SCOPE, order, rest, "row").select(*SCOPE, "row.*").select(*INSIGHT.fieldNames())


def insight_latest_counts(stored: DataFrame) -> DataFrame:
    kind = F.col("scope_type")
    return insight_latest(stored).agg(
        F.count(F.lit(1)).alias("total_items"),
        *[F.count_if(kind == k).alias(f"{k}_count") for k in ("global", "city", "cinema", "studio")],
    )


def decoded(stored: DataFrame) -> DataFrame:
    """Stored insights as flat columns: parts of the JSON columns beside the plain ones."""

    def number(column: str, path: str) -> Column:
        return F.get_json_object(column, path).cast("double")

    return stored.select(
        *SCOPE,
        F.get_json_object("scope_meta", "$.label").alias("label"),
        "period_start",
        "period_end",
        F.get_json_object("summary_snapshot", "$.total_tickets").cast("long").alias("total_tickets"),
        number("summary_snapshot", "$.total_revenue").alias("total_revenue"),
        number("summary_snapshot", "$.avg_occupancy").alias("avg_occupancy"),
        number("summary_snapshot", "$.growth.revenue").alias("growth_revenue"),
        F.get_json_object("ad_score_snapshot", "$.top_slots[0].title").alias("top_ad_title"),
        number("ad_score_snapshot", "$.top_slots[0].ad_score").alias("top_ad_score"),
        F.get_json_object("ad_score_snapshot", "$.summary.total_candidates").cast("long").alias("ad_candidates"),
        F.get_json_object("pricing_snapshot", "$.summary.recommended_changes").cast("long").alias("recommended_changes"),
        F.get_json_object("pricing_snapshot", "$.summary.peak_sales_hour.time_slot").alias("peak_time_slot"),
        F.get_json_object("pricing_snapshot", "$.recommendations[0].suggested_action").alias("top_price_action"),
        "title",
        "description",
        "recommendation",
        F.array_join(F.from_json("action_items", "array<string>"), "|").alias("action_items"),
        "impact_level",
        "category",
        "ai_source",
        "ai_model",
        "created_at",
        "updated_at",
    )


# ---------------------------------------------------------------- raw responses


def _json_text(raw: str) -> Column:
    """The JSON object inside a raw text: code fences go, then first to last brace."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    text = F.regexp_replace(text, r"(?i)^```json\s*", "")
    text = F.regexp_replace(text, r"^```\s*", "")
    text = F.trim(F.regexp_replace(text, r"\s*```$", ""))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(text)


def _filled(value: Column) -> Column:
    """Null for a text that is missing or empty."""
    return F.when(value != "", value)


def insight_payload_normalized(responses: DataFrame) -> DataFrame:
    """Clean stored raw responses and check their fields against the allowed values.

    ``responses`` has ``response_id``, ``raw_text`` and the fallback columns ``title``,
    ``description``, ``recommendation``, ``action_items``, ``impact_level``, ``category``.
    """
    rows = responses.withColumn("p", F.from_json(_json_text("raw_text"), INSIGHT_PAYLOAD))

    def text(name: str) -> Column:
        return F.trim(F.coalesce(_filled(F.col(f"p.{name}")), F.col(name)))

    def allowed(name: str, values: tuple[str, ...]) -> Column:
        given = F.lower(F.coalesce(_filled(F.col(f"p.{name}")), F.col(name)))
        return F.when(given.isin(*values), given).otherwise(F.col(name))

    items = F.filter(F.transform("p.action_items", lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return rows.select(
        "response_id",
        text("title").alias("title"),
        text("description").alias("description"),
        text("recommendation").alias("recommendation"),
        F.when(F.size(items) > 0, items).otherwise(F.col("action_items")).alias("action_items"),
        allowed("impact_level", C.PRIORITIES).alias("impact_level"),
        allowed("category", C.INSIGHT_CATEGORIES).alias("category"),
        F.transform(
            F.filter(
                F.coalesce("p.recommended_actions", F.array().cast(INSIGHT_PAYLOAD["recommended_actions"].dataType)),
                lambda a: (F.trim(F.coalesce(a["title"], F.lit(""))) != "")
                & (F.trim(F.coalesce(a["description"], F.lit(""))) != ""),
            ),
            _normal_action,
        ).alias("recommended_actions"),
    )


def _normal_action(a: Column) -> Column:
    def text(name: str) -> Column:
        return F.trim(F.coalesce(a[name], F.lit("")))

    kind = F.lower(F.trim(F.coalesce(_filled(a["action_type"]), F.lit("keep_monitoring"))))
    priority = F.lower(F.trim(F.coalesce(_filled(a["priority"]), F.lit("medium"))))

    def look(name: str, part: int) -> Column:
        own = F.lit(C.DEFAULT_BADGE[part])
        for known, *looks in C.ACTION_BADGES:
            own = F.when(kind == known, looks[part]).otherwise(own)
        return F.coalesce(_filled(a[name]), own)

    return F.struct(
        kind.alias("action_type"),
        F.when(priority.isin(*C.PRIORITIES), priority).otherwise("medium").alias("priority"),
        *[text(c).alias(c) for c in ("title", "description", "reason", "expected_impact")],
        *[
            F.trim(_filled(a[c])).alias(c)
            for c in ("city", "cinema_name", "studio_name", "movie_title", "schedule_time")
        ],
        F.when(a["occupancy"].isNotNull(), round2(a["occupancy"])).alias("occupancy"),
        look("color", 0).alias("color"),
        look("icon", 1).alias("icon"),
    )
