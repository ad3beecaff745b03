"""Rule-based reports: prices, advertising slots, breakout titles, overlaps, weekday forecast."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.expr import day_number, genre_array, growth, minmax, money, percent, round2, rounded_ratio, text_place
from marquee.functions.frames import attach
from marquee.operators import orders, sales
from marquee.plans.facts import SCOPE_COLUMNS, all_shows, session_facts, sold_shows, tickets_sold
from marquee.plans.filters import Filters
from marquee.sources.tables import Tables


# ---------------------------------------------------------------- prices


def _by_price_case(on_lagging, on_packed, on_low, otherwise) -> Column:
    """One value per case of a start hour's rounded figures."""
    demand, amount, full = F.col("normalized_demand"), F.col("normalized_revenue"), F.col("occupancy")
    lagging = (demand >= 0.7) & (amount <= 0.45) & (full >= 70)
    packed = (demand >= 0.6) & (full >= 80)
    return F.when(lagging, on_lagging).when(packed, on_packed).when(full <= 35, on_low).otherwise(otherwise)


def _price_action() -> Column:
    return _by_price_case(C.PRICE_UP, C.PRICE_UP, C.PRICE_DOWN, C.PRICE_HOLD)


def price_actions(slots: DataFrame, *keys: str) -> DataFrame:
    """The price action of every start hour with demand; uses the rounded figures of the slots."""
    pick, action, full = _by_price_case, _price_action(), F.col("occupancy")
    low = full <= 35
    return slots.filter("demand > 0").select(
        *keys,
        "time_slot",
        "demand",
        "revenue",
        "occupancy",
        "optimization_score",
        action.alias("suggested_action"),
        pick(F.lit(8), F.lit(5), F.lit(-10), F.lit(0)).cast("long").alias("suggested_price_change_pct"),
        pick(C.PRICE_REASON_LAGGING, C.PRICE_REASON_PACKED, C.PRICE_REASON_LOW, C.PRICE_REASON_HOLD).alias("reason"),
        F.when(action == C.PRICE_HOLD, 0.45).when((full >= 70) | low, 0.8).otherwise(0.65).alias("confidence"),
    )


def pricing_recommendation(t: Tables, f: Filters, top_n: int = 10) -> DataFrame:
    return orders.ordered("pricing_recommendation", price_actions(sales.time_slots(t, f)), top_n or 10)


def pricing_recommendation_summary(t: Tables, f: Filters) -> DataFrame:
    return sales.time_slots(t, f).agg(
        F.count(F.lit(1)).alias("total_slots_analyzed"),
        F.min_by("time_slot", F.struct(-F.col("revenue"), F.col("time_slot"))).alias("peak_time_slot"),
        F.min_by("time_slot", F.struct(F.col("revenue"), F.col("time_slot"))).alias("quiet_time_slot"),
        F.count_if((F.col("demand") > 0) & (_price_action() != C.PRICE_HOLD)).alias("recommended_changes"),
    )


# ---------------------------------------------------------------- advertising


def ad_sums(facts: DataFrame, *keys: str, shows: Column | None = None) -> DataFrame:
    """Shows, audience, revenue and occupancy per title and start hour, within ``keys``.

    ``shows`` counts the shows where a row of ``facts`` stands for several.
    """
    shows = F.count(F.lit(1)) if shows is None else shows
    return (
        facts.groupBy(*keys, "movie_id", "time_slot")
        .agg(
            shows.alias("total_shows"),
            F.sum("tickets").alias("audience_size"),
            F.sum("revenue").alias("amount"),
            F.coalesce(F.sum("total_capacity"), F.lit(0)).alias("capacity"),
        )
        .withColumn("occupancy", percent("audience_size", "capacity"))
    )


def ad_span(sums: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest value of the scored figures and their number, one row per ``keys``."""
    ends = [
        end(name).alias(f"{label}_{name}")
        for name in ("audience_size", "amount", "occupancy")
        for label, end in (("low", F.min), ("high", F.max))
    ]
    return sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_candidates"), *ends)


AD_SPAN = [f"{end}_{name}" for name in ("audience_size", "amount", "occupancy") for end in ("low", "high")]


def ad_scores(spanned: DataFrame, *keys: str) -> DataFrame:
    def position(name: str) -> Column:
        return minmax(name, f"low_{name}", f"high_{name}")

    score = (
        position("audience_size") * C.AD_AUDIENCE_WEIGHT
        + position("amount") * C.AD_REVENUE_WEIGHT
        + position("occupancy") * C.AD_OCCUPANCY_WEIGHT
    )
    return spanned.select(
        *keys,
        "movie_id",
        "title",
        genre_array().alias("genre"),
        "time_slot",
        "total_shows",
        "audience_size",
        money("amount").alias("total_revenue"),
        rounded_ratio("amount", "total_shows").alias("revenue_per_show"),
        "occupancy",
        round2(score * 100).alias("ad_score"),
    )


def _ad_rows(t: Tables, f: Filters) -> DataFrame:
    sums = ad_sums(session_facts(t, f)).join(t.movies.select("movie_id", "title", "genre"), "movie_id")
    return ad_scores(attach(sums, ad_span(sums), *AD_SPAN))


def best_ad_slot(t: Tables, f: Filters, top_n: int = 10) -> DataFrame:
    return orders.ordered("best_ad_slot", _ad_rows(t, f), top_n or 10)


def best_ad_slot_summary(t: Tables, f: Filters) -> DataFrame:
    place = F.struct(
        *[-F.col(c) for c in ("ad_score", "audience_size", "total_revenue")], text_place("title"), F.col("time_slot")
    )
    best = F.min_by(F.struct("title", "time_slot", "ad_score"), place).alias("best")
    return (
        _ad_rows(t, f)
        .agg(F.count(F.lit(1)).alias("total_candidates"), best)
        .select(
            "total_candidates",
            F.col("best.title").alias("top_title"),
            F.col("best.time_slot").alias("top_time_slot"),
            F.col("best.ad_score").alias("top_ad_score"),
            F.lit(C.AD_FORMULA).alias("scoring_formula"),
        )
    )


# ---------------------------------------------------------------- breakout titles


def early_blockbuster(t: Tables, f: Filters, min_tickets: int = 100, min_growth: float = 25) -> DataFrame:
    """Titles with tickets in the window against the window before it, from one pass over both."""
    now = f.in_window()
    sums = (
        sold_shows(t, f.with_previous())
        .groupBy("movie_id")
        .agg(
            F.coalesce(F.sum(F.when(now, F.col("tickets"))), F.lit(0)).alias("current_tickets"),
            F.coalesce(F.sum(F.when(~now, F.col("tickets"))), F.lit(0)).alias("previous_tickets"),
            money(F.sum(F.when(now, F.col("revenue")))).alias("total_revenue"),
        )
        .filter("current_tickets > 0")
        .join(t.movies.select("movie_id", "title"), "movie_id")
        .withColumn("growth_rate", growth("current_tickets", "previous_tickets"))
    )
    signal = (F.col("current_tickets") >= min_tickets) & (F.col("growth_rate") >= min_growth)
    return sums.select(
        "movie_id",
        "title",
        "current_tickets",
        "previous_tickets",
        "growth_rate",
        "total_revenue",
        signal.alias("blockbuster_signal"),
        F.when(signal, C.BREAKOUT_YES).otherwise(C.BREAKOUT_NO).alias("suggested_action"),
    )


def early_blockbuster_summary(t: Tables, f: Filters, min_tickets: int = 100, min_growth: float = 25) -> DataFrame:
    return early_blockbuster(t, f, min_tickets, min_growth).agg(
        F.lit("show_date").alias("date_axis"),
        F.lit(min_tickets).cast("long").alias("min_tickets"),
        F.lit(min_growth).cast("double").alias("min_growth"),
        F.count_if("blockbuster_signal").alias("detected_movies"),
    )


# ---------------------------------------------------------------- overlaps

SLOT = ["cinema_id", "cinema_name", "city", "show_date", "time_slot"]


def _slot_titles(t: Tables, f: Filters) -> DataFrame:
    """Occupancy per venue, date, start hour and title."""
    return (
        session_facts(t, f)
        .groupBy(*SLOT, "movie_id")
        .agg(F.sum("tickets").alias("tickets"), F.coalesce(F.sum("total_capacity"), F.lit(0)).alias("capacity"))
        .join(t.movies.select("movie_id", "title"), "movie_id")
        .withColumn("occupancy", percent("tickets", "capacity"))
    )


def cannibalization(
    t: Tables, f: Filters, min_competitor_occupancy: float = 70, max_impacted_occupancy: float = 40
) -> DataFrame:
    """Weak titles beside a strong one in the same venue, date and start hour.

    The strongest title of a slot is an aggregate that is joined back, one row per slot: no
    pairs of titles are built and no slot has to fit into one task.
    """
    rows = _slot_titles(t, f)
    strongest = (
        rows.groupBy(*SLOT)
        .agg(
            F.count(F.lit(1)).alias("titles"),
            F.min_by(
                F.struct("movie_id", "title", "occupancy"), F.struct(-F.col("occupancy"), text_place("title"), F.col("movie_id"))
            ).alias("best"),
        )
        .filter((F.col("titles") >= 2) & (F.col("best.occupancy") >= min_competitor_occupancy))
    )
    return (
        rows.filter(F.col("occupancy") <= max_impacted_occupancy)
        .join(strongest, SLOT)
        .filter(F.col("movie_id") != F.col("best.movie_id"))
        .select(
            F.col("movie_id").alias("impacted_movie_id"),
            F.col("title").alias("impacted_title"),
            F.col("best.movie_id").alias("competitor_movie_id"),
            F.col("best.title").alias("competitor_title"),
            *SLOT,
            F.col("occupancy").alias("impacted_occupancy"),
            F.col("best.occupancy").alias("competitor_occupancy"),
            round2(F.col("best.occupancy") - F.col("occupancy")).alias("occupancy_gap"),
            F.lit(C.OVERLAP_ADVICE).alias("suggested_action"),
        )
    )


def cannibalization_summary(
    t: Tables, f: Filters, min_competitor_occupancy: float = 70, max_impacted_occupancy: float = 40
) -> DataFrame:
    """Slots looked at (those with one title too) and cases found."""
    slots = _slot_titles(t, f).select("cinema_id", "show_date", "time_slot").distinct()
    cases = cannibalization(t, f, min_competitor_occupancy, max_impacted_occupancy)
    return attach(
        slots.agg(F.count(F.lit(1)).alias("total_slots_analyzed")),
        cases.agg(F.count(F.lit(1)).alias("possible_cannibalization_cases")),
        "possible_cannibalization_cases",
    )


# ---------------------------------------------------------------- forecast


def forecast_window(f: Filters, days_ahead: int = 7) -> Filters:
    """The given window, or the ``days_ahead`` days after ``as_of``."""
    if f.start is not None:
        return f
    first = f.as_of + timedelta(days=1)
    return f.between(first, first + timedelta(days=max(1, days_ahead) - 1))


def forecast(t: Tables, f: Filters, days_ahead: int = 7, lookback_weeks: int = 4) -> DataFrame:
    """Mean of the same weekdays in the weeks before the window, one row per day.

    Tickets and revenue are taken by sale time, occupancy by show date. Days without rows
    are left out of a mean and not counted as zero; a weekday without any day gets the mean
    of all days. The frames below hold one row per day of the calendar.
    """
    ahead = forecast_window(f, days_ahead)
    past = ahead.between(
        ahead.start - timedelta(days=max(1, lookback_weeks) * 7), ahead.start - timedelta(days=1)
    )
    sold = (
        tickets_sold(t, past)
        .groupBy("schedule_id", F.to_date("trans_time").alias("day"))
        .agg(F.count(F.lit(1)).alias("tickets"), F.sum("final_price").alias("revenue"))
        .join(all_shows(t).filter(f.scope(*SCOPE_COLUMNS)).select("schedule_id"), "schedule_id")
        .groupBy("day")
        .agg(F.sum("tickets").alias("tickets"), F.sum("revenue").alias("revenue"))
    )
    shown = session_facts(t, past).groupBy(F.col("show_date").alias("day")).agg(
        (F.avg("seat_share") * 100).alias("occupancy")
    )

    weekday = day_number("day").alias("weekday_number")
    sales_sums = sold.groupBy(weekday).agg(
        F.sum("tickets").cast("double").alias("tickets"),
        F.sum("revenue").alias("revenue"),
        F.count(F.lit(1)).alias("sales_days"),
    )
    share_sums = shown.groupBy(weekday).agg(F.sum("occupancy").alias("occupancy"), F.count(F.lit(1)).alias("show_days"))
    # Seven rows; the mean of all days comes from their sums, so tickets are read once for each axis.
    week = t.spark.range(0, 7, numPartitions=1).select(F.col("id").alias("weekday_number"))
    week = week.join(sales_sums, "weekday_number", "left").join(share_sums, "weekday_number", "left")
    every = Window.partitionBy()

    def mean(name: str, days: str) -> list[Column]:
        overall = F.try_divide(F.sum(name).over(every).cast("double"), F.sum(days).over(every).cast("double"))
        return [(F.col(name).cast("double") / F.col(days)).alias(name), overall.alias(f"any_{name}")]

    week = week.select(
        "weekday_number",
        "sales_days",
        "show_days",
        *mean("tickets", "sales_days"),
        *mean("revenue", "sales_days"),
        *mean("occupancy", "show_days"),
    )
    calendar = t.spark.range(1).select(
        F.explode(F.sequence(F.lit(ahead.start), F.lit(ahead.end))).alias("forecast_date")
    ).withColumn("weekday_number", day_number("forecast_date"))
    rows = calendar.join(week, "weekday_number")

    def predicted(name: str) -> Column:
        return round2(F.coalesce(name, f"any_{name}", F.lit(0.0))).alias(f"predicted_{name}")

    return rows.select(
        "forecast_date",
        "weekday_number",
        F.date_format("forecast_date", "EEEE").alias("weekday_label"),
        predicted("tickets"),
        predicted("revenue"),
        predicted("occupancy"),
        F.greatest(F.coalesce("sales_days", F.lit(0)), F.coalesce("show_days", F.lit(0))).alias("sample_size"),
    )


def forecast_summary(t: Tables, f: Filters, days_ahead: int = 7, lookback_weeks: int = 4) -> DataFrame:
    """Totals of the **rounded** days."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.col(f"predicted_{name}").cast("decimal(28,2)")), F.lit(0))

    return forecast(t, f, days_ahead, lookback_weeks).agg(
        round2(total("tickets")).alias("predicted_tickets"),
        round2(total("revenue")).alias("predicted_revenue"),
        rounded_ratio(total("occupancy"), F.count(F.lit(1))).alias("predicted_avg_occupancy"),
        F.count(F.lit(1)).alias("forecast_days"),
        F.lit(lookback_weeks).cast("long").alias("lookback_weeks"),
    )
