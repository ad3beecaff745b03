"""Column helpers. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.constants import PAYMENT_FEES, SEAT_CATEGORIES


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def round2(value) -> Column:
    """Round half up to two digits, through DECIMAL so that the binary form has no say."""
    return F.round(as_col(value).cast("decimal(38,10)"), 2).cast("double")


def money(value) -> Column:
    """A sum of prices at the edge of an operator; a missing sum is zero."""
    return round2(F.coalesce(as_col(value), F.lit(0)))


def ratio(part, whole) -> Column:
    """``part / whole`` as a double; zero where there is no whole."""
    whole = as_col(whole)
    return F.when(whole > 0, as_col(part).cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def rounded_ratio(part, whole) -> Column:
    return round2(ratio(part, whole))


def percent(part, whole) -> Column:
    """Share in percent, two digits; zero where there is no whole."""
    whole = as_col(whole)
    return F.when(whole > 0, round2(as_col(part).cast("double") * 100.0 / whole.cast("double"))).otherwise(F.lit(0.0))


def growth(current, previous) -> Column:
    """Change in percent; from zero it is 100 for any gain and else 0."""
    now, before = as_col(current).cast("double"), as_col(previous).cast("double")
    return F.when(before == 0, F.when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(
        round2((now - before) / before * 100.0)
    )


def minmax(value, low, high) -> Column:
    """Position between ``low`` and ``high``; where they are equal, 1 for a positive value and else 0."""
    v, lo, hi = (as_col(c).cast("double") for c in (value, low, high))
    return F.when(hi == lo, F.when(v > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise((v - lo) / (hi - lo))


def start_hour(start_time="start_time") -> Column:
    return F.split(as_col(start_time), ":").getItem(0).try_cast("long")


def slot_label(start_time="start_time") -> Column:
    """``HH:00`` of a start time."""
    return F.concat(F.lpad(start_hour(start_time).cast("string"), 2, "0"), F.lit(":00"))


def text_place(name: str) -> Column:
    """A text as part of an ascending place for ``min_by``, where nulls would come first: here they are last."""
    return F.struct(F.col(name).isNull(), F.col(name))


def start_seconds(start_time="start_time") -> Column:
    parts = F.split(as_col(start_time), ":")
    return sum(
        (F.coalesce(F.try_element_at(parts, F.lit(i + 1)).try_cast("long"), F.lit(0)) * w)
        for i, w in enumerate((3600, 60, 1))
    )


def day_number(date) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return (F.dayofweek(as_col(date)) - 1).cast("long")


def day_type(date) -> Column:
    return F.when(F.dayofweek(as_col(date)).isin(1, 7), F.lit("weekend")).otherwise(F.lit("weekday"))


def genres(genre="genre") -> Column:
    """The comma list as an array of trimmed, non-empty names."""
    listed = F.split(F.coalesce(as_col(genre), F.lit("")), ",")
    return F.filter(F.transform(listed, lambda g: F.trim(g)), lambda g: g != "")


def genre_array(genre="genre") -> Column:
    """The comma list as an array of trimmed names; an empty array where there is no list."""
    value = as_col(genre)
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(value, F.lit("")) == "", empty).otherwise(F.transform(F.split(value, ","), lambda g: F.trim(g)))


def payment_fee(payment_type) -> Column:
    """Fee of a payment type: the six fixed fees as a literal map, the unknown fee for the rest."""
    name = F.regexp_replace(F.lower(F.coalesce(as_col(payment_type), F.lit("unknown"))), r"\s+", "_")
    fees = F.create_map(*[F.lit(x) for pair in PAYMENT_FEES.items() for x in pair])
    return F.coalesce(F.try_element_at(fees, name), F.lit(PAYMENT_FEES["unknown"])).cast("long")


SEAT_COLUMNS = [f"{seat}_seats" for seat in SEAT_CATEGORIES]


def seat_counts(category="seat_category") -> list[Column]:
    """Number of rows per known seat category, one column each."""
    return [
        F.count_if(F.lower(as_col(category)) == seat).alias(name)
        for seat, name in zip(SEAT_CATEGORIES, SEAT_COLUMNS)
    ]


def seat_sums() -> list[Column]:
    """Sums of the columns that :func:`seat_counts` gives."""
    return [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in SEAT_COLUMNS]


def number_text(value) -> Column:
    """A two-digit number as a short text: ``85``, ``85.5``, ``85.25``."""
    text = F.format_string("%.2f", as_col(value))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def fill(template: str, **values) -> Column:
    """Fill the ``{name}`` fields of a fixed text with columns; a missing value is an empty field."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.coalesce(as_col(values[name]).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))
