"""Frame helpers: positions, single values from a frame, first row per key, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import stored


def value_of(frame: DataFrame, *columns: Column | str) -> Column:
    """The single row of a one-row frame as a struct, for use in another frame.

    It is a scalar subquery: Spark runs it once and hands the value to the tasks.
    """
    return frame.select(F.struct(*columns).alias("value")).scalar()


def attach(frame: DataFrame, one_row: DataFrame, *columns: str) -> DataFrame:
    """Add columns of a one-row frame to every row."""
    out = frame.withColumn("_one", value_of(one_row, *columns))
    for name in columns:
        out = out.withColumn(name, F.col(f"_one.{name}"))
    return out.drop("_one")


def with_whole(frame: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """A row per key and one over all rows, from one aggregation; ``_whole`` tells the latter.

    An empty frame has neither.
    """
    sets = frame.groupingSets([keys, []], *keys)
    return sets.agg((F.grouping(keys[0]) == 1).alias("_whole"), *sums)


def of_whole(column: str) -> Column:
    """What the row over all rows has in a column, for every row of a short frame."""
    return F.max(F.when(F.col("_whole"), F.col(column))).over(Window.partitionBy())


def first_per(frame: DataFrame, keys: list[str], order: list[Column], columns: list[str], name: str) -> DataFrame:
    """The first row per key as a struct column ``name``.

    An aggregate and not a window: tasks combine before the shuffle, so a busy key is cheap.
    ``order`` is ascending; negate numbers for descending.
    """
    return frame.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias(name))


def numbered(frame: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Position of every row in a total order, without sending all rows to one task.

    Rows are range-partitioned and sorted; the position inside a partition plus the number
    of rows in earlier partitions is the answer. The placed rows are read twice, so they are
    written first: a second run of the range partitioning could choose other bounds.
    """
    placed = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    # One row per partition: as small as the number of shuffle partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    within = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + within + 1).drop("_id", "_part", "_before")


def top_per(frame: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """The first ``n`` rows per key with their position.

    ``row_number() <= n`` makes Spark keep at most ``n`` rows per key in each task before the
    shuffle, so a key that covers all rows stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def top_numbered(frame: DataFrame, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of a frame with their position; ``n`` rows are in one task, no more."""
    return frame.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def page(frame: DataFrame, order: list[Column], page_number: int | None = None, limit: int = 20):
    """One page of a frame in a total order; the whole frame where no page is asked for."""
    if page_number is None:
        return frame
    if page_number < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    return frame.orderBy(*order).offset((page_number - 1) * limit).limit(limit)


# What a frame is in order of: columns that together are unique, each descending or not; nulls are
# last in either direction.
Keys = list[tuple[Column, bool]]


def in_order(keys: Keys) -> list[Column]:
    return [c.desc_nulls_last() if descending else c.asc_nulls_last() for c, descending in keys]


def behind(keys: Keys, values: list[Column]) -> Column:
    """Rows that come behind the row with these values."""
    condition = F.lit(False)
    for (key, descending), value in reversed(list(zip(keys, values, strict=True))):
        further = F.when(value.isNull(), F.lit(False)).otherwise(key.isNull() | ((key < value) if descending else (key > value)))
        condition = further | (key.eqNullSafe(value) & condition)
    # What the first key alone tells; it reaches the scan where it is a column of the files.
    (key, descending), value = keys[0], values[0]
    return (key.isNull() | ((key <= value) if descending else (key >= value))) & condition


def page_after(frame: DataFrame, keys: Keys, values: list[Column] | None, limit: int = 20) -> DataFrame:
    """The first rows behind the last one of the page before, or of all where ``values`` is None.

    Each task keeps ``limit`` rows, however far the page is from the beginning.
    """
    if limit < 1:
        raise ValueError("limit starts at 1")
    rows = frame if values is None else frame.filter(behind(keys, values))
    return rows.orderBy(*in_order(keys)).limit(limit)


def paged(frame: DataFrame, keys: Keys, page_number: int | None, limit: int, values: list[Column] | None) -> DataFrame:
    """A page by its number, or the one behind a row; the whole frame where neither is given."""
    if values is None:
        return page(frame, in_order(keys), page_number, limit)
    if page_number is not None:
        raise ValueError("a page is asked for by its number or by the row before it")
    return page_after(frame, keys, values, limit)


def totals(frame: DataFrame, limit: int = 20) -> DataFrame:
    """Rows of a frame, and its pages of the size that :func:`page` takes."""
    if limit < 1:
        raise ValueError("limit starts at 1")
    pages = F.ceil(F.col("total") / F.lit(limit)).cast("long")
    return frame.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", pages)
