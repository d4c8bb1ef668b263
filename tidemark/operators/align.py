"""Time-series alignment: calendars, as-of fills and snaps, all by runs within a key; no inequality joins.

Days are one run for each key, finer times and what is given a width are run in blocks: see scan.running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import running


def calendar(prices: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The distinct days of all series, for each key."""
    return prices.select(*keys, "d").distinct()


def asof_fill(prices: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ("ticker",), value: str = "close", width: int | None = None) -> DataFrame:
    """grid (keys and d) with the last value at or before each day, also from before the grid's first; NULL before the first value."""
    both = prices.select(*keys, "d", value, F.lit(0).alias("on_grid")).unionByName(grid.select(*keys, "d", F.lit(None).cast("double").alias(value), F.lit(1).alias("on_grid")))
    filled = running(both, keys, {"last_": ("last", F.col(value))}, ties=("on_grid",), width=width)
    return filled.where("on_grid = 1").select(*keys, "d", F.col("last_").alias(value))


def snap_forward(events: DataFrame, days: DataFrame, keys: tuple[str, ...], clamp: bool = False, into: str = "day", width: int | None = None) -> DataFrame:
    """events with the first calendar day at or after their d; later ones get the last day if clamp, else NULL.

    Only the distinct days of the events are put in order with the calendar, and joined back to the events.
    """
    if events.columns != [*keys, "d"]:
        placed = snap_forward(events.select(*keys, "d").distinct(), days, keys, clamp, into, width)
        return events.join(placed, [*keys, "d"], "left").select(*events.columns, into)
    both = events.withColumn("on_calendar", F.lit(0)).unionByName(days.select(*keys, "d").withColumn("on_calendar", F.lit(1)))
    # read backwards, the calendar's day comes before an event of the same day
    out = running(both, keys, {into: ("last", F.when(F.col("on_calendar") == 1, F.col("d")))}, ties=("on_calendar",), backward=True, width=width)
    if clamp:
        out = out.join(days.groupBy(*keys).agg(F.max("d").alias("last_day_")), [*keys], "left").withColumn(into, F.coalesce(into, "last_day_"))
    return out.where("on_calendar = 0").select(*keys, "d", into)


def latest(prices: DataFrame, asof, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The last close at or before a day, and its day."""
    return prices.where(F.col("d") <= asof).groupBy(*keys).agg(F.max("d").alias("asof_date"), F.max_by("close", "d").alias("close"))
