"""Drawdown and risk aggregates of level and return series, for every key at once.

Series of days are one run for each key, finer ones are run in blocks: see scan.running.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio
from tidemark.operators.scan import running

TRADING_DAYS = 252.0
NOISY = 504


def curve(levels: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """levels (key, d, x) with dd: how far x lies below its highest value so far, as a share of that."""
    return _below_top(levels, key, width).select(*levels.columns, (ratio(F.col("x"), F.col("top_")) - 1).alias("dd"))


def dollar_curve(levels: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """The same as an amount."""
    return _below_top(levels, key, width).select(*levels.columns, (F.col("x") - F.col("top_")).alias("dd"))


def _below_top(levels: DataFrame, key: str, width: int | None) -> DataFrame:
    return running(levels, (key,), {"top_": ("max", F.col("x"))}, width=width)


def walk(drops: DataFrame, key: str) -> DataFrame:
    """key, depth, peak_date, trough_date, recovery_date and duration_days of the deepest fall (drops: key, d, x, dd).

    The trough is the first day of the lowest dd, the peak the first day of the highest level up to it, recovery the first
    day from the trough on that is back at the peak's level; without one, the duration runs to the last day.
    """
    if drops.schema["d"].dataType.simpleString() != "date":
        return _walk_of_long_series(drops, key)
    low = Window.partitionBy(key)
    marked = drops.withColumn("trough", F.min(F.struct("dd", "d")).over(low))
    before = marked.withColumn("top", F.max(F.when(F.col("d") <= F.col("trough.d"), F.struct(F.col("x"), (-F.unix_date("d")).alias("back")))).over(low))
    return before.groupBy(key).agg(
        F.first("trough.dd").alias("depth"),
        F.date_from_unix_date(-F.first("top.back")).alias("peak_date"),
        F.first("trough.d").alias("trough_date"),
        F.min(F.when((F.col("d") >= F.col("trough.d")) & (F.col("x") >= F.col("top.x")), F.col("d"))).alias("recovery_date"),
        F.max("d").alias("last_d"),
    ).select(key, "depth", "peak_date", "trough_date", "recovery_date", F.datediff(F.coalesce("recovery_date", "last_d"), "peak_date").alias("duration_days"))


def _walk_of_long_series(drops: DataFrame, key: str) -> DataFrame:
    """walk() by aggregates that are joined back, so that no task holds a series."""
    day = F.col("d").cast("timestamp") if drops.schema["d"].dataType.simpleString().startswith("timestamp") else F.col("d")
    trough = drops.groupBy(key).agg(F.min(F.struct("dd", "d")).alias("trough"), F.max("d").alias("last_d"))
    marked = drops.join(trough, key)
    top = marked.where(F.col("d") <= F.col("trough.d")).groupBy(key).agg(F.max("x").alias("top"))
    there = marked.join(top, key).where(F.col("x") >= F.col("top"))
    back = F.min(F.when(F.col("d") >= F.col("trough.d"), day)).alias("recovery_date")
    ends = there.groupBy(key).agg(F.min(F.when(F.col("d") <= F.col("trough.d"), day)).alias("peak_date"), back)
    out = trough.join(ends, key).select(key, F.col("trough.dd").alias("depth"), "peak_date", F.col("trough.d").alias("trough_date"), "recovery_date", "last_d")
    lasted = F.coalesce("recovery_date", "last_d")
    days = F.datediff(lasted, "peak_date") if "timestamp" in drops.schema["d"].dataType.simpleString() else lasted - F.col("peak_date")
    return out.select(key, "depth", "peak_date", "trough_date", "recovery_date", days.alias("duration_days"))


def max_drawdown(levels: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """walk() of the drawdown curve, with the share of days under water."""
    drops = curve(levels, key, width)
    return walk(drops, key).join(drops.groupBy(key).agg(F.avg((F.col("dd") < 0).cast("double")).alias("underwater")), key)


def dollar_drawdown(levels: DataFrame, key: str) -> DataFrame:
    """walk() of the amounts; keys with fewer than two points or without a fall are left out."""
    return walk(dollar_curve(levels, key), key).join(levels.groupBy(key).count().where("count >= 2").select(key), key).where("depth < -1e-9")


def ulcer(dd: Column) -> Column:
    """Root of the mean square drawdown (an aggregate)."""
    return F.sqrt(F.avg(dd * dd))


def cdar(drops: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """key, cdar: how deep the deepest ceil(alpha n) drawdowns are on average, at least one; a magnitude."""
    order = Window.partitionBy(key).orderBy("dd", "d")
    ranked = drops.withColumns({"k": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    return ranked.where(F.col("k") <= F.greatest(F.lit(1), F.ceil(F.lit(alpha) * F.col("n")))).groupBy(key).agg((-F.avg("dd")).alias("cdar"))


def with_base(returns: DataFrame, key: str) -> DataFrame:
    """Levels (key, d, x) of returns (key, d, r), with the level 1 on the day before the first."""
    grown = running(returns.select(key, "d", "r"), (key,), {"x": ("product", 1 + F.col("r"))}).select(key, "d", "x")
    return grown.unionByName(returns.groupBy(key).agg(F.date_sub(F.min("d"), 1).alias("d")).withColumn("x", F.lit(1.0)))


def pct_change(levels: DataFrame, key: str, value: str = "close") -> DataFrame:
    """key, d, r: relative change to the row before; the first row has none."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("d"))
    return levels.select(key, "d", (ratio(F.col(value), before) - 1).alias("r")).where("r is not null")


def ratios(returns: DataFrame, key: str) -> DataFrame:
    """key, n, is_noisy, vol, sharpe, sortino, calmar and depth (with a base of 1); NULL where a ratio has no base."""
    r = F.col("r")
    down = F.least(r, F.lit(0.0))
    sums = returns.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.sqrt(F.avg(down * down)).alias("down"), F.product(1 + r).alias("g"))
    deep = curve(with_base(returns, key), key).groupBy(key).agg(F.min("dd").alias("depth"))
    year = F.lit(TRADING_DAYS)
    annual = F.when(F.col("g") > 0, F.pow("g", year / F.col("n")) - 1)
    return sums.join(deep, key).select(
        key, "n", (F.col("n") < NOISY).alias("is_noisy"), (F.col("s") * F.sqrt(year)).alias("vol"),
        (F.sqrt(year) * ratio(F.col("m"), F.col("s"))).alias("sharpe"), (F.sqrt(year) * ratio(F.col("m"), F.col("down"))).alias("sortino"),
        ratio(annual, F.abs("depth")).alias("calmar"), "depth",
    )


def panel(levels: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """One row for each key: the deepest fall of its levels (key, d, x) and, of intervals (key, metric, point, low, high), every metric with its interval.

    Columns: n_days, is_noisy, depth, peak_date, trough_date, recovery_date, duration_days, and metric, metric_low,
    metric_high of each. Keys with fewer than two returns have no row.
    """
    from tidemark.operators.bootstrap import METRICS

    picked = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(m if c == "point" else f"{m}_{c}") for m in METRICS for c in ("point", "low", "high")]
    counts = levels.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n_days")).where("n_days >= 2")
    return intervals.groupBy(key).agg(*picked).join(walk(curve(levels, key), key), key).join(counts, key).withColumn("is_noisy", F.col("n_days") < NOISY)
