"""Notional portfolios in closed form, and held-out verdicts between two of them.

A leg is a mix of tickers (leg, ticker, w). Between two rebalancing days a leg's value is its value at the first times the
weighted mean of price relatives, so a curve is a running product over segments: no day-by-day loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed, ratio, usable_price
from tidemark.operators import drawdown
from tidemark.operators.align import asof_fill
from tidemark.operators.bootstrap import paired_ulcer_gain
from tidemark.sources.shared import keep

INITIAL, OOS_SHARE, LEAST_WINDOW = 10_000.0, 0.30, 60
#: Returns of which a year's return can be told.
LEAST_OBS = 126
ULCER_MARGIN, CDAR_SLACK = 0.0025, 0.005
PERIODS = {"monthly": "MM", "quarterly": "QUARTER", "annual": "YEAR"}


def usable(prices: DataFrame) -> DataFrame:
    return prices.where(usable_price(F.col("close")))


def windows(prices: DataFrame, legs: DataFrame) -> DataFrame:
    """leg, lo, hi: from the latest first price of the leg's tickers to their latest last price."""
    span = prices.groupBy("ticker").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    return legs.where("w > 0").join(span, "ticker").groupBy("leg").agg(F.max("a").alias("lo"), F.max("z").alias("hi"))


def leg_days(prices: DataFrame, legs: DataFrame, spans: DataFrame) -> DataFrame:
    """leg, d: the union of the days of the leg's tickers, in its span (leg, lo, hi)."""
    return prices.select("ticker", "d").join(legs.where("w > 0"), "ticker").join(spans, "leg").where("d between lo and hi").select("leg", "d").distinct()


def rebalance_days(days: DataFrame, schedule: str) -> DataFrame:
    """leg, d: the first calendar day of each period but the very first day; none for 'never', years for unknown schedules."""
    if schedule == "never":
        return days.limit(0)
    period = F.trunc("d", PERIODS.get(schedule, "YEAR"))
    first = days.groupBy("leg", period.alias("p")).agg(F.min("d").alias("d"))
    return first.withColumn("start", F.min("d").over(Window.partitionBy("leg"))).where("d <> start").select("leg", "d")


def simulate(prices: DataFrame, legs: DataFrame, schedule: str, spans: DataFrame | None = None, initial: float = INITIAL) -> DataFrame:
    """leg, d, v: the daily value of an initial amount, set to the leg's weights at the start and on rebalancing days.

    Prices that are not finite and positive are left out. Tickers without a price at the start are dropped and the
    other weights scaled up. Pass total-return prices. spans (leg, lo, hi) narrows the window.
    """
    px = keep(usable(prices).select("ticker", "d", "close"), "closes")
    own = windows(px, legs)
    if spans is not None:
        own = own.join(spans.toDF("leg", "lo2", "hi2"), "leg").select("leg", F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"))
    days = keep(leg_days(px, legs, own), "leg-days")
    marks = rebalance_days(days, schedule).withColumn("reb", F.lit(1))
    run = Window.partitionBy("leg").orderBy("d")
    # a rebalancing day is the last day of its old segment and the base of the next
    seg = days.join(marks, ["leg", "d"], "left").withColumn("g", F.coalesce(F.sum("reb").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = seg.withColumn("is_base", F.row_number().over(run) == 1).where("is_base or reb = 1").withColumn("base_g", F.when(F.col("is_base"), F.lit(0)).otherwise(F.col("g") + 1))
    member = legs.where("w > 0")
    filled = asof_fill(px.join(member.select("leg", "ticker"), "ticker"), days.join(member.select("leg", "ticker"), "leg"), ("leg", "ticker"))
    filled = keep(filled, "filled")
    at_base = filled.join(base.select("leg", "d", "base_g"), ["leg", "d"]).select("leg", "ticker", F.col("base_g").alias("g"), F.col("close").alias("p0"))
    weights = at_base.where("g = 0 and p0 > 0").join(member, ["leg", "ticker"]).withColumn("w", ratio(F.col("w"), F.sum("w").over(Window.partitionBy("leg")))).select("leg", "ticker", "w")
    grown = seg.join(filled, ["leg", "d"]).join(weights, ["leg", "ticker"]).join(at_base, ["leg", "ticker", "g"])
    factor = grown.groupBy("leg", "d", "g").agg(F.sum(F.col("w") * F.col("close") / F.col("p0")).alias("f"))
    ends = Window.partitionBy("leg", "g").orderBy("d")
    last = F.when(F.lead("d").over(ends).isNull(), F.col("f")).otherwise(1.0)
    before = factor.withColumn("e", last).withColumn("done", F.coalesce(F.product("e").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return keep(before.select("leg", "d", (F.lit(initial) * F.col("done") * F.col("f")).alias("v")), "curves")


def score(curves: DataFrame) -> DataFrame:
    """leg, n, final_value, annualized, vol, sharpe, sortino, calmar and depth of simulated curves (leg, d, v)."""
    moves = drawdown.pct_change(curves, "leg", "v")
    final = curves.groupBy("leg").agg(F.max_by("v", "d").alias("final_value"))
    grown = moves.groupBy("leg").agg(F.product(1 + F.col("r")).alias("g"), F.count(F.lit(1)).alias("m"))
    annual = grown.select("leg", F.when((F.col("g") > 0) & (F.col("m") >= LEAST_OBS), F.pow("g", F.lit(252.0) / F.col("m")) - 1).alias("annualized"))
    return drawdown.ratios(moves, "leg").drop("is_noisy").join(final, "leg").join(annual, "leg")


def backtest(prices: DataFrame, legs: DataFrame, schedule: str, initial: float = INITIAL) -> DataFrame:
    """score() of each leg twice, rebalanced by the schedule and never, with missing: its tickers without usable prices, comma-joined."""
    own = legs.select(F.explode(F.array(F.lit(schedule), F.lit("never"))).alias("schedule"), "leg", "ticker", "w")
    px = keep(usable(prices).select("ticker", "d", "close"), "closes")
    name = F.concat_ws("|", "leg", "schedule")
    mix = own.select(name.alias("leg"), "ticker", "w")
    moved = simulate(px, mix.where(F.col("leg").endswith(f"|{schedule}")), schedule, initial=initial)
    curves = keep(moved if schedule == "never" else moved.unionByName(simulate(px, mix.where(F.col("leg").endswith("|never")), "never", initial=initial)), "backtest")
    lacking = legs.where("w > 0").join(px.select("ticker").distinct(), "ticker", "left_anti").groupBy("leg").agg(F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("missing"))
    parts = F.split("leg", "[|]")
    named = score(curves).withColumns({"schedule": F.element_at(parts, -1)}).withColumn("leg", F.expr("substring(leg, 1, length(leg) - length(schedule) - 1)"))
    return named.join(lacking, "leg", "left").withColumn("missing", F.coalesce("missing", F.lit("")))


def split_days(days: DataFrame, key: str = "leg") -> DataFrame:
    """key, lo, in_sample_end, oos_start, hi of a calendar whose last 30 % are held out; keys without LEAST_WINDOW days on either side are left out."""
    order = Window.partitionBy(key).orderBy("d")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    marked = days.withColumns({"k": F.row_number().over(order), "n": n}).withColumn("n_is", F.col("n") - F.floor(F.col("n") * OOS_SHARE))
    out = marked.groupBy(key).agg(
        F.min("d").alias("lo"), F.max(F.when(F.col("k") == F.col("n_is"), F.col("d"))).alias("in_sample_end"), F.max(F.when(F.col("k") == F.col("n_is") + 1, F.col("d"))).alias("oos_start"),
        F.max("d").alias("hi"), F.first("n").alias("n"), F.first("n_is").alias("n_is"),
    )
    return out.where((F.col("n_is") >= LEAST_WINDOW) & (F.col("n") - F.col("n_is") >= LEAST_WINDOW)).select(key, "lo", "in_sample_end", "oos_start", "hi")


def aligned_returns(curves: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, d, r_without, r_with: levels of both legs (pairs: pair, without, tested) joined by day first, then the changes."""
    a = curves.select(F.col("leg").alias("without"), "d", F.col("v").alias("a")).join(F.broadcast(pairs), "without")
    b = curves.select(F.col("leg").alias("tested"), "d", F.col("v").alias("b"))
    order = Window.partitionBy("pair").orderBy("d")
    both = a.join(b, ["tested", "d"])
    change = lambda c: ratio(F.col(c), F.lag(c).over(order)) - 1
    return both.select("pair", "d", change("a").alias("r_without"), change("b").alias("r_with")).where("r_without is not null and r_with is not null")


def window_stats(returns: DataFrame) -> DataFrame:
    """pair, leg, n, depth, ulcer, cdar, vol and ret of aligned returns; levels without a base row for ulcer and cdar.

    ret is a year's return, NULL under LEAST_OBS returns.
    """
    long = returns.select("pair", "d", F.explode(F.create_map(F.lit("without"), F.col("r_without"), F.lit("with"), F.col("r_with"))).alias("leg", "r")).withColumn("key", F.struct("pair", "leg"))
    level = long.withColumn("x", F.product(1 + F.col("r")).over(Window.partitionBy("key").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    drops = drawdown.curve(level, "key")
    grown = F.product(1 + F.col("r"))
    path = drops.groupBy("key").agg(F.count(F.lit(1)).alias("n"), drawdown.ulcer(F.col("dd")).alias("ulcer"), (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"), F.when((grown > 0) & (F.count(F.lit(1)) >= LEAST_OBS), F.pow(grown, F.lit(252.0) / F.count(F.lit(1))) - 1).alias("ret"))
    deep = drawdown.curve(drawdown.with_base(long, "key"), "key").groupBy("key").agg(F.min("dd").alias("depth"))
    return path.join(drawdown.cdar(drops, "key"), "key").join(deep, "key").select("key.pair", "key.leg", "n", "depth", "ulcer", "cdar", "vol", "ret")


def verdict(stats: DataFrame, returns: DataFrame, reps: int = 1000, seed: int = 42, draws: str = "seeded") -> DataFrame:
    """pair, ulcer_gain, cdar_gain, low, high, verdict and cause of each pair's tested leg against the other.

    Gates in order: the gain must clear the margin, the tail must not contradict it, and a paired bootstrap must confirm.
    """
    pick = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    gains = stats.groupBy("pair").agg((pick("without", "ulcer") - pick("with", "ulcer")).alias("ulcer_gain"), (pick("without", "cdar") - pick("with", "cdar")).alias("cdar_gain"))
    g = gains.join(paired_ulcer_gain(returns, "pair", reps, seed, draws), "pair", "left")
    up, c = F.col("ulcer_gain") > 0, F.col("cdar_gain")
    noise = F.abs("ulcer_gain") < ULCER_MARGIN
    against = (up & (c < -CDAR_SLACK)) | (~up & (c > CDAR_SLACK))
    cause = F.when(noise, "noise_margin").when(against, "cdar_contradicts").when(F.col("low").isNull(), "window_too_short").when((up & (F.col("low") > 0)) | (~up & (F.col("high") < 0)), "").otherwise("bootstrap_unconfirmed")
    named = g.withColumn("cause", cause)
    return named.withColumn("verdict", verdict_of(F.col("cause"), up))


def figure_clause(stats: DataFrame, baseline: str = "without") -> DataFrame:
    """pair, clause: the held-out figures of both legs in one line of text, the tested leg first."""
    both = stats.groupBy("pair").agg(*[F.max(F.when(F.col("leg") == leg, F.col(c))).alias(f"{c}_{leg}") for leg in ("with", "without") for c in ("ulcer", "cdar", "depth", "ret")])
    pct = lambda c, digits, plus=False: F.concat(fixed(F.col(c) * 100, digits, plus), F.lit("%"))
    # fixed value: the order and the words of the figures
    text = F.concat(
        F.lit("Ulcer "), pct("ulcer_with", 2), F.lit(" vs "), pct("ulcer_without", 2), F.lit(f" {baseline}; CDaR "), pct("cdar_with", 2), F.lit(" vs "), pct("cdar_without", 2),
        F.lit("; max DD "), pct("depth_with", 1), F.lit(" vs "), pct("depth_without", 1), F.lit(" (context)"),
    )
    cost = F.concat(F.lit("; return "), pct("ret_with", 1, True), F.lit(" vs "), pct("ret_without", 1, True), F.lit("/yr ("), fixed((F.col("ret_with") - F.col("ret_without")) * 100, 1, True), F.lit("pp, context)"))
    return both.select("pair", F.concat(text, F.coalesce(cost, F.lit(""))).alias("clause"))


def sleeve_returns(px: DataFrame, target: DataFrame, asked: DataFrame, schedule: str, sleeve: float) -> DataFrame:
    """pair, d, r_without, r_with: daily returns of a target (ticker, w) alone and with a sleeve of each candidate (asked: pair, oos_start, hi).

    The same as simulating both legs of each candidate from oos_start to hi and joining their days, for a target whose
    tickers all have prices before. Since the last rebalancing the mix has grown by (1 - sleeve) times what the target has
    grown by since then and sleeve times what the candidate has. What the target has grown by from one day to another is
    one table, of the days that any candidate starts or is rebalanced on, and the days until the next: candidates share
    it, and each has only its own prices and the target's calendar.
    """
    mix = target.where("w > 0").groupBy("ticker").agg(F.sum("w").alias("w"))
    kept = px.join(mix.select("ticker"), "ticker")
    calendar = kept.agg(F.array_sort(F.collect_set("d")).alias("days"))  # one row
    on_target = asked.crossJoin(F.broadcast(calendar)).select("pair", "oos_start", F.explode(F.filter("days", lambda d: (d >= F.col("oos_start")) & (d <= F.col("hi")))).alias("d"), F.lit(None).cast("double").alias("close"), F.lit(1).alias("on_target"))
    own = px.join(asked, F.col("ticker") == F.col("pair")).where("d <= hi").select("pair", "oos_start", "d", "close", F.lit(0).alias("on_target"))
    days = own.unionByName(on_target).groupBy("pair", "d").agg(F.max("close").alias("close"), F.max("on_target").alias("on_target"), F.first("oos_start").alias("oos_start"))
    line = Window.partitionBy("pair").orderBy("d")
    so_far, before = line.rowsBetween(Window.unboundedPreceding, Window.currentRow), line.rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("p", F.last("close", ignorenulls=True).over(so_far)).where("d >= oos_start")
    period = F.lit(0) if schedule == "never" else F.trunc("d", PERIODS.get(schedule, "YEAR"))
    of = Window.partitionBy("pair", "period")
    on_day = F.when(F.col("on_target") == 1, F.col("d"))
    marked = days.withColumn("period", period).withColumns({"first_day": F.min("d").over(of), "first_target_day": F.min(on_day).over(of)})
    is_base, is_target_base = F.col("d") == F.col("first_day"), F.col("d") == F.col("first_target_day")
    based = marked.select(
        "pair", "d", "on_target", "p", is_base.alias("is_base"), F.coalesce(F.last(F.when(is_base, F.col("d")), ignorenulls=True).over(before), "d").alias("d0"),
        F.coalesce(F.last(F.when(is_base, F.col("p")), ignorenulls=True).over(before), "p").alias("p0"), F.coalesce(F.last(F.when(is_target_base, F.col("d")), ignorenulls=True).over(before), "d").alias("t0"),
    ).where("on_target = 1 or is_base")
    based = keep(based, "sleeves")
    spans = based.select("d0", "d").unionByName(based.where("on_target = 1").select(F.col("t0").alias("d0"), "d")).distinct()
    wanted = spans.select(F.explode(F.array("d0", "d")).alias("d")).distinct().crossJoin(F.broadcast(mix.select("ticker")))  # a row for each of the target's tickers
    at = keep(asof_fill(kept, wanted).join(mix, "ticker"), "target-closes")
    grown = spans.join(at.select(F.col("d").alias("d0"), "ticker", F.col("close").alias("c0")), "d0").join(at, ["d", "ticker"]).groupBy("d0", "d").agg((F.sum(F.col("w") * F.col("close") / F.col("c0")) / F.sum("w")).alias("f"))
    grown = keep(grown, "target-growth")
    total = mix.agg(F.sum("w").alias("w"))
    share = F.lit(sleeve) / (F.col("w") * (1 - sleeve) + sleeve)
    both = based.join(grown, ["d0", "d"]).crossJoin(F.broadcast(total)).withColumn("share", share)
    both = both.withColumn("f", (1 - F.col("share")) * F.col("f") + F.col("share") * F.col("p") / F.col("p0"))
    # a day's step is measured from the day before, or from the base if that is it
    step = F.col("f") / F.when(F.lag("d").over(line) == F.col("d0"), 1.0).otherwise(F.coalesce(F.lag("f").over(line), F.lit(1.0)))
    level = both.withColumn("step", step).withColumn("v", F.product("step").over(so_far)).where("on_target = 1").select("pair", "d", "t0", "v")
    alone = level.join(grown.withColumnRenamed("d0", "t0"), ["t0", "d"])
    r_without = F.col("f") / F.when(F.lag("d").over(line) == F.col("t0"), 1.0).otherwise(F.lag("f").over(line)) - 1
    r_with = ratio(F.col("v"), F.lag("v").over(line)) - 1
    return alone.select("pair", "d", r_without.alias("r_without"), r_with.alias("r_with")).where("r_without is not null and r_with is not null")


def role_checks(prices: DataFrame, target: DataFrame, candidates: DataFrame, schedule: str = "quarterly", sleeve: float = 0.05, reps: int = 1000, seed: int = 42, draws: str = "seeded") -> DataFrame:
    """pair (the candidate), verdict, reason, in_sample_end, oos_start, hi, ulcer_gain, cdar_gain, low, high, cause, validated: all candidates at once.

    Each candidate joins the target (ticker, w) with a sleeve, and the mix is judged against the target on the last 30 %
    of their common days. The target is worked out once for all of them: see sleeve_returns. Where that cannot be done the verdict is 'insufficient' and reason tells why: already in the
    target, no prices, target tickers without prices, too few days on a side.
    """
    if not 0 < sleeve < 1:
        return candidates.select(F.col("ticker").alias("pair")).distinct().select("pair", F.lit("insufficient").alias("verdict"), F.lit(f"the sleeve {sleeve} is no share between 0 and 1").alias("reason"), *[F.lit(None).cast(t).alias(c) for c, t in (("in_sample_end", "date"), ("oos_start", "date"), ("hi", "date"), ("ulcer_gain", "double"), ("cdar_gain", "double"), ("low", "double"), ("high", "double"), ("cause", "string"))], F.lit(False).alias("validated"))
    px = usable(prices)
    px = keep(px.select("ticker", "d", "close"), "closes")
    asked = candidates.select("ticker").distinct()
    span = px.groupBy("ticker").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    wanted = target.join(span, "ticker", "left").agg(F.max("a").alias("lo"), F.max("z").alias("hi"), F.array_sort(F.collect_list(F.when(F.col("a").isNull(), F.col("ticker")))).alias("unpriced"))
    own = asked.join(span, "ticker", "left").join(target.select("ticker", F.lit(True).alias("inside")).distinct(), "ticker", "left").crossJoin(F.broadcast(wanted))  # one row
    own = own.select(F.col("ticker").alias("pair"), F.coalesce("inside", F.lit(False)).alias("inside"), F.col("a").isNull().alias("priceless"), "unpriced", F.greatest("a", "lo").alias("lo"), F.least("z", "hi").alias("hi"))
    days = px.join(own.where("not inside").select(F.col("pair").alias("ticker"), "lo", "hi"), "ticker").where("d between lo and hi").select(F.col("ticker").alias("leg"), "d").distinct()
    counted = own.join(days.groupBy(F.col("leg").alias("pair")).agg(F.count(F.lit(1)).alias("n")), "pair", "left")
    split = split_days(days).select(F.col("leg").alias("pair"), "in_sample_end", "oos_start")
    plan = counted.join(split, "pair", "left")
    reason = (
        F.when(F.col("inside"), "already in the target").when(F.col("priceless"), "no usable prices of the candidate")
        .when(F.size("unpriced") > 0, F.concat(F.lit("target tickers without prices: "), F.array_join("unpriced", ", ")))
        .when(F.col("oos_start").isNull(), F.concat(F.lit("only "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(f" common days: {LEAST_WINDOW} are needed on both sides")))
    )
    plan = keep(plan.withColumn("reason", reason), "plan")
    fit = plan.where("reason is null")
    returns = keep(sleeve_returns(px, target, fit.select("pair", "oos_start", "hi"), schedule, sleeve), "aligned")
    stats = window_stats(returns)
    judged = verdict(stats, returns, reps, seed, draws).join(figure_clause(stats), "pair")
    out = plan.join(judged, "pair", "left").withColumn("verdict", F.coalesce("verdict", F.lit("insufficient")))
    return out.select("pair", "verdict", F.coalesce("reason", "clause", F.lit("the held-out window has no returns")).alias("reason"), "in_sample_end", "oos_start", "hi", "ulcer_gain", "cdar_gain", "low", "high", "cause", (F.col("verdict") == "improved").alias("validated"))


def benchmark_check(prices: DataFrame, legs: DataFrame, reference: str, tested: str, schedule: str = "quarterly", reps: int = 1000, seed: int = 42, draws: str = "seeded") -> DataFrame:
    """One row: pair (the tested leg), verdict (shallower, deeper, inconclusive or insufficient), reason, missing, gains, interval and cause against a reference leg.

    Both legs run over the days that all their tickers share; the last 30 % of those days are judged. missing names the
    tickers without usable prices, which both legs go without.
    """
    px, own = usable(prices), legs.where(F.col("leg").isin(reference, tested))
    span = px.groupBy("ticker").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    members = own.where("w > 0").select("ticker").distinct().join(span, "ticker", "left")
    bounds = members.agg(F.max("a").alias("lo"), F.min("z").alias("hi"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("a").isNull(), F.col("ticker")))), ",").alias("missing"))
    days = px.join(members.select("ticker"), "ticker").join(F.broadcast(bounds), F.col("d").between(F.col("lo"), F.col("hi"))).select(F.lit(tested).alias("leg"), "d").distinct()
    split = split_days(days).select("oos_start", "hi")
    spans = own.select("leg").distinct().crossJoin(F.broadcast(split)).select("leg", F.col("oos_start").alias("lo"), "hi")  # one window
    pairs = prices.sparkSession.createDataFrame([(tested, reference, tested)], "pair string, without string, tested string")
    returns = keep(aligned_returns(simulate(px, own, schedule, spans), pairs), "aligned")
    stats = window_stats(returns)
    judged = verdict(stats, returns, reps, seed, draws).join(figure_clause(stats, reference), "pair")
    named = bounds.select(F.lit(tested).alias("pair"), "missing").crossJoin(days.agg(F.count(F.lit(1)).alias("n"))).join(judged, "pair", "left")  # one row each
    word = F.when(F.col("verdict") == "improved", "shallower").when(F.col("verdict") == "worsened", "deeper").otherwise(F.coalesce("verdict", F.lit("insufficient")))
    short = F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(f" common days: {LEAST_WINDOW} are needed on both sides"))
    return named.select("pair", word.alias("verdict"), F.coalesce("clause", short).alias("reason"), "missing", "ulcer_gain", "cdar_gain", "low", "high", "cause")


def verdict_of(cause: Column, up: Column) -> Column:
    return F.when(cause != "", "inconclusive").when(up, "improved").otherwise("worsened")
