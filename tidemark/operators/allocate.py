"""Allocation rules and rebalancing suggestions, for many books at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed, ratio, usable_price
from tidemark.operators.drawdown import pct_change

# Days of returns for volatilities, dollars of the smallest trade, slack of bands.
LOOKBACK, LEAST_TRADE, BAND_EPS = 252, 1.0, 1e-9
#: Rules that need no validated edge. Any other rule is refused unless the caller says it was validated.
DISCIPLINE = ("equal_weight", "inverse_vol", "to_total", "bands", "cash_flow_only", "fixed_dca")

# Fixed values of the preset templates and the questionnaire.
PRESETS = {"conservative": {"equity": 0.35, "bonds": 0.50, "diversifiers": 0.15}, "moderate": {"equity": 0.55, "bonds": 0.30, "diversifiers": 0.15}, "aggressive": {"equity": 0.75, "bonds": 0.12, "diversifiers": 0.13}}
ROLE_WEIGHTS = {
    "equity": {"us-large": 0.55, "intl-developed": 0.22, "us-dividend": 0.10, "us-small-mid": 0.08, "em-equity": 0.05, "sector-equity": 0.0},
    "bonds": {"bond-aggregate": 0.50, "treasury": 0.20, "corporate-bond": 0.18, "tips": 0.12},
    "diversifiers": {"gold": 0.60, "reit": 0.40, "commodity-broad": 0.0},
}
REFERENCE_MIXES = {
    "60-40": {"VOO": 0.60, "BND": 0.40},
    "all-weather": {"VTI": 0.30, "TLT": 0.40, "IEI": 0.15, "GLD": 0.075, "DBC": 0.075},
    "permanent": {"VTI": 0.25, "TLT": 0.25, "BIL": 0.25, "GLD": 0.25},
}


def require_edge(rule: str, validated: bool = False) -> None:
    """Refuses a rule that claims an edge unless it was validated out of sample."""
    if rule not in DISCIPLINE and not validated:
        raise PermissionError(f"{rule} claims an edge that was not validated")


def needs_series(rule: str) -> bool:
    """Whether a rule weighs by past prices, so that they must be given."""
    return rule == "inverse_vol"


def allocate(rule: str, members: DataFrame, prices: DataFrame | None = None, cap: float | None = None, validated: bool = False, key: str = "book") -> DataFrame:
    """key, ticker, w of the members (key, ticker) by a rule: equal_weight or inverse_vol (prices: ticker, d, close).

    Cash is never given a weight. A preset is no such rule, an unknown one is an error, and one that claims an edge must
    have been validated. cap bounds every weight. Keys without usable members have no rows.
    """
    if rule in PRESETS:
        raise ValueError(f"{rule} is a preset: it makes a target from roles, not from members")
    if rule not in ("equal_weight", "inverse_vol"):
        raise ValueError(f"no such rule: {rule}")
    require_edge(rule, validated)
    own = members.where(F.upper(F.trim("ticker")) != "CASH").select(key, "ticker").distinct()
    if rule == "equal_weight":
        out = equal_weight(own, key)
    else:
        out = own.join(volatility(prices), "ticker").withColumn("v", 1 / F.col("s")).select(key, "ticker", (F.col("v") / F.sum("v").over(Window.partitionBy(key))).alias("w"))
    return out if cap is None else apply_caps(out, cap, key)


def volatility(prices: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """ticker, s: the deviation of the last returns; tickers without variation are left out."""
    r = pct_change(prices, "ticker").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))).where(F.col("k") <= lookback)
    return r.groupBy("ticker").agg(F.stddev_samp("r").alias("s")).where("s > 0")


def equal_weight(members: DataFrame, key: str = "book") -> DataFrame:
    """key, ticker, w: one over the number of distinct tickers."""
    return members.select(key, "ticker").distinct().withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(key)))


def inverse_vol(prices: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """ticker, w: in inverse proportion to the deviation of the last returns; tickers without variation are left out."""
    vol = volatility(prices, lookback)
    total = vol.agg(F.sum(1 / F.col("s")).alias("t"))
    return vol.join(F.broadcast(total)).select("ticker", (1 / F.col("s") / F.col("t")).alias("w"))


def apply_caps(weights: DataFrame, cap: float, key: str = "book") -> DataFrame:
    """key, ticker, w with no weight over cap: what lies over is spread over the others in proportion, again and again.

    An error where cap is not positive or too small for the key's number of tickers. The fold's steps are as many as
    the key has tickers.
    """
    if cap <= 0:
        raise ValueError("the cap must be positive")
    lists = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ticker", "w"))).alias("x"), F.sum("w").alias("t"))
    small = F.lit(cap) * F.size("x") < 1 - 1e-9
    lists = lists.withColumn("x", F.when(small, F.raise_error(F.lit("the cap is too small for so few tickers"))).otherwise(F.transform("x", lambda e: F.struct(e["ticker"].alias("ticker"), ratio(e["w"], F.col("t")).alias("w")))))

    def step(x, _):
        over = F.aggregate(x, F.lit(0.0), lambda a, e: a + F.greatest(e["w"] - cap, F.lit(0.0)))
        under = F.aggregate(x, F.lit(0.0), lambda a, e: a + F.when(e["w"] < cap - 1e-12, e["w"]).otherwise(0.0))
        return F.transform(x, lambda e: F.struct(e["ticker"].alias("ticker"), F.when(e["w"] > cap + 1e-12, cap).when((e["w"] < cap - 1e-12) & (under > 0), e["w"] + over * ratio(e["w"], under)).otherwise(e["w"]).alias("w")))

    out = lists.withColumn("x", F.aggregate(F.sequence(F.lit(1), F.size("x")), F.col("x"), step))
    return out.select(key, F.explode("x").alias("e")).select(key, "e.ticker", "e.w")


def resolve_roles(universe: DataFrame, held: DataFrame, key: str = "book") -> DataFrame:
    """key, role, ticker: the largest holding of each role, else the role's first fund of the universe."""
    largest = held.join(universe.select("ticker", "role"), "ticker").withColumn("k", F.row_number().over(Window.partitionBy(key, "role").orderBy(F.desc("value"), "ticker"))).where("k = 1").select(key, "role", F.col("ticker").alias("own"))
    first = universe.groupBy("role").agg(F.min_by("ticker", "file_ord").alias("default"))
    grid = held.select(key).distinct().crossJoin(F.broadcast(first))  # as many roles as the vocabulary has
    return grid.join(largest, [key, "role"], "left").select(key, "role", F.coalesce("own", "default").alias("ticker"))


def preset_target(roles: DataFrame, template: DataFrame, key: str = "book") -> DataFrame:
    """key, ticker, w of a template (bucket, bucket_weight, role, role_weight): bucket weights over the roles present, scaled to 1."""
    present = roles.join(F.broadcast(template.where("role_weight > 0")), "role")
    part = F.col("bucket_weight") * ratio(F.col("role_weight"), F.sum("role_weight").over(Window.partitionBy(key, "bucket")))
    sums = present.withColumn("w", part).groupBy(key, "ticker").agg(F.sum("w").alias("w"))
    return sums.withColumn("w", ratio(F.col("w"), F.sum("w").over(Window.partitionBy(key))))


def held_weights(held: DataFrame, key: str = "book") -> DataFrame:
    """key, ticker, value and w, its share of the key's whole value."""
    return held.select(key, "ticker", "value").withColumn("w", ratio(F.col("value"), F.sum("value").over(Window.partitionBy(key))))


def _universe(held: DataFrame, prices: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, ticker, held, w, price, total, cur_w of all held or targeted tickers with a usable price."""
    books = held.groupBy(key).agg(F.sum("value").alias("total"))
    wanted = books.select(key).crossJoin(F.broadcast(target))  # one row for each target ticker
    both = held.select(key, "ticker", "value").join(wanted, [key, "ticker"], "full").join(books, key).join(prices.select("ticker", "price"), "ticker").where("price > 0")
    return both.select(key, "ticker", F.coalesce("value", F.lit(0.0)).alias("held"), F.coalesce("w", F.lit(0.0)).alias("w"), "price", "total").withColumn("cur_w", F.coalesce(ratio(F.col("held"), F.col("total")), F.lit(0.0)))


def _percent(x, digits: int = 1):
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def _suggestion(df: DataFrame, key: str, dollars, rule: str, held_back, reason) -> DataFrame:
    """held_back: why nothing is traded; reason: why something is."""
    trade = F.coalesce(dollars, F.lit(0.0))
    small = F.abs(trade) < LEAST_TRADE
    return df.select(
        key, "ticker", F.when(small, "hold").when(trade > 0, "buy").otherwise("sell").alias("action"), F.when(small, 0.0).otherwise(F.abs(trade)).alias("dollars"),
        F.when(small, 0.0).otherwise(ratio(F.abs(trade), F.col("price"))).alias("shares"), "cur_w", F.col("w").alias("target_w"),
        F.lit(rule).alias("rule"), F.when(small, held_back).otherwise(reason).alias("reason"),
    )


def refusals(held: DataFrame, prices: DataFrame, key: str = "book") -> DataFrame:
    """key, unpriced: the books that no rebalancing can be sized for, and the tickers that they hold without a usable price, comma-joined.

    Weights over a part of a book would understate its total, so that every trade would be wrong.
    """
    usable = prices.where(usable_price(F.col("price"))).select("ticker")
    return held.join(usable, "ticker", "left_anti").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("ticker")), ", ").alias("unpriced"))


def suggest(mode: str, held: DataFrame, prices: DataFrame, target: DataFrame, new_cash: float = 0.0, band: float = 0.05, band_rel: float = 0.25, key: str = "book") -> DataFrame:
    """key, ticker, action, dollars, shares, cur_w, target_w, rule and reason by rule.

    to_total trades every ticker to its weight of the total with the new cash. bands does the same, but only for books
    in which any ticker lies outside its band (the smaller of band and band_rel of its weight). cash_flow_only spreads
    new cash over shortfalls, or by the target where there are none. fixed_dca spreads it by the target. Trades of less
    than a dollar are held back. Books that hold a ticker without a usable price get no suggestions: see refusals. held:
    key, ticker, value; prices: ticker, price; target: ticker, w.
    """
    require_edge(mode)
    held = held.join(refusals(held, prices, key), key, "left_anti")
    u, book = _universe(held, prices, target, key), Window.partitionBy(key)
    whole = F.col("w") * (F.col("total") + new_cash) - F.col("held")
    exit_ = F.lit("target 0%: the position is sold off")
    against = F.concat(_percent(F.col("cur_w")), F.lit(" held, "), _percent(F.col("w")), F.lit(" wanted"))
    if mode == "to_total":
        return _suggestion(u, key, whole, mode, F.lit("on target"), F.when(F.col("w") == 0, exit_).otherwise(against))
    if mode == "bands":
        width = F.least(F.lit(band), F.lit(band_rel) * F.col("w"))
        out = F.abs(F.col("cur_w") - F.col("w")) > width + BAND_EPS
        beyond = F.concat(fixed((F.col("cur_w") - F.col("w")) * 100, 1, plus=True), F.lit(" points off, the band is "), fixed(width * 100, 2))
        inside = F.concat(F.lit("within its band of "), fixed(width * 100, 2), F.lit(" points"))
        reason = F.when(F.col("w") == 0, exit_).when(out, beyond).otherwise(F.concat(against, F.lit("; another left its band")))
        return _suggestion(u.withColumn("breach", F.max(out).over(book)), key, F.when(F.col("breach"), whole), mode, F.when(F.col("breach"), "on target").otherwise(inside), reason)
    if mode == "cash_flow_only":
        short = u.withColumn("short", F.greatest(whole, F.lit(0.0))).withColumn("all_short", F.sum("short").over(book))
        spread = F.when(F.col("all_short") > 0, new_cash * ratio(F.col("short"), F.col("all_short"))).otherwise(new_cash * F.col("w"))
        may = (F.col("w") > 0) & F.lit(new_cash > 0)
        held_back = F.when(may, "at or above target").otherwise("no cash for it")
        return _suggestion(short, key, F.when(may, spread), mode, held_back, F.when(F.col("all_short") > 0, "new cash fills what lacks").otherwise("nothing lacks: new cash by target"))
    if mode == "fixed_dca":
        reason = F.concat(_percent(F.col("w")), F.lit(f" of {new_cash:,.0f} dollars"))
        return _suggestion(u, key, new_cash * F.col("w"), mode, F.lit("not in the target, or no cash"), reason)
    raise ValueError(f"no such mode: {mode}")


def totals(suggestions: DataFrame, key: str = "book") -> DataFrame:
    """key, buy, sell and net (buys less sales, to the cent, halves to even)."""
    side = lambda a: F.sum(F.when(F.col("action") == a, F.col("dollars")).otherwise(0.0))
    return suggestions.groupBy(key).agg(side("buy").alias("buy"), side("sell").alias("sell")).withColumn("net", F.bround(F.col("buy") - F.col("sell"), 2))


def posture(answers: DataFrame) -> DataFrame:
    """answers (id, horizon, loss_response, cash_buffer; scores 0 to 2) with score and posture; a horizon score of 0 caps at conservative."""
    score = F.col("horizon") + F.col("loss_response") + F.col("cash_buffer")
    return answers.withColumn("score", score).withColumn("posture", F.when((F.col("horizon") == 0) | (score <= 2), "conservative").when(score <= 4, "moderate").otherwise("aggressive"))
