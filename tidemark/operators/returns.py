"""Value and profit curves, time-weighted returns, and money-weighted returns, for every book at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import cash_delta, cash_flow, ratio
from tidemark.operators.align import snap_forward
from tidemark.operators.scan import running
from tidemark.sources.shared import keep, sized

YEAR_DAYS, TRADING_DAYS = 365.25, 252
LEAST_DAYS, LEAST_OBS = 183, 126
VALUE_DUST = 1e-6
#: Values of holdings, exact to add up.
WORTH = "decimal(30,8)"


def priced_rows(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """The ledger's rows of tickers that have prices."""
    return ledger.join(prices.select("ticker").distinct(), "ticker", "left_semi")


def book_days(ledger: DataFrame, prices: DataFrame, width: int | None = None) -> DataFrame:
    """book, d, v, flow, income, delta: one row for each day on which any ticker of the book has a price, from its first row on.

    v is shares times the last close; a ticker without a price yet counts as zero. flow is the money into trades less the
    money out of them, delta the effect on the cash balance. Rows count from the first such day at or after theirs; later
    ones count on the last day if they are income or costs, and not yet if they are trades. Transfers are left out.

    The ledger is summed up by holding and day, and that by day, once; only days, not ledger rows, are placed on the calendar. A
    holding has a row where it is traded and where its price changes hands, not for every day of the book: what each such
    row changes in the holding's value is summed by day over all tickers, and a running sum of that is the book's value.
    Values are kept in whole hundred-millionths, so that changes add up to what they are changes of.
    """
    kind, c = F.col("action"), [F.col(x) for x in ("action", "quantity", "price", "fee", "cash")]
    trade, other = kind.isin("buy", "sell"), ~kind.isin("buy", "sell", "deposit", "withdraw")
    part = lambda when, x: F.sum(F.when(when, x).otherwise(0.0))
    signed = F.when(kind == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    sums = {"q": part(trade, signed), "trade_flow": part(trade, cash_flow(*c)), "other_flow": part(other, cash_flow(*c)), "trade_delta": part(trade, cash_delta(*c)), "other_delta": part(other, cash_delta(*c))}
    owned = keep(ledger.select("book", "ticker").distinct(), "owned")
    closes = keep(prices.select("ticker", "d", "close").join(sized(owned), "ticker").select("book", "ticker", "d", "close"), "closes")
    priced = keep(closes.select("ticker").distinct(), "priced")
    moves = keep(ledger.join(sized(priced), "ticker", "left_semi").groupBy("book", "ticker", "d").agg(*[x.alias(n) for n, x in sums.items()]), "moves")
    daily = keep(moves.groupBy("book", "d").agg(*[F.sum(n).alias(n) for n in sums if n != "q"]), "daily")
    starts = daily.groupBy("book").agg(F.min("d").alias("start"))
    days = keep(closes.select("book", "d").distinct().join(starts, "book").where("d >= start").select("book", "d"), "book-days")
    last = days.groupBy("book").agg(F.max("d").alias("last_day"))
    placed = keep(snap_forward(daily.select("book", "d"), days, ("book",), into="day", width=width), "placed")
    at = daily.join(placed, ["book", "d"]).join(last, "book", "left")
    none = F.lit(None).cast("double")
    traded = moves.where("q <> 0").join(sized(placed.where("day is not null")), ["book", "d"]).select("book", "ticker", F.col("day").alias("d"), none.alias("close"), "q", F.lit(1).alias("traded"))
    marks = closes.select("book", "ticker", "d", "close", none.alias("q"), F.lit(0).alias("traded")).unionByName(traded)
    held = running(marks, ("book", "ticker"), {"shares_": ("sum", F.col("q")), "close_": ("last", F.col("close"))}, ties=("traded", "q", "close"), before_only=True, width=width)
    worth = lambda shares, close: F.coalesce((shares * close).try_cast(WORTH), F.lit(0).cast(WORTH))
    after = worth(F.coalesce("shares_", F.lit(0.0)) + F.coalesce("q", F.lit(0.0)), F.coalesce("close", "close_"))
    changes = held.select("book", "d", (after - worth(F.col("shares_"), F.col("close_"))).alias("change_"))
    by_day = changes.groupBy("book", "d").agg(F.sum("change_").alias("change_"))
    values = running(by_day, ("book",), {"v_": ("sum", F.col("change_"))}, width=width).join(starts, "book").where("d >= start").select("book", "d", F.col("v_").cast("double").alias("v"))
    flows = at.select("book", F.explode(F.array(
        F.struct(F.col("day").alias("d"), (-F.col("trade_flow")).alias("flow"), F.lit(0.0).alias("income"), F.col("trade_delta").alias("delta")),
        F.struct(F.coalesce("day", "last_day").alias("d"), F.lit(0.0).alias("flow"), F.col("other_flow").alias("income"), F.col("other_delta").alias("delta")),
    )).alias("f")).select("book", "f.*").where("d is not null").groupBy("book", "d").agg(F.sum("flow").alias("flow"), F.sum("income").alias("income"), F.sum("delta").alias("delta"))
    return values.join(flows, ["book", "d"], "left").fillna(0.0, ["flow", "income", "delta"])


def value_curve(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """book, d, v of book_days."""
    return book_days(ledger, prices).select("book", "d", "v")


def pnl_curve(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """book, d, pnl: value plus all flows so far, transfers left out."""
    so_far = running(book_days(ledger, prices), ("book",), {"flows_": ("sum", F.col("delta"))})
    return so_far.select("book", "d", (F.col("v") + F.col("flows_")).alias("pnl"))


def daily_returns(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """book, d, r: the day's gain over the value before it and the day's net money in; money out leaves the base alone."""
    before = book_days(ledger, prices).withColumn("v0", F.lag("v").over(Window.partitionBy("book").orderBy("d")))
    gain = F.col("v") - F.col("v0") - F.col("flow") + F.col("income")
    return before.where(F.col("v0") > VALUE_DUST).select("book", "d", ratio(gain, F.col("v0") + F.greatest(F.col("flow"), F.lit(0.0))).alias("r")).where("r is not null")


def performance(returns: DataFrame, key: str = "book") -> DataFrame:
    """key, n, cumulative and annualized as in time_weighted, and depth, ulcer and underwater of the growth index, in one pass."""
    grown = growth_index(returns, key)
    drops = running(grown, (key,), {"top_": ("max", F.col("g"))}).withColumn("dd", ratio(F.col("g"), F.col("top_")) - 1)
    out = drops.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("g", "d").alias("g"), F.min("dd").alias("depth"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"), F.avg((F.col("dd") < 0).cast("double")).alias("underwater")
    )
    return out.select(key, "n", *_growth_rates(), "depth", "ulcer", "underwater")


def _growth_rates() -> tuple[Column, Column]:
    up = F.col("g") > 0
    return F.when(up, F.col("g") - 1).alias("cumulative"), F.when(up & (F.col("n") >= LEAST_OBS), F.pow("g", F.lit(float(TRADING_DAYS)) / F.col("n")) - 1).alias("annualized")


def stale_tails(prices: DataFrame, asof: Column, days: int = 10) -> DataFrame:
    """Tickers whose last close lies more than so many days before the day."""
    return prices.groupBy("ticker").agg(F.max("d").alias("last")).where(F.datediff(asof, "last") > days).select("ticker")


def excluded(ledger: DataFrame, prices: DataFrame, asof: Column, factor: float = 2.0) -> DataFrame:
    """ticker, mismatched, stale: what time-weighted returns and risk leave out, since it would make up a return.

    Tickers with a trade that the prices cannot explain, and those whose prices ended long before the day.
    """
    odd = basis_mismatches(ledger, prices, factor).select("ticker", F.lit(True).alias("mismatched"))
    old = stale_tails(prices, asof).select("ticker", F.lit(True).alias("stale"))
    return odd.join(old, "ticker", "full").fillna(False, ["mismatched", "stale"])


def summary(ledger: DataFrame, values: DataFrame, asof: Column, time_weighted_rows: DataFrame, key: str = "book") -> DataFrame:
    """One row for each key: period_start, asof_date, money_weighted, modified_dietz, twr and twr_cumulative.

    values: key, value, fully_priced. The period starts with the first row that is no transfer. The money-weighted figures
    need the whole value: NULL where any holding has no price. Keys whose ledger is only transfers have 0 for both.
    """
    c = [F.col(x) for x in ("action", "quantity", "price", "fee", "cash")]
    invested = F.min(F.when(~F.col("action").isin("deposit", "withdraw"), F.col("d")))
    start = ledger.groupBy(key).agg(F.coalesce(invested, F.min("d")).alias("period_start"))
    flows = ledger.select(key, "d", cash_flow(*c).alias("flow")).where("flow is not null")
    money = money_weighted(flows, values.select(key, "value"), asof, key)
    dietz = modified_dietz(flows, values.select(key, "value"), asof, key).select(key, F.coalesce("annualized", F.when(F.col("days").isNull(), 0.0)).alias("annualized_dietz"))
    out = start.join(values, key, "left").join(money, key, "left").join(dietz, key, "left").join(time_weighted_rows.select(key, "cumulative", "annualized"), key, "left")
    whole = F.coalesce("fully_priced", F.lit(False))
    return out.select(key, "period_start", asof.alias("asof_date"), F.when(whole, F.col("irr")).alias("money_weighted"), F.when(whole, F.col("annualized_dietz")).alias("modified_dietz"), F.col("annualized").alias("twr"), F.col("cumulative").alias("twr_cumulative"))


def growth_index(returns: DataFrame, key: str = "book", width: int | None = None) -> DataFrame:
    """The running product of 1 + r; the first value is that of the first return."""
    return running(returns, (key,), {"g": ("product", 1 + F.col("r"))}, width=width)


def time_weighted(returns: DataFrame, key: str = "book") -> DataFrame:
    """key, n, cumulative and annualized return; NULL where growth is not positive, annualized also under LEAST_OBS returns."""
    out = returns.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.product(1 + F.col("r")).alias("g"))
    return out.select(key, "n", *_growth_rates())


def money_weighted(flows: DataFrame, values: DataFrame, asof: Column, key: str = "book") -> DataFrame:
    """key, irr: the rate at which all flows (key, d, flow) and the final value (key, value) are worth nothing.

    Newton's method from 0.1 in one expression over each key's flows by day, at most 100 steps. 0 without flows; NULL
    under LEAST_DAYS days, if all flows have one sign, or without convergence.
    """
    one = F.struct((F.datediff("d", "first_d") / YEAR_DAYS).alias("t"), F.col("flow").alias("a"))
    first = Window.partitionBy(key)
    # a day's flows share their exponent, so their sum does; signs are those of the flows themselves
    sums = F.when(F.count("flow") == F.count(F.lit(1)), F.sum("flow")).alias("flow")
    days = flows.groupBy(key, "d").agg(sums, F.max(F.col("flow") > 0).alias("gain"), F.max(F.col("flow") < 0).alias("loss"))
    dated = days.withColumn("first_d", F.min("d").over(first))
    lists = dated.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("x"), F.min("d").alias("first_d"), F.max("gain").alias("gain"), F.max("loss").alias("loss"))
    full = values.join(lists, key, "left").withColumn("days", F.datediff(asof, "first_d"))
    full = full.withColumn("x", F.concat("x", F.array(F.struct((F.col("days") / YEAR_DAYS).alias("t"), F.col("value").alias("a")))))
    state = F.struct(F.lit(0.1).alias("r"), F.lit(0).alias("done"))

    def newton(s, _):
        rate = F.when(1 + s["r"] <= 0, F.lit(-0.999)).otherwise(s["r"])
        f = F.aggregate("x", F.lit(0.0), lambda acc, e: acc + e["a"] / F.pow(1 + rate, e["t"]))
        g = F.aggregate("x", F.lit(0.0), lambda acc, e: acc - e["t"] * e["a"] / F.pow(1 + rate, e["t"] + 1))
        new = rate - F.try_divide(f, g)
        return F.when(s["done"] != 0, s).when(F.abs(g) < 1e-14, F.struct(rate.alias("r"), F.lit(2).alias("done"))).otherwise(F.struct(new.alias("r"), F.when(F.abs(new - rate) < 1e-10, 1).otherwise(0).alias("done")))

    solved = full.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(100)), state, newton))
    signs = (F.col("gain") | (F.col("value") > 0)) & (F.col("loss") | (F.col("value") < 0))
    irr = F.when(F.col("first_d").isNull(), 0.0).when((F.col("days") >= LEAST_DAYS) & signs & (F.col("s.done") == 1), F.col("s.r"))
    return solved.select(key, irr.alias("irr"))


def modified_dietz(flows: DataFrame, values: DataFrame, asof: Column, key: str = "book") -> DataFrame:
    """key, days, dietz (the period's return) and annualized: gain over flows weighted by the time they were at work."""
    # a day's flows were at work for the same time: of a key there is one row for each day, not for each flow
    dated = flows.groupBy(key, "d").agg(F.sum("flow").alias("flow")).withColumn("first_d", F.min("d").over(Window.partitionBy(key)))
    days = F.datediff(asof, "first_d")
    sums = dated.groupBy(key, "first_d").agg(F.sum(-F.col("flow")).alias("c"), F.sum(-F.col("flow") * (days - F.datediff("d", "first_d")) / days).alias("wc"))
    out = values.join(sums, key, "left").withColumn("days", days)
    dietz = F.when(F.col("first_d").isNull() | (F.col("days") <= 0), 0.0).when(F.col("wc") > 0, ratio(F.col("value") - F.col("c"), F.col("wc")))
    out = out.withColumn("dietz", dietz)
    return out.select(key, "days", "dietz", annualize(F.col("dietz"), F.col("days")).alias("annualized"))


def annualize(r: Column, days: Column) -> Column:
    """A period's return for a year; NULL under LEAST_DAYS days, -1 where all is lost."""
    return F.when(days < LEAST_DAYS, None).when(1 + r <= 0, -1.0).otherwise(F.pow(1 + r, YEAR_DAYS / days) - 1)


def basis_mismatches(ledger: DataFrame, prices: DataFrame, factor: float = 2.0) -> DataFrame:
    """Tickers with a trade whose price is at least factor times, or at most a factor-th of, the last close before it, or that has no close before it."""
    trades = priced_rows(ledger, prices).where("action in ('buy', 'sell')").select("ticker", "d", "price")
    back = Window.partitionBy("ticker").orderBy("d", "is_trade").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = prices.select("ticker", "d", "close").withColumns({"price": F.lit(None).cast("double"), "is_trade": F.lit(0)}).unionByName(trades.withColumns({"close": F.lit(None).cast("double"), "is_trade": F.lit(1)}))
    at = both.withColumn("close", F.last("close", ignorenulls=True).over(back)).where("is_trade = 1")
    r = ratio(F.col("price"), F.col("close"))
    return at.where(F.col("close").isNull() | (r >= factor) | (r <= 1 / factor)).select("ticker").distinct()
