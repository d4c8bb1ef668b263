"""Column expressions that several operators use. A missing or non-finite figure is NULL everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), None).otherwise(x)


def usable_price(x: Column) -> Column:
    """Whether a close is finite and above zero. NaN compares as the largest value, so it is excluded by name."""
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < INF)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def action_rank(action: Column) -> Column:
    """Order of the actions of one day: money and shares come in, income and costs, shares go out, money goes out."""
    return F.when(action.isin("deposit", "buy"), 0).when(action.isin("dividend", "fee", "interest"), 1).when(action == "sell", 2).otherwise(3)


def cash_flow(action: Column, quantity: Column, price: Column, fee: Column, cash: Column) -> Column:
    """The investor's signed flow of one ledger row: what trades cost and bring, and income; NULL for transfers."""
    return F.when(action == "buy", -(quantity * price + fee)).when(action == "sell", quantity * price - fee).when(action.isin("dividend", "interest"), cash - fee).when(action == "fee", -fee)


def cash_delta(action: Column, quantity: Column, price: Column, fee: Column, cash: Column) -> Column:
    """The row's effect on the cash balance, transfers included."""
    return F.when(action == "deposit", cash).when(action == "withdraw", -cash).otherwise(F.coalesce(cash_flow(action, quantity, price, fee, cash), F.lit(0.0)))


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula, made plain by an apostrophe."""
    return F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def is_ticker(text: Column) -> Column:
    """Whether the text, trimmed and in upper case, has the shape of a ticker (a fixed value)."""
    return F.upper(F.trim(text)).rlike("^[A-Z0-9.\\-]{1,15}$")


def fixed(x: Column, digits: int = 2, plus: bool = False, commas: bool = False) -> Column:
    """A number with so many decimals (at most three), rounded as the binary number that it is, halves to even.

    Formatting functions round the shortest decimal spelling, so that 2.675, which is less, would become 2.68. Here the
    fraction is taken as 60 binary places and what lies behind them, multiplied by the power of ten in two halves of 30
    bits, and compared with a half in whole numbers. A negative number keeps its sign where nothing else is left of it.
    NULL for what is missing or not finite.
    """
    ten, low30 = 10**digits, (1 << 30) - 1
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  worked out once

    def split(v: Column) -> Column:
        size = F.abs(v)
        fraction = size % F.lit(1.0)
        scaled = fraction * float(1 << 60)
        places = scaled.try_cast("long")
        return F.struct(v.alias("v"), (size - fraction).try_cast("long").alias("whole"), places.alias("places"), (scaled - places.cast("double")).alias("behind"))

    def times_ten(p: Column) -> Column:
        lower = p["places"].bitwiseAND(F.lit(low30)) * ten
        return F.struct(p["v"].alias("v"), p["whole"].alias("whole"), p["behind"].alias("behind"), lower.alias("lower"), (F.shiftright(p["places"], 30) * ten + F.shiftright(lower, 30)).alias("upper"))

    def rounded(p: Column) -> Column:
        number = F.shiftright(p["upper"], 30)
        rest = F.shiftleft(p["upper"].bitwiseAND(F.lit(low30)), 30) + p["lower"].bitwiseAND(F.lit(low30))
        odd = (p["whole"] if digits == 0 else number) % 2 == 1
        more = let((rest - (1 << 59)).cast("double") + p["behind"] * ten, lambda over: ((over > 0) | ((over == 0) & odd)).cast("long"))
        return F.struct(p["v"].alias("v"), p["whole"].alias("whole"), (number + more).alias("number"))

    def spelled(p: Column) -> Column:
        whole = p["whole"] + (p["number"] == ten).cast("long")
        sign = F.when(p["v"] < 0, "-").otherwise("+" if plus else "")
        parts = [sign, F.format_number(whole, 0) if commas else whole.cast("string")]
        return F.concat(*(parts if digits == 0 else [*parts, F.lit("."), F.lpad((p["number"] % ten).cast("string"), digits, "0")]))

    exact = let(x.cast("double"), lambda v: let(split(v), lambda p: let(times_ten(p), lambda q: let(rounded(q), spelled))))
    # beyond whole numbers of 63 bits there is nothing to round
    large = F.format_string(f"%{'+' if plus else ''}{',' if commas else ''}.{digits}f", x.cast("double"))
    return F.when(finite(x.cast("double")).isNull(), None).when(F.abs(x) < float(1 << 62), exact).otherwise(large)


def signed_percent(x: Column) -> Column:
    """A share as a signed percentage with two decimals, n/a where missing."""
    return F.coalesce(F.concat(fixed(x * 100, 2, plus=True), F.lit("%")), F.lit("n/a"))


def dollars(x: Column) -> Column:
    """An amount in whole dollars with separators, the sign before the unit, n/a where missing."""
    return F.coalesce(F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), fixed(F.abs(x), 0, commas=True)), F.lit("n/a"))


def human(x: Column) -> Column:
    """A count with a unit of thousands, millions, billions or trillions: two decimals under ten, else one."""
    out = fixed(x, 0)
    for unit, size in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
        scaled = x / size
        out = F.when(F.abs(x) >= size, F.concat(F.when(F.abs(scaled) < 10, fixed(scaled, 2)).otherwise(fixed(scaled, 1)), F.lit(unit))).otherwise(out)
    return F.when(finite(x).isNull(), "n/a").otherwise(out)


def band(x: Column, cuts: list[float], labels: list[str], magnitude: bool = False) -> Column:
    """The label of the first cut that the value lies below; the last label beyond all."""
    v = F.abs(x) if magnitude else x
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels[:-1], strict=True))):
        out = F.when(v < cut, label).otherwise(out)
    return F.when(x.isNotNull(), out)
