"""Running products, sums, extremes and fills of ordered series, in blocks where a series may be long.

A window over a whole series is one task. A series of days has some ten thousand rows at most, so one task does; a
finer one has no such bound. There a series is cut into blocks of its order: each block is run through by itself, is
reduced to one row that tells what it carries on (its product, sum, extreme or last value), those rows are run through,
and each block's rows take what comes from before. Both readings of the rows share one exchange, and a series of any
length is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a block covers when nothing else is asked for: seconds of a timestamp's series, steps of a whole number's.
SECONDS, STEPS = 3600, 4096
BLOCK = "block_"


def block_of(df: DataFrame, order: str, width: int | None) -> Column | None:
    """The number of a row's block: order (a day, a timestamp or a whole number) by width; None for days without a width."""
    kind = df.schema[order].dataType.simpleString()
    if kind == "date":
        return None if width is None else F.floor(F.unix_date(order) / width)
    if kind.startswith("timestamp"):
        return F.floor(F.unix_micros(F.col(order).cast("timestamp")) / ((width or SECONDS) * 1_000_000))
    return F.floor(F.col(order) / (width or STEPS))


def _one(kind: str, x: Column, by: Column, backward: bool) -> Column:
    """What a block carries on."""
    if kind == "last":
        known = F.when(x.isNotNull(), by)
        return F.min_by(x, known) if backward else F.max_by(x, known)
    return {"product": F.product, "sum": F.sum, "max": F.max, "min": F.min}[kind](x)


def _both(kind: str, before: Column, here: Column) -> Column:
    if kind == "last":
        return F.coalesce(here, before)
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(before, here)
    joined = before * here if kind == "product" else before + here
    return F.coalesce(joined, here, before)


def running(df: DataFrame, keys: tuple[str, ...], values: dict[str, tuple[str, Column]], order: str = "d", ties: tuple[str, ...] = (), backward: bool = False, before_only: bool = False, width: int | None = None) -> DataFrame:
    """df and, of each value (name: kind and expression), what it comes to from the start of the row's series to the row.

    Kinds: product, sum, max, min, and last (the last value that is not NULL). Other NULLs are passed over; NULL before
    the first value. Rows are in the order of the columns order and ties, from the end if backward. before_only leaves
    the row itself out. Series of days are run through whole, others in blocks of order; width (days, seconds or steps)
    asks for blocks of another width, and for blocks of days. Rows of one series whose order and ties are equal should
    be equal as well.
    """
    turn = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    sequence = [turn(c) for c in (order, *ties)]
    block = block_of(df, order, width)
    frame = (Window.unboundedPreceding, -1 if before_only else Window.currentRow)
    over = lambda w, kind, x: F.last(x, ignorenulls=True).over(w) if kind == "last" else _one(kind, x, F.lit(0), False).over(w)
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(*sequence).rowsBetween(*frame)
        return df.select("*", *[over(whole, kind, x).alias(name) for name, (kind, x) in values.items()])
    dealt = df.withColumn(BLOCK, block).repartition(*keys, BLOCK)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*sequence).rowsBetween(*frame)
    own = dealt.select("*", *[over(inside, kind, x).alias(f"{name}_in") for name, (kind, x) in values.items()])
    by = F.struct(order, *ties)
    carried = dealt.groupBy(*keys, BLOCK).agg(*[_one(kind, x, by, backward).alias(f"{name}_all") for name, (kind, x) in values.items()])
    ahead = Window.partitionBy(*keys).orderBy(turn(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col(BLOCK).alias("block_of_"), *[over(ahead, kind, F.col(f"{name}_all")).alias(f"{name}_before") for name, (kind, _) in values.items()])
    same = (own[BLOCK] == carried["block_of_"]) & _same_keys(own, carried, keys)
    met = own.join(carried, same, "left")
    return met.select(*df.columns, *[_both(kind, F.col(f"{name}_before"), F.col(f"{name}_in")).alias(name) for name, (kind, _) in values.items()])


def _same_keys(own: DataFrame, carried: DataFrame, keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= own[k].eqNullSafe(carried[f"{k}_of"])
    return out
