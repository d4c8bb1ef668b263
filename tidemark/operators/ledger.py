"""The ordered ledger fold: average-cost positions, realised profit, and the splits and checks around it."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidemark.operators.scan import running
from tidemark.sources.shared import keep

DUST = 1e-9
#: Steps of ord in one stretch of a holding, and how often stretches behind broken rows are folded again.
BLOCK_ROWS, ROUNDS = 4096, 3
NUMBERS = ("quantity", "price", "fee", "cash")
STRETCH = ("start", "shares", "scale", "added", "gained", "per_cost", "fees", "moved")
CASH = "CASH"


def positions(ledger: DataFrame, keys: tuple[str, ...] = ("book", "ticker"), width: int = BLOCK_ROWS) -> DataFrame:
    """keys, shares, cost_basis, realized, fees, error of every holding after its rows in order (column ord, a number).

    Buys add to the cost, sells take shares at the average cost, income and costs are realised. error names the first row
    that breaks the contract (a sale of what is not held, a trade of cash, a transfer of a security), and the fold goes
    on without that row. Transfers, income and costs of cash are no holdings: see cash_totals. Rows of one ord are taken
    by the other columns; without an ord they come first.

    A holding's rows are folded in stretches of ord (width). Where the shares at a stretch's start are known, what it
    does to cost and profit is linear in the cost before it, so stretches are folded each by itself and put together.
    All stretches are first folded from no shares, which is right for the first of each holding, and tell what they bought
    less what they sold; those that start with shares are folded again from the sum of that, and those behind a row that was
    left out from what the stretches before leave. So a holding of one stretch is read once. A holding with a figure that is
    missing or not finite is folded in one go.
    """
    rows, held = _holding_rows(ledger, keys)
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("ord") / width), F.lit(-(1 << 62))))
    by = [*held, "stretch"]
    folded = keep(_fold_stretches(rows, None, held), "stretches")
    for k in range(ROUNDS + 1):
        if k == 0:
            at = folded.select(*by, "moved", F.col("start").alias("taken"))
        else:
            sound = folded.withColumn("lost", F.max("odd").over(Window.partitionBy(*held))).where("not lost")
            at = sound.select(*by, (F.col("shares") - F.col("start")).alias("moved"), F.col("start").alias("taken"))
        starts = _starts(at, held, "taken")
        wrong = keep(starts.where(~_near(F.col("start"), F.col("taken"))).select(*by, "start"), "wrong-starts")
        if wrong.limit(1).count():
            again = _fold_stretches(_where(rows, wrong, by, "left_semi"), wrong, held)
            folded = keep(_where(folded, wrong, by, "left_anti").unionByName(again), "stretches")
        elif k:
            break
    composed = keep(_compose(folded, held), "holdings")
    figures = ["shares", "cost_basis", "realized", "fees", "error"]
    out, unsettled = composed.where("settled").select(*held, *figures), composed.where("not settled")
    if unsettled.limit(1).count():
        out = out.unionByName(_fold_in_order(_where(rows, unsettled, held, "left_semi"), held).select(*held, *figures))
    return out.select(*[F.col(h).alias(k) for k, h in zip(keys, held, strict=True)], *figures)


def _holding_rows(ledger: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """The rows that concern holdings, with actions out of place named so; the keys under names that cannot clash."""
    is_transfer = F.col("action").isin("deposit", "withdraw")
    rows = ledger.where(F.when(F.col("ticker") == CASH, F.col("action").isin("buy", "sell")).otherwise(True))
    odd = F.when(is_transfer, "transfer").when(F.col("ticker") == CASH, "cash trade").otherwise(F.col("action"))
    rows = rows.withColumn("action", odd)
    numbers = [F.col(c).cast("double").alias(c) for c in NUMBERS]
    held = [f"k_{i}" for i in range(len(keys))]
    return rows.select(*[F.col(k).alias(h) for k, h in zip(keys, held, strict=True)], "ord", F.col("d").cast("string").alias("d"), "action", *numbers), held


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= DUST + 1e-12 * F.abs(a)


def _where(rows: DataFrame, found: DataFrame, by: list[str], how: str) -> DataFrame:
    """The rows that are found (left_semi) or not (left_anti) by columns that may be missing."""
    named = found.select(*[F.col(c).alias(f"{c}_found") for c in by])
    same = F.lit(True)
    for c in by:
        same &= rows[c].eqNullSafe(named[f"{c}_found"])
    return rows.join(named, same, how)


def _starts(sums: DataFrame, held: list[str], *others: str) -> DataFrame:
    """held, stretch, start and others: the shares before each stretch, of how many each moved."""
    before = F.coalesce(F.sum("moved").over(Window.partitionBy(*held).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    at = sums.select(*held, "stretch", before.alias("start"), *others)
    return at.withColumn("start", F.when(F.abs("start") < DUST, 0.0).otherwise(F.col("start")))


def _fold_stretches(rows: DataFrame, starts: DataFrame | None, held: list[str]) -> DataFrame:
    """held, stretch, start, shares (at its end), scale, added, gained, per_cost, fees, moved, error, odd of every stretch.

    A cost c before the stretch becomes scale * c + added; profit grows by gained - per_cost * c. moved is what was bought
    less what was sold, also by rows left out; odd is whether a figure is missing or not finite. Without starts (held,
    stretch, start) every stretch starts with no shares. Stretches are put in order by a window: rows that are dealt out
    by a key of the holding already, as by the window that numbers them, stay where they are.
    """
    both = rows.select(*held, "stretch", F.lit(1).alias("is_row"), "ord", "d", "action", *NUMBERS, F.lit(None).cast("double").alias("start"))
    if starts is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("d", "string"), ("action", "string"), *((c, "double") for c in NUMBERS))]
        both = starts.select(*held, "stretch", F.lit(0).alias("is_row"), F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), *none, "start").unionByName(both)
    step = F.row_number().over(Window.partitionBy(*held, "stretch").orderBy("is_row", "ord", "d", "action", *NUMBERS))
    dealt = both.select(*held, "stretch", step.alias("step"), "is_row", "d", "action", *NUMBERS, "start")
    schema = StructType([*(rows.schema[h] for h in held), rows.schema["stretch"], *(StructField(c, DoubleType()) for c in STRETCH), StructField("error", StringType()), StructField("odd", BooleanType())])
    kinds = [(f.name, f.dataType) for f in schema.fields]

    def fold(batches):
        names, types = [n for n, _ in kinds], to_arrow_schema(StructType([StructField(n, t) for n, t in kinds]))
        key, state = None, None
        for batch in batches:
            done = []
            days, starts_ = batch.column("d"), batch.column("start")
            columns = [batch.column(c).to_pylist() for c in ("step", "is_row", "action", *NUMBERS)]
            for k, (step, is_row, action, q, price, fee, cash) in enumerate(zip(*columns, strict=True)):
                if step == 1:
                    if state is not None:
                        done.append((*key, *state))
                    start = starts_[k].as_py() or 0.0
                    key, state = [batch.column(c)[k].as_py() for c in (*held, "stretch")], [start, start, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, False]
                if is_row:
                    _fold_linear(state, days, k, action, q, price, fee, cash)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((*key, *state), types, strict=True)], names=names)

    return dealt.mapInArrow(fold, schema)


def _fold_linear(state: list, days: pa.Array, k: int, action: str, q: float | None, price: float | None, fee: float | None, cash: float | None) -> None:
    """One more row of a stretch, the k-th of a batch: state is what STRETCH names, error and odd."""
    _, s, scale, added, gained, per_cost, fees, _, error, _ = state
    if action in ("transfer", "cash trade"):
        if error is None and days[k].is_valid:
            state[8] = _breach(action, days[k].as_py())
        return
    if action in ("buy", "sell"):
        if q is not None and q == q:
            state[7] += q if action == "buy" else -q
        known = q is not None and price is not None and fee is not None and math.isfinite(q + price + fee)
    elif action in ("dividend", "interest"):
        known = cash is not None and fee is not None and math.isfinite(cash + fee)
    else:
        known = fee is not None and math.isfinite(fee)
    if not known:
        state[9] = True
        return
    if action == "sell":
        if s <= 0 or q > s + DUST:
            if error is None and days[k].is_valid:
                state[8] = _breach("nothing" if s <= 0 else "more", days[k].as_py())
            return
        part = q / s
        state[4], state[5] = gained + q * price - part * added - fee, per_cost + part * scale
        if s - q < DUST:
            state[1:4] = 0.0, 0.0, 0.0
        else:
            state[1:4] = s - q, scale * (1 - part), added * (1 - part)
    elif action == "buy":
        state[1], state[3] = s + q, added + q * price + fee
    elif action in ("dividend", "interest"):
        state[4] = gained + cash - fee
    elif action == "fee":
        state[4] = gained - fee
    state[6] = fees + fee


def _compose(stretches: DataFrame, held: list[str]) -> DataFrame:
    """held, shares, cost_basis, realized, fees, error and settled: the stretches of each holding one after the other.

    A stretch is one row, so a holding of any size is few rows here. Not settled are holdings with odd stretches, and
    those of which a stretch was folded from other shares than the stretches before it leave.
    """
    dealt = stretches.repartition(*held).sortWithinPartitions(*held, "stretch")
    figures = ("shares", "cost_basis", "realized", "fees")
    schema = StructType([*(stretches.schema[h] for h in held), *(StructField(c, DoubleType()) for c in figures), StructField("error", StringType()), StructField("settled", BooleanType())])
    kinds = [(f.name, f.dataType) for f in schema.fields]

    def compose(batches):
        names, types = [n for n, _ in kinds], to_arrow_schema(StructType([StructField(n, t) for n, t in kinds]))
        key, state = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in (*held, *STRETCH, "error", "odd")]
            for *own, start, shares, scale, added, gained, per_cost, fees, _, error, odd in zip(*columns, strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = own, (0.0, 0.0, 0.0, 0.0, None, True)
                s, c, r, f, e, settled = state
                settled = settled and not odd and abs(s - start) <= DUST + 1e-12 * abs(s)
                state = (shares, scale * c + added, r + gained - per_cost * c, f + fees, e if e is not None else error, settled)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((*key, *state), types, strict=True)], names=names)

    return dealt.mapInArrow(compose, schema)


def _breach(what: str, d: str) -> str:
    said = {"transfer": f"transfer on {d}: only cash is paid in or out", "cash trade": f"cash trade on {d}: cash is not bought or sold", "nothing": f"nothing is held to sell on {d}", "more": f"more is sold than is held on {d}"}
    return said[what]


def _fold_in_order(rows: DataFrame, held: list[str]) -> DataFrame:
    """positions() of rows whose figures may be missing: each holding as one stream of rows."""
    dealt = rows.repartition(*held).sortWithinPartitions(*held, "ord", "d", "action", *NUMBERS)
    figures = ["shares", "cost_basis", "realized", "fees"]
    schema = StructType([*(rows.schema[h] for h in held), *(StructField(c, DoubleType()) for c in figures), StructField("error", StringType())])
    kinds = [(f.name, f.dataType) for f in schema.fields]

    def fold(batches):
        names = [*held, *figures, "error"]
        types = to_arrow_schema(StructType([StructField(n, t) for n, t in kinds]))
        key, state = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in (*held, "d", "action", *NUMBERS)]
            for *own, d, action, q, price, fee, cash in zip(*columns, strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = own, (0.0, 0.0, 0.0, 0.0, None)
                state = _fold_row(state, d, action, q, price, fee, cash)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((*key, *state), types, strict=True)], names=names)

    return dealt.mapInArrow(fold, schema)


def _fold_row(state: tuple, d: str | None, action: str, q: float | None, price: float | None, fee: float | None, cash: float | None) -> tuple:
    """shares, cost, realised profit, fees and error after one more row; a missing figure makes those that need it missing."""
    s, c, r, f, e = state
    if action in ("transfer", "cash trade"):
        return s, c, r, f, e if e is not None or d is None else _breach(action, d)
    known = lambda *x: None not in x
    if action == "sell" and (s is None or s > 0 and q is None):
        pass  # nothing can be said of it but its fee
    elif action == "sell":
        none = s <= 0
        if none or q > s + DUST or q != q and s == s:
            return s, c, r, f, e if e is not None or d is None else _breach("nothing" if none else "more", d)
        cost = q * (c / s) if known(c) else None
        r = r + (q * price - cost - fee) if known(r, price, cost, fee) else None
        s, c = (0.0, 0.0) if s - q < DUST else (s - q, c - cost if known(cost) else None)
    elif action == "buy":
        c = c + (q * price + fee) if known(c, q, price, fee) else None
        s = s + q if known(s, q) else None
    elif action in ("dividend", "interest"):
        r = r + (cash - fee) if known(r, cash, fee) else None
    elif action == "fee":
        r = r - fee if known(r, fee) else None
    return s, c, r, f + fee if known(f, fee) else None, e


def cash_totals(ledger: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """keys, cash_realized: income less costs of the cash rows."""
    rows = ledger.where((F.col("ticker") == CASH) & F.col("action").isin("dividend", "interest", "fee"))
    return rows.groupBy(*keys).agg(F.sum(F.when(F.col("action") == "fee", -F.col("fee")).otherwise(F.col("cash") - F.col("fee"))).alias("cash_realized"))


def later_splits(rows: DataFrame, splits: DataFrame, width: int | None = None) -> DataFrame:
    """rows (with ticker and d) and factor: the product of the ratios of the ticker's splits after that day; 1 without any.

    A running product of the ratios, read backwards over the splits and the distinct days of the rows, which then take
    what their day has: no inequality join, and no task holds a ticker's rows.
    """
    marks = splits.where("ratio > 0").select("ticker", "d", F.col("ratio").alias("ratio_"), F.lit(0).alias("is_row_"))
    days = rows.select("ticker", "d").distinct().select("ticker", "d", F.lit(None).cast("double").alias("ratio_"), F.lit(1).alias("is_row_"))
    after = running(marks.unionByName(days), ("ticker",), {"factor": ("product", F.col("ratio_"))}, ties=("is_row_",), backward=True, width=width)
    placed = after.where("is_row_ = 1").select("ticker", "d", "factor")
    return rows.join(placed, ["ticker", "d"], "left").select(*rows.columns, F.coalesce("factor", F.lit(1.0)).alias("factor"))


def adjust_for_splits(ledger: DataFrame, splits: DataFrame) -> DataFrame:
    """The ledger with quantities and prices of trades in today's shares."""
    trade = F.col("action").isin("buy", "sell") & (F.abs(F.col("factor") - 1) > DUST)
    return later_splits(ledger, splits).withColumns({"quantity": F.when(trade, F.col("quantity") * F.col("factor")).otherwise(F.col("quantity")), "price": F.when(trade, F.col("price") / F.col("factor")).otherwise(F.col("price"))})


def reverse_adjusted(rows: DataFrame, width: int | None = None) -> DataFrame:
    """rows (ticker, d, close, split_factor) and adjusted: the close divided by the factors of all later days."""
    later = running(rows, ("ticker",), {"later_": ("product", F.col("split_factor"))}, backward=True, before_only=True, width=width)
    return later.select(*rows.columns, (F.col("close") / F.coalesce("later_", F.lit(1.0))).alias("adjusted"))


def doubled_costs(ledger: DataFrame) -> DataFrame:
    """ticker, d, fee, trade_fee: costs booked by themselves that equal the fee of a trade of the same day."""
    fees = ledger.where("action = 'fee' and fee > 0").select("ticker", "d", "fee")
    trades = ledger.where("action in ('buy', 'sell') and fee > 0").select("ticker", "d", F.col("fee").alias("trade_fee"))
    return fees.join(trades, ["ticker", "d"]).where(F.abs(F.col("fee") - F.col("trade_fee")) <= 1e-9 * F.greatest("fee", "trade_fee")).distinct()
