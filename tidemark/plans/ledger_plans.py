"""Queries over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import cash_delta, cash_flow
from tidemark.operators import ledger as ops
from tidemark.plans import sql
from tidemark.plans.registry import query
from tidemark.sources import adapters


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns rounded, so that other orders of summation give equal values."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query(f"WITH {sql.LEDGER} SELECT book, ticker, ord, d, action, quantity, round(price, 9) AS price, round(fee, 9) AS fee, round(cash, 9) AS cash FROM ledger")
def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adapters.ledger(spark, sf_dir), "price", "fee", "cash", digits=9)


@query(
    f"WITH {sql.LEDGER} SELECT ticker, ord, d, round(CASE WHEN action = 'buy' THEN -(quantity * price + fee) WHEN action = 'sell' THEN quantity * price - fee"
    " WHEN action IN ('dividend', 'interest') THEN cash - fee WHEN action = 'fee' THEN -fee END, 9) AS flow FROM ledger"
)
def cash_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("action", "quantity", "price", "fee", "cash")]
    return adapters.ledger(spark, sf_dir).select("ticker", "ord", "d", F.round(cash_flow(*c), 9).alias("flow")).where("flow is not null")


@query(
    f"WITH {sql.LEDGER} SELECT book, d, round(sum(CASE WHEN action = 'buy' THEN -(quantity * price + fee) WHEN action = 'sell' THEN quantity * price - fee"
    " WHEN action = 'dividend' THEN cash - fee ELSE -fee END), 7) AS delta FROM ledger GROUP BY 1, 2"
)
def daily_cash_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("action", "quantity", "price", "fee", "cash")]
    return adapters.ledger(spark, sf_dir).groupBy("book", "d").agg(F.round(F.sum(cash_delta(*c)), 7).alias("delta"))


FOLD = """fold AS (SELECT book, ticker, ord, quantity AS s, quantity * price + fee AS c, 0::DOUBLE AS r, fee AS f FROM ledger WHERE ord = 1
  UNION ALL SELECT l.book, l.ticker, l.ord,
   CASE l.action WHEN 'buy' THEN s + quantity WHEN 'sell' THEN s - quantity ELSE s END,
   CASE l.action WHEN 'buy' THEN c + (quantity * price + fee) WHEN 'sell' THEN c - quantity * (c / s) ELSE c END,
   CASE l.action WHEN 'sell' THEN r + (quantity * price - quantity * (c / s) - fee) WHEN 'dividend' THEN r + (cash - fee) WHEN 'fee' THEN r - fee ELSE r END,
   f + fee FROM fold JOIN ledger l ON l.ticker = fold.ticker AND l.ord = fold.ord + 1),
pos AS (SELECT book, ticker, arg_max(s, ord) AS shares, arg_max(c, ord) AS cost_basis, arg_max(r, ord) AS realized, arg_max(f, ord) AS fees FROM fold GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {sql.LEDGER}, {FOLD} SELECT book, ticker, round(shares, 6) AS shares, round(cost_basis, 4) AS cost_basis, round(realized, 4) AS realized, round(fees, 4) AS fees, NULL::VARCHAR AS error FROM pos")
def ledger_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.positions(adapters.ledger(spark, sf_dir))
    return rounded(rounded(out, "shares"), "cost_basis", "realized", "fees", digits=4)


@query(f"WITH RECURSIVE {sql.LEDGER}, {FOLD} SELECT book, round(sum(realized), 3) AS realized, round(sum(CASE WHEN shares > 1e-9 THEN cost_basis ELSE 0 END), 3) AS cost_basis, round(sum(fees), 3) AS fees, count(*) FILTER (WHERE shares > 1e-9) AS n_held FROM pos GROUP BY 1")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.col("shares") > ops.DUST
    out = ops.positions(adapters.ledger(spark, sf_dir)).groupBy("book").agg(F.sum("realized").alias("realized"), F.sum(F.when(held, F.col("cost_basis")).otherwise(0.0)).alias("cost_basis"), F.sum("fees").alias("fees"), F.count_if(held).alias("n_held"))
    return rounded(out, "realized", "cost_basis", "fees", digits=3)


@query(
    f"WITH {sql.LEDGER}, {sql.SPLITS}, fac AS (SELECT l.ticker, l.ord, coalesce(product(s.ratio), 1) AS factor FROM ledger l LEFT JOIN splits s ON s.ticker = l.ticker AND s.d > l.d GROUP BY 1, 2)"
    " SELECT ticker, ord, factor, round(CASE WHEN action IN ('buy', 'sell') THEN quantity * factor ELSE quantity END, 9) AS quantity, round(CASE WHEN action IN ('buy', 'sell') THEN price / factor ELSE price END, 9) AS price FROM ledger JOIN fac USING (ticker, ord)"
)
def split_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.adjust_for_splits(adapters.ledger(spark, sf_dir), adapters.splits(spark, sf_dir))
    return rounded(out.select("ticker", "ord", "factor", "quantity", "price"), "quantity", "price", digits=9)


@query(
    f"WITH {sql.px('month')}, f AS (SELECT *, CASE WHEN month(d) = 6 THEN 2.0::DOUBLE WHEN month(d) = 11 THEN 0.5 ELSE 1.0 END AS split_factor FROM px)"
    " SELECT ticker, d, round(close / coalesce(product(split_factor) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 6) AS adjusted FROM f"
)
def split_reverse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.prices(spark, sf_dir, "month").withColumn("split_factor", F.when(F.month("d") == 6, 2.0).when(F.month("d") == 11, 0.5).otherwise(1.0))
    return rounded(ops.reverse_adjusted(rows).select("ticker", "d", "adjusted"), "adjusted")


@query(
    f"WITH {sql.LEDGER} SELECT DISTINCT a.ticker, a.d, round(a.fee, 6) AS fee, round(b.fee, 6) AS trade_fee FROM ledger a JOIN ledger b ON a.ticker = b.ticker AND a.d = b.d"
    " WHERE a.action = 'fee' AND a.fee > 0 AND b.action IN ('buy', 'sell') AND b.fee > 0 AND abs(a.fee - b.fee) <= 1e-9 * greatest(a.fee, b.fee)"
)
def duplicate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.doubled_costs(adapters.ledger(spark, sf_dir)), "fee", "trade_fee")
