"""Queries over price series and books: alignment, curves and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import cash_flow
from tidemark.operators import align, returns
from tidemark.plans import sql
from tidemark.plans.ledger_plans import rounded
from tidemark.plans.registry import query
from tidemark.sources import adapters

#: The day as of which books are valued.
ASOF = "2001-08-31"

CURVE = f"""{sql.LEDGER}, {sql.SUPPLIER_PX},
starts AS (SELECT book, min(d) AS start FROM ledger GROUP BY 1), owned AS (SELECT DISTINCT book, ticker FROM ledger),
cal AS (SELECT DISTINCT o.book, s.d FROM spx s JOIN owned o USING (ticker) JOIN starts t ON t.book = o.book WHERE s.d >= t.start),
calx AS (SELECT book, d, max(d) OVER (PARTITION BY book) AS last_day FROM cal),
snap AS (SELECT l.*, c.d AS exact FROM ledger l ASOF LEFT JOIN cal c ON l.book = c.book AND l.d <= c.d),
placed AS (SELECT s.*, CASE WHEN action IN ('buy', 'sell') THEN exact ELSE coalesce(exact, last_day) END AS day FROM snap s JOIN (SELECT DISTINCT book, last_day FROM calx) USING (book)),
moved AS (SELECT book, ticker, day AS d, sum(CASE action WHEN 'buy' THEN quantity ELSE -quantity END) AS q FROM placed WHERE action IN ('buy', 'sell') AND day IS NOT NULL GROUP BY 1, 2, 3),
grid AS (SELECT book, ticker, d FROM cal JOIN owned USING (book)),
sh AS (SELECT book, ticker, d, sum(coalesce(q, 0)) OVER (PARTITION BY book, ticker ORDER BY d) AS shares FROM grid LEFT JOIN moved USING (book, ticker, d)),
fill AS (SELECT s.book, s.ticker, s.d, s.shares, p.close FROM sh s ASOF LEFT JOIN spx p ON s.ticker = p.ticker AND s.d >= p.d),
val AS (SELECT book, d, sum(coalesce(shares * close, 0)) AS v FROM fill GROUP BY 1, 2),
flows AS (SELECT book, day AS d, sum(CASE action WHEN 'buy' THEN quantity * price + fee WHEN 'sell' THEN -(quantity * price - fee) ELSE 0 END) AS flow,
  sum(CASE action WHEN 'dividend' THEN cash - fee WHEN 'fee' THEN -fee ELSE 0 END) AS income FROM placed WHERE day IS NOT NULL GROUP BY 1, 2),
j AS (SELECT v.book, v.d, v, coalesce(flow, 0) AS flow, coalesce(income, 0) AS income, lag(v) OVER (PARTITION BY v.book ORDER BY v.d) AS v0 FROM val v LEFT JOIN flows f ON f.book = v.book AND f.d = v.d),
ret AS (SELECT book, d, (v - v0 - flow + income) / (v0 + greatest(flow, 0)) AS r FROM j WHERE v0 > 1e-6),
idx AS (SELECT book, d, r, product(1 + r) OVER (PARTITION BY book ORDER BY d) AS g FROM ret)"""


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return adapters.ledger(spark, sf_dir), adapters.supplier_prices(spark, sf_dir)


@query(f"WITH {sql.px()} SELECT DISTINCT d FROM px")
def union_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.calendar(adapters.prices(spark, sf_dir))


@query(
    f"WITH {sql.px()}, cal AS (SELECT DISTINCT d FROM px WHERE d >= DATE '1996-01-01'), tk AS (SELECT DISTINCT ticker FROM px), grid AS (SELECT * FROM cal, tk)"
    " SELECT g.ticker, g.d, round(p.close, 6) AS close FROM grid g ASOF LEFT JOIN px p ON g.ticker = p.ticker AND g.d >= p.d"
)
def asof_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.prices(spark, sf_dir)
    grid = align.calendar(px).where("d >= '1996-01-01'").crossJoin(F.broadcast(px.select("ticker").distinct()))
    return rounded(align.asof_fill(px, grid), "close")


@query(f"WITH {sql.LEDGER}, cal AS (SELECT DISTINCT book, d FROM ledger WHERE day(d) <= 3 AND d < DATE '2001-06-01') SELECT l.ticker, l.ord, c.d AS day FROM ledger l ASOF LEFT JOIN cal c ON l.book = c.book AND l.d <= c.d")
def snap_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = adapters.ledger(spark, sf_dir)
    days = ledger.where("day(d) <= 3 and d < '2001-06-01'").select("book", "d").distinct()
    return align.snap_forward(ledger.select("book", "ticker", "ord", "d"), days, ("book",)).select("ticker", "ord", "day")


@query(
    f"WITH {sql.LEDGER}, cal AS (SELECT DISTINCT book, d FROM ledger WHERE day(d) <= 3 AND d < DATE '2001-06-01'), mx AS (SELECT book, max(d) AS m FROM cal GROUP BY 1)"
    " SELECT l.ticker, l.ord, coalesce(c.d, m) AS day FROM ledger l ASOF LEFT JOIN cal c ON l.book = c.book AND l.d <= c.d JOIN mx ON mx.book = l.book"
)
def snap_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = adapters.ledger(spark, sf_dir)
    days = ledger.where("day(d) <= 3 and d < '2001-06-01'").select("book", "d").distinct()
    return align.snap_forward(ledger.select("book", "ticker", "ord", "d"), days, ("book",), clamp=True).select("ticker", "ord", "day")


@query(f"WITH {sql.px()} SELECT ticker, max(d) AS asof_date, round(arg_max(close, d), 6) AS close FROM px WHERE d <= DATE '2000-02-29' GROUP BY 1")
def latest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.latest(adapters.prices(spark, sf_dir), F.lit("2000-02-29").cast("date")), "close")


@query(f"WITH {sql.SUPPLIER_PX} SELECT ticker FROM spx GROUP BY 1 HAVING date_diff('day', max(d), DATE '2001-11-12') > 10")
def stale_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.stale_tails(adapters.supplier_prices(spark, sf_dir), F.lit("2001-11-12").cast("date"))


@query(
    f"WITH {sql.LEDGER}, {sql.SUPPLIER_PX}, t AS (SELECT l.ticker, l.price, p.close FROM ledger l ASOF LEFT JOIN spx p ON l.ticker = p.ticker AND l.d >= p.d WHERE l.action IN ('buy', 'sell') AND l.ticker IN (SELECT ticker FROM spx)),"
    " m AS (SELECT DISTINCT ticker FROM t WHERE close IS NULL OR price / close >= 2.05 OR price / close <= 1 / 2.05::DOUBLE), s AS (SELECT ticker FROM spx GROUP BY 1 HAVING date_diff('day', max(d), DATE '2001-11-12') > 10)"
    " SELECT coalesce(m.ticker, s.ticker) AS ticker, m.ticker IS NOT NULL AS mismatched, s.ticker IS NOT NULL AS stale FROM m FULL JOIN s USING (ticker)"
)
def twr_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.excluded(*_book(spark, sf_dir), F.lit("2001-11-12").cast("date"), factor=2.05)


@query(f"WITH {CURVE} SELECT book, d, round(v, 3) AS v FROM val")
def value_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.value_curve(*_book(spark, sf_dir)), "v", digits=3)


@query(f"WITH {CURVE} SELECT book, d, round(v + sum(income - flow) OVER (PARTITION BY book ORDER BY d), 2) AS pnl FROM j")
def pnl_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.pnl_curve(*_book(spark, sf_dir)), "pnl", digits=2)


@query(f"WITH {CURVE} SELECT book, d, round(r, 8) AS r FROM ret")
def daily_twr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.daily_returns(*_book(spark, sf_dir)), "r", digits=8)


@query(f"WITH {CURVE} SELECT book, d, round(g, 8) AS g FROM idx")
def growth_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.growth_index(returns.daily_returns(*_book(spark, sf_dir))).select("book", "d", "g"), "g", digits=8)


@query(f"WITH {CURVE}, t AS (SELECT book, count(*) AS n, product(1 + r) AS g FROM ret GROUP BY 1) SELECT book, n, round(CASE WHEN g > 0 THEN g - 1 END, 8) AS cumulative, round(CASE WHEN g > 0 AND n >= 126 THEN g ** (252.0::DOUBLE / n) - 1 END, 8) AS annualized FROM t")
def twr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.time_weighted(returns.daily_returns(*_book(spark, sf_dir))), "cumulative", "annualized", digits=8)


@query(
    f"WITH {CURVE}, t AS (SELECT book, count(*) AS n, product(1 + r) AS g FROM ret GROUP BY 1), c AS (SELECT book, d, g / max(g) OVER (PARTITION BY book ORDER BY d) - 1 AS dd FROM idx)"
    " SELECT book, any_value(n) AS n, round(any_value(t.g) - 1, 8) AS cumulative, round(any_value(t.g) ** (252.0::DOUBLE / any_value(n)) - 1, 8) AS annualized, round(min(dd), 8) AS depth, round(sqrt(avg(dd * dd)), 8) AS ulcer, round(avg(CASE WHEN dd < 0 THEN 1.0::DOUBLE ELSE 0 END), 8) AS underwater FROM c JOIN t USING (book) GROUP BY book"
)
def book_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.performance(returns.daily_returns(*_book(spark, sf_dir))), "cumulative", "annualized", "depth", "ulcer", "underwater", digits=8)


FLOWS = f"""{sql.LEDGER}, {sql.SUPPLIER_PX}, cf AS (SELECT book, d, CASE action WHEN 'buy' THEN -(quantity * price + fee) WHEN 'sell' THEN quantity * price - fee WHEN 'dividend' THEN cash - fee ELSE -fee END AS flow FROM ledger),
lastpx AS (SELECT ticker, arg_max(close, d) AS close FROM spx GROUP BY 1), sh AS (SELECT book, ticker, sum(CASE action WHEN 'buy' THEN quantity WHEN 'sell' THEN -quantity ELSE 0 END) AS s FROM ledger GROUP BY 1, 2),
mv AS (SELECT book, sum(s * close) AS value FROM sh JOIN lastpx USING (ticker) GROUP BY 1), firsts AS (SELECT book, min(d) AS first_d FROM cf GROUP BY 1)"""


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ledger, px = _book(spark, sf_dir)
    c = [F.col(x) for x in ("action", "quantity", "price", "fee", "cash")]
    flows = ledger.select("book", "d", cash_flow(*c).alias("flow")).where("flow is not null")
    last = px.groupBy("ticker").agg(F.max_by("close", "d").alias("close"))
    signed = F.when(F.col("action") == "buy", F.col("quantity")).when(F.col("action") == "sell", -F.col("quantity")).otherwise(0.0)
    shares = ledger.groupBy("book", "ticker").agg(F.sum(signed).alias("s"))
    return flows, shares.join(last, "ticker").groupBy("book").agg(F.sum(F.col("s") * F.col("close")).alias("value"))


@query(
    f"WITH RECURSIVE {FLOWS}, x AS (SELECT book, date_diff('day', first_d, d) / 365.25::DOUBLE AS t, flow AS a FROM cf JOIN firsts USING (book) UNION ALL SELECT book, date_diff('day', first_d, DATE '{ASOF}') / 365.25::DOUBLE, value FROM mv JOIN firsts USING (book)),"
    " xs AS (SELECT book, list(t) AS ts, list(a) AS as_ FROM x GROUP BY 1),"
    " it AS (SELECT book, 0 AS k, 0.1::DOUBLE AS r, 1.0::DOUBLE AS step, ts, as_ FROM xs UNION ALL SELECT book, k + 1, r - f / g, f / g, ts, as_ FROM (SELECT *,"
    " list_sum(list_transform(list_zip(ts, as_), lambda z: z[2] / (1 + r) ** z[1])) AS f, list_sum(list_transform(list_zip(ts, as_), lambda z: -z[1] * z[2] / (1 + r) ** (z[1] + 1))) AS g FROM it WHERE k < 100 AND abs(step) >= 1e-10))"
    " SELECT book, round(arg_max(r, k), 7) AS irr FROM it GROUP BY book"
)
def xirr(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows, values = _flows(spark, sf_dir)
    return rounded(returns.money_weighted(flows, values, F.lit(ASOF).cast("date")), "irr", digits=7)


@query(
    f"WITH {FLOWS}, z AS (SELECT book, any_value(first_d) AS first_d, date_diff('day', any_value(first_d), DATE '{ASOF}') AS days, sum(-flow) AS c, sum(-flow * (date_diff('day', first_d, DATE '{ASOF}') - date_diff('day', first_d, d)) / date_diff('day', first_d, DATE '{ASOF}')) AS wc FROM cf JOIN firsts USING (book) GROUP BY book),"
    " y AS (SELECT book, days, (value - c) / wc AS dietz FROM z JOIN mv USING (book)) SELECT book, days::INTEGER AS days, round(dietz, 8) AS dietz, round((1 + dietz) ** (365.25::DOUBLE / days) - 1, 8) AS annualized FROM y"
)
def modified_dietz(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows, values = _flows(spark, sf_dir)
    return rounded(returns.modified_dietz(flows, values, F.lit(ASOF).cast("date")), "dietz", "annualized", digits=8)


@query(
    f"WITH {sql.LEDGER}, {sql.SUPPLIER_PX}, t AS (SELECT l.ticker, l.price, p.close FROM ledger l ASOF LEFT JOIN spx p ON l.ticker = p.ticker AND l.d >= p.d WHERE l.action IN ('buy', 'sell') AND l.ticker IN (SELECT ticker FROM spx))"
    " SELECT DISTINCT ticker FROM t WHERE close IS NULL OR price / close >= 2.05 OR price / close <= 1 / 2.05::DOUBLE"
)
def basis_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.basis_mismatches(*_book(spark, sf_dir), factor=2.05)


SUMMARY = f"""WITH RECURSIVE {CURVE}, t AS (SELECT book, count(*) AS n, product(1 + r) AS g FROM ret GROUP BY 1),
{FLOWS.replace(sql.LEDGER + ", " + sql.SUPPLIER_PX + ", ", "").replace(" sh AS (", " hs AS (").replace("FROM sh JOIN", "FROM hs JOIN")}, x AS (SELECT book, date_diff('day', first_d, d) / 365.25::DOUBLE AS t, flow AS a FROM cf JOIN firsts USING (book) UNION ALL SELECT book, date_diff('day', first_d, DATE '{ASOF}') / 365.25::DOUBLE, value FROM mv JOIN firsts USING (book)),
xs AS (SELECT book, list(t) AS ts, list(a) AS as_ FROM x GROUP BY 1),
it AS (SELECT book, 0 AS k, 0.1::DOUBLE AS r, 1.0::DOUBLE AS step, ts, as_ FROM xs UNION ALL SELECT book, k + 1, r - f / g, f / g, ts, as_ FROM (SELECT *,
 list_sum(list_transform(list_zip(ts, as_), lambda z: z[2] / (1 + r) ** z[1])) AS f, list_sum(list_transform(list_zip(ts, as_), lambda z: -z[1] * z[2] / (1 + r) ** (z[1] + 1))) AS g FROM it WHERE k < 100 AND abs(step) >= 1e-10)),
dz AS (SELECT book, date_diff('day', any_value(first_d), DATE '{ASOF}') AS days, sum(-flow) AS c, sum(-flow * (date_diff('day', first_d, DATE '{ASOF}') - date_diff('day', first_d, d)) / date_diff('day', first_d, DATE '{ASOF}')) AS wc FROM cf JOIN firsts USING (book) GROUP BY book)
SELECT t.book, first_d AS period_start, DATE '{ASOF}' AS asof_date, round((SELECT arg_max(r, k) FROM it WHERE it.book = t.book), 7) AS money_weighted, round((1 + (value - c) / wc) ** (365.25::DOUBLE / days) - 1, 7) AS modified_dietz, round(g ** (252.0::DOUBLE / n) - 1, 7) AS twr, round(g - 1, 7) AS twr_cumulative
FROM t JOIN firsts USING (book) JOIN mv USING (book) JOIN dz USING (book)"""


@query(SUMMARY)
def returns_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, px = _book(spark, sf_dir)
    _, values = _flows(spark, sf_dir)
    rates = returns.time_weighted(returns.daily_returns(ledger, px))
    out = returns.summary(ledger, values.withColumn("fully_priced", F.lit(True)), F.lit(ASOF).cast("date"), rates)
    return rounded(out, "money_weighted", "modified_dietz", "twr", "twr_cumulative", digits=7)
