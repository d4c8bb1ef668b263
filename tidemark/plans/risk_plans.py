"""Queries over drawdowns and risk ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import align, bootstrap, drawdown, returns
from tidemark.plans import sql
from tidemark.plans.ledger_plans import rounded
from tidemark.plans.registry import query
from tidemark.sources import adapters

DD = f"WITH {sql.px('week')}, c AS (SELECT ticker, d, close AS x, close / max(close) OVER w - 1 AS dd, close - max(close) OVER w AS fall FROM px WINDOW w AS (PARTITION BY ticker ORDER BY d))"
RET = f"WITH {sql.px('week')}, r AS (SELECT * FROM (SELECT ticker, d, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM px) WHERE r IS NOT NULL)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.prices(spark, sf_dir, "week").withColumnRenamed("close", "x")


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawdown.pct_change(adapters.prices(spark, sf_dir, "week"), "ticker")


@query(f"{DD} SELECT ticker, d, round(dd, 8) AS dd FROM c")
def drawdown_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drawdown.curve(_levels(spark, sf_dir), "ticker").select("ticker", "d", "dd"), "dd", digits=8)


def _walk(dd: str) -> str:
    return (
        f", t AS (SELECT ticker, min({dd}) AS depth, max(d) AS last_d FROM c GROUP BY 1), t2 AS (SELECT c.ticker, min(d) AS trough_date FROM c JOIN t ON c.ticker = t.ticker AND c.{dd} = t.depth GROUP BY 1),"
        " p AS (SELECT c.ticker, max(x) AS top FROM c JOIN t2 USING (ticker) WHERE d <= trough_date GROUP BY 1), p2 AS (SELECT c.ticker, min(d) AS peak_date FROM c JOIN p ON c.ticker = p.ticker AND x = top GROUP BY 1),"
        " rec AS (SELECT c.ticker, min(d) AS recovery_date FROM c JOIN t2 USING (ticker) JOIN p USING (ticker) WHERE d >= trough_date AND x >= top GROUP BY 1)"
    )


@query(
    f"{DD}{_walk('dd')}, u AS (SELECT ticker, avg(CASE WHEN dd < 0 THEN 1.0::DOUBLE ELSE 0 END) AS underwater FROM c GROUP BY 1) SELECT ticker, round(depth, 8) AS depth, peak_date, trough_date, recovery_date,"
    " date_diff('day', peak_date, coalesce(recovery_date, last_d))::INTEGER AS duration_days, round(underwater, 8) AS underwater FROM t JOIN t2 USING (ticker) JOIN p2 USING (ticker) LEFT JOIN rec USING (ticker) JOIN u USING (ticker)"
)
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drawdown.max_drawdown(_levels(spark, sf_dir), "ticker"), "depth", "underwater", digits=8)


@query(
    f"{DD}{_walk('fall')} SELECT ticker, round(depth, 4) AS depth, peak_date, trough_date, recovery_date, date_diff('day', peak_date, coalesce(recovery_date, last_d))::INTEGER AS duration_days"
    " FROM t JOIN t2 USING (ticker) JOIN p2 USING (ticker) LEFT JOIN rec USING (ticker) WHERE depth < -1e-9"
)
def dollar_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drawdown.dollar_drawdown(_levels(spark, sf_dir), "ticker"), "depth", digits=4)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five series of one point every few minutes or less: values by kind of event, those of one moment as their mean."""
    e = adapters.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.col("ts").cast("timestamp").alias("d")).agg(F.avg("value").alias("x")).where("x > 0")


EVENTS = "e AS (SELECT event_type, ts AS d, avg(value) AS x FROM events GROUP BY 1, 2 HAVING avg(value) > 0)"
EVENT_DD = f"WITH {EVENTS}, c AS (SELECT event_type, d, x, x / max(x) OVER (PARTITION BY event_type ORDER BY d) - 1 AS dd FROM e)"


@query(
    f"{EVENT_DD}, t AS (SELECT event_type, min(dd) AS depth, max(d) AS last_d, avg(CASE WHEN dd < 0 THEN 1.0::DOUBLE ELSE 0 END) AS underwater FROM c GROUP BY 1), t2 AS (SELECT c.event_type, min(d) AS trough_date FROM c JOIN t ON c.event_type = t.event_type AND c.dd = t.depth GROUP BY 1),"
    " tops AS (SELECT c.event_type, max(x) AS top FROM c JOIN t2 USING (event_type) WHERE d <= trough_date GROUP BY 1),"
    " b AS (SELECT c.event_type, min(d) FILTER (WHERE d <= trough_date) AS peak_date, min(d) FILTER (WHERE d >= trough_date) AS recovery_date FROM c JOIN t2 USING (event_type) JOIN tops USING (event_type) WHERE x >= top GROUP BY 1)"
    " SELECT event_type, round(depth, 8) AS depth, epoch_us(peak_date) AS peak_us, epoch_us(trough_date) AS trough_us, epoch_us(recovery_date) AS recovery_us, date_diff('day', peak_date::DATE, coalesce(recovery_date, last_d)::DATE)::INTEGER AS duration_days, round(underwater, 8) AS underwater FROM t JOIN t2 USING (event_type) JOIN b USING (event_type)"
)
def event_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest fall of each of five long series, run in blocks of an hour."""
    out = rounded(drawdown.max_drawdown(_events(spark, sf_dir), "event_type"), "depth", "underwater", digits=8)
    us = lambda c: F.unix_micros(c).alias(c.replace("_date", "_us"))
    return out.select("event_type", "depth", us("peak_date"), us("trough_date"), us("recovery_date"), "duration_days", "underwater")


@query(f"WITH {EVENTS}, r AS (SELECT event_type, d, (x - 20) / 1e5 AS r FROM e) SELECT event_type, epoch_us(d) AS us, round(product(1 + r) OVER (PARTITION BY event_type ORDER BY d), 8) AS g FROM r")
def event_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth index of the same series, whose values count as small returns."""
    moves = _events(spark, sf_dir).select("event_type", "d", ((F.col("x") - 20) / 1e5).alias("r"))
    return rounded(returns.growth_index(moves, "event_type").select("event_type", F.unix_micros("d").alias("us"), "g"), "g", digits=8)


@query(f"WITH {EVENTS}, g AS (SELECT DISTINCT event_type, date_trunc('minute', d) AS d FROM e) SELECT g.event_type, epoch_us(g.d) AS us, x FROM g ASOF LEFT JOIN e ON g.event_type = e.event_type AND g.d >= e.d")
def event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that held at the start of each minute in which something happened."""
    e = _events(spark, sf_dir)
    grid = e.select("event_type", F.date_trunc("minute", "d").alias("d")).distinct()
    return align.asof_fill(e, grid, ("event_type",), "x").select("event_type", F.unix_micros("d").alias("us"), "x")


@query(f"{DD} SELECT ticker, round(sqrt(avg(dd * dd)), 8) AS ulcer FROM c GROUP BY 1")
def ulcer(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = drawdown.curve(_levels(spark, sf_dir), "ticker")
    return drops.groupBy("ticker").agg(F.round(drawdown.ulcer(F.col("dd")), 8).alias("ulcer"))


@query(f"{DD}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dd, d) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM c) SELECT ticker, round(-avg(dd), 8) AS cdar FROM k WHERE k <= greatest(1, ceil(0.05::DOUBLE * n)) GROUP BY 1")
def cdar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drawdown.cdar(drawdown.curve(_levels(spark, sf_dir), "ticker"), "ticker"), "cdar", digits=8)


@query(
    f"{RET}, l AS (SELECT ticker, d, product(1 + r) OVER (PARTITION BY ticker ORDER BY d) AS x FROM r), b AS (SELECT * FROM l UNION ALL SELECT ticker, (min(d) - INTERVAL 1 DAY)::DATE, 1.0::DOUBLE FROM r GROUP BY 1),"
    " dd AS (SELECT ticker, min(dd) AS depth FROM (SELECT ticker, x / max(x) OVER (PARTITION BY ticker ORDER BY d) - 1 AS dd FROM b) GROUP BY 1), s AS (SELECT ticker, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(least(r, 0) ** 2)) AS dn, product(1 + r) AS g FROM r GROUP BY 1)"
    " SELECT ticker, n, n < 504 AS is_noisy, round(s * sqrt(252), 7) AS vol, round(sqrt(252) * m / s, 7) AS sharpe, round(sqrt(252) * m / dn, 7) AS sortino, round((g ** (252.0::DOUBLE / n) - 1) / abs(depth), 7) AS calmar, round(depth, 7) AS depth FROM s JOIN dd USING (ticker)"
)
def risk_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drawdown.ratios(_returns(spark, sf_dir), "ticker"), "vol", "sharpe", "sortino", "calmar", "depth", digits=7)


@query(f"{DD} SELECT arg_min(ticker, (dd, ticker)) AS ticker, round(min(dd), 8) AS depth FROM c WHERE dd < 0")
def deepest_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = drawdown.curve(_levels(spark, sf_dir), "ticker").groupBy("ticker").agg(F.min("dd").alias("depth")).where("depth < 0")
    return rounded(deep.agg(F.min_by("ticker", F.struct("depth", "ticker")).alias("ticker"), F.min("depth").alias("depth")), "depth", digits=8)


def _resampled(name: str, block: str) -> str:
    """Replicates of the returns: a row for each ticker, replicate and position."""
    return (
        f"{name}b AS (SELECT ticker, n, {block} AS b FROM cnt), {name}i AS (SELECT ticker, n, rep, pos, {sql.counted_start('rep', '(pos // b)', 'greatest(1, n - b + 1)')} + pos % b AS at FROM {name}b, range(1000) t(rep), range((SELECT max(n) FROM cnt)) u(pos) WHERE pos < n),"
        f" {name} AS (SELECT i.ticker, i.n, rep, pos, r FROM {name}i i JOIN num x ON x.ticker = i.ticker AND x.k = i.at)"
    )


PATH = "SELECT ticker, rep, least(0, min(x / greatest(1, top) - 1)) AS max_drawdown, sqrt(avg((x / top - 1) ** 2)) AS ulcer, -list_avg(list_slice(list_sort(list(x / top - 1)), 1, greatest(1, ceil(0.05::DOUBLE * any_value(n)))::BIGINT)) AS cdar, arg_max(x, pos) ** (252.0::DOUBLE / any_value(n)) - 1 AS annual"
RATIO = "SELECT ticker, rep, sqrt(252) * avg(r) / stddev_samp(r) AS sharpe, sqrt(252) * avg(r) / sqrt(avg(least(r, 0) ** 2)) AS sortino"
INTERVALS = (
    f"{RET}, num AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS k FROM r), cnt AS (SELECT ticker, count(*) AS n FROM num GROUP BY 1), {_resampled('q', 'least(n, greatest(2, round(n ** (1 / 3.0::DOUBLE))))::BIGINT')}, {_resampled('p', 'least(n, greatest(2, round(n ** 0.5::DOUBLE)))::BIGINT')},"
    " own AS (SELECT ticker, n, -1 AS rep, k AS pos, r FROM num JOIN cnt USING (ticker)), lv AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker, rep ORDER BY pos) AS x FROM (SELECT * FROM p UNION ALL SELECT * FROM own)), tp AS (SELECT *, max(x) OVER (PARTITION BY ticker, rep ORDER BY pos) AS top FROM lv),"
    f" pm AS (SELECT *, CASE WHEN max_drawdown < 0 THEN annual / abs(max_drawdown) END AS calmar FROM ({PATH} FROM tp GROUP BY 1, 2)), rm AS ({RATIO} FROM (SELECT * FROM q UNION ALL SELECT * FROM own) GROUP BY 1, 2),"
    " long AS (SELECT ticker, rep, unnest(['sharpe', 'sortino']) AS metric, unnest([sharpe, sortino]) AS v FROM rm UNION ALL SELECT ticker, rep, unnest(['calmar', 'max_drawdown', 'ulcer', 'cdar']), unnest([calmar, max_drawdown, ulcer, cdar]) FROM pm),"
    " iv AS (SELECT ticker, metric, max(v) FILTER (WHERE rep < 0) AS point, quantile_cont(v, 0.025) FILTER (WHERE rep >= 0 AND isfinite(v)) AS low, quantile_cont(v, 0.975) FILTER (WHERE rep >= 0 AND isfinite(v)) AS high FROM long GROUP BY 1, 2)"
)


@query(f"{INTERVALS} SELECT ticker, metric, round(point, 8) AS point, round(low, 8) AS low, round(high, 8) AS high FROM iv")
def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With counted starts, which SQL can draw as well."""
    return rounded(bootstrap.intervals(_returns(spark, sf_dir), "ticker", draws="counted"), "point", "low", "high", digits=8)


WALKED = f"{_walk('dd').replace(' p AS', ' tops AS').replace('JOIN p ON c.ticker = p.ticker', 'JOIN tops ON c.ticker = tops.ticker').replace('JOIN p USING', 'JOIN tops USING')}, wk AS (SELECT ticker, depth AS level_depth, peak_date, trough_date, recovery_date, date_diff('day', peak_date, coalesce(recovery_date, last_d))::INTEGER AS duration_days FROM t JOIN t2 USING (ticker) JOIN p2 USING (ticker) LEFT JOIN rec USING (ticker))"
PANEL = f"{INTERVALS}, c AS (SELECT ticker, d, close AS x, close / max(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS dd FROM px){WALKED}"
METRIC_COLUMNS = ", ".join(f"round(max({c}) FILTER (WHERE metric = '{m}'), 7) AS {m}{'' if c == 'point' else '_' + c}" for m in bootstrap.METRICS for c in ("point", "low", "high"))


@query(f"{PANEL}, w AS (SELECT ticker, {METRIC_COLUMNS} FROM iv GROUP BY 1) SELECT w.*, n AS n_days, n < 504 AS is_noisy, round(level_depth, 7) AS depth, peak_date, trough_date, recovery_date, duration_days FROM w JOIN wk USING (ticker) JOIN cnt USING (ticker)")
def risk_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drawdown.panel(_levels(spark, sf_dir), bootstrap.intervals(_returns(spark, sf_dir), "ticker", draws="counted"), "ticker")
    return rounded(out, "depth", *[f"{m}{x}" for m in bootstrap.METRICS for x in ("", "_low", "_high")], digits=7)
