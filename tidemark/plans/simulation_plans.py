"""Queries over simulated portfolios and held-out verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import simulate
from tidemark.operators.scan import running
from tidemark.plans import sql
from tidemark.plans.ledger_plans import rounded
from tidemark.plans.registry import query
from tidemark.sources import adapters

#: The mixes compared. The candidate is added to the target as a sleeve of 5 %.
TARGET = {"1-URGENT": 0.5, "2-HIGH": 0.3, "3-MEDIUM": 0.2}
REFERENCE = {"4-NOT SPECIFIED": 0.6, "3-MEDIUM": 0.4}
CANDIDATE, SLEEVE = "5-LOW", 0.05


def legs(spark: SparkSession) -> DataFrame:
    rows = [("target", t, w) for t, w in TARGET.items()] + [("reference", t, w) for t, w in REFERENCE.items()]
    return spark.createDataFrame(rows, "leg string, ticker string, w double")


def sleeve_legs(spark: SparkSession) -> DataFrame:
    rows = [("without", t, w) for t, w in TARGET.items()] + [("with", t, w * (1 - SLEEVE)) for t, w in TARGET.items()] + [("with", CANDIDATE, SLEEVE)]
    return spark.createDataFrame(rows, "leg string, ticker string, w double")


def _values(rows) -> str:
    return ", ".join(f"('{leg}', '{t}', {w!r}::DOUBLE)" for leg, t, w in rows)


LEGS = f"legs(leg, ticker, w) AS (VALUES {_values([('target', t, w) for t, w in TARGET.items()] + [('reference', t, w) for t, w in REFERENCE.items()])})"
SIM = f"""{sql.px("week")}, {LEGS}, sp AS (SELECT ticker, min(d) AS a, max(d) AS z FROM px GROUP BY 1), win AS (SELECT leg, max(a) AS lo, max(z) AS hi FROM legs JOIN sp USING (ticker) GROUP BY 1),
days AS (SELECT DISTINCT leg, d FROM px JOIN legs USING (ticker) JOIN win USING (leg) WHERE d BETWEEN lo AND hi)"""


def simulated(period: str | None, sim: str = SIM) -> str:
    """A chain of steps, a day each: the recursion that the closed form replaces."""
    mark = f"row_number() OVER (PARTITION BY leg, date_trunc('{period}', d) ORDER BY d) = 1 AND row_number() OVER (PARTITION BY leg ORDER BY d) > 1" if period else "FALSE"
    return f"""WITH RECURSIVE {sim}, m AS (SELECT leg, d, row_number() OVER (PARTITION BY leg ORDER BY d) AS k, {mark} AS reb FROM days),
    f AS (SELECT m.leg, m.k, m.d, m.reb, l.ticker, l.w, p.close FROM m JOIN legs l USING (leg) ASOF JOIN px p ON l.ticker = p.ticker AND m.d >= p.d),
    day AS (SELECT leg, k, any_value(d) AS d, any_value(reb) AS reb, list(w ORDER BY ticker) AS ws, list(close ORDER BY ticker) AS ps FROM f GROUP BY 1, 2),
    sim AS (SELECT leg, k, d, 10000.0::DOUBLE AS v, list_transform(list_zip(ws, ps), lambda z: z[1] * 10000 / z[2]) AS sh FROM day WHERE k = 1
     UNION ALL SELECT n.leg, n.k, n.d, list_sum(list_transform(list_zip(s.sh, n.ps), lambda z: z[1] * z[2])),
      CASE WHEN n.reb THEN list_transform(list_zip(n.ws, n.ps), lambda z: z[1] * list_sum(list_transform(list_zip(s.sh, n.ps), lambda y: y[1] * y[2])) / z[2]) ELSE s.sh END
      FROM sim s JOIN day n ON n.leg = s.leg AND n.k = s.k + 1)"""


def _sim(spark: SparkSession, sf_dir: str, schedule: str) -> DataFrame:
    return simulate.simulate(adapters.prices(spark, sf_dir, "week"), legs(spark), schedule)


@query(f"{simulated(None)} SELECT leg, d, round(v, 4) AS v FROM sim")
def simulate_buyhold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sim(spark, sf_dir, "never"), "v", digits=4)


@query(f"{simulated('quarter')} SELECT leg, d, round(v, 4) AS v FROM sim")
def simulate_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sim(spark, sf_dir, "quarterly"), "v", digits=4)


@query(f"{simulated('month')} SELECT leg, d, round(v, 4) AS v FROM sim")
def simulate_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sim(spark, sf_dir, "monthly"), "v", digits=4)


@query(f"WITH {SIM} SELECT leg, min(d) AS d FROM days GROUP BY leg, date_trunc('quarter', d) HAVING min(d) > (SELECT min(d) FROM days x WHERE x.leg = days.leg)")
def rebalance_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.prices(spark, sf_dir, "week")
    return simulate.rebalance_days(simulate.leg_days(px, legs(spark), simulate.windows(px, legs(spark))), "quarterly")


@query(
    f"WITH {SIM}, n AS (SELECT leg, d, row_number() OVER (PARTITION BY leg ORDER BY d) AS k, count(*) OVER (PARTITION BY leg) AS n FROM days), s AS (SELECT *, n - floor(n * 0.30::DOUBLE) AS n_is FROM n)"
    " SELECT leg, min(d) AS lo, max(d) FILTER (WHERE k = n_is) AS in_sample_end, max(d) FILTER (WHERE k = n_is + 1) AS oos_start, max(d) AS hi FROM s WHERE n_is >= 60 AND n - n_is >= 60 GROUP BY leg"
)
def in_sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.prices(spark, sf_dir, "week")
    return simulate.split_days(simulate.leg_days(px, legs(spark), simulate.windows(px, legs(spark))))


@query(
    f"{simulated('quarter')}, r AS (SELECT leg, d, v, v / lag(v) OVER (PARTITION BY leg ORDER BY d) - 1 AS r FROM sim), x AS (SELECT leg, v / max(v) OVER (PARTITION BY leg ORDER BY d) - 1 AS dd FROM sim)"
    " SELECT a.leg, a.n, round(a.final_value, 4) AS final_value, round(a.sharpe, 7) AS sharpe, round(b.depth, 8) AS depth FROM (SELECT leg, count(r) AS n, arg_max(v, d) AS final_value, sqrt(252) * avg(r) / stddev_samp(r) AS sharpe FROM r GROUP BY 1) a JOIN (SELECT leg, min(dd) AS depth FROM x GROUP BY 1) b USING (leg)"
)
def backtest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simulate.score(_sim(spark, sf_dir, "quarterly")).select("leg", "n", "final_value", "sharpe", "depth")
    return rounded(rounded(out, "final_value", digits=4), "sharpe", digits=7).withColumn("depth", F.round("depth", 8))


SCORED = (
    ", r AS (SELECT leg, d, v, v / lag(v) OVER (PARTITION BY leg ORDER BY d) - 1 AS r FROM sim), x AS (SELECT leg, v / max(v) OVER (PARTITION BY leg ORDER BY d) - 1 AS dd FROM sim)"
    " SELECT a.leg, a.n, round(a.final_value, 4) AS final_value, round(CASE WHEN n >= 126 THEN g ** (252.0::DOUBLE / n) - 1 END, 8) AS annualized, round(depth, 8) AS depth, '' AS missing FROM (SELECT leg, count(r) AS n, arg_max(v, d) AS final_value, product(1 + r) AS g FROM r GROUP BY 1) a JOIN (SELECT leg, min(dd) AS depth FROM x GROUP BY 1) b USING (leg)"
)


@query(f"SELECT 'quarterly' AS schedule, * FROM ({simulated('quarter')}{SCORED}) UNION ALL SELECT 'never', * FROM ({simulated(None)}{SCORED})")
def backtest_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mixes, rebalanced and left alone."""
    out = simulate.backtest(adapters.prices(spark, sf_dir, "week"), legs(spark), "quarterly").select("schedule", "leg", "n", "final_value", "annualized", "depth", "missing")
    return rounded(rounded(out, "final_value", digits=4), "annualized", "depth", digits=8)


#: Two legs over held-out windows, from sim on: their aligned returns, statistics, bootstrap interval and verdict.
JUDGED = f"""pr AS (SELECT pair, a.d, a.v / lag(a.v) OVER (PARTITION BY pair ORDER BY a.d) - 1 AS r_without, b.v / lag(b.v) OVER (PARTITION BY pair ORDER BY a.d) - 1 AS r_with FROM pairs JOIN sim a ON a.leg = pairs.without JOIN sim b ON b.leg = pairs.tested AND a.d = b.d),
pq AS (SELECT pair, d, unnest(['without', 'with']) AS leg, unnest([r_without, r_with]) AS r FROM pr WHERE r_without IS NOT NULL AND r_with IS NOT NULL),
nm AS (SELECT *, row_number() OVER (PARTITION BY pair, leg ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY pair, leg) AS n FROM pq), sz AS (SELECT DISTINCT pair, leg, n, least(n, greatest(2, round(n ** 0.5::DOUBLE)))::BIGINT AS b FROM nm),
ix AS (SELECT pair, leg, n, rep, pos, {sql.counted_start('rep', '(pos // b)', 'greatest(1, n - b + 1)')} + pos % b AS at FROM sz, range(1000) t(rep), range((SELECT max(n) FROM sz)) u(pos) WHERE pos < n),
rs AS (SELECT i.pair, i.leg, rep, pos, r FROM ix i JOIN nm x ON x.pair = i.pair AND x.leg = i.leg AND x.k = i.at UNION ALL SELECT pair, leg, -1, k, r FROM nm),
lv AS (SELECT *, product(1 + r) OVER (PARTITION BY pair, leg, rep ORDER BY pos) AS x FROM rs), tp AS (SELECT *, max(x) OVER (PARTITION BY pair, leg, rep ORDER BY pos) AS top FROM lv),
ul AS (SELECT pair, leg, rep, sqrt(avg((x / top - 1) ** 2)) AS ulcer FROM tp GROUP BY 1, 2, 3), gn AS (SELECT a.pair, a.rep, a.ulcer - b.ulcer AS g FROM ul a JOIN ul b ON a.pair = b.pair AND a.rep = b.rep WHERE a.leg = 'without' AND b.leg = 'with'),
ci AS (SELECT pair, quantile_cont(g, 0.025) FILTER (WHERE rep >= 0) AS low, quantile_cont(g, 0.975) FILTER (WHERE rep >= 0) AS high, max(g) FILTER (WHERE rep < 0) AS ulcer_gain FROM gn GROUP BY 1),
st AS (SELECT pair, leg, count(*) AS n, least(0, min(x / greatest(1, top) - 1)) AS depth, sqrt(avg((x / top - 1) ** 2)) AS ulcer, -list_avg(list_slice(list_sort(list(x / top - 1)), 1, greatest(1, ceil(0.05::DOUBLE * count(*)))::BIGINT)) AS cdar, CASE WHEN count(*) >= 126 THEN arg_max(x, pos) ** (252.0::DOUBLE / count(*)) - 1 END AS ret FROM tp WHERE rep < 0 GROUP BY 1, 2),
w AS (SELECT a.pair, a.cdar AS c1, b.cdar AS c0, a.ulcer AS u1, b.ulcer AS u0, a.depth AS d1, b.depth AS d0, a.ret AS r1, b.ret AS r0, b.cdar - a.cdar AS cdar_gain FROM st a JOIN st b ON a.pair = b.pair WHERE a.leg = 'with' AND b.leg = 'without'),
vd AS (SELECT w.*, low, high, ulcer_gain, CASE WHEN abs(ulcer_gain) < 0.0025::DOUBLE THEN 'noise_margin' WHEN (ulcer_gain > 0 AND cdar_gain < -0.005::DOUBLE) OR (ulcer_gain <= 0 AND cdar_gain > 0.005::DOUBLE) THEN 'cdar_contradicts' WHEN (ulcer_gain > 0 AND low > 0) OR (ulcer_gain <= 0 AND high < 0) THEN '' ELSE 'bootstrap_unconfirmed' END AS cause FROM w JOIN ci USING (pair)),
vv AS (SELECT *, CASE WHEN cause <> '' THEN 'inconclusive' WHEN ulcer_gain > 0 THEN 'improved' ELSE 'worsened' END AS verdict,
 printf('Ulcer %.2f%% vs %.2f%% ', u1 * 100, u0 * 100) || baseline || printf('; CDaR %.2f%% vs %.2f%%; max DD %.1f%% vs %.1f%% (context)', c1 * 100, c0 * 100, d1 * 100, d0 * 100) || coalesce(printf('; return %+.1f%% vs %+.1f%%/yr (%+.1fpp, context)', r1 * 100, r0 * 100, (r1 - r0) * 100), '') AS clause FROM vd, (SELECT any_value(baseline) AS baseline FROM pairs))"""
ASKED = sorted({*TARGET, *REFERENCE, CANDIDATE})


def role_sql(px: str, target: dict[str, float], asked: list[str], sleeve: float) -> str:
    """Held-out verdicts on candidates, both legs of each simulated day by day."""
    others = [c for c in asked if c not in target]
    legs = [r for c in others for r in [*[(f"{c}+without", t, w) for t, w in target.items()], *[(f"{c}+with", t, w * (1 - sleeve)) for t, w in target.items()], (f"{c}+with", c, sleeve)]]
    named = lambda tickers: ", ".join(f"'{t}'" for t in tickers)
    rows = lambda tickers: ", ".join(f"('{t}')" for t in tickers)
    sim = f"""{px}, legs(leg, ticker, w) AS (VALUES {_values(legs)}),
pairs AS (SELECT c AS pair, c || '+without' AS without, c || '+with' AS tested, 'without' AS baseline FROM (VALUES {rows(others)}) v(c)),
sp AS (SELECT ticker, min(d) AS a, max(d) AS z FROM px GROUP BY 1), tg AS (SELECT max(a) AS lo, max(z) AS hi FROM sp WHERE ticker IN ({named(target)})),
cd AS (SELECT p.ticker AS pair, d, row_number() OVER (PARTITION BY p.ticker ORDER BY d) AS k, count(*) OVER (PARTITION BY p.ticker) AS n, least(z, hi) AS hi FROM px p JOIN sp USING (ticker), tg WHERE d BETWEEN greatest(a, lo) AND least(z, hi)),
sl AS (SELECT pair, any_value(hi) AS hi, any_value(n) AS n, max(d) FILTER (WHERE k = n - floor(n * 0.30::DOUBLE)) AS in_sample_end, max(d) FILTER (WHERE k = n - floor(n * 0.30::DOUBLE) + 1) AS oos_start FROM cd GROUP BY 1),
ok AS (SELECT * FROM sl WHERE n - floor(n * 0.30::DOUBLE) >= 60 AND floor(n * 0.30::DOUBLE) >= 60),
win AS (SELECT leg, greatest(max(a), any_value(oos_start)) AS lo, least(max(z), any_value(ok.hi)) AS hi FROM legs JOIN sp USING (ticker) JOIN ok ON leg LIKE ok.pair || '+%' GROUP BY 1),
days AS (SELECT DISTINCT leg, d FROM px JOIN legs USING (ticker) JOIN win USING (leg) WHERE d BETWEEN lo AND hi)"""
    return f"""{simulated('quarter', sim)}, {JUDGED}, ask(pair) AS (VALUES {rows(asked)})
SELECT ask.pair, coalesce(verdict, 'insufficient') AS verdict,
 CASE WHEN ask.pair IN ({named(target)}) THEN 'already in the target' WHEN ok.pair IS NULL THEN 'only ' || coalesce(sl.n, 0) || ' common days: 60 are needed on both sides' ELSE clause END AS reason,
 ok.in_sample_end, ok.oos_start, CASE WHEN ask.pair NOT IN ({named(target)}) THEN sl.hi END AS hi,
 round(ulcer_gain, 8) AS ulcer_gain, round(cdar_gain, 8) AS cdar_gain, round(low, 8) AS low, round(high, 8) AS high, cause, coalesce(verdict = 'improved', FALSE) AS validated
FROM ask LEFT JOIN sl ON sl.pair = ask.pair LEFT JOIN ok ON ok.pair = ask.pair AND ask.pair IN (SELECT pair FROM pairs) LEFT JOIN vv ON vv.pair = ask.pair"""


def _judged(px: DataFrame, target: dict[str, float], sleeve: float) -> DataFrame:
    target = px.sparkSession.createDataFrame(list(target.items()), "ticker string, w double")
    out = simulate.role_checks(px, target, px.select("ticker").distinct(), sleeve=sleeve, draws="counted")
    out = out.withColumn("hi", F.when(F.col("reason") != "already in the target", F.col("hi")))
    return rounded(out, "ulcer_gain", "cdar_gain", "low", "high", digits=8)


@query(role_sql(sql.px("week"), TARGET, ASKED, SLEEVE))
def role_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five tickers as candidates of the target at once, each on its own calendar; starts of the bootstrap are counted."""
    return _judged(adapters.prices(spark, sf_dir, "week"), TARGET, SLEEVE)


#: One ticker, and beside the others two that follow from all orders so far: one rises with their sum, one falls with it.
LONE = {"1-URGENT": 1.0}
TREND_PX = (
    "opx AS (SELECT o_orderpriority AS ticker, date_trunc('week', o_orderdate)::DATE AS d, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2), wk AS (SELECT date_trunc('week', o_orderdate)::DATE AS d, sum(o_totalprice) AS x FROM orders GROUP BY 1),"
    " so_far AS (SELECT d, sum(x) OVER (ORDER BY d) / sum(x) OVER () AS part FROM wk), px AS (SELECT * FROM opx UNION ALL SELECT 'UP', d, 100 * part FROM so_far UNION ALL SELECT 'DOWN', d, 100 / part ** 24 FROM so_far)"
)


@query(role_sql(TREND_PX, LONE, sorted({*ASKED, "UP", "DOWN"}), 0.5))
def role_check_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of which one improves the target, one worsens it, and the others leave it open."""
    px = adapters.prices(spark, sf_dir, "week").select("ticker", "d", "close")
    weeks = adapters.table(spark, sf_dir, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("d")).agg(F.sum("o_totalprice").alias("x"))
    part = running(weeks.withColumn("key", F.lit(0)), ("key",), {"so_far": ("sum", F.col("x"))}).crossJoin(F.broadcast(weeks.agg(F.sum("x").alias("whole")))).select("d", (F.col("so_far") / F.col("whole")).alias("part"))
    trends = part.select(F.explode(F.array(F.struct(F.lit("UP").alias("ticker"), (100 * F.col("part")).alias("close")), F.struct(F.lit("DOWN").alias("ticker"), (100 / F.pow("part", F.lit(24.0))).alias("close")))).alias("t"), "d")
    return _judged(px.unionByName(trends.select("t.ticker", "d", "t.close")), LONE, 0.5)


BENCH_SIM = f"""{sql.px("week")}, {LEGS}, pairs AS (SELECT 'target' AS pair, 'reference' AS without, 'target' AS tested, 'reference' AS baseline),
sp AS (SELECT ticker, min(d) AS a, max(d) AS z FROM px WHERE ticker IN (SELECT ticker FROM legs) GROUP BY 1), bd AS (SELECT max(a) AS lo, min(z) AS hi FROM sp),
cd AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM px, bd WHERE ticker IN (SELECT ticker FROM legs) AND d BETWEEN lo AND hi)),
sl AS (SELECT any_value(n) AS n, max(d) FILTER (WHERE k = n - floor(n * 0.30::DOUBLE) + 1) AS oos_start FROM cd),
ok AS (SELECT * FROM sl WHERE n - floor(n * 0.30::DOUBLE) >= 60 AND floor(n * 0.30::DOUBLE) >= 60),
win AS (SELECT leg, greatest(max(a), any_value(oos_start)) AS lo, least(max(z), any_value(bd.hi)) AS hi FROM legs JOIN sp USING (ticker), bd, ok GROUP BY 1),
days AS (SELECT DISTINCT leg, d FROM px JOIN legs USING (ticker) JOIN win USING (leg) WHERE d BETWEEN lo AND hi)"""


@query(
    f"{simulated('quarter', BENCH_SIM)}, {JUDGED} SELECT 'target' AS pair, CASE verdict WHEN 'improved' THEN 'shallower' WHEN 'worsened' THEN 'deeper' WHEN 'inconclusive' THEN 'inconclusive' ELSE 'insufficient' END AS verdict, coalesce(clause, 'only ' || sl.n || ' common days: 60 are needed on both sides') AS reason,"
    " ''::VARCHAR AS missing, round(ulcer_gain, 8) AS ulcer_gain, round(cdar_gain, 8) AS cdar_gain, round(low, 8) AS low, round(high, 8) AS high, cause FROM sl LEFT JOIN vv ON TRUE"
)
def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target against the reference on the union calendar; starts of the bootstrap are counted."""
    out = simulate.benchmark_check(adapters.prices(spark, sf_dir, "week"), legs(spark), "reference", "target", draws="counted")
    return rounded(out, "ulcer_gain", "cdar_gain", "low", "high", digits=8)


STATS = f"""{simulated('quarter')}, p AS (SELECT a.d, a.v / lag(a.v) OVER (ORDER BY a.d) - 1 AS r_without, b.v / lag(b.v) OVER (ORDER BY a.d) - 1 AS r_with FROM sim a JOIN sim b ON a.d = b.d WHERE a.leg = 'reference' AND b.leg = 'target'),
l AS (SELECT 'without' AS leg, d, r_without AS r FROM p WHERE r_without IS NOT NULL UNION ALL SELECT 'with', d, r_with FROM p WHERE r_with IS NOT NULL),
g AS (SELECT leg, d, r, product(1 + r) OVER (PARTITION BY leg ORDER BY d) AS x FROM l), c AS (SELECT leg, d, r, x / max(x) OVER (PARTITION BY leg ORDER BY d) - 1 AS dd, least(0, x / greatest(1, max(x) OVER (PARTITION BY leg ORDER BY d)) - 1) AS dd1 FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY dd, d) AS k, count(*) OVER (PARTITION BY leg) AS n FROM c)"""


@query(
    f"{STATS} SELECT 'pair' AS pair, leg, count(*) AS n, round(CASE WHEN count(*) >= 126 THEN product(1 + r) ** (252.0::DOUBLE / count(*)) - 1 END, 8) AS ret, round(min(dd1), 8) AS depth, round(sqrt(avg(dd * dd)), 8) AS ulcer, round(-avg(dd) FILTER (WHERE k <= greatest(1, ceil(0.05::DOUBLE * n))), 8) AS cdar, round(stddev_samp(r) * sqrt(252), 8) AS vol FROM k GROUP BY leg"
)
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("pair", "reference", "target")], "pair string, without string, tested string")
    returns = simulate.aligned_returns(_sim(spark, sf_dir, "quarterly"), pairs)
    return rounded(simulate.window_stats(returns), "depth", "ulcer", "cdar", "vol", "ret", digits=8)
