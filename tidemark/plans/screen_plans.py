"""Queries over candidate checks and role gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import discover, drawdown, screen
from tidemark.plans import sql
from tidemark.plans.ledger_plans import rounded
from tidemark.plans.registry import query
from tidemark.plans.simulation_plans import _sim, simulated
from tidemark.sources import adapters
from tidemark.sources.shared import keep

TODAY = "2001-08-01"
CHECKS = f"""{sql.FACTS}, f2 AS (SELECT *, CASE WHEN avg_volume = 0 THEN 'Exchange Traded Note' END AS legal_type, CASE WHEN avg_volume = 17000 THEN 'Trading--Leveraged' ELSE category END AS cat, greatest(date_diff('day', inception, DATE '{TODAY}'), 0) / 365.25::DOUBLE AS y FROM facts),
ch AS (SELECT ticker, 'structure' AS "check", CASE WHEN cat LIKE '%Leveraged%' OR legal_type LIKE '%Note%' THEN 'fail' ELSE 'pass' END AS status FROM f2
 UNION ALL SELECT ticker, 'cost', CASE WHEN expense_ratio <= 0.002::DOUBLE THEN 'pass' WHEN expense_ratio <= 0.005::DOUBLE THEN 'warn' ELSE 'fail' END FROM f2
 UNION ALL SELECT ticker, 'liquidity', CASE WHEN aum < 1e8 AND avg_volume < 1e5 THEN 'fail' WHEN aum < 1e8 OR avg_volume < 1e5 THEN 'warn' ELSE 'pass' END FROM f2
 UNION ALL SELECT ticker, 'age', CASE WHEN y < 1 THEN 'fail' WHEN y < 3 THEN 'warn' ELSE 'pass' END FROM f2
 UNION ALL SELECT ticker, 'concentration', CASE WHEN top_share IS NULL THEN 'n/a' WHEN top_share > 0.5::DOUBLE THEN 'warn' ELSE 'pass' END FROM f2)"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = adapters.facts(spark, sf_dir).withColumn("legal_type", F.when(F.col("avg_volume") == 0, "Exchange Traded Note")).withColumn("category", F.when(F.col("avg_volume") == 17000, "Trading--Leveraged").otherwise(F.col("category")))
    return screen.fact_checks(facts, F.lit(TODAY).cast("date"))


@query(f"WITH {CHECKS} SELECT * FROM ch")
def screen_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


@query(
    f"WITH {CHECKS} SELECT ticker, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'n/a' END AS verdict,"
    " count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'warn') AS n_warn, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'n/a') AS n_na FROM ch GROUP BY 1"
)
def screen_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.roll_up(_checks(spark, sf_dir))


BOOK = "book AS (SELECT d, v / lag(v) OVER (ORDER BY d) - 1 AS p FROM sim WHERE leg = 'target')"
PAIR = f"{simulated('quarter')}, {BOOK}, c AS (SELECT ticker, d, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS c FROM px), j AS (SELECT ticker, d, c, p FROM c JOIN book USING (d) WHERE c IS NOT NULL AND p IS NOT NULL)"


def _book_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sim(spark, sf_dir, "quarterly").where("leg = 'target'")


@query(
    f"{PAIR}, lv AS (SELECT d, v, v / max(v) OVER (ORDER BY d) - 1 AS dd FROM sim WHERE leg = 'target'), t AS (SELECT arg_min(d, (dd, d)) AS tr FROM lv), k AS (SELECT arg_min(d, (-v, d)) AS pk FROM lv, t WHERE d <= tr),"
    " w AS (SELECT ticker, product(1 + c) - 1 AS dd_return FROM j, t, k WHERE d BETWEEN pk AND tr GROUP BY 1), a AS (SELECT ticker, count(*) AS n, corr(c, p) AS rho FROM j GROUP BY 1), r AS (SELECT ticker, corr(c, p) AS red_rho FROM j WHERE p < 0 GROUP BY 1 HAVING count(*) >= 20)"
    " SELECT ticker, n, round(rho, 8) AS rho, round(red_rho, 8) AS red_rho, round(dd_return, 8) AS dd_return, CASE WHEN n < 60 OR rho IS NULL THEN 'n/a' WHEN rho > 0.85 THEN 'fail' WHEN rho > 0.6 OR coalesce(red_rho - rho > 0.15, FALSE) THEN 'warn' ELSE 'pass' END AS status FROM a LEFT JOIN r USING (ticker) LEFT JOIN w USING (ticker)"
)
def screen_diversifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _book_curve(spark, sf_dir)
    out = screen.diversifier(drawdown.pct_change(adapters.prices(spark, sf_dir, "week"), "ticker"), drawdown.pct_change(curve, "leg", "v"))
    return rounded(out, "rho", "red_rho", "dd_return", digits=8)


@query(
    f"WITH {sql.SUPPLIER_PX}, c AS (SELECT ticker, d, close / max(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS dd FROM spx), t AS (SELECT ticker, date_diff('day', min(d), max(d)) / 365.25::DOUBLE AS years, min(dd) AS depth FROM c GROUP BY 1)"
    " SELECT ticker, round(years, 8) AS years, round(depth, 8) AS depth, CASE WHEN years < 2 THEN 'n/a' WHEN depth >= 0 THEN 'pass' WHEN depth < -0.35::DOUBLE THEN 'warn' WHEN depth <= -0.3::DOUBLE THEN 'warn' ELSE 'pass' END AS status FROM t"
)
def screen_own_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = adapters.supplier_prices(spark, sf_dir).withColumnRenamed("close", "x")
    return rounded(screen.own_drawdown(levels, F.lit(-0.35)), "years", "depth", digits=8)


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, symbol, w: the ten parts that each supplier in credit sold most of, as shares of those ten; the others show no holdings."""
    line = adapters.table(spark, sf_dir, "lineitem").join(adapters.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    sums = line.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    top = sums.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc(F.round("v", 4)), "l_partkey"))).where("k <= 10")
    return top.select(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.col("l_partkey").alias("symbol"), (F.col("v") / F.sum("v").over(Window.partitionBy("l_suppkey"))).alias("w"))


def _funds(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    """ticker, category: the suppliers with odd keys are held, the others are candidates; nations are categories."""
    return adapters.table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 2 == int(odd)).select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.concat(F.lit("N"), "s_nationkey").alias("category"))


OVERLAP_SQL = (
    "s AS (SELECT l_suppkey, l_partkey, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(v, 4) DESC, l_partkey) AS k FROM s),"
    " h AS (SELECT 'S' || l_suppkey AS ticker, l_partkey AS symbol, l_suppkey, v / sum(v) OVER (PARTITION BY l_suppkey) AS w FROM k WHERE k <= 10), pp AS (SELECT a.ticker, b.ticker AS held_ticker, round(sum(least(a.w, b.w)), 12) AS overlap FROM h a JOIN h b USING (symbol) WHERE a.l_suppkey % 2 = 0 AND b.l_suppkey % 2 = 1 GROUP BY 1, 2),"
    " b AS (SELECT ticker, max(overlap) AS overlap, arg_min(held_ticker, (-overlap, held_ticker)) AS held_ticker FROM pp GROUP BY 1), same AS (SELECT s_nationkey, min('S' || s_suppkey) AS t FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY 1),"
    " ov AS (SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_acctbal > 0 AND c.known AND EXISTS (SELECT 1 FROM h WHERE l_suppkey % 2 = 1) THEN coalesce(overlap, 0) END AS overlap, held_ticker, t FROM supplier LEFT JOIN b ON b.ticker = 'S' || s_suppkey LEFT JOIN same USING (s_nationkey) LEFT JOIN (SELECT DISTINCT ticker, TRUE AS known FROM h) c ON c.ticker = 'S' || s_suppkey WHERE s_suppkey % 2 = 0),"
    " lap AS (SELECT ticker, CASE WHEN overlap IS NULL THEN t ELSE held_ticker END AS held_ticker, overlap, CASE WHEN overlap >= 0.7 THEN 'fail' WHEN overlap >= 0.4 THEN 'warn' WHEN overlap IS NOT NULL THEN 'pass' WHEN t IS NOT NULL THEN 'warn' ELSE 'n/a' END AS status FROM ov)"
)


@query(f"WITH {OVERLAP_SQL} SELECT ticker, held_ticker, round(overlap, 9) AS overlap, status FROM lap")
def screen_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.overlaps(_funds(spark, sf_dir, False), _funds(spark, sf_dir, True), _holdings(spark, sf_dir))
    return rounded(out, "overlap", digits=9)


#: What each of the suppliers' funds is said to be, from columns of supplier alone.
FUND_SQL = "fund AS (SELECT 'S' || s_suppkey AS ticker, s_suppkey, abs(s_acctbal) / 1e6 AS expense_ratio, abs(s_acctbal) * 5e4 AS aum, s_nationkey * 2e4 AS avg_volume, 'N' || s_nationkey AS category, (DATE '2001-08-01' - (abs(s_acctbal) / 4)::INTEGER)::DATE AS inception, CASE WHEN s_acctbal > 0 THEN s_nationkey / 30.0::DOUBLE END AS top_share FROM supplier)"


def _fund_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal = F.col("s_acctbal")
    return adapters.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"), (F.abs(bal) / 1e6).alias("expense_ratio"), (F.abs(bal) * 5e4).alias("aum"), (F.col("s_nationkey") * 2e4).alias("avg_volume"), F.concat(F.lit("N"), "s_nationkey").alias("category"),
        F.lit(None).cast("string").alias("legal_type"), F.date_sub(F.lit(TODAY).cast("date"), F.bround(F.abs(bal) / 4).cast("int")).alias("inception"), F.when(bal > 0, F.col("s_nationkey") / 30.0).alias("top_share"),
    )


#: The role verdicts that the screen is given: a nation's word for each candidate, with an in-sample end of its own.
ROLE_SQL = "rl AS (SELECT 'S' || s_suppkey AS ticker, ['improved', 'worsened', 'inconclusive', 'insufficient'][1 + s_nationkey % 4] AS verdict, CASE WHEN s_nationkey % 4 < 3 THEN (DATE '1999-01-04' + s_nationkey * 7)::DATE END AS own_end FROM supplier WHERE s_nationkey <> 3)"


SCREEN_SQL = f"""{simulated('quarter')}, {BOOK}, {sql.SUPPLIER_PX}, {OVERLAP_SQL}, {FUND_SQL}, {ROLE_SQL},
be AS (SELECT max(d) FILTER (WHERE k = n - floor(n * 0.3::DOUBLE)) AS e FROM (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM book WHERE p IS NOT NULL)),
ask AS (SELECT 'S' || s_suppkey AS ticker FROM supplier), ct AS (SELECT ask.ticker, least(coalesce(own_end, e), e) AS cut FROM ask LEFT JOIN rl USING (ticker), be),
sr AS (SELECT ticker, d, close / lag(close) OVER w - 1 AS c, close / max(close) OVER w - 1 AS dd FROM spx WINDOW w AS (PARTITION BY ticker ORDER BY d)),
bl AS (SELECT d, product(1 + p) OVER (ORDER BY d) AS x FROM book WHERE p IS NOT NULL UNION ALL SELECT (min(d) - INTERVAL 1 DAY)::DATE, 1.0::DOUBLE FROM book WHERE p IS NOT NULL),
bd AS (SELECT d, x / max(x) OVER (ORDER BY d) - 1 AS dd, arg_min(d, (-x, d)) OVER (ORDER BY d) AS peak FROM bl),
wk AS (SELECT cut, arg_min((dd, d, peak), (dd, d)) AS f FROM (SELECT DISTINCT cut FROM ct) JOIN bd ON bd.d <= cut GROUP BY 1),
hw AS (SELECT cut, min((sr.dd, sr.ticker)) AS worst FROM (SELECT DISTINCT cut FROM ct) JOIN sr ON sr.d <= cut WHERE substr(sr.ticker, 2)::INTEGER % 2 = 1 GROUP BY 1),
cl AS (SELECT sr.ticker, sr.d, c, dd, p, cut, f FROM sr JOIN ct USING (ticker) LEFT JOIN wk USING (cut) LEFT JOIN book ON book.d = sr.d WHERE sr.d <= cut),
fig AS (SELECT ticker, any_value(cut) AS cut, any_value(f) AS f, count(*) FILTER (WHERE c IS NOT NULL AND p IS NOT NULL) AS n, corr(c, p) AS rho, CASE WHEN count(*) FILTER (WHERE c IS NOT NULL AND p < 0) >= 20 THEN corr(c, p) FILTER (WHERE p < 0) END AS red,
 product(1 + c) FILTER (WHERE p IS NOT NULL AND c IS NOT NULL AND d BETWEEN f[3] AND f[2]) - 1 AS thr, date_diff('day', min(d), max(d)) / 365.25::DOUBLE AS y, min((dd, d)) AS deep FROM cl GROUP BY 1),
fg AS (SELECT fig.*, deep[1] AS depth, worst[1] AS pd, worst[2] AS peer, ' [in-sample through ' || fig.cut || ']' AS note FROM fig LEFT JOIN hw ON hw.cut = fig.cut),
dv AS (SELECT ticker, CASE WHEN n < 60 OR rho IS NULL THEN 'n/a' WHEN rho > 0.85 THEN 'fail' WHEN rho > 0.6 OR coalesce(red - rho > 0.15, FALSE) THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN n < 60 THEN 'only ' || n || ' common days' WHEN rho IS NULL THEN 'nothing varies' ELSE 'correlation ' || printf('%+.2f', rho) || ' over ' || n || ' days' || coalesce(printf(', %+.2f on red ones', red), '')
  || coalesce(printf('; %+.1f%% while the book fell %.1f%% from ', thr * 100, f[1] * 100) || f[3]::DATE || ' to ' || f[2]::DATE, '') END || note AS reason FROM fg),
od AS (SELECT ticker, CASE WHEN y < 2 THEN 'n/a' WHEN depth >= 0 THEN 'pass' WHEN depth < pd THEN 'warn' WHEN depth <= -0.3::DOUBLE THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN y < 2 THEN printf('only %.1f years of history', y) WHEN depth >= 0 THEN 'no fall' ELSE printf('fell %.1f%% by ', depth * 100) || deep[2]::DATE || printf(' in %.1f years', y)
  || CASE WHEN pd < 0 AND depth < pd THEN ', deeper than all that is held, ' || peer || printf(' with %.1f%%', pd * 100) WHEN pd < 0 THEN '; ' || peer || printf(' of what is held fell %.1f%%', pd * 100) ELSE '' END END || note AS reason FROM fg),
same2 AS (SELECT s_nationkey, min('S' || s_suppkey) AS t FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY 1),
p2 AS (SELECT a.ticker, round(sum(least(a.w, b.w)), 12) AS o, b.ticker AS ht FROM h a JOIN h b USING (symbol) WHERE b.l_suppkey % 2 = 1 GROUP BY a.ticker, b.ticker), b2 AS (SELECT ticker, max(o) AS o, arg_min(ht, (-o, ht)) AS ht FROM p2 GROUP BY 1),
lp AS (SELECT 'S' || s_suppkey AS ticker, CASE WHEN hk.ticker IS NULL THEN CASE WHEN t IS NOT NULL THEN 'warn' ELSE 'n/a' END WHEN coalesce(o, 0) >= 0.7 THEN 'fail' WHEN coalesce(o, 0) >= 0.4 THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN hk.ticker IS NULL THEN coalesce('of the same category as ' || t, 'no holdings to compare') WHEN coalesce(o, 0) = 0 THEN 'nothing in common with what is held' ELSE printf('%.0f%% in common with ', o * 100) || ht END AS reason
 FROM supplier LEFT JOIN (SELECT DISTINCT ticker FROM h) hk ON hk.ticker = 'S' || s_suppkey LEFT JOIN b2 ON b2.ticker = 'S' || s_suppkey LEFT JOIN same2 USING (s_nationkey)),
fy AS (SELECT *, greatest(date_diff('day', inception, DATE '{TODAY}'), 0) / 365.25::DOUBLE AS y FROM fund),
res AS (SELECT ticker, 'structure' AS "check", 'pass' AS status, category AS reason FROM fy
 UNION ALL SELECT ticker, 'cost', CASE WHEN expense_ratio <= 0.002::DOUBLE THEN 'pass' WHEN expense_ratio <= 0.005::DOUBLE THEN 'warn' ELSE 'fail' END, printf('%.2f%%', expense_ratio * 100) || CASE WHEN expense_ratio <= 0.002::DOUBLE THEN ' a year' WHEN expense_ratio <= 0.005::DOUBLE THEN ' a year, not cheap' ELSE ' a year, expensive' END FROM fy
 UNION ALL SELECT ticker, 'liquidity', CASE WHEN aum < 1e8 AND avg_volume < 1e5 THEN 'fail' WHEN aum < 1e8 OR avg_volume < 1e5 THEN 'warn' ELSE 'pass' END,
  '$' || printf('%.0f', aum / 1e6) || 'M, ' || format('{{:,}}', avg_volume::BIGINT) || ' shares a day' || CASE WHEN aum < 1e8 AND avg_volume < 1e5 THEN ': both too small' WHEN aum < 1e8 OR avg_volume < 1e5 THEN ': one too small' ELSE '' END FROM fy
 UNION ALL SELECT ticker, 'age', CASE WHEN y < 1 THEN 'fail' WHEN y < 3 THEN 'warn' ELSE 'pass' END, printf('%.1f years', y) || CASE WHEN y < 1 THEN ', too young' WHEN y < 3 THEN ', young' ELSE '' END FROM fy
 UNION ALL SELECT ticker, 'concentration', CASE WHEN top_share IS NULL THEN 'n/a' WHEN top_share > 0.5::DOUBLE THEN 'warn' ELSE 'pass' END, coalesce(printf('largest holdings %.0f%%', top_share * 100) || CASE WHEN top_share > 0.5::DOUBLE THEN ', concentrated' ELSE '' END, 'not published') FROM fy
 UNION ALL SELECT ticker, 'novelty', 'fail', 'held already' FROM fy WHERE s_suppkey % 2 = 1
 UNION ALL SELECT ticker, 'diversifier', coalesce(status, 'n/a'), coalesce(reason, 'no usable price history') FROM ask LEFT JOIN dv USING (ticker)
 UNION ALL SELECT ticker, 'own_drawdown', coalesce(status, 'n/a'), coalesce(reason, 'no usable price history') FROM ask LEFT JOIN od USING (ticker)
 UNION ALL SELECT ticker, 'overlap', status, reason FROM lp
 UNION ALL SELECT ticker, 'role', CASE verdict WHEN 'improved' THEN 'pass' WHEN 'worsened' THEN 'fail' ELSE 'n/a' END, coalesce(verdict, 'no role check') FROM ask LEFT JOIN rl USING (ticker))
SELECT * FROM res"""


@query(SCREEN_SQL)
def screen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every supplier's fund with its reason, before a held-out verdict: returns are looked at up to each candidate's own cut-off."""
    from tidemark.operators import simulate

    supplier = adapters.table(spark, sf_dir, "supplier")
    ticker, nation = F.concat(F.lit("S"), "s_suppkey"), F.col("s_nationkey")
    words = F.array(*[F.lit(w) for w in ("improved", "worsened", "inconclusive", "insufficient")])
    role = supplier.where("s_nationkey <> 3").select(ticker.alias("ticker"), F.get(words, nation % 4).alias("verdict"), F.when(nation % 4 < 3, F.date_add(F.lit("1999-01-04").cast("date"), nation * 7)).alias("in_sample_end"))
    book = drawdown.pct_change(_book_curve(spark, sf_dir), "leg", "v")
    end = simulate.split_days(book.select("leg", "d")).select("in_sample_end")
    return screen.screen(supplier.select(ticker.alias("ticker")), _fund_facts(spark, sf_dir), _funds(spark, sf_dir, True).select("ticker"), _holdings(spark, sf_dir), adapters.supplier_prices(spark, sf_dir), book.select("d", "r"), F.lit(TODAY).cast("date"), role, end)


#: Roles under this share count as gaps: with six roles of about equal size none lies under the default.
GAP = 0.17
HP = f"{sql.UNIVERSE}, hp AS (SELECT 'B' || (l_suppkey % 7) AS book, 'P' || l_partkey AS ticker, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2), un AS (SELECT * FROM uni)"
EXPO = f"{HP}, ex AS (SELECT book, role, sum(value) / any_value(total) AS exposure FROM hp JOIN un USING (ticker) JOIN (SELECT book, sum(value) AS total FROM hp GROUP BY 1) USING (book) GROUP BY 1, 2)"
GAPS = f"{EXPO}, gap AS (SELECT b.book, r.role, coalesce(exposure, 0) AS exposure FROM (SELECT DISTINCT book FROM hp) b CROSS JOIN (SELECT DISTINCT role FROM un) r LEFT JOIN ex ON ex.book = b.book AND ex.role = r.role WHERE coalesce(exposure, 0) <= {GAP}::DOUBLE)"
MENU = f"""{GAPS}, pool AS (SELECT g.book, u.* FROM gap g JOIN un u USING (role) WHERE NOT EXISTS (SELECT 1 FROM hp WHERE hp.book = g.book AND hp.ticker = u.ticker)),
ld AS (SELECT book, role, coalesce(arg_min(flavor, file_ord) FILTER (WHERE core), arg_min(flavor, file_ord)) AS lead FROM pool GROUP BY 1, 2),
ord AS (SELECT p.*, lead, min(file_ord) OVER (PARTITION BY p.book, p.role, flavor) AS shelf_ord FROM pool p JOIN ld ON ld.book = p.book AND ld.role = p.role),
rk AS (SELECT *, row_number() OVER (PARTITION BY book, role ORDER BY core DESC, (flavor = lead) DESC, shelf_ord, file_ord) AS place FROM ord)"""


def _discovery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = adapters.table(spark, sf_dir, "lineitem")
    held = line.groupBy(F.concat(F.lit("B"), F.col("l_suppkey") % 7).alias("book"), F.concat(F.lit("P"), "l_partkey").alias("ticker")).agg(F.sum("l_extendedprice").alias("value"))
    return keep(held, "held"), keep(adapters.universe(spark, sf_dir), "universe")


@query(f"WITH {EXPO} SELECT book, role, round(exposure, 8) AS exposure FROM ex")
def role_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discover.exposure(*_discovery(spark, sf_dir)), "exposure", digits=8)


@query(f"WITH {GAPS} SELECT book, role, round(exposure, 8) AS exposure FROM gap")
def gap_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discover.gaps(*_discovery(spark, sf_dir), threshold=GAP), "exposure", digits=8)


@query(f"WITH {MENU} SELECT book, role, lead, place, ticker, flavor, core FROM rk WHERE place <= 3")
def shelf_menu_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, universe = _discovery(spark, sf_dir)
    return discover.menu(held, universe, discover.gaps(held, universe, GAP))


@query(f"WITH {MENU} SELECT book, role, flavor, count(*) AS n FROM rk WHERE place > 3 AND flavor <> lead GROUP BY 1, 2, 3")
def shelf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, universe = _discovery(spark, sf_dir)
    return discover.more_shelves(held, universe, discover.gaps(held, universe, GAP))


#: Roles that are taken for satellites here, and a shelf that is asked for by name.
BETS, SHELF = ("PROMO",), "Brand#13"
NAMED = f"""{GAPS}, pl AS (SELECT g.book, u.*, CASE WHEN u.role = 'LARGE' THEN '{SHELF}' WHEN u.role = 'SMALL' THEN 'no such shelf' END AS wanted FROM gap g JOIN un u USING (role) WHERE NOT EXISTS (SELECT 1 FROM hp WHERE hp.book = g.book AND hp.ticker = u.ticker)),
pm AS (SELECT *, min(file_ord) OVER (PARTITION BY book, role, flavor) AS shelf_ord, bool_or(core) OVER (PARTITION BY book, role) AS any_core, (SELECT count(DISTINCT flavor) FROM pl x WHERE x.book = pl.book AND x.role = pl.role) AS shelves FROM pl),
pw AS (SELECT * REPLACE (coalesce(wanted, CASE WHEN role = 'PROMO' AND shelves = 1 THEN flavor END) AS wanted) FROM pm),
dr AS (SELECT *, row_number() OVER (PARTITION BY book, role ORDER BY core DESC, file_ord) AS k FROM pw WHERE flavor = wanted), fu AS (SELECT *, row_number() OVER (PARTITION BY book, role, flavor ORDER BY file_ord) AS k FROM pw WHERE wanted IS NULL AND role <> 'PROMO' AND core),
ti AS (SELECT *, row_number() OVER (PARTITION BY book, role ORDER BY file_ord) AS k FROM pw WHERE wanted IS NULL AND role <> 'PROMO' AND NOT any_core),
mn AS (SELECT * FROM dr WHERE k <= 6 UNION ALL SELECT * FROM fu WHERE k <= 3 UNION ALL SELECT * FROM ti WHERE k <= 3),
mp AS (SELECT book, role, row_number() OVER (PARTITION BY book, role ORDER BY CASE WHEN wanted IS NULL THEN shelf_ord END, core DESC, file_ord) AS place, ticker, flavor, core FROM mn)"""


def _menus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each book is shown of its gaps: all of them are named, one with a shelf, one with a shelf that does not exist."""
    held, universe = _discovery(spark, sf_dir)
    asked = discover.gaps(held, universe, GAP).select("book", "role", F.when(F.col("role") == "LARGE", SHELF).when(F.col("role") == "SMALL", "no such shelf").alias("flavor"))
    return discover.role_menus(asked, held, universe, BETS)


@query(f"WITH {NAMED} SELECT * FROM mp")
def role_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _menus(spark, sf_dir)[0]


@query(f"WITH {NAMED}, has AS (SELECT book, role, bool_or(flavor = wanted) AS known FROM pw GROUP BY 1, 2) SELECT book, role, flavor, count(*) AS n FROM pw JOIN has USING (book, role) WHERE (wanted IS NULL OR known) AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.book = pw.book AND mp.role = pw.role AND mp.flavor = pw.flavor) GROUP BY 1, 2, 3")
def role_menu_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _menus(spark, sf_dir)[1]


@query(f"WITH {NAMED} SELECT book, role, any_value(wanted) AS flavor, list_aggregate(list_sort(list(DISTINCT flavor)), 'string_agg', ',') AS shelves FROM pw WHERE wanted IS NOT NULL GROUP BY book, role HAVING NOT bool_or(flavor = wanted)")
def role_menu_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _menus(spark, sf_dir)[2].withColumn("shelves", F.array_join("shelves", ","))
