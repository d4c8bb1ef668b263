"""Queries over price tables and report panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import allocate, bootstrap, drawdown, report
from tidemark.operators import ledger as ledger_ops
from tidemark.plans import sql
from tidemark.plans.ledger_plans import FOLD, rounded
from tidemark.plans.registry import query
from tidemark.sources import adapters, price_tables



@query(
    "WITH r AS (SELECT o_orderpriority AS ticker, o_orderdate::DATE AS d, o_totalprice AS raw, CASE WHEN o_orderkey % 40 = 0 THEN 1.07::DOUBLE ELSE 1.0 END AS f, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate::DATE ORDER BY o_orderkey) = 1),"
    " c AS (SELECT ticker, d, raw / coalesce(product(f) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS close FROM r) SELECT ticker, d, round(close, 6) AS close FROM c"
)
def provider_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = adapters.table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    o = o.withColumn("k", F.row_number().over(Window.partitionBy("o_orderpriority", "d").orderBy("o_orderkey"))).where("k = 1")
    raw = o.select(F.col("o_orderpriority").alias("ticker"), F.concat(F.col("d").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), F.col("o_totalprice").cast("string").alias("close"), F.lit(None).cast("string").alias("adjClose"), F.when(F.col("o_orderkey") % 40 == 0, "1.07").otherwise("none").alias("splitFactor"))
    return rounded(price_tables.provider_closes(raw, total_return=False), "close")


@query(
    "WITH r AS (SELECT user_id, event_type, ts::DATE AS asof_date, value AS close, ts AS fetched_at FROM events WHERE value > 0 AND ts <= TIMESTAMP '2024-01-25 00:05:00' AND ts::DATE <= DATE '2024-01-24' AND ts::DATE >= DATE '2024-01-14')"
    " SELECT event_type || user_id AS ticker, max(asof_date) AS asof_date, round(arg_max(close, fetched_at), 6) AS close FROM r GROUP BY 1"
)
def latest_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select(F.concat("event_type", "user_id").alias("ticker"), F.to_date("ts").alias("asof_date"), F.col("value").alias("close"), F.lit("cache").alias("source"), F.col("ts").cast("timestamp").alias("fetched_at"))
    out = price_tables.latest_cached(e, F.lit("2024-01-24").cast("date"), F.lit("2024-01-25 00:00:00").cast("timestamp"), allow_stale=True)
    return rounded(out.select("ticker", "asof_date", "close"), "close")


@query(
    f"WITH RECURSIVE {sql.LEDGER}, {FOLD}, {sql.SUPPLIER_PX}, l AS (SELECT ticker, arg_max(close, d) AS close FROM spx GROUP BY 1), h AS (SELECT *, shares * close AS value FROM pos LEFT JOIN l USING (ticker) WHERE shares > 1e-9)"
    " SELECT book, round(sum(coalesce(value, 0)), 2) AS value, round(sum(CASE WHEN close IS NULL THEN 0 ELSE cost_basis END), 2) AS priced_cost, round(sum(cost_basis), 2) AS cost_basis, round(sum(coalesce(value - cost_basis, 0)), 2) AS unrealized, round(sum(realized), 2) AS realized, round(sum(fees), 2) AS fees, count(*) FILTER (WHERE close IS NULL) AS unpriced, round(sum(coalesce(value - cost_basis, 0)) + sum(realized), 2) AS net FROM h GROUP BY 1"
)
def panel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = adapters.supplier_prices(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "d").alias("close"))
    out = report.totals(report.holdings(ledger_ops.positions(adapters.ledger(spark, sf_dir)), last))
    return rounded(out, "value", "priced_cost", "cost_basis", "unrealized", "realized", "fees", "net", digits=2)


@query(
    f"WITH {sql.px('month')}, c AS (SELECT ticker, close, d, close / max(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS dd FROM px), s AS (SELECT ticker, min(dd) AS depth, sqrt(avg(dd * dd)) AS ulcer FROM c GROUP BY 1),"
    " l AS (SELECT 'depth' AS metric, ticker, printf('%+.2f%%', depth * 100) AS v FROM s UNION ALL SELECT 'ulcer', ticker, printf('%+.2f%%', ulcer * 100) FROM s) SELECT metric, " + ", ".join(f"max(v) FILTER (WHERE ticker = '{t}') AS \"{t}\"" for t in adapters.TARGET) + " FROM l GROUP BY 1"
)
def panel_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.prices(spark, sf_dir, "month").withColumnRenamed("close", "x")
    figures = drawdown.curve(px, "ticker").groupBy(F.col("ticker").alias("leg")).agg(F.min("dd").alias("depth"), drawdown.ulcer(F.col("dd")).alias("ulcer"))
    return report.leg_table(figures, list(adapters.TARGET))


@query(
    f"WITH {sql.HELD}, {sql.TARGET}, w AS (SELECT book, ticker, value / sum(value) OVER (PARTITION BY book) AS cur_w FROM hv), t AS (SELECT book, ticker, w FROM target, (SELECT DISTINCT book FROM hv) WHERE w > 0)"
    " SELECT coalesce(t.book, w.book) AS book, coalesce(t.ticker, w.ticker) AS ticker, coalesce(w, 0) AS w, round(coalesce(cur_w, 0), 8) AS cur_w, round(coalesce(w, 0) - coalesce(cur_w, 0), 8) AS delta, w IS NULL AS omitted FROM t FULL JOIN w ON t.book = w.book AND t.ticker = w.ticker"
)
def panel_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = allocate.held_weights(adapters.held_values(spark, sf_dir)).drop("value")
    target = held.select("book").distinct().crossJoin(F.broadcast(adapters.target(spark).where("w > 0")))  # four tickers
    return rounded(report.proposal(target, held), "cur_w", "delta", digits=8)


@query(
    f"WITH {sql.FACTS} SELECT ticker, printf('%.2f%%', expense_ratio * 100) AS expense, '$' || CASE WHEN aum >= 1e9 THEN CASE WHEN aum / 1e9 < 10 THEN printf('%.2fB', aum / 1e9) ELSE printf('%.1fB', aum / 1e9) END ELSE CASE WHEN aum / 1e6 < 10 THEN printf('%.2fM', aum / 1e6) ELSE printf('%.1fM', aum / 1e6) END END AS aum,"
    " CASE WHEN avg_volume = 0 THEN '0' WHEN avg_volume / 1e3 < 10 THEN printf('%.2fK', avg_volume / 1e3) ELSE printf('%.1fK', avg_volume / 1e3) END AS volume, printf('%.1fy', greatest(date_diff('day', inception, DATE '2001-08-01'), 0) / 365.25::DOUBLE) AS age, category AS kind FROM facts"
)
def panel_securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.securities(adapters.facts(spark, sf_dir), F.lit("2001-08-01").cast("date"))


@query(
    "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS n_cache, list_aggregate(list_sort(list(DISTINCT event_type)), 'string_agg', ',') AS sources, min(ts::DATE) AS first_close, max(ts::DATE) AS last_close, date_diff('day', max(ts::DATE), DATE '2024-02-05')::INTEGER AS lag_days, date_diff('day', max(ts::DATE), DATE '2024-02-05') > 4 AS flagged, date_diff('day', max(ts::DATE), DATE '2024-02-05') > 10 AS alarm FROM events"
)
def panel_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_type") == "view", "cache").otherwise(F.col("event_type"))
    rows = adapters.table(spark, sf_dir, "events").select(source.alias("source"), F.to_date("ts").alias("asof_date"), F.col("ts").cast("timestamp").alias("fetched_at"))
    out = report.provenance(rows, F.lit("2024-02-05").cast("date"))
    named = F.array_sort(F.transform("sources", lambda s: F.when(s == "cache", "view").otherwise(s)))
    return out.select("n", "n_cache", F.array_join(named, ",").alias("sources"), "first_close", "last_close", "lag_days", "flagged", "alarm")


@query(
    "WITH c AS (SELECT 'P' || p_partkey AS ticker, p_name AS name, p_type AS category, p_retailprice * 1e6 AS size, CASE WHEN p_size % 7 = 0 THEN 'EQUITY' ELSE 'ETF' END AS quote_type, p_partkey FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, ticker) AS k FROM c WHERE quote_type = 'ETF' AND size > 9.2e8 AND NOT regexp_matches(lower(name), 'leveraged|inverse|ultra|[23]x')),"
    " b AS (SELECT ticker, name, lower(category) AS role, category || ' ETF.' AS summary, category <> 'PROMO' AS core, '' AS flavor, NULL AS place, size FROM f WHERE k <= 40), u AS (SELECT 'P1' AS ticker, 'Chosen' AS name, 'promo' AS role, 'By hand.' AS summary, TRUE AS core, 'x' AS flavor, 1 AS place, NULL AS size UNION ALL SELECT * FROM b WHERE ticker <> 'P1')"
    " SELECT ticker, name, role, summary, core, flavor, row_number() OVER (ORDER BY role, place ASC NULLS LAST, size DESC, ticker)::INTEGER AS file_ord FROM u"
)
def universe_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapters.table(spark, sf_dir, "part")
    listed = part.select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 7 == 0, "EQUITY").otherwise("ETF").alias("quote_type"), F.col("p_type").alias("category"), (F.col("p_retailprice") * 1e6).alias("size"))
    categories = part.select(F.col("p_type").alias("category"), F.lower("p_type").alias("role"), (F.col("p_type") != "PROMO").alias("core"), F.lit("").alias("flavor")).distinct()
    curated = spark.createDataFrame([("P1", "Chosen", "promo", "By hand.", "x", 1)], "ticker string, name string, role string, summary string, flavor string, place int")
    return price_tables.build_universe(listed, categories, curated, least_size=9.2e8, most=40)
