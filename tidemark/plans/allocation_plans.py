"""Queries over allocation and rebalancing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import allocate
from tidemark.plans import sql
from tidemark.plans.ledger_plans import rounded
from tidemark.plans.registry import query
from tidemark.sources import adapters

NEW_CASH = 500_000.0
#: Part types in the place of roles.
TYPE_ROLES = {"STANDARD": "us-large", "MEDIUM": "intl-developed", "PROMO": "bond-aggregate", "LARGE": "treasury", "SMALL": "gold", "ECONOMY": "reit"}
ROLE_CASE = "CASE role " + " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in TYPE_ROLES.items()) + " END"
TEMPLATE = [(p, b, bw, r, rw) for p, buckets in allocate.PRESETS.items() for b, bw in buckets.items() for r, rw in allocate.ROLE_WEIGHTS[b].items()]
TEMPLATE_SQL = "tpl(preset, bucket, bucket_weight, role, role_weight) AS (VALUES " + ", ".join(f"('{p}', '{b}', {bw!r}::DOUBLE, '{r}', {rw!r}::DOUBLE)" for p, b, bw, r, rw in TEMPLATE) + ")"

UNI = f"""{sql.HELD}, {sql.TARGET}, tot AS (SELECT book, sum(value) AS total FROM hv GROUP BY 1),
u AS (SELECT b.book, l.ticker, coalesce(h.value, 0) AS held, coalesce(t.w, 0) AS w, l.price, total, coalesce(h.value, 0) / total AS cur_w
  FROM tot b CROSS JOIN lastpx l LEFT JOIN hv h ON h.book = b.book AND h.ticker = l.ticker LEFT JOIN target t ON t.ticker = l.ticker WHERE h.value IS NOT NULL OR t.w IS NOT NULL)"""


def _out(trade: str) -> str:
    return f"SELECT book, ticker, CASE WHEN abs({trade}) < 1 THEN 'hold' WHEN {trade} > 0 THEN 'buy' ELSE 'sell' END AS action, round(CASE WHEN abs({trade}) < 1 THEN 0 ELSE abs({trade}) END, 0) AS dollars, round(CASE WHEN abs({trade}) < 1 THEN 0 ELSE abs({trade}) / price END, 6) AS shares, round(cur_w, 8) AS cur_w, w AS target_w"


def _suggest(spark: SparkSession, sf_dir: str, mode: str, **more) -> DataFrame:
    held = adapters.held_values(spark, sf_dir)
    out = allocate.suggest(mode, held, held.select("ticker", "price").distinct(), adapters.target(spark), **more).drop("rule", "reason")
    return rounded(rounded(rounded(out, "dollars", digits=0), "shares"), "cur_w", digits=8)


@query(f"WITH {UNI} {_out('(w * total - held)')} FROM u")
def rebalance_to_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggest(spark, sf_dir, "to_total")


@query(f"WITH {UNI}, b AS (SELECT *, bool_or(abs(cur_w - w) > least(0.30::DOUBLE, 0.9::DOUBLE * w) + 1e-9) OVER (PARTITION BY book) AS breach FROM u) {_out('(CASE WHEN breach THEN w * total - held ELSE 0 END)')} FROM b")
def rebalance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggest(spark, sf_dir, "bands", band=0.30, band_rel=0.9)


@query(
    f"WITH {UNI}, s AS (SELECT *, greatest(0, w * (total + {NEW_CASH}::DOUBLE) - held) AS short FROM u), a AS (SELECT *, sum(short) OVER (PARTITION BY book) AS alls FROM s)"
    f" {_out(f'(CASE WHEN w <= 0 THEN 0 WHEN alls > 0 THEN {NEW_CASH}::DOUBLE * short / alls ELSE {NEW_CASH}::DOUBLE * w END)')} FROM a"
)
def rebalance_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggest(spark, sf_dir, "cash_flow_only", new_cash=NEW_CASH)


@query(f"WITH {UNI} {_out(f'({NEW_CASH}::DOUBLE * w)')} FROM u")
def rebalance_dca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggest(spark, sf_dir, "fixed_dca", new_cash=NEW_CASH)


@query(f"WITH {UNI}, t AS (SELECT book, w * total - held AS x FROM u) SELECT book, round(sum(CASE WHEN x >= 1 THEN x ELSE 0 END), 0) AS buy, round(sum(CASE WHEN x <= -1 THEN -x ELSE 0 END), 0) AS sell, round(sum(CASE WHEN abs(x) >= 1 THEN x ELSE 0 END), 2) + 0.0::DOUBLE AS net FROM t GROUP BY 1")
def suggestion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = adapters.held_values(spark, sf_dir)
    out = allocate.totals(allocate.suggest("to_total", held, held.select("ticker", "price").distinct(), adapters.target(spark)))
    return rounded(out, "buy", "sell", digits=0).withColumn("net", F.col("net") + 0.0)


@query(f"WITH {sql.HELD} SELECT book, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY book) AS w FROM (SELECT DISTINCT book, ticker FROM hv)")
def equal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.equal_weight(adapters.held_values(spark, sf_dir))


@query(
    f"WITH {sql.px('week')}, r AS (SELECT ticker, d, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM px), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM r WHERE r IS NOT NULL),"
    " v AS (SELECT ticker, stddev_samp(r) AS s FROM k WHERE k <= 252 GROUP BY 1) SELECT ticker, round(1 / s / sum(1 / s) OVER (), 8) AS w FROM v"
)
def inverse_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocate.inverse_vol(adapters.prices(spark, sf_dir, "week")), "w", digits=8)


@query(
    f"WITH RECURSIVE {sql.HELD}, n AS (SELECT book, ticker, value / sum(value) OVER (PARTITION BY book) AS w, count(*) OVER (PARTITION BY book) AS n FROM hv),"
    " it AS (SELECT book, 0 AS k, any_value(n) AS n, list(ticker ORDER BY ticker) AS ts, list(w ORDER BY ticker) AS ws FROM n GROUP BY 1 UNION ALL SELECT book, k + 1, n, ts, list_transform(ws, lambda w: CASE WHEN w > 0.201::DOUBLE + 1e-12 THEN 0.201::DOUBLE WHEN w < 0.201::DOUBLE - 1e-12 THEN w +"
    " list_sum(list_transform(ws, lambda y: greatest(y - 0.201::DOUBLE, 0))) * w / list_sum(list_transform(ws, lambda y: CASE WHEN y < 0.201::DOUBLE - 1e-12 THEN y ELSE 0 END)) ELSE w END) FROM it WHERE k < n)"
    " SELECT book, unnest(ts) AS ticker, round(unnest(ws), 8) AS w FROM it WHERE k = n"
)
def cap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = adapters.held_values(spark, sf_dir).select("book", "ticker", F.col("value").alias("w"))
    return rounded(allocate.apply_caps(held, 0.201), "w", digits=8)


@query(
    f"WITH {sql.HELD}, v AS (SELECT ticker, stddev_samp(r) AS s FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM (SELECT ticker, d, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM pm) WHERE r IS NOT NULL) WHERE k <= 252 GROUP BY 1)"
    " SELECT 'equal_weight' AS rule, book, ticker, round(1.0::DOUBLE / count(*) OVER (PARTITION BY book), 8) AS w FROM (SELECT DISTINCT book, ticker FROM hv) UNION ALL SELECT 'inverse_vol', book, ticker, round(1 / s / sum(1 / s) OVER (PARTITION BY book), 8) FROM (SELECT DISTINCT book, ticker FROM hv) JOIN v USING (ticker)"
)
def allocate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, px = adapters.held_values(spark, sf_dir), adapters.prices(spark, sf_dir, "month")
    members = held.select("book", "ticker").unionByName(held.select("book", F.lit("CASH").alias("ticker")))  # cash gets no weight
    parts = [allocate.allocate(rule, members, px if allocate.needs_series(rule) else None).withColumn("rule", F.lit(rule)) for rule in ("equal_weight", "inverse_vol")]
    return rounded(parts[0].unionByName(parts[1]), "w", digits=8)


@query(
    f"WITH {UNI} SELECT book, ticker, CASE WHEN abs(w * total - held) < 1 THEN 'on target' WHEN w = 0 THEN 'target 0%: the position is sold off' ELSE printf('%.1f%% held, %.1f%% wanted', cur_w * 100, w * 100) END AS reason FROM u"
)
def rebalance_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = adapters.held_values(spark, sf_dir)
    return allocate.suggest("to_total", held, held.select("ticker", "price").distinct(), adapters.target(spark)).select("book", "ticker", "reason")


HELD_PARTS = "hp AS (SELECT 'B' || (l_suppkey % 7) AS book, 'P' || l_partkey AS ticker, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"
ROLES = f"{sql.UNIVERSE}, {HELD_PARTS}, k AS (SELECT book, role, ticker, row_number() OVER (PARTITION BY book, role ORDER BY value DESC, ticker) AS k FROM hp JOIN uni USING (ticker)), f AS (SELECT role, arg_min(ticker, file_ord) AS dflt FROM uni GROUP BY 1), rr AS (SELECT b.book, f.role, coalesce(k.ticker, dflt) AS ticker FROM (SELECT DISTINCT book FROM hp) b CROSS JOIN f LEFT JOIN k ON k.book = b.book AND k.role = f.role AND k.k = 1)"


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = adapters.table(spark, sf_dir, "lineitem")
    held = line.groupBy(F.concat(F.lit("B"), F.col("l_suppkey") % 7).alias("book"), F.concat(F.lit("P"), "l_partkey").alias("ticker")).agg(F.sum("l_extendedprice").alias("value"))
    return allocate.resolve_roles(adapters.universe(spark, sf_dir), held)


@query(f"WITH {ROLES} SELECT * FROM rr")
def role_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir)


@query(
    f"WITH {ROLES}, {TEMPLATE_SQL}, p AS (SELECT t.preset, r.book, r.ticker, bucket_weight * role_weight / sum(role_weight) OVER (PARTITION BY t.preset, r.book, bucket) AS w FROM (SELECT book, {ROLE_CASE} AS role, ticker FROM rr) r JOIN tpl t ON t.role = r.role AND role_weight > 0)"
    " SELECT preset, book, ticker, round(sum(w) / sum(sum(w)) OVER (PARTITION BY preset, book), 8) AS w FROM p GROUP BY 1, 2, 3"
)
def preset_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in TYPE_ROLES.items() for x in kv])
    roles = _roles(spark, sf_dir).withColumn("role", F.element_at(names, F.col("role")))
    parts = []
    for preset in allocate.PRESETS:
        template = spark.createDataFrame([t[1:] for t in TEMPLATE if t[0] == preset], "bucket string, bucket_weight double, role string, role_weight double")
        parts.append(allocate.preset_target(roles, template).withColumn("preset", F.lit(preset)))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "w", digits=8)


@query(
    "WITH a AS (SELECT c_custkey AS id, (c_custkey % 3)::INTEGER AS horizon, (c_custkey // 3 % 3)::INTEGER AS loss_response, (c_custkey // 9 % 3)::INTEGER AS cash_buffer FROM customer), s AS (SELECT *, horizon + loss_response + cash_buffer AS score FROM a)"
    " SELECT *, CASE WHEN horizon = 0 OR score <= 2 THEN 'conservative' WHEN score <= 4 THEN 'moderate' ELSE 'aggressive' END AS posture FROM s"
)
def onboarding_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    answers = adapters.table(spark, sf_dir, "customer").select(key.alias("id"), (key % 3).cast("int").alias("horizon"), (F.floor(key / 3) % 3).cast("int").alias("loss_response"), (F.floor(key / 9) % 3).cast("int").alias("cash_buffer"))
    return allocate.posture(answers)


@query(f"WITH {sql.HELD} SELECT book, ticker, round(value, 3) AS value, round(value / sum(value) OVER (PARTITION BY book), 8) AS w FROM hv")
def held_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = allocate.held_weights(adapters.held_values(spark, sf_dir))
    return rounded(rounded(out, "value", digits=3), "w", digits=8)


@query("WITH raw AS (SELECT 'T' || (c_nationkey % 4) AS target_id, trim(c_mktsegment) AS ticker, sum(abs(c_acctbal)) AS w FROM customer GROUP BY 1, 2) SELECT target_id, ticker, round(w / sum(w) OVER (PARTITION BY target_id), 8) AS w FROM raw")
def target_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.ledger_files import normalise_target

    rows = adapters.table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), F.col("c_nationkey") % 4).alias("target_id"), F.col("c_mktsegment").alias("ticker"), F.abs("c_acctbal").alias("w"))
    return rounded(normalise_target(rows, "target_id"), "w", digits=8)
