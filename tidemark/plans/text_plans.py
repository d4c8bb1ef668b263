"""Queries over text, panels, freshness and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import fence, report
from tidemark.operators import ledger as ledger_ops
from tidemark.plans import sql
from tidemark.plans.ledger_plans import FOLD, rounded
from tidemark.plans.registry import query
from tidemark.sources import adapters, price_tables

TOKEN_SQL = r"\{\{\s*([A-Za-z][A-Za-z0-9_]*)\s*\}\}"
#: Claims that the prose may name.
CLAIMS = {"depth": "-9.84%", "ulcer": "2.40%", "value": "$14,647"}


@query(f"SELECT conv_id, turn, regexp_matches(regexp_replace(text, '{TOKEN_SQL}', '', 'g'), '{fence.numeral_class()}') AS bare FROM conversations WHERE text IS NOT NULL")
def fence_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", fence.has_bare_numeral(F.col("text")).alias("bare"))


PROSE_SQL = "CASE doc_id % 6 WHEN 0 THEN text || ' fell {{ Depth }} and {{ulcer}}' WHEN 1 THEN text || ' worth {{VALUE}} or {{nope}}' WHEN 2 THEN text || ' broken {{ulcer' WHEN 3 THEN '{{value}} as of {{depth}} ' || text WHEN 4 THEN text || ' about 十 percent {{depth}}' ELSE '{{ulcer}}' || text END"


def _nested(text: str) -> str:
    for name, value in CLAIMS.items():
        text = f"regexp_replace({text}, '(?i)\\{{\\{{\\s*{name}\\s*\\}}\\}}', '{value}', 'g')"
    return text


@query(
    f"WITH p AS (SELECT doc_id, {PROSE_SQL} AS prose FROM documents), r AS (SELECT *, {_nested('prose')} AS out FROM p) SELECT doc_id, CASE WHEN trim(prose) = '' OR regexp_matches(regexp_replace(prose, '{TOKEN_SQL}', '', 'g'), '{fence.numeral_class()}')"
    f" OR len(list_filter(regexp_extract_all(prose, '{TOKEN_SQL}', 1), lambda t: lower(t) NOT IN ('depth', 'ulcer', 'value'))) > 0 OR contains(out, '{{{{') OR contains(out, '}}}}') THEN NULL ELSE out END AS rendered FROM r"
)
def fence_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    prose = (
        F.when(k == 0, F.concat("text", F.lit(" fell {{ Depth }} and {{ulcer}}"))).when(k == 1, F.concat("text", F.lit(" worth {{VALUE}} or {{nope}}"))).when(k == 2, F.concat("text", F.lit(" broken {{ulcer")))
        .when(k == 3, F.concat(F.lit("{{value}} as of {{depth}} "), "text")).when(k == 4, F.concat("text", F.lit(" about 十 percent {{depth}}"))).otherwise(F.concat(F.lit("{{ulcer}}"), "text"))
    )
    claims = F.create_map(*[F.lit(x) for kv in CLAIMS.items() for x in kv])
    return adapters.table(spark, sf_dir, "documents").select("doc_id", fence.render(prose, claims).alias("rendered"))


@query("SELECT p_partkey, CASE WHEN abs(x) < 0.05::DOUBLE THEN 'mild' WHEN abs(x) < 0.15::DOUBLE THEN 'moderate' WHEN abs(x) < 0.30::DOUBLE THEN 'deep' ELSE 'severe' END AS band FROM (SELECT p_partkey, -p_size / 150.0::DOUBLE AS x FROM part)")
def band_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = -F.col("p_size") / 150.0
    return adapters.table(spark, sf_dir, "part").select("p_partkey", scalar.band(x, [0.05, 0.15, 0.30], ["mild", "moderate", "deep", "severe"], magnitude=True).alias("band"))


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS safe FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || text ELSE text END AS t FROM documents)")
def csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text"))
    return adapters.table(spark, sf_dir, "documents").select("doc_id", scalar.csv_safe(t).alias("safe"))


@query("SELECT p_partkey, regexp_matches(upper(trim(t)), '^[A-Z0-9.\\-]{1,15}$') AS ok FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_brand, '#', '-') END AS t FROM part)")
def ticker_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("-")))
    return adapters.table(spark, sf_dir, "part").select("p_partkey", scalar.is_ticker(t).alias("ok"))


@query("SELECT event_type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:05:00' AND ts >= TIMESTAMP '2024-01-13 00:00:00' GROUP BY 1")
def freshness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fetched at most a week before a fixed now, and not more than five minutes after it."""
    now, ts = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")
    return adapters.table(spark, sf_dir, "events").where(price_tables.fresh(ts, now, "7 days")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT event_id, round(greatest(date_diff('microsecond', ts, TIMESTAMP '2024-01-20 00:00:00') / 3.6e9, 0), 4) AS hours FROM events")
def cache_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, ts = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")
    return rounded(adapters.table(spark, sf_dir, "events").select("event_id", price_tables.age_hours(ts, now).alias("hours")), "hours", digits=4)


@query(f"WITH {sql.UNIVERSE}, {sql.FACTS} SELECT ticker FROM uni WHERE ticker NOT IN (SELECT ticker FROM facts WHERE top_share IS NOT NULL)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_tables.without_facts(adapters.universe(spark, sf_dir).select("ticker"), adapters.facts(spark, sf_dir).where("top_share is not null"))


@query(
    f"WITH RECURSIVE {sql.LEDGER}, {FOLD}, {sql.SUPPLIER_PX}, l AS (SELECT ticker, arg_max(close, d) AS close FROM spx GROUP BY 1)"
    " SELECT book, ticker, round(shares, 6) AS shares, round(cost_basis / shares, 6) AS avg_cost, round(shares * close, 3) AS value, round(shares * close - cost_basis, 3) AS unrealized, round(realized, 3) AS realized, l.close IS NOT NULL AS priced FROM pos LEFT JOIN l USING (ticker) WHERE shares > 1e-9"
)
def panel_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = adapters.supplier_prices(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "d").alias("close"))
    out = report.holdings(ledger_ops.positions(adapters.ledger(spark, sf_dir)), last).drop("cost_basis", "fees")
    return rounded(rounded(out, "shares", "avg_cost", digits=6), "value", "unrealized", "realized", digits=3)


@query("SELECT o_orderstatus, '{\"status\":\"' || o_orderstatus || '\",\"orders\":' || count(*) || ',\"customers\":' || count(DISTINCT o_custkey) || '}' AS summary FROM orders GROUP BY 1")
def run_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = adapters.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers"))
    return out.select("o_orderstatus", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "orders", "customers")).alias("summary"))


@query("SELECT s_suppkey, CASE WHEN abs(x) >= 1e3 THEN CASE WHEN abs(x / 1e3) < 10 THEN printf('%.2f', x / 1e3) ELSE printf('%.1f', x / 1e3) END || 'K' ELSE printf('%.0f', x) END AS human, printf('%+.2f%%', x / 12345 * 100) AS pct, printf('%.1f', x / 8) AS eighths, printf('%.2f', x / 16) AS sixteenths, CASE WHEN x < 0 THEN '-$' ELSE '$' END || format('{:,}', round_even(abs(x / 2), 0)::BIGINT) AS dollars FROM (SELECT s_suppkey, s_acctbal::DOUBLE AS x FROM supplier)")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables of balances, also as parts of two, where ties occur."""
    x = F.col("s_acctbal").cast("double")
    return adapters.table(spark, sf_dir, "supplier").select("s_suppkey", scalar.human(x).alias("human"), scalar.signed_percent(x / 12345).alias("pct"), scalar.fixed(x / 8, 1).alias("eighths"), scalar.fixed(x / 16, 2).alias("sixteenths"), scalar.dollars(x / 2).alias("dollars"))


def _band_sql(spec, x: str) -> str:
    cuts, words, magnitude = spec
    v = f"abs({x})" if magnitude else x
    return "CASE " + " ".join(f"WHEN {v} < {c!r}::DOUBLE THEN '{w}'" for c, w in zip(cuts, words[:-1], strict=True)) + f" ELSE '{words[-1]}' END"


TOKENS = ["max_drawdown", "cdar", "ulcer", "sharpe", "twr_annual", "gap_gold", "bench_dd_preset", "bench_ulcer_reference", "n_holdings"]
_SPECS = {t: fence.BANDS.get(t) or next((s for p, s in fence.PREFIX_BANDS.items() if t.startswith(p)), None) for t in TOKENS}


@query("SELECT p_partkey, t AS token, CASE t " + " ".join(f"WHEN '{t}' THEN {_band_sql(s, 'x')}" for t, s in _SPECS.items() if s) + " END AS band FROM (SELECT p_partkey, (p_size - 10) / 50.0::DOUBLE AS x, unnest([" + ", ".join(f"'{t}'" for t in TOKENS) + "]) AS t FROM part)")
def claim_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 10) / 50.0).alias("x"), F.explode(F.array(*[F.lit(t) for t in TOKENS])).alias("token"))
    return rows.select("p_partkey", "token", fence.band_of(F.col("token"), F.col("x")).alias("band"))


@query(
    "WITH n AS (SELECT n_nationkey AS k, n_name, s.v FROM nation JOIN (SELECT s_nationkey, avg(s_acctbal) / 1e4 AS v FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey), r AS (SELECT k, 'gap_' || regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS token, v, n_name FROM n UNION ALL SELECT k, 'sharpe', v * 3, n_name FROM n),"
    f" b AS (SELECT *, CASE WHEN token = 'sharpe' THEN {_band_sql(fence.BANDS['sharpe'], 'v')} ELSE {_band_sql(fence.PREFIX_BANDS['gap_'], 'v')} END AS band FROM r)"
    " SELECT k, string_agg('{{' || token || '}}  — about ' || n_name || ' (' || band || ')', chr(10) ORDER BY token) AS coarse, string_agg('{{' || token || '}}  — about ' || n_name || printf(' (%.3f)', v), chr(10) ORDER BY token) AS exact FROM b GROUP BY k"
)
def prompt_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = adapters.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.avg("s_acctbal") / 1e4).alias("v"))
    rows = means.join(adapters.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("k"))
    made = rows.select("k", "n_name", F.explode(F.array(F.struct(F.concat(F.lit("gap_"), fence.slug(F.col("n_name"))).alias("token"), F.col("v").alias("value")), F.struct(F.lit("sharpe").alias("token"), (F.col("v") * 3).alias("value")))).alias("c"))
    claims = fence.claim_rows(made.select("k", "c.token", "c.value", scalar.fixed(F.col("c.value"), 3).alias("rendered"), F.concat(F.lit("about "), "n_name").alias("label")), "k")
    return fence.prompt_listing(claims, "k", False).withColumnRenamed("listing", "coarse").join(fence.prompt_listing(claims, "k", True).withColumnRenamed("listing", "exact"), "k")
