"""Tables of prices, splits and fund facts: freshness, reading as of a day, provider rows, and their sinks.

Raw and total-return closes never mix: basis is a partition column of the series table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite, fixed, usable_price
from tidemark.sources.cache import merge_into

STALE_DAYS, GRACE_DAYS, LAG_FLAG_DAYS = 10, 4, 4
PRICE_TTL, SPLIT_TTL, FACT_TTL, WARM_TTL = "20 hours", "7 days", "7 days", "6 hours"
SERIES = "ticker string, d date, close double, basis string, source string, fetched_at timestamp"


def fresh(fetched_at: Column, now: Column, ttl: str, allow_stale: bool = False) -> Column:
    """Whether a row was fetched at most ttl ago and not over five minutes in the future; stale rows pass if allowed."""
    not_ahead = fetched_at <= now + F.expr("interval 5 minutes")
    return fetched_at.isNotNull() & not_ahead & (F.lit(allow_stale) | (fetched_at >= now - F.expr(f"interval {ttl}")))


def read_series(spark: SparkSession, path: str, basis: str, now: Column, allow_stale: bool = False) -> DataFrame:
    """ticker, d, close, source, fetched_at of one basis: usable closes of fresh rows, the one fetched last for each day."""
    rows = spark.read.schema(SERIES + ", bucket int").parquet(path).where((F.col("basis") == basis) & usable_price(F.col("close")) & fresh(F.col("fetched_at"), now, PRICE_TTL, allow_stale))
    last = F.row_number().over(Window.partitionBy("ticker", "d").orderBy(F.desc("fetched_at"), "source"))
    return rows.withColumn("k", last).where("k = 1").select("ticker", "d", "close", "source", "fetched_at")


def write_series(rows: DataFrame, path: str) -> None:
    """Merges rows of SERIES into their table, by basis, ticker and day; of a day the close fetched last stays. Writing again changes nothing."""
    merge_into(rows.select(*[c.split(" ")[0] for c in SERIES.split(", ")]), path, ("ticker", "d"), layout=("basis",))


def covers(series: DataFrame, end: Column) -> DataFrame:
    """Tickers whose series reaches the day, give or take GRACE_DAYS."""
    return series.groupBy("ticker").agg(F.max("d").alias("last")).where(F.col("last") >= F.date_sub(end, GRACE_DAYS)).select("ticker")


def latest_cached(rows: DataFrame, asof: Column, now: Column, allow_stale: bool = False) -> DataFrame:
    """ticker, asof_date, close, source, fetched_at: of usable fresh rows at or before the day and not over STALE_DAYS old, the newest day, fetched last."""
    ok = rows.where((F.col("asof_date") <= asof) & (F.col("asof_date") >= F.date_sub(asof, STALE_DAYS)) & usable_price(F.col("close")) & fresh(F.col("fetched_at"), now, PRICE_TTL, allow_stale))
    return ok.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("asof_date"), F.desc("fetched_at")))).where("k = 1").drop("k", "bucket")


def first_provider(*sources: DataFrame) -> DataFrame:
    """Rows of the first source that has a ticker at all (columns of each: ticker and more)."""
    both = None
    for k, s in enumerate(sources):
        s = s.withColumn("provider", F.lit(k))
        both = s if both is None else both.unionByName(s)
    return both.withColumn("first", F.min("provider").over(Window.partitionBy("ticker"))).where("provider = first").drop("first", "provider")


def provider_closes(rows: DataFrame, total_return: bool) -> DataFrame:
    """ticker, d, close of provider rows of text (ticker, date, close, adjClose, splitFactor).

    Raw closes are divided by the factors of all later splits, whatever window is asked for later: filter by day after
    this, not before. Values that are no finite numbers are dropped; a missing factor is 1.
    """
    number = lambda c: finite(F.col(c).try_cast("double"))
    day = F.try_to_date(F.substring("date", 1, 10), "yyyy-MM-dd")
    factor = F.coalesce(F.when(number("splitFactor") > 0, number("splitFactor")), F.lit(1.0))
    typed = rows.select("ticker", day.alias("d"), number("close").alias("raw"), number("adjClose").alias("adjusted"), factor.alias("factor")).where("d is not null")
    later = Window.partitionBy("ticker").orderBy("d").rowsBetween(1, Window.unboundedFollowing)
    close = F.col("adjusted") if total_return else F.col("raw") / F.coalesce(F.product("factor").over(later), F.lit(1.0))
    out = typed.withColumn("close", close)
    return out.where(usable_price(F.col("close"))).select("ticker", "d", "close")


def clean_splits(rows: DataFrame) -> DataFrame:
    """ticker, d, ratio without ratios that are not above 0 or do nothing."""
    return rows.where(F.col("d").isNotNull() & (F.col("ratio") > 0) & ~F.isnan("ratio") & (F.col("ratio") != 1)).select("ticker", "d", "ratio")


def split_rows_to_keep(found: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Split rows to store: those found, and for tickers without any a row that does nothing, so that the answer is remembered."""
    none = asked.join(found.select("ticker"), "ticker", "left_anti").select("ticker", F.lit("1970-01-01").cast("date").alias("d"), F.lit(1.0).alias("ratio"))
    return found.select("ticker", "d", "ratio").unionByName(none).withColumn("fetched_at", now)


def normalise_facts(raw: DataFrame) -> DataFrame:
    """Fund facts from provider rows of text and numbers: missing, blank and non-finite cells become NULL, epochs dates, holdings a map."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    number = lambda c: finite(F.col(c).try_cast("double"))
    held = F.filter(F.coalesce(F.col("holdings"), F.array().cast("array<struct<symbol:string,weight:double>>")), lambda h: h["symbol"].isNotNull() & (F.trim(h["symbol"]) != "") & h["weight"].isNotNull() & ~F.isnan(h["weight"]))
    return raw.select(
        "ticker", number("expense_ratio").alias("expense_ratio"), number("aum").alias("aum"), number("avg_volume").alias("avg_volume"), text("category").alias("category"), text("family").alias("family"),
        text("legal_type").alias("legal_type"), text("quote_type").alias("quote_type"), F.to_date(F.timestamp_seconds(number("inception_epoch"))).alias("inception"),
        F.map_from_entries(F.transform(held, lambda h: F.struct(F.upper(F.trim(h["symbol"])), h["weight"]))).alias("top_holdings"),
    )


FACTS = "ticker string, expense_ratio double, aum double, avg_volume double, category string, family string, legal_type string, quote_type string, inception date, top_holdings map<string,double>, fetched_at timestamp"


def write_facts(facts: DataFrame, path: str) -> None:
    """Merges fund facts into the cache, one JSON object each; of a ticker the facts fetched last stay. Writing again changes nothing."""
    merge_into(facts.select(*[f.split(" ")[0] for f in FACTS.split(", ")]), path, ("ticker",), fmt="json")


def read_facts(spark: SparkSession, path: str, now: Column, allow_stale: bool = False) -> DataFrame:
    """The fund facts fetched last for each ticker, if fresh; rows that are no JSON objects or have no time are left out.

    Figures that are not finite become NULL, and holdings with such a weight are dropped.
    """
    rows = spark.read.schema(FACTS + ", broken string").option("columnNameOfCorruptRecord", "broken").option("allowNonNumericNumbers", True).option("recursiveFileLookup", True).json(path)
    rows = rows.where(F.col("broken").isNull() & F.col("ticker").isNotNull() & fresh(F.col("fetched_at"), now, FACT_TTL, allow_stale)).drop("broken")
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("fetched_at")))).where("k = 1").drop("k")
    held = F.map_filter("top_holdings", lambda _, w: finite(w).isNotNull())
    return last.withColumns({c: finite(F.col(c)) for c in ("expense_ratio", "aum", "avg_volume")} | {"top_holdings": held})


def without_facts(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """The tickers asked for that have no facts."""
    return asked.select("ticker").distinct().join(facts, "ticker", "left_anti")


def append_latest(rows: DataFrame, path: str) -> None:
    """Merges latest closes (ticker, asof_date, close, source, fetched_at) into their table; of a day the one fetched last stays. Writing again changes nothing."""
    merge_into(rows.select("ticker", "asof_date", "close", "source", "fetched_at"), path, ("ticker", "asof_date"))


def write_splits(rows: DataFrame, path: str) -> None:
    """Merges split_rows_to_keep into their table: a ticker's splits are those that were fetched last."""
    merge_into(rows.select("ticker", "d", "ratio", "fetched_at"), path, ("ticker",), whole=True)


def read_splits(spark: SparkSession, path: str, now: Column, allow_stale: bool = False) -> tuple[DataFrame, DataFrame]:
    """ticker, d, ratio of fresh splits; and the tickers of which it is known what splits they have, if any."""
    rows = spark.read.schema("ticker string, d date, ratio double, fetched_at timestamp, bucket int").parquet(path).where(fresh(F.col("fetched_at"), now, SPLIT_TTL, allow_stale))
    return clean_splits(rows), rows.select("ticker").distinct()


def age_hours(fetched_at: Column, now: Column) -> Column:
    """Hours since a row was fetched; 0 if that lies in the future."""
    return F.greatest((now.cast("timestamp").cast("double") - fetched_at.cast("timestamp").cast("double")) / 3600, F.lit(0.0))


def build_universe(listed: DataFrame, categories: DataFrame, curated: DataFrame, least_size: float = 1e9, most: int = 100) -> DataFrame:
    """ticker, name, role, summary, core, flavor, file_ord: a universe from what is listed and what is chosen by hand.

    listed: ticker, name, quote_type, category, size; categories: category, role, core, flavor; curated: ticker, name, role,
    summary, flavor and place. Of each category the most largest funds above least_size are taken; not those listed abroad
    (a dot in the ticker), of other kinds, or leveraged or inverse by name. Of a ticker that comes twice the curated row
    counts, else the larger. In a role curated rows stand first, then the larger ones; file_ord counts over all roles.
    """
    name = F.lower("name")
    odd = name.contains("leveraged") | name.contains("inverse") | name.contains("ultra") | name.rlike("[23]x")
    fit = listed.where((F.col("quote_type") == "ETF") & ~F.col("ticker").contains(".") & ~odd & (F.col("size") > least_size)).join(F.broadcast(categories), "category")  # a vocabulary
    ranked = fit.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("size"), "ticker"))).where(F.col("k") <= most)
    pulled = ranked.select(F.upper("ticker").alias("ticker"), "name", "role", F.concat("category", F.lit(" ETF.")).alias("summary"), "core", "flavor", F.lit(None).cast("int").alias("place"), "size")
    chosen = curated.select(F.upper("ticker").alias("ticker"), "name", "role", "summary", F.lit(True).alias("core"), "flavor", "place", F.lit(None).cast("double").alias("size"))
    both = chosen.unionByName(pulled).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("place").asc_nulls_last(), F.desc("size"), "role"))).where("k = 1")
    # places within a role first; roles are few, and their sizes place them one after another
    own = both.withColumn("own", F.row_number().over(Window.partitionBy("role").orderBy(F.col("place").asc_nulls_last(), F.desc("size"), "ticker")))
    sizes = both.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("role", F.coalesce(F.sum("n").over(Window.orderBy("role").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return own.join(F.broadcast(before), "role").select("ticker", "name", "role", "summary", "core", "flavor", (F.col("start") + F.col("own")).cast("int").alias("file_ord"))


def export_ledger(ledger: DataFrame, path: str) -> None:
    """The ledger as a CSV in another tool's columns, texts made safe for spreadsheets."""
    from tidemark.functions.scalar import csv_safe

    ledger.select(F.col("d").alias("Date"), F.col("ticker").alias("Code"), F.lit("YAHOO").alias("DataSource"), F.lit("USD").alias("Currency"), F.col("price").alias("Price"), F.col("quantity").alias("Quantity"), F.col("action").alias("Action"), F.col("fee").alias("Fee"), csv_safe(F.col("note") if "note" in ledger.columns else F.lit("")).alias("Note")).write.mode("overwrite").option("header", True).csv(path)


def write_target(target: DataFrame, path: str) -> None:
    """The rows of target_rows as one CSV file in a folder: a target has a row for each fund."""
    target_rows(target).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def target_rows(target: DataFrame) -> DataFrame:
    """Ticker and Weight in percent with two decimals, largest first; a positive weight never prints as 0.00."""
    pct = F.col("w") * 100
    shown = F.when((F.col("w") > 0) & (fixed(pct, 2) == "0.00"), "0.01").otherwise(fixed(pct, 2))
    return target.orderBy(F.desc("w"), "ticker").select(F.col("ticker").alias("Ticker"), shown.alias("Weight"))
