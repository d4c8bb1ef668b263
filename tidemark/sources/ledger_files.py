"""Readers of ledgers, targets and fund lists from files, with validation reports instead of silent repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import action_rank, is_ticker

ACTIONS = ("buy", "sell", "dividend", "fee", "interest", "deposit", "withdraw")
CSV_SCHEMA = "Date string, Code string, Action string, Quantity string, Price string, Fee string, Currency string, DataSource string, Note string"
# Activity types of the JSON export and the actions they become; others are skipped.
JSON_ACTIONS = {"BUY": "buy", "SELL": "sell", "DIVIDEND": "dividend", "FEE": "fee", "INTEREST": "interest"}
JSON_SCHEMA = "array<struct<symbol:string,currency:string,unitPrice:string,quantity:string,type:string,fee:string,dataSource:string,date:string,comment:string>>"


def _number(c: str) -> Column:
    text = F.trim(F.coalesce(F.col(c), F.lit("")))
    return F.when(text == "", 0.0).otherwise(text.try_cast("double"))


def _is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _checked(rows: DataFrame) -> DataFrame:
    """Typed columns and error (NULL for good rows) of text rows with a row number row_no."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    action, ticker = F.lower(text("Action")), F.upper(text("Code"))
    day = F.coalesce(F.try_to_date(text("Date"), "yyyy-MM-dd"), F.try_to_date(text("Date"), "yyyyMMdd"))
    q, p, f = _number("Quantity"), _number("Price"), _number("Fee")
    trade = action.isin("buy", "sell")
    positive = lambda x: _is_finite(x) & (x > 0)
    error = (
        F.when(day.isNull(), F.concat(F.lit("bad date: "), text("Date")))
        .when(~action.isin(*ACTIONS), F.concat(F.lit("unknown action: "), action))
        .when(~is_ticker(F.col("Code")) | F.col("Code").isNull(), F.concat(F.lit("bad ticker: "), ticker))
        .when(q.isNull() | p.isNull() | f.isNull(), "not a number")
        .when(trade & ~positive(q), "a trade needs a positive quantity")
        .when(trade & ~positive(p), "a trade needs a positive price")
        .when(~text("Currency").isin("", "USD"), F.concat(F.lit("currency must be USD: "), text("Currency")))
    )
    out = rows.select("row_no", day.alias("d"), ticker.alias("ticker"), action.alias("action"), q.alias("quantity"), p.alias("price"), f.alias("fee"), text("DataSource").alias("source"), text("Note").alias("note"), error.alias("error"))
    still = F.col("action").isin("buy", "sell")
    cash = F.when(still, 0.0).when(F.col("quantity") != 0, F.col("quantity") * F.col("price")).otherwise(F.col("price"))
    return out.withColumn("cash", cash).withColumns({"quantity": F.when(still, F.col("quantity")).otherwise(0.0), "price": F.when(still, F.col("price")).otherwise(0.0)})


def _numbered(df: DataFrame) -> DataFrame:
    """row_no from 1 in file order, without a window over a whole file.

    Ids rise with the place in the files: their upper part is the task, the lower one the row in it. So a row's number is
    its number in its file's part of the task, and the rows that earlier tasks had of the file: a few numbers for each.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    placed = placed.withColumn("task", F.shiftright("place", 33))
    parts = placed.groupBy("file", "task").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("file", "task", "first", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), ["file", "task"]).withColumn("row_no", (F.col("start") + F.col("place") - F.col("first") + 1).cast("int")).drop("place", "task", "first", "start")


def read_csv_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows (with ord, the order by day, action and place in the file), and the others with row_no and error."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = {"Date", "Code", "Action", "Quantity", "Price", "Fee"} - {c.lstrip("﻿") for c in raw.columns}
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    numbered = _numbered(raw)
    for c in ("Currency", "DataSource", "Note"):
        if c not in numbered.columns:
            numbered = numbered.withColumn(c, F.lit(None).cast("string"))
    return _split(_checked(numbered))


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = checked.where("error is null").withColumn("ord", F.row_number().over(Window.partitionBy("ticker").orderBy("d", action_rank(F.col("action")), "row_no")).cast("long"))
    return good.drop("error"), checked.where("error is not null").select("row_no", "error")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a ledger file; the job fails on the first bad one."""
    good, bad = read_csv_report(spark, path)
    first = bad.orderBy("row_no").limit(1).collect()
    if first:
        raise ValueError(f"{path}: data row {first[0]['row_no']}: {first[0]['error']}")
    return good


def read_json_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same for a JSON export: an object with activities, or a bare array. What is no such trade or income is skipped with a reason."""
    text = spark.read.option("wholetext", True).text(path)
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.activities"), JSON_SCHEMA), F.from_json("value", JSON_SCHEMA))
    rows = text.select(F.posexplode(listed).alias("pos", "a")).select((F.col("pos") + 1).alias("row_no"), "a.*")
    known = F.create_map(*[F.lit(x) for kv in JSON_ACTIONS.items() for x in kv])
    day = F.when(F.length("date") > 10, F.to_date(F.try_to_timestamp("date") + F.expr("interval 12 hours"))).otherwise(F.try_to_date(F.substr(F.col("date"), F.lit(1), F.lit(10))))
    skip = (
        F.when(F.element_at(known, F.upper("type")).isNull(), F.concat(F.lit("skipped type "), F.coalesce("type", F.lit("none"))))
        .when(F.coalesce(F.col("currency"), F.lit("USD")) != "USD", F.concat(F.lit("skipped currency "), F.col("currency")))
        .when(F.upper(F.coalesce("dataSource", F.lit(""))) == "COINGECKO", "skipped source")
        .when(F.trim(F.coalesce("symbol", F.lit(""))) == "", "no symbol")
    )
    shaped = rows.select(
        "row_no", day.cast("string").alias("Date"), F.col("symbol").alias("Code"), F.element_at(known, F.upper("type")).alias("Action"), F.col("quantity").alias("Quantity"), F.col("unitPrice").alias("Price"),
        F.col("fee").alias("Fee"), F.lit("USD").alias("Currency"), F.col("dataSource").alias("DataSource"), F.col("comment").alias("Note"), skip.alias("skip"),
    )
    good, bad = _split(_checked(shaped.where("skip is null")))
    return good, bad.unionByName(shaped.where("skip is not null").select("row_no", F.col("skip").alias("error")))


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """CSV or JSON, told by the first character that is not blank."""
    blank = F.regexp_replace("value", "^[\\uFEFF\\s]+", "")
    first = spark.read.text(path).select(F.substring(blank, 1, 1).alias("c")).where("c <> ''").first()
    return read_json_report(spark, path) if first and first["c"] in ("{", "[") else read_csv_report(spark, path)


# A small book that shows every action.
DEMO = (
    ("2023-01-02", "CASH", "deposit", 0.0, 4000.0, 0.0), ("2023-01-09", "AAA", "buy", 8.0, 250.0, 1.0), ("2023-02-01", "BBB", "buy", 20.0, 60.0, 1.0), ("2023-04-03", "AAA", "buy", 4.0, 262.0, 1.0),
    ("2023-06-15", "AAA", "dividend", 0.0, 18.0, 0.0), ("2023-09-29", "CASH", "interest", 0.0, 9.5, 0.0), ("2023-11-20", "AAA", "sell", 3.0, 280.0, 1.0), ("2023-12-29", "CASH", "fee", 0.0, 0.0, 15.0), ("2024-01-31", "CASH", "withdraw", 0.0, 200.0, 0.0),
)


def demo_ledger(spark: SparkSession) -> DataFrame:
    """The rows of the example book, as read_csv gives them."""
    rows = [(k, d, t, a, str(q), str(p), str(f)) for k, (d, t, a, q, p, f) in enumerate(DEMO, 1)]
    text = spark.createDataFrame(rows, "row_no int, Date string, Code string, Action string, Quantity string, Price string, Fee string")
    return _split(_checked(text.withColumns({"Currency": F.lit("USD"), "DataSource": F.lit("DEMO"), "Note": F.lit("")})))[0]


def normalise_target(rows: DataFrame, key: str) -> DataFrame:
    """key, ticker, w: weights of repeated tickers added up and scaled to 1 in each target; errors for negative, cash or empty ones."""
    bad = F.when(F.col("w") < 0, F.raise_error(F.lit("a weight is negative"))).when(F.upper(F.trim("ticker")) == "CASH", F.raise_error(F.lit("cash is no target"))).otherwise(F.col("w"))
    sums = rows.groupBy(key, F.upper(F.trim("ticker")).alias("ticker")).agg(F.sum(bad).alias("w"))
    total = F.sum("w").over(Window.partitionBy(key))
    return sums.withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(F.raise_error(F.lit("the target is empty or sums to zero")).cast("double")))


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """ticker, w of a target file with columns Ticker and Weight."""
    raw = spark.read.option("header", True).csv(path)
    weight = F.coalesce(F.nullif(F.trim("Weight"), F.lit("")), F.lit("0")).cast("double")
    rows = raw.where(F.trim(F.coalesce("Ticker", F.lit(""))) != "").select(F.lit(path).alias("target"), F.when(is_ticker(F.col("Ticker")), F.col("Ticker")).otherwise(F.raise_error(F.lit("bad ticker"))).alias("ticker"), weight.alias("w"))
    return normalise_target(rows, "target").select("ticker", "w")


def read_universe(spark: SparkSession, path: str, roles: list[str]) -> DataFrame:
    """ticker, name, role, summary, core, flavor, file_ord: rows of known roles, the first of each ticker; core unless 0."""
    raw = _numbered(spark.read.option("header", True).csv(path))
    for c in ("core", "flavor"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    known = raw.where(F.col("role").isin(roles)).withColumn("ticker", F.upper(F.trim("ticker")))
    first = known.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("row_no"))).where("k = 1")
    return first.select("ticker", "name", "role", "summary", (F.coalesce(F.trim("core"), F.lit("1")) != "0").alias("core"), F.coalesce("flavor", F.lit("")).alias("flavor"), F.col("row_no").alias("file_ord"))
