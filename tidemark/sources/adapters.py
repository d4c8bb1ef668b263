"""The benchmark tables seen as ledgers, price series, splits, funds and targets. All mappings are synthetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import action_rank
from tidemark.sources.shared import plain_unions

#: Books that the suppliers are dealt to.
BOOKS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """ticker, d, close: the five order priorities as tickers, mean order totals as closes of a day, week or month."""
    d = F.to_date(F.date_trunc(grain, "o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("ticker"), d.alias("d")).agg(F.avg("o_totalprice").alias("close"))


def supplier_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, d, close: mean unit prices of each supplier's lines in a week."""
    d = F.to_date(F.date_trunc("week", "l_shipdate"))
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), d.alias("d")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, ticker, ord, d, action, quantity, price, fee, cash: lines as trades of the supplier's shares, after one opening purchase each.

    ord is the order of a ticker's rows: by day, the day's rank of the action, and the line's own columns.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("B"), F.col("l_suppkey") % BOOKS).alias("book"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.to_date("l_shipdate").alias("d"),
        F.when(F.col("l_returnflag") == "N", "buy").when(F.col("l_returnflag") == "R", "sell").when(F.col("l_linestatus") == "F", "dividend").otherwise("fee").alias("action"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_linenumber", "l_partkey",
    )
    action = F.col("action")
    rows = rows.select(
        "book", "ticker", "d", "action",
        F.when(action == "buy", F.col("l_quantity")).when(action == "sell", F.col("l_quantity") * 0.1).otherwise(0.0).alias("quantity"),
        F.when(action.isin("buy", "sell"), F.col("l_extendedprice") / F.col("l_quantity")).otherwise(0.0).alias("price"),
        F.when(action == "dividend", 0.0).otherwise(F.col("l_tax") * 10).alias("fee"),
        F.when(action == "dividend", F.col("l_extendedprice") * F.col("l_discount") / 100).otherwise(0.0).alias("cash"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )
    first = rows.groupBy("book", "ticker").agg(F.date_sub(F.min("d"), 1).alias("d"))
    zero = F.lit(0).cast("long")
    opening = first.select("book", "ticker", "d", F.lit("buy").alias("action"), F.lit(1000.0).alias("quantity"), F.lit(1500.0).alias("price"), F.lit(0.0).alias("fee"), F.lit(0.0).alias("cash"), zero.alias("l_orderkey"), F.lit(0).alias("l_linenumber"), zero.alias("l_partkey"), F.lit(0.0).alias("l_extendedprice"))
    order = Window.partitionBy("ticker").orderBy("d", action_rank(action), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.unionByName(opening).withColumn("ord", F.row_number().over(order).cast("long")).select("book", "ticker", "ord", "d", "action", "quantity", "price", "fee", "cash")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, d, ratio: one or two splits for two thirds of the suppliers."""
    key = F.col("l_suppkey")
    keys = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    made = F.when(key % 3 == 0, F.array(F.struct(F.lit("1998-01-01").alias("d"), F.lit(2.0).alias("ratio")))).when(key % 3 == 1, F.array(F.struct(F.lit("1997-06-01").alias("d"), F.lit(1.5).alias("ratio")), F.struct(F.lit("2000-01-01").alias("d"), F.lit(0.5).alias("ratio"))))
    return keys.select(F.concat(F.lit("S"), key).alias("ticker"), F.explode(made).alias("s")).select("ticker", F.to_date("s.d").alias("d"), "s.ratio")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, name, role, flavor, core, file_ord: parts as funds, types as roles, brands as shelves, dearest first."""
    order = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.col("p_name").alias("name"), F.col("p_type").alias("role"), F.col("p_brand").alias("flavor"), (F.col("p_size") <= 25).alias("core"), F.row_number().over(order).alias("file_ord"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, expense_ratio, aum, avg_volume, category, inception, top_share: fund facts of the parts."""
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("ticker"),
        (F.col("p_retailprice") / 400000).alias("expense_ratio"),
        (size * 1e7).alias("aum"),
        (key % 200 * 1000.0).alias("avg_volume"),
        F.col("p_type").alias("category"),
        F.date_sub(F.lit("2001-08-01").cast("date"), size * 60).alias("inception"),
        F.when(key % 5 != 0, (key % 90) / 100.0).alias("top_share"),
    )


#: A target over the five tickers of prices(); one of them is to be sold out.
TARGET = {"1-URGENT": 0.40, "2-HIGH": 0.25, "3-MEDIUM": 0.20, "4-NOT SPECIFIED": 0.15, "5-LOW": 0.0}


def target(spark: SparkSession) -> DataFrame:
    """ticker, w of the target."""
    return spark.createDataFrame(list(TARGET.items()), "ticker string, w double")


def held_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, ticker, value, price: what each customer segment holds of each priority, at the last month's mean price."""
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    held = t.groupBy(F.col("c_mktsegment").alias("book"), F.col("o_orderpriority").alias("ticker")).agg((F.count(F.lit(1)) * 10.0 + F.length(F.first("o_orderpriority"))).alias("shares"))
    last = prices(spark, sf_dir, "month").groupBy("ticker").agg(F.max_by("close", "d").alias("price"))
    return held.join(F.broadcast(last), "ticker").select("book", "ticker", "shares", (F.col("shares") * F.col("price")).alias("value"), "price")
