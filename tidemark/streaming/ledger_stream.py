"""Structured Streaming over ledgers: new rows arrive as files, positions of the holdings they touch are folded again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ledger import positions

LEDGER_SCHEMA = "book string, ticker string, ord long, d date, action string, quantity double, price double, fee double, cash double"


def ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(LEDGER_SCHEMA).parquet(folder)


def daily_flows_stream(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """book, day, net: signed trade flows of each day, kept open for late rows until the watermark passes it."""
    flow = F.when(F.col("action") == "buy", -(F.col("quantity") * F.col("price") + F.col("fee"))).when(F.col("action") == "sell", F.col("quantity") * F.col("price") - F.col("fee")).otherwise(F.col("cash") - F.col("fee"))
    stamped = rows.withColumn("ts", F.col("d").cast("timestamp")).withWatermark("ts", delay)
    return stamped.groupBy("book", F.window("ts", "1 day")).agg(F.sum(flow).alias("net")).select("book", F.col("window.start").cast("date").alias("day"), "net")


def refold_positions(rows: DataFrame, ledger_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Appends each batch to the ledger table and gives sink the new positions of the holdings in it. The batch number is part of the folder, so a batch that runs again replaces itself."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")
        stored = spark.read.schema(LEDGER_SCHEMA).option("basePath", ledger_path).parquet(f"{ledger_path}/batch=*")
        touched = spark.read.schema(LEDGER_SCHEMA).parquet(f"{ledger_path}/batch={number}").select("book", "ticker").distinct()
        sink(positions(stored.join(touched, ["book", "ticker"], "left_semi")), number)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
