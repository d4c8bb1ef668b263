"""Tables in the folder that driver and executors share, for results that several branches of a plan read."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session of one process that names no shared folder, as in tests.
OWN_DIR = "/tmp/checkpoints/tidemark-tables"
#: Rows up to which a kept table is broadcast.
FEW = 250_000


def plain_unions(spark: SparkSession) -> None:
    """Has unions forget how their inputs were dealt out.

    Spark 4.1 otherwise plans no exchange between a union of inputs that are dealt out alike and a window or aggregate on
    the same key; when adaptive execution then merges the inputs' partitions differently, groups come in pieces.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df below spark.checkpoint.dir and returns that table: it is worked out once, and survives lost executors."""
    spark = df.sparkSession
    plain_unions(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    elif re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        own = f"{OWN_DIR}/{name}-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(kept: DataFrame, few: int = FEW) -> DataFrame:
    """A kept table as a side of a join, by its rows: broadcast up to few, else never, however small its files are."""
    return F.broadcast(kept) if kept.limit(few + 1).count() <= few else kept.hint("merge")
