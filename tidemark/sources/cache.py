"""Cache tables that can be written again: merged by key, newest row first, in buckets of tickers.

A write touches the buckets of its tickers alone. Rows are staged first, so that a source is read once; then the stored
rows of those buckets are merged with them, staged again, and put in place of the buckets by a dynamic overwrite, one
file for each. Writing the same rows twice, or a task that runs again, changes nothing, and a table never has more files
than buckets and layouts, however often it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import keep

BUCKETS = 64


def bucket_of(ticker: str = "ticker") -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(BUCKETS)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def merge_into(rows: DataFrame, path: str, keys: tuple[str, ...], layout: tuple[str, ...] = (), fmt: str = "parquet", whole: bool = False, newest: str = "fetched_at") -> None:
    """Merges rows (with ticker, keys and newest) into the table at path.

    Of rows with equal keys the one with the latest newest stays, of several such the first by its other columns; with
    whole, all different rows that were fetched when the key was fetched last. layout: columns that are folders of their
    own above the bucket. Rows without a ticker or without a time are left out.
    """
    spark, folders = rows.sparkSession, [*layout, "bucket"]
    columns = rows.columns
    fresh = keep(rows.where(F.col("ticker").isNotNull() & F.col(newest).isNotNull()).withColumn("bucket", bucket_of()), "cache-rows")
    touched = fresh.select(*folders).distinct().collect()  # at most as many as there are buckets in each layout
    if not touched:
        return
    both = fresh
    if exists(spark, path):
        hit = F.lit(False)
        for t in touched:
            same = F.lit(True)
            for c in folders:
                same &= F.col(c) == F.lit(t[c])
            hit |= same
        stored = spark.read.schema(fresh.schema).option("allowNonNumericNumbers", True).format(fmt).load(path).where(hit & F.col("ticker").isNotNull() & F.col(newest).isNotNull())
        both = fresh.unionByName(stored.select(*fresh.columns))
    own = Window.partitionBy(*layout, *keys)
    others = [F.to_json(c) if isinstance(fresh.schema[c].dataType.jsonValue(), dict) else F.col(c) for c in columns if c not in (*layout, *keys, newest)]
    if whole:
        merged = both.withColumn("last_", F.max(newest).over(own)).where(F.col(newest) == F.col("last_")).drop("last_").dropDuplicates()
    else:
        merged = both.withColumn("place_", F.row_number().over(own.orderBy(F.desc(newest), *others))).where("place_ = 1").drop("place_")
    staged = keep(merged, "cache-merged")
    staged.repartition(*folders).sortWithinPartitions(*folders, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).format(fmt).save(path)
