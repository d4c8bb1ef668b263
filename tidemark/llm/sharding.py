"""Sharding by sampled splitters, with DataFrame functions only.

Keys are hashes of the texts. A size-weighted sample of keys gives quantile boundaries, which cut the keys into ranges;
a key that several boundaries fall on is a range of its own. Records go to their range by a binary search, and a range
that turns out overfull is subdivided: by another hash of the key or, in a range of one key, by row. The parts, in
order, are one sequence of all records in which equal texts stand together; each part's exact total places it in that
sequence, and the shards are equal stretches of it. Rows so large that a boundary on one would show are dealt out before,
to the emptiest shard; there is a fixed number of them at most. Texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep

#: Ranges for each shard, and keys sampled for each range.
RANGES, SAMPLED = 32, 40
#: A row is large from this part of a shard's bytes on, so there are at most shards * LARGE such rows.
LARGE = 512


def shard_by_bytes(documents: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot (gapless from 0) of every row.

    Shards get nearly equal numbers of bytes: they differ by less than two of the largest rows that are not large, a
    LARGE-th of a shard each, unless a single row exceeds a shard. A group of equal texts is cut only where a shard ends,
    so shards - 1 groups at most; one of large rows also where no shard has room for all of it. Null texts count as
    empty; repeated rows and ids are placed one by one, however many there are; an empty table gives an empty result.
    """
    body = F.col(text_col).cast("string").cast("binary")
    rows = documents.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("").cast("binary"))).alias("text_crc32"),
        F.xxhash64(F.coalesce(body, F.lit("").cast("binary"))).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = keep(rows, "shard-keys")
    bytes_ = rows.agg(F.sum("size").alias("bytes")).first()["bytes"]
    if not bytes_:
        return rows.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    is_large = F.col("size") * F.lit(shards * LARGE) >= F.lit(bytes_)
    large, load, count = _deal_large(rows.where(is_large), shards, bytes_)
    small = rows.where(~is_large)
    rest = bytes_ - sum(load)
    # a shard's room is what lacks to the mean; where large rows are more than that, the others share the difference
    room = [max(0.0, bytes_ / shards - x) for x in load]
    ends, at = [], 0.0
    for x in room[:-1]:
        at += x * (rest / sum(room) if sum(room) else 0)
        ends.append(at)
    placed = _in_order(small, shards * RANGES, rest, seed)
    middle = F.col("bytes_before") + F.col("size") / 2.0
    shard = sum(((middle >= F.lit(e)).cast("int") for e in ends), F.lit(0))
    placed = keep(placed.select("id", "size", "text_crc32", shard.alias("shard"), "row_before"), "shards")
    first = placed.groupBy("shard").agg(F.min("row_before").alias("first_row"))
    taken = F.array(*[F.lit(n) for n in count]).cast("array<bigint>")
    placed = placed.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("row_before") - F.col("first_row") + F.get(taken, F.col("shard"))).alias("slot"))
    return placed.unionByName(large)


def _deal_large(rows: DataFrame, shards: int, bytes_: int) -> tuple[DataFrame, list[int], list[int]]:
    """The large rows with shard and slot, and each shard's bytes and rows of them.

    Groups of equal texts, largest first, go whole to the emptiest shard if it has room for them, else row by row. The
    groups' sizes are collected: as many rows as there are large ones at most.
    """
    groups = [(r["size"], r["key"], r["n"]) for r in rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).collect()]
    load, count, dealt = [0] * shards, [0] * shards, []
    for size, key, n in sorted(groups, key=lambda g: (-g[0] * g[2], g[1])):
        at = min(range(shards), key=lambda k: (load[k], k))
        for first, many in [(0, n)] if (load[at] + size * n) * shards <= bytes_ else [(k, 1) for k in range(n)]:
            at = min(range(shards), key=lambda k: (load[k], k))
            dealt.append((key, size, first, first + many, at, count[at]))
            load[at] += size * many
            count[at] += many
    table = rows.sparkSession.createDataFrame(dealt, "key long, size long, first long, last long, shard int, slot long")
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy("key", "size").orderBy("row")) - 1)
    placed = numbered.join(F.broadcast(table), ["key", "size"]).where("number >= first and number < last")
    return placed.select("id", "size", "text_crc32", "shard", (F.col("slot") + F.col("number") - F.col("first")).alias("slot")), load, count


def _in_order(rows: DataFrame, ranges: int, bytes_: int, seed: int) -> DataFrame:
    """The rows with bytes_before and row_before: what comes before each in the sequence of all."""
    n = rows.count()
    # a row is drawn with a chance in proportion to its size
    drawn = rows.where(F.rand(seed) * float(max(bytes_, 1)) < F.col("size") * float(ranges * SAMPLED)).agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 20_000)).first()[0] or []
    often = [k for k, m in Counter(drawn).items() if m > 1 and k < (1 << 63) - 1]
    cuts = sorted({*drawn, *(k + 1 for k in often)})
    bounds = F.array(*[F.lit(x) for x in cuts]).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in range(max(len(cuts), 1).bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(cuts)) & (F.get(bounds, lo + s - 1) <= F.col("key")), lo + s).otherwise(lo))
    placed = rows.withColumn("range", below)
    # overfull ranges: into as many parts as their bytes or rows ask for
    full = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"), (F.min("key") == F.max("key")).alias("one"))
    parts = full.select("range", "one", F.greatest(F.lit(1), F.ceil(F.col("b") * ranges / F.lit(2.0 * max(bytes_, 1))), F.ceil(F.col("r") * ranges / F.lit(4.0 * max(n, 1)))).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.when(F.col("one"), F.xxhash64("row")).otherwise(F.xxhash64("key", F.lit(1))), F.col("parts")).cast("int")).drop("parts", "one")
    # a part that is still overfull holds a key of very many short rows: those are cut out and subdivided by row
    most = max(4.0 * n / ranges, 1.0)
    full = placed.groupBy("range", "part").agg(F.count(F.lit(1)).alias("r")).where(F.col("r") > 2 * most).select("range", "part")
    heavy = placed.join(F.broadcast(full), ["range", "part"]).groupBy("range", "part", "key").agg(F.count(F.lit(1)).alias("r")).where(F.col("r") > most)
    heavy = heavy.select("range", "part", "key", F.ceil(F.col("r") / most).cast("int").alias("cuts"))
    placed = placed.join(F.broadcast(heavy), ["range", "part", "key"], "left").withColumns({"own": F.when(F.col("cuts").isNotNull(), F.col("key")).otherwise(F.lit(-(1 << 63))), "cut": F.coalesce(F.pmod(F.xxhash64("row"), F.col("cuts")), F.lit(-1)).cast("int")}).drop("cuts")
    # exact totals before each piece; as many rows as ranges, parts and cuts, whatever the input
    piece = ["range", "part", "own", "cut"]
    held = placed.groupBy(*piece).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
    before = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    base = held.select(*piece, F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    inside = Window.partitionBy(*piece).orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(F.broadcast(base), piece)
    return at.withColumn("bytes_before", F.col("b0") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("row_before", F.col("r0") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))


def shard_digest(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the sharding query."""
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
