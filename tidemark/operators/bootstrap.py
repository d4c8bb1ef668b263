"""Moving-block bootstraps of risk metrics.

A key's replicates are dealt out over tasks: a short series has all of them in one, a long one as many tasks as keep each
to a bounded number of positions. The series goes to each of its tasks in blocks; a task holds one series and a few
replicates of it at a time. Quantiles are taken over the values that the tasks of a key send. Which replicate a task
draws follows from its number alone, so the intervals do not depend on how many tasks there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tidemark.operators.scan import block_of

#: Positions that a task draws at most, over its replicates and at once; days of a series that are shipped in one row.
WORK, PIECE, SHIPPED = 20_000_000, 2_000_000, 1024
METRICS = ("sharpe", "sortino", "calmar", "max_drawdown", "ulcer", "cdar")


def seeded_starts(most: int, reps: int, pieces: int, seed: int) -> np.ndarray:
    """Starts below most, from a seeded generator."""
    return np.random.default_rng(seed).integers(0, most, size=(reps, pieces))


def counted_starts(most: int, reps: int, pieces: int, seed: int, first: int = 0) -> np.ndarray:
    """Starts below most that follow from replicate (from first on), piece and seed by three congruential steps, so that SQL can draw them too."""
    x = (seed * 1_000_003 + np.arange(first, first + reps, dtype=np.int64)[:, None] * 8191 + np.arange(pieces, dtype=np.int64) * 131_071 + 12_345) % 2_147_483_647
    for _ in range(3):
        x = (x * 48_271 + 11) % 2_147_483_647
    return x % most


DRAWS = {"seeded": seeded_starts, "counted": counted_starts}


def block_indices(n: int, block: int, reps: int, seed: int, draws: str = "seeded") -> np.ndarray:
    """Positions of each replicate: blocks at random starts, end to end, cut to n."""
    pieces = -(-n // block)
    return _positions(DRAWS[draws](max(1, n - block + 1), reps, pieces, seed), n, block)


def _positions(starts: np.ndarray, n: int, block: int) -> np.ndarray:
    return (starts[:, :, None] + np.arange(block)).reshape(len(starts), -1)[:, :n]


def drawn(n: int, block: int, first: int, last: int, seed: int, draws: str):
    """The rows first to last of block_indices, in pieces of a bounded number of positions; the generator runs through those before."""
    pieces, most = -(-n // block), max(1, n - block + 1)
    step = max(1, PIECE // max(1, n))
    generator = np.random.default_rng(seed)
    for k in range(0 if draws == "seeded" else first, last, step):
        rows = min(step, last - k)
        if draws == "seeded":
            starts = generator.integers(0, most, size=(rows, pieces))
        else:
            starts = DRAWS[draws](most, rows, pieces, seed, k)
        if k + rows > first:
            yield _positions(starts[max(0, first - k) :], n, block)


def path_block(n: int) -> int:
    """Block length for metrics of the path: about the root of n, at least 2."""
    return min(n, max(2, round(n**0.5)))


def metric(r: np.ndarray, name: str) -> np.ndarray:
    """A metric of each row of returns; not finite where it has no base."""
    with np.errstate(all="ignore"):
        if name == "sharpe":
            return np.sqrt(252) * r.mean(axis=1) / r.std(axis=1, ddof=1)
        if name == "sortino":
            return np.sqrt(252) * r.mean(axis=1) / np.sqrt((np.minimum(r, 0) ** 2).mean(axis=1))
        level = np.cumprod(1 + r, axis=1)
        if name in ("max_drawdown", "calmar"):
            deep = np.minimum(0, (level / np.maximum(1, np.maximum.accumulate(level, axis=1)) - 1).min(axis=1))
            return deep if name == "max_drawdown" else np.where(deep < 0, (level[:, -1] ** (252 / r.shape[1]) - 1) / np.abs(deep), np.nan)
        dd = level / np.maximum.accumulate(level, axis=1) - 1
        if name == "ulcer":
            return np.sqrt((dd**2).mean(axis=1))
        k = max(1, int(np.ceil(0.05 * r.shape[1])))
        return -np.partition(dd, k - 1, axis=1)[:, :k].mean(axis=1)


def intervals(returns: DataFrame, key: str, reps: int = 1000, ci: float = 0.95, seed: int = 42, draws: str = "seeded") -> DataFrame:
    """key, metric, point, low, high of returns (key, d, r): percentile intervals of block bootstraps.

    Ratios of returns use blocks of the cube root of n, metrics of the path of the square root. Replicates that are not
    finite are skipped; with fewer than two returns, or none finite, the interval is the point.
    """

    def measure(columns: list[np.ndarray], first: int, last: int) -> dict[str, tuple[float, np.ndarray]]:
        r = columns[0]
        n = len(r)
        made: dict[str, list] = {name: [] for name in METRICS}
        if n > 1:  # one set of positions for each length of block
            for block, names in ((min(n, max(2, round(n ** (1 / 3)))), METRICS[:2]), (path_block(n), METRICS[2:])):
                for at in drawn(n, block, first, last, seed, draws):
                    for name in names:
                        made[name].append(metric(r[at], name))
        return {name: (float(metric(r[None, :], name)[0]) if n > 1 else float("nan"), np.concatenate(found) if found else np.zeros(0)) for name, found in made.items()}

    merged = _replicates(returns, key, ("r",), measure, reps)
    edge = lambda q: F.coalesce(_quantile(F.col("found"), q), F.col("point"))
    there = F.col("point").isNotNull()
    return merged.select(key, "metric", "point", F.when(there, edge((1 - ci) / 2)).alias("low"), F.when(there, edge((1 + ci) / 2)).alias("high"))


def paired_ulcer_gain(returns: DataFrame, key: str = "pair", reps: int = 1000, seed: int = 42, draws: str = "seeded") -> DataFrame:
    """key, low and high: the interval of the Ulcer index of r_without less that of r_with, both resampled at the same positions; NULL under ten days."""

    def measure(columns: list[np.ndarray], first: int, last: int) -> dict[str, tuple[float, np.ndarray]]:
        a, b = columns
        n = len(a)
        gain = [metric(a[at], "ulcer") - metric(b[at], "ulcer") for at in drawn(n, path_block(n), first, last, seed, draws)] if n >= 10 else []
        return {"gain": (float("nan"), np.concatenate(gain) if gain else np.zeros(0))}

    merged = _replicates(returns, key, ("r_without", "r_with"), measure, reps)
    return merged.select(key, _quantile(F.col("found"), 0.025).alias("low"), _quantile(F.col("found"), 0.975).alias("high"))


def _quantile(found: Column, q: float) -> Column:
    """The quantile of a sorted array, between its neighbours in proportion; NULL of an empty one."""
    place = F.lit(q) * (F.size(found) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(found, low), F.get(found, F.least(low + 1, F.size(found) - 1))
    return F.when(F.size(found) > 0, a + (b - a) * (place - low))


def _replicates(returns: DataFrame, key: str, columns: tuple[str, ...], measure, reps: int) -> DataFrame:
    """key, metric, point (NULL unless finite) and found: the sorted finite values of all replicates.

    measure gets a key's series in order of d and a range of replicates, and gives each metric's value of the series
    itself and of those replicates.
    """
    finer = returns.schema["d"].dataType.simpleString() != "date"
    block = block_of(returns, "d", None if finer else SHIPPED)
    rows = returns.select(F.col(key).alias("key_"), block.alias("block_"), F.struct("d", *[F.col(c).cast("double").alias(c) for c in columns]).alias("row_"))
    shipped = rows.groupBy("key_", "block_").agg(F.sort_array(F.collect_list("row_")).alias("rows_"))
    shipped = shipped.select("key_", "block_", *[F.col(f"rows_.{c}").alias(f"x_{k}") for k, c in enumerate(columns)])
    tasks = F.least(F.lit(reps), F.ceil(F.col("n_") * reps / WORK)).cast("int")
    parts = returns.groupBy(F.col(key).alias("key_of_")).agg(F.count(F.lit(1)).alias("n_")).withColumn("tasks_", tasks)
    dealt = shipped.join(parts, F.col("key_").eqNullSafe(F.col("key_of_"))).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("tasks_") - 1)))
    dealt = dealt.select("key_", "part_", "tasks_", "block_", *[f"x_{k}" for k in range(len(columns))]).repartition("key_", "part_").sortWithinPartitions("key_", "part_", "block_")
    schema = StructType([StructField("key_", returns.schema[key].dataType), StructField("metric", StringType()), StructField("point", DoubleType()), StructField("found", ArrayType(DoubleType()))])
    key_type = to_arrow_schema(StructType(schema.fields[:1]))[0].type

    def resample(batches):
        current, held = None, []

        def out():
            own, part, tasks = current
            series = [np.concatenate(x) for x in zip(*held, strict=True)]
            found = measure(series, reps * part // tasks, reps * (part + 1) // tasks)
            values = [v[np.isfinite(v)] for _, v in found.values()]
            points = [p if np.isfinite(p) else None for p, _ in found.values()]
            return pa.RecordBatch.from_arrays([pa.array([own] * len(found), key_type), pa.array(list(found)), pa.array(points, pa.float64()), pa.array(values, pa.list_(pa.float64()))], names=["key_", "metric", "point", "found"])

        for batch in batches:
            for i in range(batch.num_rows):
                mine = tuple(batch.column(c)[i].as_py() for c in ("key_", "part_", "tasks_"))
                if mine != current:
                    if current is not None:
                        yield out()
                    current, held = mine, []
                held.append([batch.column(f"x_{k}")[i].values.to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))])
        if current is not None:
            yield out()

    made = dealt.mapInArrow(resample, schema)
    merged = made.groupBy("key_", "metric").agg(F.first("point").alias("point"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return merged.withColumnRenamed("key_", key)
