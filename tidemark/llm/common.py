"""What the operators share: the folder for intermediate tables, word hashing and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only by a session of one process that names no shared folder, as in tests.
OWN_SHARED_DIR = "/tmp/checkpoints/tidemark"

WHITE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which every executor and the driver can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"{OWN_SHARED_DIR}/{name}-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


#: Rows of texts that go to a worker at once, at most; Spark's own 10,000 take tens of MB in each task, on both sides.
TEXT_ROWS = 1_500


def small_batches(spark: SparkSession) -> None:
    """Lets rows go to workers in batches of at most TEXT_ROWS in this session; smaller ones stay as they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns that table: lineage ends there, and no executor holds the only copy."""
    spark = df.sparkSession
    # Spark 4.1 otherwise trusts how a union's inputs are dealt out, also after adaptive execution has changed it
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes kept tables whose readers have all been written; nothing may read them afterwards."""
    for df in tables:
        spark = df.sparkSession
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Memory:
    """What a worker remembers by string, up to a bound, in two generations: the younger one becomes the elder when it is full, and what is asked for again moves back. So what occurs often is never forgotten."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def missing(self, keys: set[str]) -> list[str]:
        """Those of the keys that are not remembered; the others are all in the younger generation then."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        rest = keys.difference(self.young)
        again = self.old.keys() & rest
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return list(rest - again)


_TABLES = []


def worker_tables(maxsize: int):
    """An lru_cache for what a worker loads for one operator: only_for() empties those of the others."""

    def held(load):
        _TABLES.append(lru_cache(maxsize=maxsize)(load))
        return _TABLES[-1]

    return held


def only_for(*own) -> None:
    """Called where a task begins. A worker serves one operator after the other: here it lets go of all tables but own, so that what it holds does not add up over the stages of a job."""
    others = [t for t in _TABLES if t not in own and t.cache_info().currsize]
    for t in others:
        t.cache_clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
            trim(0)


def filesystem(uri: str):
    """The pyarrow file system of a folder's URI and the path in it, for files that tasks write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row in them, without copies. A null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (raw[ends[0] : ends[-1]], ends - ends[0]) if len(ends) else (raw[:0], np.zeros(1, np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Splits UTF-8 bytes into words and hashes each to 64 bits, A-Z taken as a-z.

    A word's hash is a polynomial in a fixed odd base over random values of its bytes, so that sums over the
    whole buffer give every word's hash at once. Two words share one with a chance of about 2**-60.
    """

    BLOCK = 1 << 20
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, outside: bytes = WHITE):
        """outside: the byte values that separate words."""
        values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for x in range(65, 91):
            values[x] = values[x + 32]
        self.gap = np.zeros(256, bool)
        self.gap[list(outside)] = True
        values[self.gap] = 0
        self.values = values
        base = np.full(self.BLOCK + 1, self.BASE, np.uint64)
        base[0] = 1
        back = np.full(self.BLOCK + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.up, self.down = np.multiply.accumulate(base), np.multiply.accumulate(back)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word; none reaches over the start of a row."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        full = ~self.gap[data]
        starts, ends = full.copy(), full.copy()
        starts[1:] &= ~full[:-1]
        ends[:-1] &= ~full[1:]
        rows = offsets[:-1][np.diff(offsets) > 0]
        starts[rows] = full[rows]
        rows = rows[rows > 0] - 1
        ends[rows] = full[rows]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and for each row the index of its first word (one more at the end)."""
        starts, ends = self.spans(data, offsets)
        out = np.empty(len(starts), np.uint64)
        done = 0
        while done < len(starts):
            origin = starts[done]
            last = max(done + 1, int(np.searchsorted(ends, origin + self.BLOCK, "right")))
            if ends[last - 1] - origin > self.BLOCK:  # one word longer than a block
                out[done] = self._long(data[origin : ends[done]])
            else:
                part = self.values[data[origin : ends[last - 1]]]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * self.up[: len(part)], out=sums[1:])
                at = starts[done:last] - origin
                out[done:last] = (sums[ends[done:last] - origin] - sums[at]) * self.down[at]
            done = last
        return mix(out), np.searchsorted(starts, offsets)

    def _long(self, word: np.ndarray) -> np.uint64:
        total, shift = 0, 1
        for i in range(0, len(word), self.BLOCK):
            part = self.values[word[i : i + self.BLOCK]]
            total += int(np.sum(part * self.up[: len(part)])) * shift
            shift = shift * int(self.up[self.BLOCK]) % (1 << 64)
        return np.uint64(total % (1 << 64))


def shingles(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words in each row, a shorter row's whole sequence as one; and each row's first index."""
    counts = np.diff(rows)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(made)))
    total = int(first[-1])
    row = np.repeat(np.arange(len(counts)), made)
    at = rows[:-1][row] + (np.arange(total) - first[:-1][row])
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    out = np.zeros(total, np.uint64)
    room = counts[row]
    short = np.flatnonzero(room < size)
    for j in range(size):
        term = padded[at + j]
        if len(short):
            term[short[room[short] <= j]] = 0
        out = (out ^ term) * np.uint64(0xD6E8FEB86659FD93 + 2 * j)
        out ^= out >> np.uint64(32)
    return mix(out), first


def batches_of(batch: pa.RecordBatch, column: str, most: int):
    """Cuts a batch so that each piece has at most about so many bytes of text in the column, a row at least."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)
