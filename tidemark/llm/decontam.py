"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task cuts its documents into shards, sorts every word suffix of a shard (prefix doubling, only ties are sorted
again) and binary-searches every benchmark suffix in it. That yields, for each document, which words lie inside an
occurrence of a benchmark window, the items found and their longest verbatim matches. Documents never move: there is
no shuffle. The benchmark is laid down as files in the shared folder and read block by block, so neither the driver
nor a task has to hold all of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import WordHasher, batches_of, filesystem, only_for, shared_dir, small_batches, text_buffers, worker_tables

#: Bytes that separate words, after A-Z became a-z: all of ASCII but digits and letters.
NOT_WORD = bytes(x for x in range(128) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122))
#: UTF-8 bytes of text whose suffixes are sorted together.
SHARD_BYTES = 3 << 20
#: Rows of the benchmark in one block.
BLOCK_ROWS = 4_000
#: Matches that are looked at together.
PIECE = 1 << 20
#: Words up to which suffixes are put in order; longer matches are then extended word by word.
DEPTH = 64


def suffix_array(words: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Start positions of all suffixes, in the order of their first depth words (as numbers; the end sorts first)."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.concatenate(([True], words[order][1:] != words[order][:-1])) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    slots = np.arange(n)
    while step < depth and len(slots):
        head = rank[order[slots]]
        tied = np.concatenate((head[1:] == head[:-1], [False])) | np.concatenate(([False], head[1:] == head[:-1]))
        slots, head = slots[tied], head[tied]
        if not len(slots):
            break
        at = order[slots]
        key = (head << np.int64(32)) | (rank[np.minimum(at + step, n)] + 1)
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[slots] = at
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(first, slots, 0))
        step *= 2
    return order


def bound(words: np.ndarray, order: np.ndarray, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """For every query (a start in the query words and a length), the first place in order whose suffix does not come before it; upper: that comes after all with it as prefix."""
    n = len(order)
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), n, np.int64)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        sign = _compare(words, order[mid], query, starts[open_], lengths[open_])
        before = sign <= 0 if upper else sign < 0
        lo[open_[before]] = mid[before] + 1
        hi[open_[~before]] = mid[~before]
    return lo


def _compare(words: np.ndarray, at: np.ndarray, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the suffix comes before the query, has it as prefix or comes after it."""
    sign = np.zeros(len(at), np.int8)
    live, d, n = np.flatnonzero(lengths > 0), 0, len(words)
    while len(live):
        place = at[live] + d
        ended = place >= n
        w, q = words[np.minimum(place, n - 1)], query[starts[live] + d]
        less, more = ended | (w < q), ~ended & (w > q)
        sign[live[less]], sign[live[more]] = -1, 1
        d += 1
        live = live[~less & ~more]
        live = live[lengths[live] > d]
    return sign


def common_prefix(words: np.ndarray, at: np.ndarray, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words that the suffix at each place shares with its query."""
    out, n = np.zeros(len(at), np.int64), len(words)
    live = np.flatnonzero((at >= 0) & (at < n) & (lengths > 0))
    while len(live):
        place = at[live] + out[live]
        live = live[(place < n) & (words[np.minimum(place, n - 1)] == query[starts[live] + out[live]])]
        out[live] += 1
        live = live[out[live] < lengths[live]]
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi), and the number of the range of each."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


def _pieces(lo: np.ndarray, hi: np.ndarray, most: int):
    """Cuts the ranges into slices (first, last) of at most about so many integers, a range at least; longer ones come in parts."""
    size = hi - lo
    ends = np.cumsum(size)
    at = 0
    while at < len(lo):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        if to == at + 1 and size[at] > most:
            for a in range(int(lo[at]), int(hi[at]), most):
                yield np.array([at]), np.array([a]), np.array([min(a + most, int(hi[at]))])
        else:
            yield np.arange(at, to), lo[at:to], hi[at:to]
        at = to


class Block:
    """The suffixes of some benchmark items: their words, and for every suffix of at least a window its start, item and window."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int, hasher: WordHasher):
        self.ids = ids
        data, offsets = text_buffers(texts)
        self.words, self.rows = hasher(data, offsets)
        counts = np.diff(self.rows)
        item = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        left = (self.rows[1:][item] - np.arange(len(item))).astype(np.int32)
        size = np.minimum(window, counts)[item].astype(np.int32)
        self.starts = np.flatnonzero((left >= size) & (size > 0))
        self.item, self.left, self.window = item[self.starts], left[self.starts].astype(np.int64), size[self.starts].astype(np.int64)


@worker_tables(8)
def _block(path: str, window: int) -> Block:
    """A block of the benchmark, read from the shared folder; a worker keeps the last ones."""
    store, place = filesystem(path)
    table = pq.read_table(place, filesystem=store)
    return Block(table.column("item").to_pylist(), table.column("body"), window, WordHasher(NOT_WORD))


def _lay_down(benchmark: DataFrame, item_col: str, text_col: str) -> list[str]:
    """Writes the benchmark's items to the shared folder in blocks and lists the files."""
    spark = benchmark.sparkSession
    path = shared_dir(spark, "benchmark")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("body"))
    items.where(F.col("body").isNotNull()).write.option("maxRecordsPerFile", BLOCK_ROWS).parquet(path)
    return sorted(spark.read.schema("item string, body string").parquet(path).inputFiles())


FOUND = "n_words long, n_hit long, items array<string>, longest array<struct<item: string, item_word: long, word: long, length: long>>"


def search(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """Where benchmark windows occur in each document.

    A window is window consecutive words of an item, or all words of a shorter item. Returns one row per document row:
    id, n_words, n_hit (words inside any occurrence), items (sorted ids of the items found) and longest (for each of
    these items the longest verbatim match: first word in the item and in the document, and words; the first in the
    document of equal ones). carry: columns of the documents to keep. Null and empty texts have no words; null item
    texts are no items; items without words match nothing; repeated rows each get their row; other columns are not
    looked at. Words that repeat, in texts or items, cost time for each maximal match, not memory.
    """
    out = _positional(documents, benchmark, (id_col, *carry), text_col, item_col, item_text, window, True)
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate((id_col, *carry))], "n_words", "n_hit", "items", "longest")


def _positional(documents: DataFrame, benchmark: DataFrame, carry: tuple[str, ...], text_col: str, item_col: str, item_text: str, window: int, longest: bool) -> DataFrame:
    """search() with carry's columns named c_0, c_1 and so on; longest is empty where it is not wanted."""
    small_batches(documents.sparkSession)
    files = _lay_down(benchmark, item_col, item_text)
    fields = documents.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("body"))
    held = [f"c_{i}" for i in range(len(carry))]
    schema = StructType([*(f for f in fields.schema.fields if f.name != "body"), *StructType.fromDDL(FOUND).fields])

    def scan(batches):
        only_for(_block)
        hasher = WordHasher(NOT_WORD)
        for batch in batches:
            for shard in batches_of(batch, "body", SHARD_BYTES):
                yield _scan_shard(shard, held, files, window, hasher, longest)

    return fields.mapInArrow(scan, schema)


def _scan_shard(shard: pa.RecordBatch, held: list[str], files: list[str], window: int, hasher: WordHasher, longest: bool) -> pa.RecordBatch:
    data, offsets = text_buffers(shard.column("body"))
    own, rows = hasher(data, offsets)
    counts = np.diff(rows)
    n_rows = len(counts)
    words = np.zeros(len(own) + n_rows, np.uint64)  # a 0 ends each document
    row_of = np.repeat(np.arange(n_rows), counts + 1)
    begin = rows[:-1] + np.arange(n_rows)
    words[np.arange(len(own)) + np.repeat(np.arange(n_rows), counts)] = own
    marks = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set() for _ in range(n_rows)]
    best: list[dict] = [{} for _ in range(n_rows)]
    if len(own) and files:
        order = suffix_array(words, max(DEPTH, window))
        for path in files:
            b = _block(path, window)
            if not len(b.starts):
                continue
            lo = bound(words, order, b.words, b.starts, b.window, False)
            hi = np.maximum(lo, bound(words, order, b.words, b.starts, b.window, True))
            hot = np.flatnonzero(hi > lo)
            if not len(hot):
                continue
            # equal windows have equal ranges; each range is looked at once
            _, one, of = np.unique(np.stack((lo[hot], b.window[hot])), axis=1, return_index=True, return_inverse=True)
            one, of = hot[one], of.reshape(-1)
            _note_places(order, lo[one], hi[one], b.window[one], marks)
            _note_items(order, lo[one], hi[one], of, b.item[hot], row_of, b.ids, items)
            if longest:
                _note_longest(words, order, b, hot, lo[one], hi[one], of, row_of, begin, best)
    inside = np.cumsum(marks[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(inside)))
    n_hit = total[np.append(begin[1:], len(words))] - total[begin] if n_rows else np.zeros(0, np.int64)
    found = [[{"item": i, "item_word": m[1], "word": -m[2], "length": m[0]} for i, m in sorted(x.items())] for x in best]
    kind = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [*(shard.column(c) for c in held), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(found, kind)],
        names=[*held, "n_words", "n_hit", "items", "longest"],
    )


def _note_places(order: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, marks: np.ndarray) -> None:
    """Adds 1 to marks where an occurrence begins, and takes 1 away behind its end."""
    for k, a, z in _pieces(lo, hi, PIECE):
        at, of = _ranges(a, z)
        np.add.at(marks, order[at], 1)
        np.add.at(marks, order[at] + size[k][of], -1)


def _note_items(order: np.ndarray, lo: np.ndarray, hi: np.ndarray, of: np.ndarray, item: np.ndarray, row_of: np.ndarray, ids: list[str], items: list[set]) -> None:
    """Adds to each document's set the items of the windows that occur in it. of, item: range and item of every window."""
    n_rows, n_items = len(items), len(ids)
    seen = []
    for k, a, z in _pieces(lo, hi, PIECE):
        at, which = _ranges(a, z)
        seen.append(np.unique(k[which] * np.int64(n_rows) + row_of[order[at]]))
    places = np.unique(np.concatenate(seen))  # (range, document)
    asked = np.unique(of * np.int64(n_items) + item)  # (range, item)
    first = np.searchsorted(asked // n_items, places // n_rows, "left")
    last = np.searchsorted(asked // n_items, places // n_rows, "right")
    for k, a, z in _pieces(first, last, PIECE):
        at, which = _ranges(a, z)
        pairs = np.unique(places[k[which]] % n_rows * n_items + asked[at] % n_items)
        for p in pairs.tolist():
            items[p // n_items].add(ids[p % n_items])


def _note_longest(words: np.ndarray, order: np.ndarray, b: Block, hot: np.ndarray, lo: np.ndarray, hi: np.ndarray, of: np.ndarray, row_of: np.ndarray, begin: np.ndarray, best: list[dict]) -> None:
    """For each document and item, the longest run of words they share that starts with a window.

    Only starts of runs are looked at: places and windows with different words before them. The places of each range are
    put in order of the word before, so that those with the same word as a window are one stretch, which is left out.
    """
    parts = [(k[which], order[at]) for k, a, z in _pieces(lo, hi, PIECE) for at, which in [_ranges(a, z)]]
    range_, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    ahead = np.where(place > 0, words[place - 1], np.uint64(0))  # 0 where a document begins
    names, code = np.unique(ahead, return_inverse=True)
    wide = np.int64(len(names) + 1)
    key = range_ * wide + code.reshape(-1)
    by_key = np.argsort(key, kind="stable")
    key, place = key[by_key], place[by_key]
    query = b.starts[hot]
    opens = np.isin(query, b.rows)
    before = b.words[np.maximum(query - 1, 0)]
    at = np.minimum(np.searchsorted(names, before), len(names) - 1)
    known = (names[at] == before) & ~opens
    left, right = np.searchsorted(key, of * wide), np.searchsorted(key, (of + 1) * wide)
    same_left = np.where(known, np.searchsorted(key, of * wide + at), right)
    same_right = np.where(known, np.searchsorted(key, of * wide + at, "right"), right)
    window = np.concatenate((hot, hot))
    for k, a, z in _pieces(np.concatenate((left, same_right)), np.concatenate((same_left, right)), PIECE):
        spot, which = _ranges(a, z)
        if not len(spot):
            continue
        p, w = place[spot], window[k][which]
        size = common_prefix(words, p, b.words, b.starts[w], b.left[w])
        row, item = row_of[p], b.item[w].astype(np.int64)
        pick = np.lexsort((p, -size, item, row))
        lead = np.concatenate(([True], (row[pick][1:] != row[pick][:-1]) | (item[pick][1:] != item[pick][:-1])))
        pick = pick[lead]
        for r, i, n, q, d in zip(row[pick].tolist(), item[pick].tolist(), size[pick].tolist(), (b.starts[w[pick]] - b.rows[item[pick]]).tolist(), (p[pick] - begin[row[pick]]).tolist(), strict=True):
            name, found = b.ids[i], (n, q, -d)
            if (old := best[r].get(name)) is None or (n, -d) > (old[0], old[2]):
                best[r][name] = found


def is_contaminated(n_hit, n_words, share: int = 20):
    """At least one word in share, and at least one, lies in a benchmark window."""
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13) -> DataFrame:
    """The documents, all columns whatever their names, without those that the rule calls contaminated. Rows without text stay."""
    found = _positional(documents, benchmark, tuple(documents.columns), text_col, "item_id", "text", window, False)
    clean = found.where(~is_contaminated(F.col("n_hit"), F.col("n_words")))
    return clean.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(documents.columns)])


def items_digest(ids) -> str:
    """SHA-256 of the comma-joined sorted ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def contamination_digest(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result columns of the decontamination query; the longest matches are not worked out for them."""
    found = _positional(documents, benchmark, (id_col,), text_col, "item_id", "text", 13, False).withColumnRenamed("c_0", id_col)
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
