"""Language-model scoring with a log-frequency Bloom filter.

Counts of all words and word pairs of the training documents are quantised to powers of a base; an n-gram with level q
is in the filter once for each level from 1 to q, each time with several bits. A scorer finds a pair's level by probing
level after level until a bit is missing, and smooths the pair's relative frequency with the word's own.

Counting sends sorted hash arrays, summed up in each task, to blocks of the hash range; each block becomes its exact
word counts, kept as a table, and its part of the filter. Documents are dealt to groups of GROUP_TEXT bytes by a hash.
A group asks each block once for its distinct pairs and words there, in one shuffle; the block looks pairs up in its part
of the filter and words in its counts, and the answers, a byte for a pair, go back to the group, which adds them up for
its documents. So documents are read as often at any size, a worker holds one block or one group, and what is shuffled
is in proportion to the input. Words of a bounded broadcast table of the most frequent ones are not asked for; that
saves a part of the shuffle and changes no result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.llm.common import WordHasher, batches_of, keep, mix, text_buffers

#: Counts are quantised to powers of BASE; each level sets PROBES bits; bits for each level and n-gram.
BASE, PROBES, BITS = 1.6, 5, 7.2
#: Weight of the word's own probability against the pair's: PRIOR observations times this power of the first word's count.
PRIOR, GROWTH = 2.0, 0.75
#: N-grams that one block of the hash range should hold, at most and about, and words of the broadcast table at most.
BLOCK_NGRAMS, TABLE_WORDS = 1_500_000, 1_000_000
#: Blocks that one look-up task takes, about; a block's filter takes about 2.5 MB, 4 at most.
PASS_BLOCKS = 1
#: Bytes of text in a group of documents, about; groups at least; n-grams that a block looks up at once.
GROUP_TEXT, GROUPS, LOOKED_UP = 12 << 20, 24, 1 << 19
CHUNK = 2 << 20
#: Stands for the end of a document, which counts as a token.
END = np.uint64(0x5DEECE66D1234567)
_LEVELS = 64


def tokens(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of each row and its end, and each row's first index (one more at the end)."""
    words, rows = hasher(*text_buffers(texts))
    counts = np.diff(rows)
    out = np.full(len(words) + len(counts), END, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(words)) + row] = words
    return out, rows + np.arange(len(rows))


def pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each token and the one before it; a document starts after an end."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1]] = END
    return mix(before * np.uint64(0xD1342543DE82EF95) + words)


def _sum_up(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs or the sum of its weights."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, weights = values[order], weights[order]
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.diff(np.append(at, len(values))) if weights is None else np.add.reduceat(weights, at)


def pack(values: np.ndarray) -> bytes:
    """Sorted hashes as the first of them and the gaps between them, in as many bytes as the widest gap takes."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The hashes of pack()."""
    if not data:
        return np.zeros(0, np.uint64)
    narrow = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    wide = np.zeros((len(narrow) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(data, np.uint8, 8, offset=1)
    wide[1:, : data[0]] = narrow
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64)


@lru_cache(maxsize=1)
def _hasher() -> WordHasher:
    return WordHasher()


def _by_row(row: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    """The sum of the weights, or the number, of each of n rows."""
    return np.bincount(row, weights, minlength=n).astype(np.float64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised log count: 1 for 1, one more for each power of BASE."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of the counts that have it; 0 for level 0."""
    low = BASE ** (levels - 1.0)
    return np.where(levels <= 0, 0.0, np.maximum(1.0, (np.ceil(low - 1e-9) + np.maximum(np.ceil(low - 1e-9), np.ceil(low * BASE - 1e-9) - 1)) / 2))


def _bit(grams: np.ndarray, level, probe: int, size: np.ndarray) -> np.ndarray:
    salt = mix(np.array([level * 64 + probe + 1], np.uint64))
    return (((grams ^ salt) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) * size >> np.uint64(32)


def build_block(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter's bytes for the n-grams of a block."""
    levels = level_of(counts)
    out = np.zeros(-(-max(64, int(levels.sum() * BITS)) // 8) * 8, bool)
    size = np.uint64(len(out))
    for q in range(1, int(levels.max(initial=0)) + 1):
        own = grams[levels >= q]
        for p in range(PROBES):
            out[_bit(own, q, p, size).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


class Filter:
    """Blocks of the filter from the first on, in slices that are used as they are: (blocks, their sizes in bytes, their bytes)."""

    def __init__(self, slices: list[tuple[list[int], list[int], bytes]], first: int, last: int):
        self.first = first
        self.slice = np.full(last - first, -1, np.int64)
        self.start, self.bits = np.zeros(last - first, np.int64), np.ones(last - first, np.uint64)
        self.data = []
        for k, (own, sizes, data) in enumerate(slices):
            at = np.array(own, np.int64) - first
            self.slice[at] = k
            self.start[at] = np.cumsum(sizes) - sizes
            self.bits[at] = np.array(sizes, np.uint64) * np.uint64(8)
            self.data.append(np.frombuffer(data, np.uint8))

    def levels(self, grams: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The level of each n-gram of these blocks: probes go on, level by level, for those that had all bits so far."""
        out = np.zeros(len(grams), np.int64)
        block = block - self.first
        which = self.slice[block]
        for k, data in enumerate(self.data):
            live = np.flatnonzero(which == k)
            for q in range(1, _LEVELS):
                for p in range(PROBES):
                    at = _bit(grams[live], q, p, self.bits[block[live]])
                    live = live[(data[self.start[block[live]] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if not len(live):
                    break
                out[live] = q
        return out


def block_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    """The block of the hash range that an n-gram belongs to."""
    return ((grams >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)


def _in_blocks(grams: np.ndarray, counts: np.ndarray, blocks: int):
    """(block, hashes, counts) of sorted n-grams; blocks are ranges."""
    edges = np.searchsorted(block_of(grams, blocks), np.arange(blocks + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, pack(grams[edges[b] : edges[b + 1]]), counts[edges[b] : edges[b + 1]].astype("<u4").tobytes()


def count_ngrams(training: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """A table with a row for each block: block, words and their counts (binary arrays), the part of the filter, and totals; and the number of blocks.

    All rows count; a null text is an empty one. The blocks' number follows the bytes of text, so that a block stays
    small at any size of input.
    """
    body = training.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    size = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(8, -(-size // 5 // BLOCK_NGRAMS))

    def count(batches):
        hasher = WordHasher()
        held = {1: [], 2: []}
        size = 0

        def out():
            for order, parts in held.items():
                if parts:
                    grams = np.concatenate([p[0] for p in parts])
                    grams, counts = _sum_up(grams, np.concatenate([p[1] for p in parts]))
                    rows = list(_in_blocks(grams, counts, blocks))
                    for at in range(0, len(rows), 64):
                        b, g, c = zip(*rows[at : at + 64], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([order] * len(b), pa.int32()), pa.array(g, pa.binary()), pa.array(c, pa.binary())], names=["block", "n", "grams", "counts"])
                    parts.clear()

        for batch in batches:
            for part in batches_of(batch, "body", CHUNK):
                words, first = tokens(part.column("body"), hasher)
                for order, grams in ((1, words), (2, pairs(words, first))):
                    held[order].append(_sum_up(grams))
                    size += len(held[order][-1][0])
                if size > 3_000_000:
                    yield from out()
                    size = 0
        yield from out()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {}
        for order in (1, 2):
            own = pdf[pdf["n"] == order]
            sums[order] = _sum_up(np.concatenate([np.zeros(0, np.uint64), *map(unpack, own["grams"])]), np.frombuffer(b"".join(own["counts"]), "<u4").astype(np.int64))
        words, counts = sums[1]
        part = build_block(np.concatenate((words, sums[2][0])), np.concatenate((counts, sums[2][1])))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "words": [words.tobytes()], "counts": [counts.astype("<i8").tobytes()], "filter": [part.tobytes()], "total": [int(counts.sum())], "distinct": [len(words)], "pairs": [len(sums[2][0])]})

    counted = body.mapInArrow(count, "block int, n int, grams binary, counts binary")
    table = counted.groupBy("block").applyInPandas(settle, "block int, words binary, counts binary, filter binary, total long, distinct long, pairs long")
    return keep(table, "ngram-blocks"), blocks


def frequent_words(table: DataFrame, most: int = TABLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The words above the lowest count at which at most so many words are left, sorted by hash; with their counts."""

    def histogram(batches):
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                values, n = _sum_up(level_of(np.frombuffer(c, "<i8")).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(n.astype(np.int64))], names=["level", "n"])

    levels = {r["level"]: r["n"] for r in table.select("counts").mapInArrow(histogram, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least, kept = max(levels, default=1) + 1, 0
    while least > 1 and kept + levels.get(least - 1, 0) <= most:
        least -= 1
        kept += levels.get(least, 0)

    def pick(batches):
        for batch in batches:
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(c, "<i8")
                some = level_of(counts) >= least
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(w, "<u8")[some].tobytes()], pa.binary()), pa.array([counts[some].tobytes()], pa.binary())], names=["words", "counts"])

    rows = table.select("words", "counts").mapInArrow(pick, "words binary, counts binary").collect()
    words = np.frombuffer(b"".join(bytes(r["words"]) for r in rows), "<u8")
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), "<i8")
    order = np.argsort(words)
    return words[order], counts[order]


def _counts_in(words: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each word in a table sorted by hash, 0 where it is missing."""
    if not len(table):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[at] == words, counts[at], 0)


def _ask(fields: DataFrame, frequent, blocks: int) -> DataFrame:
    """grp, block, words, grams: the distinct words beyond the frequent ones, and pairs, of a group of documents (grp, body; a group's rows stand together)."""

    def ask(batches):
        hasher = _hasher()
        grp, words, grams = None, [], []

        def out():
            if grp is None:
                return
            distinct = np.unique(np.concatenate(words))
            found = {"words": distinct[_counts_in(distinct, *frequent.value) == 0], "grams": np.unique(np.concatenate(grams))}
            edges = {k: np.searchsorted(block_of(v, blocks), np.arange(blocks + 1)) for k, v in found.items()}
            some = np.flatnonzero(np.diff(edges["words"]) + np.diff(edges["grams"]))
            for at in range(0, len(some), 64):
                own = some[at : at + 64]
                packed = {k: pa.array([pack(v[edges[k][b] : edges[k][b + 1]]) for b in own], pa.binary()) for k, v in found.items()}
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), grp, np.int64)), pa.array(own.astype(np.int32)), packed["words"], packed["grams"]], names=["grp", "block", "words", "grams"])

        for batch in batches:
            for part in batches_of(batch, "body", CHUNK):
                number = part.column("grp").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if number[a] != grp:
                        yield from out()
                        grp, words, grams = int(number[a]), [], []
                    tokens_, first = tokens(part.slice(a, z - a).column("body"), hasher)
                    words.append(np.unique(tokens_))
                    grams.append(np.unique(pairs(tokens_, first)))
        yield from out()

    return fields.mapInArrow(ask, "grp long, block int, words binary, grams binary")


def _look_up(asked: DataFrame, table: DataFrame, blocks: int, pass_blocks: int) -> DataFrame:
    """grp, block, counts, levels of what was asked: the words' exact counts and the pairs' levels in the filter, in the order of their hashes."""
    none = F.lit(None).cast("binary")
    stream = asked.withColumns({"counts": none, "filter": none}).unionByName(table.select(F.lit(None).cast("long").alias("grp"), "block", "words", none.alias("grams"), "counts", "filter"))
    # a block's own row comes first, then what is asked
    stream = stream.repartition(-(-blocks // max(1, pass_blocks)), "block").sortWithinPartitions("block", F.col("filter").isNull())

    def look_up(batches):
        current, exact, exact_counts, lookup = -1, np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def out():
            words, grams = (np.concatenate([x[k] for x in waiting]) for k in (1, 2))
            counts = _counts_in(words, exact, exact_counts).astype("<i8")
            levels = (np.zeros(len(grams), np.int64) if lookup is None else lookup.levels(grams, np.full(len(grams), current))).astype(np.uint8)
            w, g = (np.cumsum([0, *(len(x[k]) for x in waiting)]).tolist() for k in (1, 2))
            made = [(counts[w[k] : w[k + 1]].tobytes(), levels[g[k] : g[k + 1]].tobytes()) for k in range(len(waiting))]
            columns = [pa.array([x[0] for x in waiting], pa.int64()), pa.array([current] * len(waiting), pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*made, strict=True))]
            waiting.clear()
            return pa.RecordBatch.from_arrays(columns, names=["grp", "block", "counts", "levels"])

        size = 0
        for batch in batches:
            for grp, block, w, g, c, f in zip(*(batch.column(x) for x in ("grp", "block", "words", "grams", "counts", "filter")), strict=True):
                if block.as_py() != current or size > LOOKED_UP:
                    if waiting:
                        yield out()
                    size = 0
                if block.as_py() != current:  # without a row of its own no training n-gram is in the block
                    current, exact, exact_counts, lookup = block.as_py(), np.zeros(0, np.uint64), np.zeros(0, np.int64), None
                if f.is_valid:
                    exact, exact_counts, data = np.frombuffer(w.as_py(), "<u8"), np.frombuffer(c.as_py(), "<i8"), f.as_py()
                    lookup = Filter([([current], [len(data)], data)], current, current + 1)
                    continue
                waiting.append((grp.as_py(), unpack(w.as_py()), unpack(g.as_py())))
                size += len(waiting[-1][1]) + len(waiting[-1][2])
        if waiting:
            yield out()

    return stream.mapInArrow(look_up, "grp long, block int, counts binary, levels binary")


def score(documents: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every document row; log10 of probabilities.

    base_score is exact add-half word scoring; score takes pairs of words, from the filter, smoothed with the words'
    exact counts. Whole texts are scored; a null or empty text is its end alone. Equal rows get equal scores. Without
    training texts all words are unknown. Other columns are not read. pass_blocks: blocks that a look-up task takes; it
    changes no result.
    """
    spark = documents.sparkSession
    table, blocks = count_ngrams(training, text_col)
    totals = table.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    n_all, n_distinct = totals["n"] or 0, totals["v"] or 0
    frequent = spark.sparkContext.broadcast(frequent_words(table))
    rest = float(np.log10(n_all + 0.5 * (n_distinct + 1)))
    fields = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    size = fields.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    groups = max(GROUPS, -(-size // GROUP_TEXT))
    # the same exchange serves what is asked and what is added up
    dealt = fields.withColumn("grp", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("body")), F.lit(groups))).repartition(groups, "grp")
    answers = _look_up(_ask(dealt.sortWithinPartitions("grp"), frequent, blocks), table, blocks, pass_blocks).repartition(groups, "grp")
    schema = StructType([fields.schema["id"], *[StructField(c, LongType()) for c in ("n_tokens", "n_known")], *[StructField(c, DoubleType()) for c in ("base", "score")]])

    def add_up(docs: pa.Table, answered: pa.Table) -> pa.Table:
        words, first = tokens(docs.column("body"), _hasher())
        n = len(first) - 1
        row = np.repeat(np.arange(n), np.diff(first))
        order = np.argsort(answered.column("block").to_numpy())
        joined = lambda c, kind: np.frombuffer(b"".join(answered.column(c).take(pa.array(order)).to_pylist()), kind)
        distinct, word = np.unique(words, return_inverse=True)
        count = _counts_in(distinct, *frequent.value)
        count[count == 0] = joined("counts", "<i8")
        grams, gram = np.unique(pairs(words, first), return_inverse=True)
        level = joined("levels", np.uint8)
        assert len(level) == len(grams), "a group of documents was dealt out twice in different ways"
        # what each distinct word stands for, then the tokens
        log = np.log10(count + 0.5) - rest
        alone, weight = 10**log, PRIOR * (count + 1.0) ** GROWTH
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first[:-1]] = word[first[1:] - 1]
        pair = np.minimum(count_of(np.arange(_LEVELS))[level][gram], np.minimum(count[word], count[before]))
        smooth = (pair + weight[before] * alone[word]) / (count[before] + weight[before])
        figures = [pa.array(np.diff(first)), pa.array(np.bincount(row[count[word] > 0], minlength=n)), pa.array(_by_row(row, log[word], n)), pa.array(_by_row(row, np.log10(smooth), n))]
        return pa.Table.from_arrays([docs.column("id"), *figures], names=["id", "n_tokens", "n_known", "base", "score"])

    found = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(add_up, schema)
    return found.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
