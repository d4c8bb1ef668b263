"""N-gram Jaccard self-join by grouped prefixes, and the components of its links.

Word shingles are put in one global order, rare ones first, by a sketch of how often each occurs in all documents. Two
documents that reach the threshold share a shingle in their prefixes. Documents with equal sets are one node, and nodes
with the same prefix and size one group; groups that share a prefix shingle and may be similar by size are candidates,
which are expanded to their members and verified on the whole sets.

Only components are asked for, so candidates come in rounds. First each group meets one other group for each shingle
they share. Then, at shingles whose nodes still lie in different components, nodes are dealt out into crowds, small ones
at first, and those of one crowd that lie apart meet; after each round the components grow, and shingles with no more
nodes than a crowd are done. Last, what is left at the most frequent shingles meets crowd by crowd, every crowd with
every other: so no link is lost, a large group of near copies takes few verifications, not all pairs, and no task has
more than two crowds of a shingle. Before a pair is verified it must pass bounds that no linked pair fails: sizes,
places of the shared shingle, and parity bitmaps of the sets, whose bits differ in no more places than the sets differ
in shingles.

The sketch grows with the input up to a fixed size, which is what bounds the broadcast. Above that, shingles that are
rarer than a cell's usual count stand in the order of their hashes: prefixes then hold more shared shingles and more
pairs are tried, but no link depends on the order. A shingle whose cell is full is dealt out by group as well, over
about as many parts as the square root of the number of documents, whose first groups then meet; so no task holds all
groups of a frequent shingle.

Most shingles of prefixes are in one group alone and can link nothing. So that they are not shuffled with all that
belongs to them, tasks first send sorted gaps of 40 bits of each, about three bytes, and a bitmap says which of these
occur again; what it marks falsely is found alone later. Sketch and bitmaps have a fixed most size and come to the driver
in one job each, however many partitions make them. Sets are compared by 60-bit hashes of shingles and named by 63 bits; two different sets
share a name with a chance of 1e-9 among 10^5 documents and 1e-3 among 10^8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemark.llm.common import WordHasher, batches_of, drop, keep, mix, only_for, shingles, small_batches, text_buffers

#: Cells of the sketch, as powers of two: at least and at most; and those of one slice, which is summed up by itself.
CELLS_LOG, MOST_CELLS_LOG, SLICE_LOG = 16, 26, 16
#: UTF-8 bytes of text for which there is a cell.
CELL_BYTES = 5
#: Counts at which the level of a cell grows by one, in units of what a cell holds on average if that is more than one.
LEVELS = (1, 2, 3, 4, 6, 9, 14, 22, 36, 60, 100, 250, 800, 2500, 10_000)
#: Shingles of a cell from which number on their groups are dealt out over several tasks.
HOT = 250
#: Bits of the filter of rows whose texts are wanted, as a power of two, at least and at most.
WANTED_LOG, MOST_WANTED_LOG = 20, 27
#: Bytes of that filter that are merged by themselves, as a power of two.
MARKED_LOG = 16
#: Words of 64 bits in a set's parity bitmap.
BITMAP_WORDS = 16
#: Nodes of a shingle that meet each other in the rounds after the first, and in the last one, crowd by crowd.
CROWDS, LAST_CROWD = (64, 4096), 1024
#: Bits of a prefix shingle by which it is looked for in other groups, and where they begin.
PRINT_LOG, PRINT_AT = 40, 20
#: Cells of the bitmap of those that occur again, and slices in which it is made, as powers of two: at least and at most.
AGAIN_LOG, MOST_AGAIN_LOG, SLICES_LOG, MOST_SLICES_LOG = 16, 29, 4, 12
CHUNK = 4 << 20
#: Shingles that a task counts before it hands them on.
COUNTED = 3_000_000


def _rows(part: pa.RecordBatch, hasher: WordHasher, size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*hasher(*text_buffers(part.column("body"))), size)


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells of a slice and their counts (up to 255): gaps by low and high byte, then the counts."""
    gaps = np.diff(cells, prepend=np.int64(-1)) - 1
    return zstandard.ZstdCompressor(level=1).compress(b"".join((gaps & 255, gaps >> 8, np.minimum(counts, 255))[k].astype(np.uint8).tobytes() for k in range(3)))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(3, -1).astype(np.int64)
    return np.cumsum((low | high << 8) + 1) - 1, counts


def frequency_levels(body: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """A level from 0 to 15 for each cell of the hash range, by the number of shingles in it over all documents; two
    levels a byte, even cells in the low half. The number of cells as a power of two; the lowest level of at least HOT.

    Tasks sum up their own counts and send those of each slice to one task, which adds them up as they come. The cells
    follow the bytes of text up to a fixed number.
    """
    text = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    log = min(MOST_CELLS_LOG, max(CELLS_LOG, (text // CELL_BYTES).bit_length() - 1))
    width, bounds = 1 << SLICE_LOG, np.array(LEVELS) * max(1, (text // CELL_BYTES) >> log)

    def count(batches):
        only_for()
        hasher, held, waiting = WordHasher(), [], 0

        def out():
            cells = np.concatenate(held)
            held.clear()
            cells.sort()
            at = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            counts, cells = np.diff(np.append(at, len(cells))), cells[at].astype(np.int64)
            own, first = np.unique(cells >> SLICE_LOG, return_index=True)
            last = np.append(first[1:], len(cells))
            packed = [_pack(cells[a:z] & (width - 1), counts[a:z]) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], names=["slice", "cells"])

        for batch in batches:
            for part in batches_of(batch, "body", CHUNK):
                held.append((_rows(part, hasher, size)[0] >> np.uint64(64 - log)).astype(np.uint32))
                waiting += len(held[-1])
                if waiting > COUNTED:
                    yield out()
                    held, waiting = [], 0
        if waiting:
            yield out()

    def add(batches):
        current, sums = -1, np.zeros(width, np.int64)

        def level():
            levels = np.searchsorted(bounds, sums, "right").astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([(levels[::2] | levels[1::2] << 4).tobytes()], pa.binary())], names=["slice", "levels"])

        for batch in batches:
            for s, packed in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if s != current:
                    if current >= 0:
                        yield level()
                    current = s
                    sums[:] = 0
                cells, counts = _unpack(packed)
                sums[cells] += counts
        if current >= 0:
            yield level()

    counted = body.mapInArrow(count, "slice int, cells binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, levels binary")
    out = np.zeros(1 << (log - 1), np.uint8)
    for r in counted.collect():
        out[r["slice"] << (SLICE_LOG - 1) : (r["slice"] + 1) << (SLICE_LOG - 1)] = np.frombuffer(r["levels"], np.uint8)
    return out, log, int(np.searchsorted(bounds, HOT)) + 1


def _ordered_sets(part: pa.RecordBatch, hasher: WordHasher, size: int, levels: np.ndarray, log: int):
    """Each row's distinct shingles in the global order: the level in the top four bits, then the hash."""
    hashes, first = _rows(part, hasher, size)
    cells = (hashes >> np.uint64(64 - log)).astype(np.int64)
    level = levels[cells >> 1] >> ((cells & 1) << 2).astype(np.uint8) & np.uint8(15)
    keys = (level.astype(np.uint64) << np.uint64(60)) | (hashes & np.uint64((1 << 60) - 1))
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(keys[a:z])
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if z - a > 1 else own


def _node(own: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int(mix(np.array([np.add.reduce(mix(own)) + np.uint64(len(own))], np.uint64))[0] >> np.uint64(1))


def _bitmap(own: np.ndarray) -> np.ndarray:
    """For each cell of a hash of the shingles, the parity of how many fall into it."""
    odd = np.bincount((mix(own) >> np.uint64(40)).astype(np.int64) % (64 * BITMAP_WORDS), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _overlap(percent: int):
    """Shingles that sets of n_a and n_b must share to link."""
    return F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent) - 1e-9)


def _sizes_fit(percent: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _bitmaps_fit(percent: int):
    """Whether the bitmaps of a pair (n_a, n_b, bits_a, bits_b) allow a link."""
    differ = sum((F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(BITMAP_WORDS)), F.lit(0))
    return differ <= F.col("n_a") + F.col("n_b") - 2 * _overlap(percent)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n of which one must be shared to reach the threshold."""
    return n - -(-percent * n // 100) + 1


def links(documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tie (a hash of the text), n_shingles, component_id and group of every document row.

    Two documents link when the Jaccard index of their sets of size-word shingles is at least percent / 100; a text of
    fewer words has its whole sequence as one shingle. component_id is the smallest id that links lead to, its own
    without any. group names the component whatever the ids are, NULL without shingles. Null, empty and blank texts have
    no shingles and no links. Rows with equal texts link; null ids are never the smallest unless there is no other. Other
    columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    body = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    table, log, hot_level = frequency_levels(body, size)
    levels = spark.sparkContext.broadcast(table)
    fields = body.withColumn("tie", F.xxhash64("body"))

    def sign(batches):
        only_for()
        hasher = WordHasher()
        for batch in batches:
            for part in batches_of(batch, "body", CHUNK):
                n, node, group, prefix, bits = [], [], [], [], []
                for own in _ordered_sets(part, hasher, size, levels.value, log):
                    n.append(len(own))
                    node.append(_node(own) if len(own) else None)
                    head = own[: prefix_size(len(own), percent)] if len(own) else own
                    group.append(_node(np.append(head, np.uint64(len(own)))) if len(own) else None)
                    prefix.append(head.view(np.int64))
                    bits.append(_bitmap(own))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(group, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["id", "tie", "n", "node", "grp", "prefix", "bits"])

    schema = StructType([fields.schema["id"], StructField("tie", LongType()), StructField("n", LongType()), StructField("node", LongType()), StructField("grp", LongType()), StructField("prefix", ArrayType(LongType())), StructField("bits", ArrayType(LongType()))])
    signed = keep(fields.select("id", "tie", "body").mapInArrow(sign, schema), "signatures")
    levels.destroy()

    # nodes (equal sets) with one row's key, and groups (equal prefixes and sizes)
    full = signed.where("node is not null")
    one = F.min(F.struct("id", "tie"))
    nodes = full.groupBy("node").agg(F.min("id").alias("least"), F.first("grp").alias("grp"), F.first("n").alias("n"), one.alias("row"), F.first("bits").alias("bits"))
    nodes = keep(nodes.select("node", "least", "grp", "n", F.xxhash64("row.id", "row.tie").alias("key"), "bits"), "nodes")
    heads_of, repeated, marks = prefix_groups(full)
    prefixes = (full.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100
    shared = keep(shared_tokens(prefixes_again(heads_of, prefixes, marks), percent, int(nodes.count() ** 0.5) + 1, hot_level), "shared")
    drop(repeated)
    slim = keep(signed.select("id", "tie", "n", "node"), "rows")
    drop(signed)

    sketch = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def checked(pairs: DataFrame, name: str, *before: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs not tried before, and those of them that link."""
        for b in before:
            pairs = pairs.join(b, ["a", "b"], "left_anti")
        fit = keep(pairs, name)
        return fit, verify(fields, nodes, fit, size, percent)

    # first round: a partner for each shingle, and the first member for each other member of a group
    head = keep(nodes.groupBy("grp").agg(F.min(F.struct("node", "n")).alias("h"), F.count(F.lit(1)).alias("members")).select("grp", "members", "h.*"), "heads")
    inner = nodes.select("grp", F.col("node").alias("b")).join(head.where("members > 1").select("grp", F.col("node").alias("a")), "grp").where("a <> b").select("a", "b")
    met = shared.select(F.explode("partners").alias("g1"), F.col("grp").alias("g2")).where("g1 is not null and g1 <> g2").distinct()
    outer = met.join(head.select(F.col("grp").alias("g1"), F.col("node").alias("a"), F.col("n").alias("n_a")), "g1").join(head.select(F.col("grp").alias("g2"), F.col("node").alias("b"), F.col("n").alias("n_b")), "g2")
    first = inner.unionByName(outer.where(_sizes_fit(percent)).select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried, edges = checked(first.join(sketch("a"), "a").join(sketch("b"), "b").where(_bitmaps_fit(percent)).select("a", "b"), "tried")
    comps = components(edges)
    drop(head, edges)

    # rounds of growing crowds: those that share a prefix shingle, are in one crowd of it and still lie apart
    before = [tried]
    spots = spots_apart(shared, nodes, comps)
    for crowd in (*CROWDS, None):
        if not spots.limit(1).count():
            break
        met = _new_pairs(spots, percent, crowd)
        pairs, edges = checked(met, "pairs", *before)
        last = comps
        comps = contract(comps, edges)
        before.append(pairs)
        drop(met, edges, last)
        if crowd:
            over = spots
            spots = still_apart(spots, nodes, comps, crowd)
            drop(over)
    drop(*before, shared, spots)

    least = nodes.select("node", "least").join(comps, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    lowest = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = least.join(lowest, "comp").select("node", "component_id", F.col("comp").alias("group"))
    return slim.join(named, "node", "left").select(F.col("id").alias(id_col), "tie", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "group")


def prefix_groups(full: DataFrame) -> tuple[DataFrame, DataFrame, Marks]:
    """grp, n, prefix, several (has more than one node) and row of every group; the kept table of those that may have several rows; and their marks.

    Rows that are alone in their group are read from where they are; the others, few, are put together. Where row is true,
    it is a row as it was: its group is not it if that is marked, which prefixes_again() leaves out. A task thus needs one
    worker; a function of its own for the marks would need another one beside it.
    """
    names = keep(full.groupBy("grp").count().where("count > 1").select("grp"), "repeated")
    marks = Marks(names, names.count())
    repeated = keep(full.where(marks.has(F.col("grp"))).groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), (F.min("node") < F.max("node")).alias("several")), "groups")
    drop(names)
    alone = full.select("grp", "n", "prefix", F.lit(False).alias("several"), F.lit(True).alias("row"))
    return alone.unionByName(repeated.withColumn("row", F.lit(False))), repeated, marks


def _prints(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(PRINT_AT)) & np.uint64((1 << PRINT_LOG) - 1)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and the place of each list's first (one more at the end)."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def prefixes_again(groups: DataFrame, prefixes: int, marks: Marks | None = None) -> DataFrame:
    """token, grp, n, pos and several of the prefix shingles that may be in several groups, and of the first one of groups of several nodes.

    prefixes: about how many prefix shingles there are, which sets the sizes of the bitmap and of its slices. With marks,
    groups have a column row, and of rows where it is true those whose group is marked are left out.
    """
    groups = groups.select("grp", "n", "prefix", "several", "row") if marks else groups.select("grp", "n", "prefix", "several", F.lit(False).alias("row"))
    spark = groups.sparkSession
    log = min(MOST_AGAIN_LOG, max(AGAIN_LOG, prefixes.bit_length() + 1))
    inner = PRINT_LOG - min(MOST_SLICES_LOG, max(SLICES_LOG, prefixes.bit_length() - 20))
    width = 1 << (log - PRINT_LOG + inner)

    def wanted(batch):
        if marks is None:
            return batch
        gone = batch.column("row").to_numpy(zero_copy_only=False) & marks.holds(batch.column("grp").to_numpy())
        return batch.filter(pa.array(~gone))

    def send(batches):
        held, waiting = [], 0

        def out():
            prints = np.concatenate(held)
            held.clear()
            prints.sort()
            own, first = np.unique(prints >> np.uint64(inner), return_index=True)
            packer, packed = zstandard.ZstdCompressor(level=1), []
            for a, z in zip(first.tolist(), np.append(first[1:], len(prints)).tolist(), strict=True):
                gaps = np.diff(prints[a:z] & np.uint64((1 << inner) - 1), prepend=np.uint64(0))
                packed.append(packer.compress(np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], names=["slice", "prints"])

        for batch in batches:
            held.append(_prints(_lists(wanted(batch).column("prefix"))[0]))
            waiting += len(held[-1])
            if waiting > COUNTED:
                yield out()
                held, waiting = [], 0
        if waiting:
            yield out()

    def find(batches):
        current, held = -1, []

        def out():
            prints = np.sort(np.concatenate(held))
            bits = np.zeros(width, bool)
            bits[(prints[1:][prints[1:] == prints[:-1]] >> np.uint64(PRINT_LOG - log)).astype(np.int64)] = True
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(bits, bitorder="little").tobytes())], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for s, packed in zip(batch.column("slice").to_pylist(), batch.column("prints").to_pylist(), strict=True):
                if s != current:
                    if held:
                        yield out()
                    current, held = s, []
                planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(5, -1)
                wide = np.zeros((planes.shape[1], 8), np.uint8)
                wide[:, :5] = planes.T
                held.append(np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64))
        if held:
            yield out()

    found = groups.select("grp", "prefix", "row").mapInArrow(send, "slice int, prints binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(find, "slice int, bits binary")
    bits = np.zeros((1 << log) // 8, np.uint8)
    for r in found.collect():
        bits[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8)
    marked = spark.sparkContext.broadcast(bits)

    def pick(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = wanted(whole.slice(start, 2000))
                tokens, first = _lists(batch.column("prefix"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))
                pos = np.arange(len(tokens)) - first[:-1][row]
                cells = (_prints(tokens) >> np.uint64(PRINT_LOG - log)).astype(np.int64)
                several = batch.column("several").to_numpy(zero_copy_only=False)
                kept = np.flatnonzero(((marked.value[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1) | (several[row] & (pos == 0)))
                for at in range(0, len(kept), 100_000):
                    k = kept[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[k]), batch.column("grp").take(pa.array(row[k])), batch.column("n").take(pa.array(row[k])), pa.array(pos[k].astype(np.int32)), pa.array(several[row[k]])], names=["token", "grp", "n", "pos", "several"])

    return groups.mapInArrow(pick, "token long, grp long, n long, pos int, several boolean")


def shared_tokens(postings: DataFrame, percent: int, parts: int, hot_level: int) -> DataFrame:
    """token, part, grp, n, pos and partners: the prefix shingles that several groups have, or several nodes of a group.

    partners are groups of the same shingle that a group may link with: the first in the order of sizes, or else the one
    before. A frequent shingle's groups are dealt out over parts, so that no task holds all of them: there a group has the
    first of all as a partner and the first of its part or the one before in it, and the first of a part the one before.
    """
    hot = F.shiftrightunsigned("token", 60) >= hot_level
    postings = postings.withColumn("part", F.when(hot, F.pmod(F.xxhash64("grp"), F.lit(parts)).cast("int")).otherwise(0))
    own = Window.partitionBy("token", "part")
    same, near = own.orderBy("n", "grp"), lambda s: F.col(s)["n"] * 100 >= F.col("n") * percent
    led = postings.withColumn("lead", F.first(F.struct("n", "grp")).over(same)).withColumn("prev", F.lag(F.struct("n", "grp")).over(same)).withColumn("shared", F.count(F.lit(1)).over(own))
    partner = F.when(F.col("prev").isNotNull(), F.when(near("lead"), F.col("lead")["grp"]).when(near("prev"), F.col("prev")["grp"]))
    # a group of several nodes keeps its first shingle also where no other group has it: there its members meet each other
    found = led.where((F.col("shared") > 1) | hot | (F.col("several") & (F.col("pos") == 0)))
    found = keep(found.select("token", "part", "grp", "n", "pos", partner.alias("partner"), F.col("prev").isNull().alias("first")), "postings")
    dealt = found.where(hot)
    tops = dealt.where("first").withColumn("prev", F.lag(F.struct("n", "grp")).over(Window.partitionBy("token").orderBy("n", "grp")))
    tops = tops.select("token", "grp", F.when(near("prev"), F.col("prev")["grp"]).alias("top"))
    leads = dealt.groupBy("token").agg(F.min(F.struct("n", "grp")).alias("lead"))
    met = dealt.join(leads, "token").join(tops, ["token", "grp"], "left").withColumn("partners", F.array("partner", "top", F.when(near("lead"), F.col("lead")["grp"])))
    columns = ["token", "part", "grp", "n", "pos", "partners"]
    return found.where(~hot).withColumn("partners", F.array("partner")).select(*columns).unionByName(met.select(*columns))


def spots_apart(shared: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """token, there, pos, node, n, comp and bits of the nodes at those prefix shingles that have several nodes and whose nodes lie in more than one component; there counts them."""
    placed = keep(nodes.select("grp", "node", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    at = shared.select("token", "grp", "pos")
    ends = placed.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"))
    apart = at.join(ends, "grp").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("members").alias("there")).where("low <> high").select("token", "there")
    found = at.join(apart, "token").join(placed, "grp").join(nodes.select("node", "bits"), "node")
    spots = keep(found.select("token", "there", "pos", "node", "n", "comp", "bits"), "spots")
    drop(placed)
    return spots


def still_apart(spots: DataFrame, nodes: DataFrame, comps: DataFrame, done: int) -> DataFrame:
    """Those of the spots whose shingle has more nodes than are done with and still lies in more than one component of comps.

    Components only grow, so what is left out of one round need not be looked at in the next.
    """
    left = spots.where(F.col("there") > done).select("token", "there", "pos", "node", "n")
    placed = keep(left.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    apart = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    found = placed.join(apart, "token").join(nodes.select("node", "bits"), "node")
    again = keep(found.select("token", "there", "pos", "node", "n", "comp", "bits"), "spots")
    drop(placed)
    return again


def _places_fit(percent: int):
    """Whether the places of a shared shingle in both sets leave room for the overlap."""
    return F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= _overlap(percent)


def _new_pairs(spots: DataFrame, percent: int, crowd: int | None) -> DataFrame:
    """a < b of the pairs of one crowd, or of any two without a crowd, that lie apart and that sizes, places and bitmaps allow to link."""
    own = F.pmod(F.xxhash64("node", "token"), F.ceil(F.col("there") / (crowd or LAST_CROWD)))
    dealt = spots.withColumn("own", own)
    if crowd:
        dealt = dealt.withColumn("meeting", F.struct(F.col("own").alias("i"), F.col("own").alias("j")))
    else:  # a crowd comes to a meeting with each one
        others = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("there") / LAST_CROWD) - 1)
        dealt = dealt.withColumn("meeting", F.explode(F.transform(others, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))))
    left, right = (dealt.select("token", F.col("meeting.i").alias("i"), F.col("meeting.j").alias("j"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "comp", "bits", "own")]) for x in "ab")
    met = left.join(right, ["token", "i", "j"]).where(F.expr("node_a < node_b and comp_a <> comp_b and (i = j or own_a <> own_b)") & _sizes_fit(percent) & _places_fit(percent) & _bitmaps_fit(percent))
    return keep(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "met")


def contract(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp of all nodes that have edges, when the components of comps are joined by more edges."""
    label = lambda c: edges.select(F.col(c).alias("node")).distinct().join(comps, "node", "left").select(F.col("node").alias(c), F.coalesce("comp", "node").alias(f"{c}_comp"))
    over = edges.join(label("a"), "a").join(label("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).where("a <> b")
    whole = components(over).toDF("comp", "whole")
    every = comps.unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti").withColumn("comp", F.col("node")))
    return keep(every.join(whole, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp")), "comps")


class Marks:
    """A bitmap in which the lowest bits of every number of a column are marked; sized by their count, up to a bound."""

    def __init__(self, names: DataFrame, count: int):
        self.log = min(MOST_WANTED_LOG, max(WANTED_LOG, (16 * count).bit_length()))
        cells = (1 << self.log) - 1

        width = 1 << min(MARKED_LOG, self.log - 3)

        def mark(batches):
            bits = np.zeros(1 << self.log, bool)
            for batch in batches:
                bits[batch.column(0).to_numpy(zero_copy_only=False) & cells] = True
            packed = np.packbits(bits, bitorder="little").reshape(-1, width)
            at = np.flatnonzero(packed.any(axis=1))
            for k in at.tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(packed[k].tobytes())], pa.binary())], names=["slice", "bits"])

        def merge(batches):
            current, bits = -1, None
            for batch in batches:
                for k, packed in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                    own = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
                    if k != current:
                        if bits is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])
                        current, bits = k, own
                    else:
                        bits = bits | own
            if bits is not None:
                yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])

        marked = names.mapInArrow(mark, "slice int, bits binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, bits binary")
        bits = np.zeros((1 << self.log) // 8, np.uint8)
        for row in marked.collect():
            bits[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
        self.bits = names.sparkSession.sparkContext.broadcast(bits)

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        """Whether each number may be marked: false marks happen, missing ones do not. For tasks."""
        at = numbers & ((1 << self.log) - 1)
        return (self.bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def has(self, column):
        """Whether the number of a column may be marked, as a function of the column."""

        @F.pandas_udf("boolean")
        def marked(numbers: pd.Series) -> pd.Series:
            return pd.Series(self.holds(numbers.to_numpy()))

        return marked(column)


def verify(fields: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a < b) of nodes whose whole sets reach the threshold.

    A filter marks one row of each node in question; the texts are read again, and those of marked rows meet their
    pairs, where their sets are made and compared. False marks cost work, never results.
    """
    ends = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node"), "ends")
    count = ends.count()
    if not count:
        drop(ends)
        return pairs.where("false")
    key = F.xxhash64("id", "tie")
    wanted = Marks(ends.select("key"), count)
    rows = fields.where(wanted.has(key)).select(key.alias("key"), "body").dropDuplicates(["key"])
    texts = keep(rows.join(ends, "key").select("node", "body"), "texts")
    wanted.bits.destroy()

    def compare(batches):
        hasher, last, own = WordHasher(), None, None
        for batch in batches:
            for part in batches_of(batch, "body_b", CHUNK):
                other, first = shingles(*hasher(*text_buffers(part.column("body_b"))), size)
                same = []
                for k, a in enumerate(part.column("a").to_pylist()):
                    if a != last:  # pairs come sorted by a
                        own = np.unique(shingles(*hasher(*text_buffers(part.column("body_a").slice(k, 1))), size)[0])
                        last = a
                    both = np.concatenate((own, np.unique(other[first[k] : first[k + 1]])))
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    same.append(100 * shared >= percent * (len(both) - shared))
                mask = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])

    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    edges = keep(joined.select("a", "b", "body_a", "body_b").mapInArrow(compare, "a long, b long"), "edges")
    drop(ends, texts)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node, comp (one node of its component, the same for all) of all nodes that have edges.

    In each round every node takes its smallest neighbour's label, if that is smaller, and that one's label in turn;
    then edges are moved to the labels, and those within a label go. Names of nodes are hashes, so few rounds do.
    """
    edges = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph")
    steps = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        step = keep(low.join(low.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")), "step")
        steps.append(step)
        moved = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        over = edges
        edges = keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "graph")
        drop(over)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    links = steps[0].withColumnRenamed("to", "comp")
    for step in steps[1:]:
        links = links.join(step.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    links = keep(links, "links")
    drop(edges, *steps)
    return links


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one document of each group of linked ones: that with the smallest id, null ids last, ties by a hash of the text.

    Documents without shingles all stay. Of rows that repeat id and text one stays.
    """
    every = keep(links(documents, size, percent, id_col, text_col).select(F.col(id_col).alias("id_"), F.col("tie").alias("tie_"), F.col("group").alias("group_")), "linked")
    found = every.where("group_ is not null")
    best = found.groupBy("group_").agg(F.min(F.struct(F.col("id_").isNull().alias("none"), F.col("id_").alias("id"), F.col("tie_").alias("tie"))).alias("b"))
    is_best = F.col("id_").eqNullSafe(F.col("b.id")) & (F.col("tie_") == F.col("b.tie"))
    gone = keep(found.join(best, "group_").where(~is_best).select("id_", "tie_").distinct(), "gone")
    tie = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    same = lambda df: documents[id_col].eqNullSafe(df["id_"]) & (tie == df["tie_"])
    # rows without a mark stay where they are, and marked ones go if none like them stays; the others, few, are compared exactly
    key, key_ = F.xxhash64(F.col(id_col), tie), F.xxhash64("id_", "tie_")
    marks = Marks(gone.select(key_.alias("key")), 16 * gone.count())
    alike = keep(every.where(marks.has(key_)).join(gone.toDF("i", "t"), F.expr("id_ <=> i and tie_ = t"), "left_anti").select(key_.alias("key")), "alike")
    unsure = Marks(alike, 16 * alike.count())
    left = documents.where(~marks.has(key)).unionByName(documents.where(marks.has(key) & unsure.has(key)).join(gone, same(gone), "left_anti"))
    again = keep(found.groupBy("id_", "tie_").count().where("count > 1").select("id_", "tie_"), "again")
    if again.limit(1).count():
        there = left[id_col].eqNullSafe(again["id_"]) & (F.xxhash64(F.coalesce(left[text_col].cast("string"), F.lit(""))) == again["tie_"])
        some = left.join(again, there, "left_semi").dropDuplicates([id_col, text_col])
        left = left.join(again, there, "left_anti").unionByName(some)
    return left
