"""The trie of conversations that share their first turns, by partition refinement.

Conversations with equal turns are one sequence with a weight. All sequences start in one class; turn by turn a class is
split into those that go on alike. A class of one sequence is retired: the rest of it is a chain of nodes that it has
alone, taken from its turns without any more grouping. A pass splits by one turn, the next by two, then four, up to a
bound, each turn in its own right: as many passes as the logarithm of the turns that two different sequences share, not
as many as there are turns. A node is named by its smallest member and its depth.

Folding back needs no walk up the trie. Every node belongs to its smallest member, and a member owns its nodes from some
depth to its end; so what lies below a node is what its owner owns from there on, and all that its other members own.

Numbering the turns, chains and the lists of members are spread over tasks: no task holds a whole conversation or all
ends of a node, but one reads through the list of each node's ends, in pieces, to digest it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop, keep

#: Ids up to this bound below their base (the multiple of it) share the first turns of the base; fewer than MOST_HEAD of them.
SHARING, MOST_HEAD = 100, 6
#: Turns by which a pass splits at most, and turns of a block in running sums.
WIDEST, BLOCK = 1024, 1024
#: Ids of one piece of a list.
LISTED = 50_000


def head_size(conv: Column) -> Column:
    """Turns that a conversation takes from the one that it shares its beginning with."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_HEAD).cast("long")


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), key (a digest of role and text) and size (code points of the text) of every turn.

    Turns are ordered by turn, null first, those of one turn by role and digest. Null roles and texts are empty. Rows
    without a conversation are in none and left out. A conversation's turns are numbered in pieces.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), F.char_length(text).cast("long").alias("size"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("key")]
    dealt = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange("conv", *order, "any").drop("any").withColumn("block", F.spark_partition_id())
    dealt = keep(dealt, "turns")
    totals = dealt.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("conv", "block").orderBy(*order)))
    return own.join(before, ["conv", "block"]).select("conv", (F.col("own") + F.col("before")).alias("pos"), "key", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, key, size) of all turns, and (conv, n) of all conversations, after each has taken its head from its base."""
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    lengths = lengths.select("conv", "own", head_size(F.col("conv")).alias("head"), (F.col("conv") - F.col("conv") % SHARING).alias("base"))
    there = lengths.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    shaped = keep(lengths.join(there, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_own", F.lit(0)))), "shapes")
    heads = turns.where((F.col("conv") % SHARING == 0) & (F.col("pos") < MOST_HEAD)).withColumnRenamed("conv", "base")
    first = shaped.where("taken > 0").select("conv", "base", "taken").join(heads, "base").where("pos <= taken").select("conv", F.col("pos").alias("depth"), "key", "size")
    rest = turns.join(shaped.select("conv", "head", "taken"), "conv").where("pos > head").select("conv", (F.col("taken") + F.col("pos") - F.col("head")).alias("depth"), "key", "size")
    return first.unionByName(rest), shaped.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("n"))


def _marks() -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at its depth; together those of a sequence, xored, name it."""
    return F.xxhash64("depth", "key"), F.xxhash64("key", "depth", F.lit("again"))


def sequences(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv, n and rep: the smallest conversation with equal turns."""
    one, two = _marks()
    whole = turns.groupBy("conv").agg(F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two"))
    named = lengths.join(whole, "conv", "left").withColumns({"one": F.coalesce("one", F.lit(0)), "two": F.coalesce("two", F.lit(0))})
    reps = named.groupBy("n", "one", "two").agg(F.min("conv").alias("rep"))
    return named.join(reps, ["n", "one", "two"]).select("conv", "n", "rep")


def refine(turns: DataFrame, reps: DataFrame) -> DataFrame:
    """conv, depth, size, n, node and convs: the node that each sequence (conv, n, weight) is in at each depth, and the node's conversations."""
    one, two = _marks()
    active = reps.where("n > 0").withColumn("class", F.lit(0).cast("long"))
    deep, width, passes = 0, 1, []
    columns = ["conv", "depth", "size", "n", "weight", "node", "convs"]
    while True:
        last = active
        run = Window.partitionBy("conv").orderBy("depth")
        here = turns.where((F.col("depth") > deep) & (F.col("depth") <= deep + width)).join(active, "conv")
        here = keep(here.select("conv", "depth", "size", "n", "weight", "class", F.bit_xor(one).over(run).alias("one"), F.bit_xor(two).over(run).alias("two")), "pass")
        key = ["class", "depth", "one", "two"]
        parts = here.groupBy(*key).agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("members"), F.sum("weight").alias("convs"))
        split = keep(here.join(parts, key).select(*columns, "members"), "split")
        passes.append(split)
        deep += width
        active = keep(split.where((F.col("depth") == deep) & (F.col("n") > deep) & (F.col("members") > 1)).select("conv", "n", "weight", F.col("node").alias("class")), "active")
        drop(here, *([last] if len(passes) > 1 else []))
        if not active.limit(1).count():
            break
        width = min(2 * width, WIDEST)
    drop(active)
    split = passes[0]
    for p in passes[1:]:
        split = split.unionByName(p)
    seen = split.groupBy("conv").agg(F.max("depth").alias("seen"), F.first("n").alias("n"), F.first("weight").alias("weight")).where("seen < n")
    tails = turns.join(seen, "conv").where("depth > seen").select("conv", "depth", "size", "n", "weight", F.col("conv").alias("node"), F.col("weight").alias("convs"))
    out = keep(split.select(*columns).unionByName(tails), "placed").drop("weight")
    drop(*passes)
    return out


def end_digests(members: DataFrame) -> DataFrame:
    """rep and ends_sha256: the digest of the ids (conv) of each rep in ascending order, with commas between.

    The ids are sorted and joined in pieces all over; one task then reads the pieces of a list in order.
    """

    def joined(batches):
        rep, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["rep", "first", "ids"])

        for batch in batches:
            for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if ids and (r != rep or len(ids) >= LISTED):
                    yield out()
                    ids = []
                rep = r
                ids.append(c)
        if ids:
            yield out()

    def digest(batches):
        rep, sha = None, None
        for batch in batches:
            done, hashes = [], []
            for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if r == rep:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append(rep)
                        hashes.append(sha.hexdigest())
                    rep, sha = r, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(hashes, pa.string())], names=["rep", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["rep", "ends_sha256"])

    pieces = members.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(joined, "rep long, first long, ids string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digest, "rep long, ends_sha256 string")


def _from_here_on(values: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """values (conv, depth, ...) with the sums of the columns from each depth to the conversation's end, in blocks of depths."""
    blocked = values.withColumn("block", F.floor(F.col("depth") / BLOCK))
    sums = blocked.groupBy("conv", "block").agg(*[F.sum(c).alias(f"{c}_all") for c in columns])
    later = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    behind = sums.select("conv", "block", *[F.coalesce(F.sum(f"{c}_all").over(later), F.lit(0)).alias(f"{c}_behind") for c in columns])
    inside = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    within = blocked.select(*values.columns, "block", *[F.sum(c).over(inside).alias(f"{c}_in") for c in columns])
    return within.join(behind, ["conv", "block"]).select(*values.columns, *[(F.col(f"{c}_in") + F.col(f"{c}_behind")).alias(f"{c}_on") for c in columns])


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row of each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are first rebuilt with the head of their base (see rebuilt). Node (conv_id, depth) stands for the first
    depth turns (role and text) of its smallest member. n_convs counts members, n_children nodes one turn deeper, n_leaves
    the childless nodes at or below it, saved_tokens the code points of last texts that members at or below it need not
    repeat, ends_sha256 digests the ids of the members that end there. The root has depth 0 and no parent; conversations
    without turns end there. An empty table has no node. Ties, nulls and repeated rows: see numbered. Other columns are
    not read.
    """
    turns, lengths = rebuilt(keep(numbered(conversations, conv_col, turn_col, role_col, text_col), "numbered"))
    turns = keep(turns, "rebuilt")
    members = keep(sequences(turns, lengths), "sequences")
    reps = keep(members.groupBy("rep").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("weight")).withColumnRenamed("rep", "conv"), "reps")
    placed = refine(turns, reps)

    # what each sequence owns, and where it leaves the nodes of others
    owned = placed.where("conv = node")
    left = placed.where("conv <> node").groupBy("conv").agg(F.max(F.struct("depth", "node")).alias("up")).select("conv", "up.*")
    starts = reps.where("n > 0").join(left, "conv", "left").select("conv", F.coalesce("depth", F.lit(0)).alias("from"), F.col("node").alias("from_node"), "n")
    branches = starts.where("n > from").groupBy(F.col("from_node").alias("conv"), F.col("from").alias("depth")).agg(F.count(F.lit(1)).alias("branches"))
    nodes = owned.join(branches, ["conv", "depth"], "left").join(starts.select("conv", "from", "from_node"), "conv")
    n_children = F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("n")).cast("long")
    nodes = nodes.select("conv", "depth", "convs", n_children.alias("children"), ((F.col("convs") - 1) * F.col("size")).alias("saved"), "from", "from_node")
    nodes = keep(nodes.withColumn("leaf", (F.col("children") == 0).cast("long")), "nodes")

    # fold back
    sums = nodes.groupBy("conv").agg(F.sum("leaf").alias("leaf_sum"), F.sum("saved").alias("saved_sum"))
    others = placed.where("conv <> node").select("conv", "node", "depth").join(sums, "conv").groupBy(F.col("node").alias("conv"), "depth").agg(F.sum("leaf_sum").alias("leaf_others"), F.sum("saved_sum").alias("saved_others"))
    folded = _from_here_on(nodes, ("leaf", "saved")).join(others, ["conv", "depth"], "left")

    digests = end_digests(members)
    ended = placed.where("depth = n").select(F.col("conv").alias("rep"), F.col("node").alias("conv"), "depth").join(digests, "rep").drop("rep")
    root = members.agg(F.min("conv").alias("root"), F.count(F.lit(1)).alias("convs"))
    none = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    below = folded.join(ended, ["conv", "depth"], "left").crossJoin(F.broadcast(root.select("root")))
    parent = F.when(F.col("depth") > F.col("from") + 1, F.col("conv")).otherwise(F.coalesce("from_node", "root"))
    out = below.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), F.col("convs").cast("long").alias("n_convs"), F.col("children").cast("long").alias("n_children"),
        (F.col("leaf_on") + zero("leaf_others")).cast("long").alias("n_leaves"), (F.col("saved_on") + zero("saved_others")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    top = nodes.agg(zero(F.sum((F.col("depth") == 1).cast("long"))).alias("children"), zero(F.sum("leaf")).alias("leaves"), zero(F.sum("saved")).alias("saved"))
    still = members.where("n = 0").select("rep").distinct().join(digests, "rep").agg(F.max("ends_sha256").alias("ends"))
    first = root.where("convs > 0").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(still)).select(
        F.col("root").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.col("children").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
    )
    return out.unionByName(first)
