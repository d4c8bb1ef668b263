"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, decontam, langid, lmscore, media, ngramjoin, pii, seekstore, sharding, warc
from tidemark.llm.common import Memory, WordHasher

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
sort_key = lambda x: (x is not None, x or 0)


def words(text):
    return (text or "").encode().translate(LOWER).split()


def test_word_hasher_agrees_with_split():
    import pyarrow as pa

    from tidemark.llm.common import text_buffers

    texts = ["A b\x0bC", None, "", "é" * 3, "x" * (3 << 20) + " y", " a b ", "b"]
    hashes, first = WordHasher()(*text_buffers(pa.array(texts)))
    flat = [w for t in texts for w in words(t)]
    assert len(hashes) == len(flat) and first.tolist() == np.cumsum([0] + [len(words(t)) for t in texts]).tolist()
    names = {}
    for h, w in zip(hashes.tolist(), flat, strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_token_files(spark, docs, rows, empty):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    manifest = seekstore.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
    found = seekstore.id_digest(seekstore.read_ids(spark, manifest)).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected[i, len(ids), seekstore.crc32_of(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=sort_key)
    assert seekstore.read_ids(spark, manifest, {7}).count() == 1
    assert seekstore.read_ids(spark, seekstore.write_ids(empty, public_tokenizers.path("word_bpe_49k.json"), 2)).count() == 0


def test_damaged_frame_is_noticed(tmp_path):
    path = tmp_path / "f.zst"
    with path.open("wb") as out:
        w = seekstore.Writer(out, frame_bytes=100)
        places = [w.add(bytes([k]) * 60) for k in range(5)]
        w.finish(b"index")
    from pyarrow import fs

    store = fs.LocalFileSystem()
    reader = seekstore.Reader(store.open_input_file(str(path)))
    assert reader.index == b"index" and places == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert reader.frame(3) == b"\x03" * 60
    data = bytearray(path.read_bytes())
    data[reader.starts[3] + 8] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017
        seekstore.Reader(store.open_input_file(str(path))).frame(3)


def test_shards(docs, rows, empty):
    found = sharding.shard_digest(sharding.shard_by_bytes(docs, shards=5)).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len(text(t)) + 8, zlib.crc32(text(t))) for i, t, *_ in rows)
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    assert sharding.shard_by_bytes(empty).count() == 0


def test_shards_are_even(spark):
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text " * 20).otherwise(F.repeat(F.col("id").cast("string"), 30)).alias("text"))
    sums = sharding.shard_by_bytes(table).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(sums) == 24 and all(r["m"] == r["n"] - 1 for r in sums)
    assert max(r["b"] for r in sums) < 1.01 * min(r["b"] for r in sums)


def test_shards_of_uneven_texts_are_even_and_cut_few_groups(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = sharding.shard_by_bytes(table).collect()
    assert len(placed) == table.count()
    sums, rows, where = Counter(), {}, {}
    for r in placed:
        sums[r["shard"]] += r["size"]
        rows.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in rows.values())
    assert max(sums.values()) - min(sums.values()) <= 2 * sum(sums.values()) / 24 / sharding.LARGE
    assert sum(len(x) > 1 for x in where.values()) <= 23


def test_shards_of_one_repeated_row(spark):
    table = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 5 > 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    sums = sharding.shard_by_bytes(table, shards=8).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(sums) == 8 and all(r["m"] == r["n"] - 1 for r in sums) and max(r["b"] for r in sums) - min(r["b"] for r in sums) <= 50


def test_media(docs, rows, empty):
    found = media.media_digest(docs).collect()
    assert len(found) == len(rows)
    expected = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        raw += bytes((-len(raw)) % 64 or (64 if not raw else 0))
        expected[i, len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == expected
    assert media.media_digest(empty).count() == 0


def test_media_features_equal_plain_means(docs, rows):
    import io

    found = {(r["n_bytes"], r["payload_sha256"]): r for r in media.tiles(media.store_texts(docs)).collect()}
    for _, t, *_ in rows:
        pixels = media.payload(t)
        h, w = pixels.shape

        def means(rows_, columns, pixels=pixels, h=h, w=w):
            wide = np.repeat(np.repeat(pixels.astype(float), rows_, axis=0), columns, axis=1)
            return wide.reshape(rows_, h, columns, w).mean(axis=(1, 3))

        if h > 2000:
            continue
        got = found[len((t or "").encode()), hashlib.sha256(pixels.tobytes()).hexdigest()]
        small = np.round(means(8, 9), 6)
        bits = "".join("1" if a < b else "0" for line in small for a, b in zip(line, line[1:], strict=False))
        assert got["feature"] == f"{int(bits, 2):016x}"
        assert np.abs(np.load(io.BytesIO(bytes(got["tile"]))).astype(float) - means(16, 16)).max() <= 0.5 + 1e-6


def test_images():
    r = np.random.default_rng(1)
    grey = r.integers(0, 256, (37, 51), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(b"P2\n# note\n2 2\n255\n1 2 3 4\n") == [[1, 2], [3, 4]]).all()
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    out = media.area_resize(grey, 5, 7)
    fine = np.repeat(np.repeat(grey.astype(float), 5, axis=0), 7, axis=1).reshape(5, 37, 7, 51).mean(axis=(1, 3))
    assert np.allclose(out, fine)
    assert np.load(__import__("io").BytesIO(media.tile(grey))).shape == (16, 16)


def test_lm_scores(docs, rows, empty):
    train = docs.where(~langid.held_out("doc_id", fold=1))
    out = lmscore.score(docs, train).collect()
    token = lambda t: [*words(t), b"\n"]
    counts = Counter(w for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in token(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((sort_key(i), len(token(t)), sum(counts[w] > 0 for w in token(t)), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t)), 4)) for i, t, *_ in rows)
    assert sorted((sort_key(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == expected
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)
    assert lmscore.score(empty, empty).count() == 0
    assert all(r["n_known"] == 0 for r in lmscore.score(docs, empty).collect())


def test_lm_rare_words_take_exact_counts(docs, rows, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): r for r in lmscore.score(docs, docs).collect()}
    monkeypatch.setattr(lmscore, "frequent_words", lambda table: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    for r in lmscore.score(docs, docs).collect():
        w = whole[r["doc_id"], r["n_tokens"]]
        assert r["n_known"] == w["n_known"] and abs(r["base_score"] - w["base_score"]) < 1e-6 * abs(w["base_score"])


def test_filter_levels():
    r = np.random.default_rng(2)
    grams = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64))
    counts = r.geometric(0.02, len(grams))
    part = lmscore.build_block(grams, counts).tobytes()
    f = lmscore.Filter([([0], [len(part)], part)], 0, 1)
    own = np.zeros(5000, np.int64)
    assert (f.levels(grams, own[: len(grams)]) >= lmscore.level_of(counts)).all()
    assert (f.levels(r.integers(1 << 63, (1 << 64) - 1, 5000, dtype=np.uint64), own) > 0).mean() < 0.08


def test_lm_score_equals_plain_smoothing_and_does_not_depend_on_passes(spark):
    import random

    r = random.Random(8)
    texts = [(k, " ".join(r.choice("the of and to in is it on at by an or".split()) for _ in range(r.randrange(0, 40)))) for k in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    train = [t.split() + ["\n"] for k, t in texts[:40]]
    single = Counter(w for t in train for w in t)
    double = Counter((a, b) for t in train for a, b in zip(["\n", *t], t, strict=False))
    n, v = sum(single.values()), len(single)
    quantised = lambda c: float(lmscore.count_of(lmscore.level_of(np.array([c])))[0]) if c else 0.0

    def plain(t):
        out = 0.0
        for a, b in zip(["\n", *t.split()], [*t.split(), "\n"], strict=True):
            c, weight = single[a], lmscore.PRIOR * (single[a] + 1) ** lmscore.GROWTH
            out += math.log10((min(quantised(double[a, b]), single[a], single[b]) + weight * (single[b] + 0.5) / (n + 0.5 * (v + 1))) / (c + weight))
        return out

    whole = {x["doc_id"]: x for x in lmscore.score(table, table.where("doc_id < 40")).collect()}
    parts = {x["doc_id"]: x for x in lmscore.score(table, table.where("doc_id < 40"), pass_blocks=3).collect()}
    for k, t in texts:
        assert abs(whole[k]["score"] - parts[k]["score"]) < 1e-9 and abs(whole[k]["base_score"] - parts[k]["base_score"]) < 1e-9
        assert whole[k]["n_known"] == parts[k]["n_known"] and whole[k]["n_tokens"] == parts[k]["n_tokens"] == len(t.split()) + 1
    # a false positive of the filter raises a pair's level, about one in thirty; otherwise the two are equal
    over = [whole[k]["score"] - plain(t) for k, t in texts]
    assert min(over) > -1e-9 and sum(abs(x) < 1e-9 for x in over) >= 15
    assert sum(over) < 0.05 * sum(len(t.split()) + 1 for _, t in texts)


def test_lm_documents_are_read_as_often_at_any_number_of_blocks(spark, docs, monkeypatch):
    """A pass over the documents for some blocks each grows with the product of both."""
    kept = []
    keep = lmscore.keep
    monkeypatch.setattr(lmscore, "keep", lambda df, name: (kept.append(name), keep(df, name))[1])
    found = {}
    for most in (lmscore.BLOCK_NGRAMS, 300):
        monkeypatch.setattr(lmscore, "BLOCK_NGRAMS", most)
        kept.clear()
        out = lmscore.score(docs, docs)
        scans = out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") + len(kept)
        found[most] = scans, lmscore.count_ngrams(docs)[1], sorted((sort_key(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out.collect())
    (few, blocks, rows), (many, more_blocks, same) = found.values()
    assert (blocks, few, rows) == (8, many, same) and more_blocks > 2 * 32


def test_packed_hashes_are_as_they_were():
    r = np.random.default_rng(5)
    for size, bits in ((0, 64), (1, 64), (2, 64), (900, 64), (900, 40), (900, 9)):
        values = np.unique(r.integers(0, (1 << bits) - 1, size, dtype=np.uint64, endpoint=True))
        assert (lmscore.unpack(lmscore.pack(values)) == values).all() and len(lmscore.unpack(lmscore.pack(values))) == len(values)
    assert len(lmscore.pack(np.arange(100, dtype=np.uint64))) == 1 + 8 + 99


def brute_links(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return Counter((rows[k][0], len(sets[k]), least[comp[k]]) for k in range(len(rows)))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, docs, rows, empty, size, percent):
    found = ngramjoin.links(docs, size, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_links(rows, size, percent)
    if size == 4:
        assert ngramjoin.links(empty, size, percent).count() == 0


def test_ngram_join_of_near_copies(spark):
    import random

    r = random.Random(5)
    pool = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(60)]
    rows = []
    for g in range(12):
        base = [r.choice(pool) for _ in range(60)]
        for k in range(9):
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(60)] = r.choice(pool)
            rows.append((g * 100 + k, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((2, 80), (4, 85), (1, 80)):
        found = ngramjoin.links(table, size, percent).collect()
        assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in found) == brute_links(rows, size, percent)


def test_ngram_join_crowd_by_crowd(spark, monkeypatch):
    import random

    for name, value in (("CROWDS", (2, 5)), ("LAST_CROWD", 4), ("HOT", 3)):
        monkeypatch.setattr(ngramjoin, name, value)
    r = random.Random(7)
    pool = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    base = r.sample(pool, 40)
    rows = []
    for k in range(90):  # many around the threshold, linked in chains or not at all
        own = list(base)
        for _ in range(r.randrange(1, 9)):
            own[r.randrange(40)] = r.choice(pool)
        rows.append((k, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngramjoin.links(table, 1, 85).collect()
    expected = brute_links(rows, 1, 85)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in found) == expected
    assert 3 < len({c for _, _, c in expected})


def test_marks_of_many_slices(spark, monkeypatch):
    for name, value in (("WANTED_LOG", 12), ("MARKED_LOG", 5)):
        monkeypatch.setattr(ngramjoin, name, value)
    some = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("key"))
    marks = ngramjoin.Marks(some, some.count())
    held = spark.range(3000).select("id", marks.has(F.xxhash64("id")).alias("in")).collect()
    assert all(x["in"] for x in held if x["id"] % 7 == 0) and sum(x["in"] for x in held) < 1200


def test_bitmaps_come_in_one_job_whatever_the_partitions(spark):
    groups = spark.createDataFrame([(g, 15, [g << 30, 7 << 40], False) for g in range(9)], "grp long, n long, prefix array<long>, several boolean")
    body = spark.createDataFrame([("a b c d e f",), ("a b c d e g",)], "body string")
    some = spark.range(50).select(F.xxhash64("id").alias("key"))
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for name, make in (("marks", lambda: ngramjoin.Marks(some, 50)), ("levels", lambda: ngramjoin.frequency_levels(body, 4)), ("again", lambda: ngramjoin.prefixes_again(groups, 20))):
            spark.sparkContext.setJobGroup(name, name)
            make()
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) <= 8, name
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ngram_join_inside_groups_of_equal_prefixes(spark, monkeypatch):
    import pyarrow as pa

    levels = np.zeros(1 << (ngramjoin.CELLS_LOG - 1), np.uint8), ngramjoin.CELLS_LOG, 12  # the order of shingles is that of their hashes alone
    monkeypatch.setattr(ngramjoin, "frequency_levels", lambda body, size: levels)
    rows = []
    for g in range(12):
        vocabulary = [f"g{g}w{k}" for k in range(60)]
        key = {w: int(next(ngramjoin._ordered_sets(pa.RecordBatch.from_pydict({"body": [w]}), WordHasher(), 1, *levels[:2]))[0]) for w in vocabulary}
        low, rest = sorted(vocabulary, key=key.get)[:5], sorted(vocabulary, key=key.get)[5:]
        # 20 words each, of which 5 are the prefix: y and z link, x with neither
        texts = [low + rest[:15], low + rest[15:30], low + rest[15:29] + rest[30:31]]
        rows += [(10 * g + k, " ".join(t)) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_links(rows, 1, 80)
    assert sum(i % 10 == 2 and c == i - 1 for i, _, c in expected) == 12
    found = ngramjoin.links(table, 1, 80).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == expected


def test_one_of_each_group_stays(spark, docs):
    stay = ngramjoin.keep_one(docs)
    assert stay.columns == docs.columns
    # 1, 2, 2 and 12 go with 1 and 11; 3 has a word more than 1
    assert sorted((r["doc_id"] for r in stay.collect()), key=sort_key) == sorted([1, 4, 5, 6, 7, 8, 9, None, None, 10, 11, 2**40, 14, 15], key=sort_key)
    text = "one two three four five six seven eight nine ten"
    odd = spark.createDataFrame([(1, text), (1, "some other words that stand for themselves and no more"), (None, text), (1, text), (3, ""), (3, "")], "doc_id long, text string")
    assert sorted(r["text"] for r in ngramjoin.keep_one(odd).collect()) == sorted([text, "some other words that stand for themselves and no more", "", ""])


def brute_windows(text, items, window=13):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    own, hit, found = split(text), set(), set()
    for i, t in items:
        w = split(t)
        size = min(window, len(w))
        if size:
            for k in range(len(w) - size + 1):
                for p in range(len(own) - size + 1):
                    if own[p : p + size] == w[k : k + size]:
                        hit |= set(range(p, p + size))
                        found.add("" if i is None else str(i))
    return len(own), len(hit), sorted(found)


def test_decontamination(spark, docs, rows, empty):
    base = words(rows[0][1])
    text = " ".join(w.decode() for w in base)
    items = [(1, text[:200]), (2, "a b"), (3, None), (4, ""), (5, "the the the"), (None, "mail me at joe"), (6, "--- !!"), (1, "the " * 20), (7, "no such words anywhere in the text at all not even once I hope so")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    small = [r for r in rows if not r[1] or len(r[1]) < 5000]
    found = decontam.search(docs.where("text is null or length(text) < 5000"), bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == Counter((i, *(lambda x: (x[0], x[1], tuple(x[2])))(brute_windows(t, items))) for i, t, *_ in small)
    longest = {r["doc_id"]: {m["item"]: m for m in r["longest"]} for r in found}
    assert longest[1]["1"]["word"] == 0 and longest[1]["1"]["length"] >= 13
    clean = decontam.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and 1 not in {r["doc_id"] for r in clean.collect()}
    assert decontam.search(empty, bench).count() == 0 and decontam.search(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_finds_runs_of_repeated_words(spark):
    import random

    r = random.Random(4)
    line = lambda n, k: " ".join(r.choice("abc"[:k]) for _ in range(n))
    texts = [(k, line(r.randrange(1, 60), r.randrange(1, 4))) for k in range(40)]
    items = [(k, line(r.randrange(1, 30), r.randrange(1, 3))) for k in range(12)]
    found = decontam.search(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), window=5).collect()
    for row in found:
        own = texts[row["doc_id"]][1].split()
        assert (row["n_words"], row["n_hit"], row["items"]) == brute_windows(texts[row["doc_id"]][1], items, 5)
        best = {}
        for i, t in items:
            w = t.split()
            for q in range(len(w)):
                for p in range(len(own)):
                    n = 0
                    while q + n < len(w) and p + n < len(own) and w[q + n] == own[p + n]:
                        n += 1
                    if n >= min(5, len(w)):
                        best[str(i)] = max(best.get(str(i), (0, 0)), (n, -p))
        assert {m["item"]: (m["length"], -m["word"]) for m in row["longest"]} == best
        assert all(own[m["word"] : m["word"] + m["length"]] == items[int(m["item"])][1].split()[m["item_word"] : m["item_word"] + m["length"]] for m in row["longest"])


def test_decontamination_of_long_repeats_stays_small():
    import subprocess
    import sys

    code = """
import resource, pyarrow as pa
from tidemark.llm import decontam
from tidemark.llm.common import Memory, WordHasher
decontam._block = lambda path, window: decontam.Block(["1"], pa.array(["the " * 2000]), window, WordHasher(decontam.NOT_WORD))
shard = pa.RecordBatch.from_pydict({"c_0": [1], "body": ["the " * 100_000]})
out = decontam._scan_shard(shard, ["c_0"], ["x"], 13, WordHasher(decontam.NOT_WORD), True).to_pylist()[0]
assert out["n_hit"] == 100_000 and out["longest"] == [{"item": "1", "item_word": 0, "word": 0, "length": 2000}], out["longest"]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 1000


def test_suffix_array():
    r = np.random.default_rng(0)
    w = r.integers(1, 4, 400).astype(np.uint64)
    order = decontam.suffix_array(w, 64).tolist()
    assert order == sorted(range(400), key=lambda k: w[k : k + 64].tolist())


def brute_merge(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get((parts[k], parts[k + 1]), 1 << 30))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        pair = parts[best], parts[best + 1]
        k, out = 0, []
        while k < len(parts):
            if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                out.append(pair[0] + pair[1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out
    return parts


def test_automaton_accepts_what_merging_gives():
    import itertools

    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b"), (b"b", b"a"), (b"ab", b"ab"), (b"b", b"b"), (b"aa", b"aa"), (b"ba", b"ab")]
    labels = {0: b"a", 1: b"b"} | {2 + k: a + b for k, (a, b) in enumerate(merges)}
    ids = {}
    triples = []
    labels = {0: b"a", 1: b"b"}
    ids = {b"a": 0, b"b": 1}
    for a, b in merges:
        if a + b not in ids:
            ids[a + b] = len(labels)
            labels[ids[a + b]] = a + b
        triples.append((ids[a], ids[b], ids[a + b]))
    ranks = {m: k for k, m in reversed(list(enumerate(merges)))}
    seen = set()
    usable = [m for m in merges if not (m[0] + m[1] in seen or seen.add(m[0] + m[1]))]
    ranks = {m: k for k, m in enumerate(usable)}
    machine = bpe.Automaton(labels, [(ids[a], ids[b], ids[a + b]) for a, b in usable])
    for n in range(1, 11):
        for word in itertools.product(b"ab", repeat=n):
            word = bytes(word)
            assert [labels[t] for t in machine.encode(word)] == brute_merge(word, ranks), word


def test_automaton_of_random_merges():
    import random

    r = random.Random(12)
    for _ in range(40):
        labels, ids, triples, ranks = {k: bytes([97 + k]) for k in range(3)}, {}, [], {}
        ids = {b: k for k, b in labels.items()}
        for _ in range(r.randrange(1, 25)):
            a, b = r.choice(list(labels.values())), r.choice(list(labels.values()))
            if a + b not in ids:
                ids[a + b] = len(labels)
                labels[ids[a + b]] = a + b
                ranks[a, b] = len(triples)
                triples.append((ids[a], ids[b], ids[a + b]))
        machine = bpe.Automaton(labels, triples)
        for _ in range(200):
            word = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 14)))
            assert [labels[t] for t in machine.encode(word)] == brute_merge(word, ranks), (word, triples)


def test_bpe_equals_the_library(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = bpe.digests(docs, path).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == expected
    assert all(r["decoded"] == (r["text"] or "") for r in bpe.encode(docs, path, carry=("doc_id", "text")).collect())
    assert bpe.digests(empty, path).count() == 0


def test_language_mixtures(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(table.where(~langid.held_out("doc_id")))
    own = langid.predict(table, model, carry=("doc_id", "lang")).where(langid.held_out("doc_id")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in own) > 0.98 * len(own)
    text = {r["lang"]: r["text"] for r in table.where("length(text) > 3000").collect()}
    mixed = spark.createDataFrame([(1, text["en"][:2500] + " " + text["de"][:1000]), (2, text["fr"][:3000]), (3, "1234 !!"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(mixed, model).collect()}
    assert got[1]["lang_pred"] == "en" and 0.6 < got[1]["score"] < 0.8 and got[2]["lang_pred"] == "fr" and got[2]["score"] > 0.99
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (3, 4, 5))
    assert langid.fit_and_predict(docs).count() == docs.count() and langid.fit_and_predict(empty).count() == 0


def brute_shares(text, names, table):
    """The method as it is stated, word by word, for one text: EM over all languages, then over growing sets by BIC."""
    raw = (text or "").encode().translate(LOWER)
    for gap in b"\t\n\x0b\x0c\r":
        raw = raw.replace(bytes([gap]), b" ")
    raw += b"  "
    starts = [m.start() for m in re.finditer(rb"[^ ]+", raw)]
    ends = [*starts[1:], len(raw) - 2]
    cell = lambda k: ((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 14
    logs = [[sum(float(table[cell(k), j]) for k in range(a, z)) for j in range(len(names))] for a, z in zip(starts, ends, strict=True)]
    like = [[math.exp(max(x - max(row), -60)) for x in row] for row in logs]

    def em(share, own, steps):
        for _ in range(steps):
            sums = [0.0] * len(names)
            for row in like:
                total = sum(s * x for s, x in zip(share, row, strict=True))
                for j in own:
                    sums[j] += share[j] * row[j] / total
            share = [x / len(like) for x in sums]
        return share

    everything = list(range(len(names)))
    share = em([1 / len(names)] * len(names), everything, langid.STEPS)
    order = sorted(everything, key=lambda j: (-share[j], j))
    best, result = -math.inf, None
    for size in range(1, len(names) + 1):
        own = order[:size]
        part = [share[j] / sum(share[k] for k in own) if j in own else 0.0 for j in everything]
        if size > 1:
            part = em(part, own, langid.SET_STEPS)
        fit = sum(math.log(sum(s * x for s, x in zip(part, row, strict=True)) + 1e-300) for row in like) - 0.5 * (2 * size - 1) * math.log(len(like) + 1)
        if fit <= best + 1e-9:
            break
        best, result = fit, {names[j]: part[j] for j in own}
    return result


def test_language_shares_equal_the_plain_method_and_rows_do_not_see_each_other(spark):
    import pyarrow as pa

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").limit(60).collect()
    names, table = langid.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    short = ["no", "a", "die", "la no the", "\tno\n", "x1 y", "été", "no no"]
    texts = [r["text"][:600] for r in rows] + short + [a + " " + b["text"][:300] for a, b in zip(short, rows, strict=False)] + ["1", "", None, " "]
    whole = langid.shares_of(pa.array(texts, pa.string()), len(names), table)
    for k, t in enumerate(texts):
        alone = langid.shares_of(pa.array([t], pa.string()), len(names), table)[0]
        assert np.array_equal(alone, whole[k]), t
        if t and re.search(r"[^\W\d_]", t):
            want = brute_shares(t, names, table)
            got = {n: x for n, x in zip(names, alone.tolist(), strict=True) if x > 0}
            assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-6 for n in want), (t, got, want)
        else:
            assert not alone.any()
    table_of = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    some = [langid.predict(table_of.repartition(n), (names, table)).collect() for n in (1, 7)]
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in some[0]} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in some[1]}


def test_many_languages(spark):
    rows = [(k * 10 + j, f"w{k}a w{k}b w{k}c " * 4, f"l{k:03d}") for k in range(300) for j in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(table)
    assert len(model[0]) == 300
    mixed = spark.createDataFrame([(1, " ".join(f"w{k}a w{k}b w{k}c " * 40 for k in (5, 90, 200, 250, 299)))], "doc_id long, text string")
    got = langid.predict(mixed, model).collect()[0]
    assert len(got["languages"]) >= 4 and abs(sum(x["share"] for x in got["languages"]) - 1) < 1e-6


def test_language_stage_keeps_columns(docs):
    model = langid.learn(docs)
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def brute_pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_plain_pii_equals_the_patterns():
    import random

    r = random.Random(9)
    bits = ["a@b.c", "@", ".", "1", "25", "4111 1111 1111 1111", "192.168.0.1", "+1 ", "(415)", " ", "-", "x", "@b", "é", "256", "0", "%", "\n"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))
        spans = pii.plain_spans(t)
        assert [(k, a, b) for k, x in zip(pii.KINDS, spans, strict=True) for a, b in x] == brute_pii(t), t


def test_disguised_pii(docs, rows, empty):
    found = {r["doc_id"]: r for r in pii.span_digest(pii.find(docs.where("doc_id is not null"))).collect()}
    for i, t, *_ in rows:
        if i is not None:
            assert found[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(t)).encode()).hexdigest()
    text = next(t for i, t, *_ in rows if i == 14)
    spans = [x.split(":") for x in found[14]["spans"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "joe [at] example [dot] com"), ("email", "ｊｏｅ＠example.org"), ("phone", "plus four one five five five five zero one zero zero")]
    assert found[2**40]["n_email"] == found[2**40]["n_ip"] == found[2**40]["n_card"] == found[2**40]["n_phone"] == 1
    assert found[4]["spans"] == "" and pii.find(empty).count() == 0


def test_redaction(docs):
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs.where("doc_id > 12 or doc_id in (4, 7)")).collect()}
    assert clean[2**40] == "mail me at [EMAIL] or [PHONE], [IP] and [CARD]"
    assert clean[14] == "[EMAIL], [EMAIL], [PHONE]" and clean[4] is None and clean[7].startswith("Le café")
    assert pii.redact(docs).columns == docs.columns


def test_forms_of_disguise():
    forms = {
        "write john dot smith at example dot com now": ("email", "john dot smith at example dot com"),
        "john.smith AT example.com": ("email", "john.smith AT example.com"),
        "john_smith(at)mail(dot)example(dot)org!": ("email", "john_smith(at)mail(dot)example(dot)org"),
        "joe @ example . com, joe @ example.com": ("email", "joe @ example.com"),
        "host 192 dot 168 dot 1 dot 7": ("ip", "192 dot 168 dot 1 dot 7"),
        "host 10[.]0[.]0[.]25": ("ip", "10[.]0[.]0[.]25"),
        "card four one one one one one one one one one one one one one one one": ("card", "four one one one one one one one one one one one one one one one"),
        "card 4111\u200b1111 1111 1111": ("card", "4111\u200b1111 1111 1111"),
        "call +1 415 555 O1OO or +14l55550I00": ("phone", "+14l55550I00"),
        "jо\u0435@ex\u0430mple.com": ("email", "jо\u0435@ex\u0430mple.com"),
    }
    for text, (kind, part) in forms.items():
        found = [(k, text[a:b]) for k, x in zip(pii.KINDS, pii.disguised_spans(text, pii.plain_spans(text)), strict=True) for a, b in x]
        assert (kind, part) in found, (text, found)
        assert __import__("pyarrow.compute").compute.match_substring_regex(__import__("pyarrow").array([text]), pii.TRIGGER)[0].as_py(), text


def test_prose_is_no_disguise():
    for t in ("visit us at example.com today", "arrived at noon.Then left", "we met @ noon", "meet at noon, dot com prices", "we were at home. the dot was red", "one two three", "room one at level two dot", "naïve café"):
        assert pii.disguised_spans(t, pii.plain_spans(t)) == [[], [], [], []]


def test_generated_disguises_are_found_where_they_were_put():
    import random

    import pyarrow as pa

    r = random.Random(21)
    back = {x: c for c, x in pii.HOMOGLYPHS.items() if x.isalnum()}
    number = {d: w for w, d in reversed(list(pii.NUMBERS.items()))}
    names, hosts, prose = ["joe", "ann.lee", "m_k", "x9"], ["example.com", "mail.example.org", "a-b.net"], ["we met", "nothing here", "the end of it", "so"]

    def email():
        name, host = r.choice(names), r.choice(hosts)
        at = r.choice([" [at] ", "(at)", " {at}", "<at>", " (arroba) ", " arobase ", " @ "])
        dot = r.choice([" [dot] ", "(dot)", " dot ", " punto ", "[.]"])
        if r.random() < 0.3:
            plain = f"{name}@{host}"
            k = r.choice([k for k, c in enumerate(plain) if c in back])
            return plain[:k] + back[plain[k]] + plain[k + 1 :]
        return name + at + (host if at == " @ " else host.replace(".", dot))

    def ip():
        parts = [str(r.randrange(256)) for _ in range(4)]
        return r.choice([" dot ", "[.]", " [dot] "]).join(parts) if r.random() < 0.5 else " dot ".join(" ".join(number[d] for d in p) for p in parts)

    def phone():
        digits = "".join(r.choice("123456789") for _ in range(10))
        kind = r.randrange(3)
        return "plus " + " ".join(number[d] for d in digits) if kind == 0 else "+" + "\u200b".join(digits) if kind == 1 else "+" + "".join(chr(0xFF10 + int(d)) for d in digits)

    for _ in range(600):
        kind, made = r.choice([("email", email), ("ip", ip), ("phone", phone)])
        piece, before, after = made(), r.choice(prose) + ": ", "; " + r.choice(prose)
        text = before + piece + after
        assert pii._triggered(pa.array([text]), pii.TRIGGER)[0], text
        found = [(k, a, b) for k, x in zip(pii.KINDS, pii.disguised_spans(text, pii.plain_spans(text)), strict=True) for a, b in x]
        assert (kind, len(before), len(before) + len(piece)) in found, (text, found)


def test_transducers_keep_offsets():
    import random

    r = random.Random(2)
    bits = ["one", " two ", "dot", " at ", "@", ".", " ", "(", ")", "x", "é", "ａ", "\u200b", "7", "o", "plus ", "\xa0", "fünf", "-"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(0, 16)))
        out = pii.normalise(text)
        assert len(out.text) == len(out.start) == len(out.end)
        assert all(0 <= a < b <= len(text) for a, b in zip(out.start, out.end, strict=True))
        assert sorted(out.start) == out.start and sorted(out.end) == out.end
        kept = [k for k, (a, b) in enumerate(zip(out.start, out.end, strict=True)) if b - a == 1 and text[a] == out.text[k]]
        assert all(text[out.start[k]] == out.text[k] for k in kept)


def test_warc(spark):
    big = "<p>" + "x" * 1200
    pages = [(1, "http://a/ b", big), (2, "u", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "é\r\nx", "日本" * 400), (3, None, big)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("id", F.lit("clash")).withColumn("digest", F.lit(0))
    files = warc.write(warc.plan(table))
    found = warc.archive_digest(warc.read(spark, files)).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    expected = Counter()
    for i, _, h in pages:
        again = h == big and i != 3
        expected[i, len((h or "").encode()), sha(h), "revisit" if again else "response", 3 if again else None] += 1
    assert Counter(tuple(r) for r in found) == expected
    stored = {r["page_id"]: r for r in warc.read(spark, files).where("record_type = 'response'").collect()}
    assert bytes(stored[7]["payload"]).decode() == "日本" * 400
    for f in files:
        for fields, payload in warc.records_of(f, {"<urn:page:7>"}):
            assert fields["WARC-Record-ID"] == "<urn:page:7>" and payload.decode() == "日本" * 400
    assert warc.read(spark, warc.write(warc.plan(table.limit(0)))).count() == 0


def test_vocabulary_letters():
    names = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"]
    assert all(c in names for c in bpe.byte_letters()) and sorted(bpe.byte_letters().values()) == list(range(256))


def test_components_of_random_graphs(spark):
    import random

    r = random.Random(7)
    for nodes, n in ((300, 200), (60, 200), (2, 1)):
        edges = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)] if n > 1 else [(5, 9)]
        edges = [(a, b) for a, b in edges if a != b]
        got = {x["node"]: x["comp"] for x in ngramjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = {v: v for e in edges for v in e}
        for _ in want:
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        assert set(got) == set(want)
        for v in want:
            assert (got[v] == got[want[v]]) and len({got[u] for u in want if want[u] == want[v]}) == 1
        assert len(set(got.values())) == len(set(want.values()))
    assert ngramjoin.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_disguises_of_any_length_pass_the_gate():
    import pyarrow as pa

    for text, kind, span in [
        ("joe.bloggs at mail.example.com", "email", "joe.bloggs at mail.example.com"),
        ("joe.bloggs at example.technology", "email", "joe.bloggs at example.technology"),
        ("write to john at example\ndot com", "email", "john at example\ndot com"),
        ("john at " + "long-" * 30 + "name dot com", "email", "john at " + "long-" * 30 + "name dot com"),
        ("joe @example.com", "email", "joe @example.com"),
        ("joe@example dot\u2003com.", "email", "joe@example dot\u2003com"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("host 192.168.one.one is up", "ip", "192.168.one.one"),
        ("call plus four four 20 7946 0958", "phone", "plus four four 20 7946 0958"),
    ]:
        assert pii._triggered(pa.array([text]), pii.TRIGGER)[0], text
        found = [(k, text[a:b]) for k, x in zip(pii.KINDS, pii.disguised_spans(text, pii.plain_spans(text)), strict=True) for a, b in x]
        assert (kind, span) in found, (text, found)
    for text in ("one of two ways", "we met at noon", "chapter one, 5 pages", "look at example.com"):
        assert pii.disguised_spans(text, pii.plain_spans(text)) == [[], [], [], []], text


LONG = 1000


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("joe.bloggs" + "a" * LONG + " at example.com", "email", None),
        ("joe" + "b" * LONG + " at" + " " * LONG + "example" + " " * LONG + "dot com", "email", None),
        ("x" * LONG + "_1" + "y" * LONG + " " * LONG + "at " + "host-" * LONG + "s.example.com", "email", None),
        ("joe" + " " * LONG + "(" + " " * LONG + "at" + " " * LONG + ")" + " " * LONG + "example.com", "email", None),
        ("joe" + " " * LONG + "@" + " " * LONG + "example.com", "email", None),
        ("192" + " " * LONG + "dot" + " " * LONG + "168 dot one dot" + " " * LONG + "one", "ip", None),
        ("10.0.0 (dot" + " " * LONG + ")" + " " * LONG + "seven", "ip", None),
        ("+" + " " * LONG + "four" + " " * LONG + "four" + " " * LONG + "20 7946 0958", "phone", None),
        ("plus" + " " * LONG + "four four" + "-" * LONG + " 20 7946 0958", "phone", None),
        ("+44 20 7946 095" + " " * LONG + "eight", "phone", None),
    ],
)
def test_disguises_of_a_thousand_characters(text, kind, span):
    import pyarrow as pa

    assert pii._triggered(pa.array([text]), pii.TRIGGER)[0]
    short = re.sub(r" {9,}", " ", re.sub(r"(.)\1{20,}", r"\1", text.replace("host-" * LONG, "host-")))
    spans = lambda t: [(k, t[a:b]) for k, x in zip(pii.KINDS, pii.disguised_spans(t, pii.plain_spans(t)), strict=True) for a, b in x]
    found, like = spans(text), spans(short)
    assert [k for k, _ in found] == [k for k, _ in like]
    assert kind in [k for k, _ in found] or kind == "phone", (short, like)
    if kind == "email":
        assert found[0][1].startswith(text[:3]) and found[0][1].endswith("com")


def test_looking_back_takes_linear_time():
    import time

    t = time.time()
    pii.normalise(("one" + " " * 500) * 400 + ("a" * 500 + " at x. ") * 400)
    assert time.time() - t < 5


def test_only_shingles_of_several_groups_are_shuffled(spark):
    """Of ten groups of 500 prefix shingles, two share one: its postings are found, and few others."""
    r = np.random.Generator(np.random.PCG64(5))
    prefixes = r.integers(0, 1 << 62, (10, 500)).tolist()
    prefixes[7][3] = prefixes[2][9]
    groups = spark.createDataFrame([(g, 2500, p, g == 4) for g, p in enumerate(prefixes)], "grp long, n long, prefix array<long>, several boolean").repartition(3)
    found = {(x["token"], x["grp"], x["pos"]) for x in ngramjoin.prefixes_again(groups, 5000).collect()}
    assert {(prefixes[2][9], 2, 9), (prefixes[2][9], 7, 3), (prefixes[4][0], 4, 0)} <= found
    assert len(found) < 20
    assert ngramjoin.prefixes_again(groups.limit(0), 0).count() == 0


def test_memory_keeps_what_is_used():
    memory = Memory(4)
    memory.put("often", b"1")
    for k in range(20):
        assert memory.get("often") == b"1"
        memory.put(str(k), b"2")
    assert len(memory.young) + len(memory.old) <= 4
    assert memory.missing({"often", "new"}) == ["new"]
    assert memory.young["often"] == b"1"


def test_words_are_encoded_once_whatever_stands_behind_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), seekstore.ChunkTokenizer(path)
    texts = ["Reoned,*** don't I'LL É'x straße STRASSE Ünïte étude café!? <|endoftext|>foo bar<|startoftext|>, a<|endoftext|>b 12ab, 'tis word'' (word) µm ªb ×a ﬁ ,,,, ...", "", " ", "a" * 100 + ",", "Σας ß."]
    assert [list(memoryview(x).cast("I")) for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    asked, joined = [], own._joined
    own._joined = lambda words: (asked.extend(words), joined(words))[1]
    own.encode(["qwoned qwoned, Qwoned. QWONED!"])
    assert asked.count("qwoned") == 1


def test_prefix_shingles_need_one_worker_a_task(spark):
    """Rows of marked groups are left out in the function that looks at the shingles: no second function runs beside it, and groups of several rows stand once."""
    prefix = [[10 * g + k for k in range(3)] for g in range(6)]
    rows = [(100 * g + c, g, 15, [p << 30 for p in prefix[g]]) for g in range(6) for c in range(1 + (g == 2))] + [(900, 6, 15, [prefix[0][1] << 30, 7 << 40])]
    full = spark.createDataFrame(rows, "node long, grp long, n long, prefix array<long>")
    groups, repeated, marks = ngramjoin.prefix_groups(full)
    found = ngramjoin.prefixes_again(groups, 20, marks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert [tuple(r) for r in repeated.select("grp", "several").collect()] == [(2, True)]
    kept = [(r["token"], r["grp"], r["pos"], r["several"]) for r in found.collect()]
    assert len(kept) == len(set(kept))
    assert {(prefix[0][1] << 30, 0, 1, False), (prefix[0][1] << 30, 6, 0, False), (prefix[2][0] << 30, 2, 0, True)} <= set(kept)


def test_a_worker_keeps_the_tables_of_one_operator(tmp_path):
    from tidemark.llm import common

    loads = []
    first, second = (common.worker_tables(2)(lambda path, k=k: loads.append((k, path)) or path) for k in "ab")
    for table in (first, second, first):
        common.only_for(table)
        assert table("x") == table("x") == "x"
    assert loads == [("a", "x"), ("b", "x"), ("a", "x")]
    common.only_for()
    assert not first.cache_info().currsize
    for table in (first, second):
        common._TABLES.remove(table)


def test_texts_go_to_workers_in_small_batches(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows, then in (("10000", "1500"), ("0", "1500"), ("700", "700")):
            spark.conf.set(name, rows)
            decontam.remove_contaminated(docs, spark.createDataFrame([("1", "a b c")], "item_id string, text string"))
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)


def test_chunks_of_long_ago_are_still_known():
    own = seekstore.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(350_000):
        own.known.put(str(k), b"")
    assert not own.known.missing({"0", "1000"})


def test_units_of_one_piece_are_remembered_once_and_longer(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, asked = bpe.Vocabulary(path), []
    merge = own.automaton.encode
    own.automaton.encode = lambda word: (asked.append(word), merge(word))[1]
    text = " ".join(f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(140_000))
    assert own.encode(text) == own.encode(text)
    assert len(asked) == 140_000
    monkeypatch.setattr(bpe, "KNOWN", 4)
    library, small = Tokenizer.from_file(path), bpe.Vocabulary(path)
    for t in (text[:3000] + text[:3000], "it's  'so'  !!'s\n\n x'll 12ab,  " * 3 + "y" * 100, "", "   "):
        assert np.frombuffer(small.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(small.known.young) + len(small.known.old) <= 8
