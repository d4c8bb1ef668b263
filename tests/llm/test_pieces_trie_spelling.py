"""Operators 11 to 13 against the library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import pieces, prefixtrie, queries, spelling

MODEL = public_tokenizers.path("piece_bpe_32k.model")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def test_pieces_equal_the_library(docs, rows, empty, library):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(docs, MODEL).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or ""), library.eos_id()]
        expected[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert got == expected
    full = pieces.encode(docs, MODEL, carry=("doc_id", "lang")).collect()
    assert Counter(r["decoded"] for r in full) == Counter(t or "" for _, t, *_ in rows)
    assert pieces.digests(empty, MODEL).count() == 0


def test_random_texts_equal_the_library(library, model):
    r = random.Random(11)
    names = list(model.ids)
    letters = ["a", "e", "t", "h", "n", " ", "  ", "▁", "\n", "\t", "é", "日", "Ⅳ", "ﷺ", "ing", "x" * 9]
    texts = ["".join(r.choice(names).replace("▁", " ") for _ in range(r.randrange(1, 8))) for _ in range(3000)]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    texts += [" ", "\n", " " * 500, "x" * 20_000, "a " * 2000 + "b", "<s></s><0x41>", "x\x00y"]
    for t in texts:
        ids = [*library.encode(t), library.eos_id()]
        assert np.frombuffer(model.encode(t), "<u4").tolist() == ids, t
        assert model.decode(model.encode(t)) == library.decode(ids), t


def test_decoding_of_any_ids_equals_the_library(library, model):
    r = random.Random(12)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, 259, 28705, r.randrange(3, 259), r.randrange(3, 32_000)]) for _ in range(r.randrange(1, 9))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_tokens_go_together_as_merging_leaves_them(model):
    r = random.Random(13)
    tokens = [t for t in model.matches.values() if t.work_out(model.ranks)]
    blanks = [t for t in tokens if set(t.text) == {"▁"}]
    for k in range(20_000):
        a, b = r.choice(blanks if k % 10 == 0 else tokens), r.choice(blanks if k % 15 == 0 else tokens)
        assert model.go_together(a, b) == (pieces.merged(a.text + b.text, model.ranks) == [a.text, b.text])


def test_remembered_units_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "JUDGED", 5)
    small = pieces.Pieces(MODEL)
    for t in ["the cat sat on the mat and the dog", "one two three four five one two"] * 3:
        assert np.frombuffer(small.encode(t), "<u4").tolist() == [*library.encode(t), 2]


def trie_of(rows):
    own = defaultdict(list)
    for c, t, role, x in rows:
        if c is not None:
            role, x = role or "", x or ""
            own[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{x}".encode()).digest(), x))
    own = {c: [(v[2], v[4]) for v in sorted(turns)] for c, turns in own.items()}
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members, below = defaultdict(list), defaultdict(list)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        ends = ",".join(str(c) for c in sorted(m) if len(path[c]) == len(p))
        leaves = sum(out[x][5] for x in below[p]) or 1
        saved = sum(out[x][6] for x in below[p]) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
        out[p] = (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def nodes_of(df):
    found = prefixtrie.trie(df)
    assert {f.dataType.simpleString() for f in found.schema.fields if f.name != "ends_sha256"} == {"bigint"}
    return sorted(tuple(r) for r in found.select(*NODE).collect())


def talk(seed):
    r = random.Random(seed)
    rows = []
    for c in [0, 1, 2, 3, 5, 100, 101, 107, 150, 203, 204, -1, -100, -150, 9000, 9001, 9002]:
        rows += [(c, r.choice([None, t, t, t]), r.choice(["u", "a", None]), r.choice(["x", "y", None, "é😀"])) for t in range(r.randrange(0, 9))]
    rows += [(c, t, "u", "same" if t < 37 or c % 3 else f"other {c}") for c in range(300, 312) for t in range(40)]
    return rows + rows[:5] + [(None, 1, "u", "in no conversation")]


def test_trie(spark):
    rows = talk(1)
    r = random.Random(2)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    for c in ("conv", "depth", "pos", "key", "size", "block", "node", "class", "rep", "n"):
        df = df.withColumn(c, F.lit("clash"))
    assert nodes_of(df) == trie_of(rows)


def test_trie_in_blocks_and_narrow_passes(spark, monkeypatch):
    for name, value in (("WIDEST", 2), ("BLOCK", 3), ("LISTED", 2)):
        monkeypatch.setattr(prefixtrie, name, value)
    rows = talk(3)
    assert nodes_of(spark.createDataFrame(rows, TURNS).repartition(7)) == trie_of(rows)


def test_trie_of_nothing_and_of_conversations_without_turns(spark):
    assert nodes_of(spark.createDataFrame([], TURNS)) == []
    short = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(short, 0, "u", "gone with its head"), (short + 7 * 100, 0, "u", "x")]
    assert nodes_of(spark.createDataFrame(rows, TURNS)) == trie_of(rows)
    assert nodes_of(spark.createDataFrame(rows[:1], TURNS))[0][:7] == (short, 0, None, 1, 0, 1, 0)


def variants_of(rows):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(small)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = sorted(w for w in n if n[w] >= 3 and len(w) >= 5)

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b))) and len(b) == len(a) + 1

    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w in words:
        if around[w]:
            best = min(around[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return out


def misspelt(seed, count=160):
    r = random.Random(seed)
    letters = "abcdeéÀ"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(5, 9))) for _ in range(12)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(r.randrange(1, 30)):
            w = base[int(len(base) * r.random() ** 2)]
            if r.random() < 0.5:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÉ") + w[k:], w[:k] + r.choice("ab") + w[k + 1 :]])
            words.append(r.choice([w, w.upper(), w.title()]))
        rows.append((r.choice([i, i, i, None]), r.choice([" ", ", ", "1", "\n"]).join(words)))
    return [*rows, *rows[:9], (1, None), (2, ""), (3, " - "), (4, "abcde " * 5000), (5, "Zabcde" * 2000)]


@pytest.mark.parametrize("crowded", [2000, 3])
def test_variants(spark, monkeypatch, crowded):
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    rows = misspelt(crowded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "body", "word", "n", "mask", "size", "form", "root"):
        df = df.withColumn(c, F.lit(7))
    found = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n")
    expected = variants_of(rows)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert sum(x[4] for x in expected) > 100 and any(x[1] and x[2] != x[1] for x in expected)


def test_tables_of_words_are_not_broadcast(spark, monkeypatch):
    """They go through the driver otherwise: Spark sizes them by their packed files, and not by what the bands make of them."""
    plans = []
    keep = spelling.keep
    monkeypatch.setattr(spelling, "keep", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1])
    text = " ".join(f"{a}{b}{c}sting" for a in "bdfg" for b in "aeio" for c in ("", "x"))
    df = spark.createDataFrame([(k, f"{text} casting" if k else f"{text} " * 9) for k in range(4)], "doc_id long, text string")
    out = spelling.variants(df)
    plans.append(("whole", out._jdf.queryExecution().executedPlan().toString()))
    assert {name for name, _ in plans} == {"words", "near", "forms", "roots", "whole"}
    crowded = lambda line: "shorter#" in line and "band#" not in line  # noqa: E731  few rows whatever the words are
    assert not [line for _, plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and not crowded(line)]
    assert [name for name, plan in plans if "SortMergeJoin" in plan].count("roots") and out.count()


def test_counts_handed_on_in_parts_and_long_texts(spark, monkeypatch):
    rows = misspelt(9, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, spelling.word_counts(df).collect()))
    monkeypatch.setattr(spelling, "COUNTED", 5)
    monkeypatch.setattr(spelling, "LISTED", 10)
    assert sorted(map(tuple, spelling.word_counts(df).collect())) == whole
    assert spelling.variants(df.limit(0)).count() == 0


@pytest.mark.parametrize(("word", "other"), [("abcde", "abcdé"), ("abcde", "abde"), ("aabbc", "abbc"), ("àéîõü", "àéîõüý"), ("zzzzz", "zzzzzz")])
def test_one_edit_flips_two_bits_at_most(spark, word, other):
    a, b = spark.createDataFrame([(word,), (other,)], "w string").select(spelling.mask(F.col("w")).alias("m")).collect()
    differ = a["m"] ^ b["m"]
    assert bin(differ).count("1") <= 2 and any(differ & spelling._band(k) == 0 for k in range(spelling.BANDS))


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_spelling_variants"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    theirs = con.sql(queries.ORACLE_SQL[name])
    assert sorted(theirs.columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*theirs.columns).collect()))) == sorted(map(str, theirs.fetchall()))
