"""The pipeline's stages against plain versions of each, one after the other, on small tables."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import pii

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain_near_duplicates(rows, size=5, percent=80):
    """The ids that stay: of each group of linked texts the smallest, and all without words."""
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().translate(LOWER).split()
        sets[r["doc_id"]] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids, lead = sorted(sets), {i: i for i in sets}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    return {i for i in ids if root(i) == i}


def plain_contamination(rows, items, window=13):
    """The ids of documents of whose words at least one in twenty lies in a window of an item."""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    wanted = {}
    for t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(n, set()).add(tuple(w[k : k + n]))
    out = set()
    for r in rows:
        w, hit = split(r["text"]), set()
        for n, grams in wanted.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(r["doc_id"])
    return out


def plain_redaction(text):
    if text is None:
        return None
    base = pii.plain_spans(text)
    spans = sorted((a, -b, k) for found in (base, pii.disguised_spans(text, base)) for k, x in enumerate(found) for a, b in x)
    out, at, open_ = [], 0, None
    for a, b, k in spans:
        if open_ and a < open_[1]:
            open_[1] = max(open_[1], -b)
            continue
        if open_:
            out += [text[at : open_[0]], f"[{pii.KINDS[open_[2]].upper()}]"]
            at = open_[1]
        open_ = [a, -b, k]
    if open_:
        out += [text[at : open_[0]], f"[{pii.KINDS[open_[2]].upper()}]"]
        at = open_[1]
    return "".join([*out, text[at:]])


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = stage(spark, docs, sf)
        if name == "language ID":
            expected = {i: t for i, t in expected.items() if t and re.search(r"[^\W\d_]", t)}
        elif name == "n-gram Jaccard join":
            stay = plain_near_duplicates(rows)
            expected = {i: t for i, t in expected.items() if i in stay}
        elif name == "benchmark decontamination":
            gone = plain_contamination(rows, items)
            assert gone
            expected = {i: t for i, t in expected.items() if i not in gone}
        elif name == "PII":
            expected = {i: plain_redaction(t) for i, t in expected.items()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == expected, name
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in expected.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()} == {
        i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids.items()
    }


def test_run_equals_the_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(corpus_pipeline.run(spark, sf)) == plain(docs)


def test_language_stage_writes_what_it_predicts(spark):
    from tidemark.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    guessed = {r["doc_id"]: r["lang_pred"] for r in langid.fit_and_predict(docs).collect()}
    known = {i: x for i, x in guessed.items() if x != "und"}
    assert {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == known
    labels = {r["doc_id"]: r["lang"] for r in docs.where("lang is not null").collect()}
    right = [known[i] == labels[i] for i in known if i in labels]
    assert sum(right) > 0.9 * len(right) and len(set(known.values())) == len(set(labels.values()))


def brute_stage(name, rows, items):
    if name == "language ID":
        return {i for i, t in rows if t and re.search(r"[^\W\d_]", t)}
    if name == "n-gram Jaccard join":
        return plain_near_duplicates([{"doc_id": i, "text": t} for i, t in rows])
    if name == "benchmark decontamination":
        return {i for i, _ in rows} - plain_contamination([{"doc_id": i, "text": t} for i, t in rows], items)
    return {i for i, _ in rows}


def test_stages_with_nulls_clashing_names_and_without_rows(spark, docs):
    sf = "/root/testdata/sf0.001"
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in named.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, named, sf)
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == brute_stage(name, rows, items), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == named.columns, name
            same = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
            assert all(t == same[i] for i, t in rows if i in same) or name == "PII", name


def test_redaction_without_a_length_column(spark, docs):
    out = corpus_pipeline.redact_personal_data(spark, docs.select("doc_id", "text"), "")
    assert out.columns == ["doc_id", "text"] and out.count() == docs.count()
