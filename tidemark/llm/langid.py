"""Language identification by multilingual mixture inference.

Every language has a smoothed distribution over byte trigrams. A document is a mixture: each of its words comes from
one language, with the likelihood of its trigrams, and expectation-maximisation estimates the languages' shares. The
language set grows by the languages with the largest shares as long as the penalised likelihood (a BIC term for each
language) improves. Learning is one small aggregation; the model has a fixed size for each language. Prediction moves
no rows, and a row's result depends on its own text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tidemark.llm.common import WHITE, batches_of, only_for, small_batches, text_buffers

#: Trigrams are hashed to so many cells.
CELLS = 1 << 18
#: Labelled documents of each language that the model is fitted on, about; chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Bytes of text handled together, and words whose likelihoods are looked up together.
CHUNK, PIECE = 2 << 20, 1 << 16
#: Steps of expectation-maximisation over all languages, and over each set of languages.
STEPS, SET_STEPS = 8, 3
#: Added to every cell's count, and to every share.
SMOOTH, LEAST_SHARE = 0.05, 1e-12
UNKNOWN = "und"

_GAP = np.zeros(256, bool)
_GAP[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[list(WHITE)] = 32


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with two spaces after each, so that no trigram at a byte of a text reaches the next one; and their starts."""
    n = len(offsets) - 1
    begin = offsets + 2 * np.arange(n + 1)
    out = np.full(int(begin[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(2 * np.arange(n), np.diff(offsets))] = data
    return out, begin


def cells_of(data: np.ndarray) -> np.ndarray:
    """The cell of the trigram at each byte; beyond the end there are spaces."""
    b = np.concatenate((_LOWER[data], np.full(2, 32, np.uint32)))
    gram = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return (gram * np.uint32(0x9E3779B1)) >> np.uint32(14)


def learn(documents: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Fits the trigram distributions on rows with text and language, about train_rows of each language.

    Returns the languages, in order, and an array of log probabilities, cells by languages: 1 MB for each language, of
    which only the cells that occur are sent. Nulls are left out; without any labelled row there are no languages.
    """
    labelled = documents.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body")).where("lang is not null and body is not null")
    seen = labelled.groupBy("lang").count()
    sample = labelled.join(F.broadcast(seen), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(float(train_rows)) / F.col("count")) * (1 << 20)).select("lang", "body")

    def count(batches):
        only_for()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in batches_of(batch, "body", CHUNK):
                data, begin = apart(*text_buffers(part.column("body")))
                cells, names = cells_of(data), np.array(part.column("lang").to_pylist(), object)
                inside = np.ones(len(data), bool)  # not the spaces between
                inside[begin[1:] - 1] = inside[begin[1:] - 2] = False
                which, code = np.unique(names.astype(str), return_inverse=True)
                of = np.repeat(code, np.diff(begin))
                for k, name in enumerate(which.tolist()):
                    sums[name] = sums.get(name, 0) + np.bincount(cells[inside & (of == k)], minlength=CELLS)
        for name, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at].astype(np.int64))], names=["lang", "cell", "n"])

    totals = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # one row for each language: its cells and their counts
    rows = totals.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts"))
    names, columns = [], []
    for r in rows.toLocalIterator():
        own = np.full(CELLS, SMOOTH)
        own[r["cells"]] += r["counts"]
        names.append(r["lang"])
        columns.append(np.log(own / own.sum()).astype(np.float32))
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], np.stack([columns[k] for k in order], axis=1) if order else np.zeros((CELLS, 0), np.float32)


def _mixture(likelihood: np.ndarray, rows: np.ndarray, share: np.ndarray, steps: int) -> np.ndarray:
    """Expectation-maximisation of the shares of each document (rows: first word of each, all with words)."""
    count = np.diff(np.append(rows, len(likelihood)))
    for _ in range(steps):
        mixed = likelihood * np.repeat(share, count, axis=0)
        mixed /= mixed.sum(axis=1, keepdims=True)
        share = np.add.reduceat(mixed, rows, axis=0) / count[:, None] + LEAST_SHARE
    return share / share.sum(axis=1, keepdims=True)


def infer(likelihoods: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The shares of all languages in each document, 0 for those out of its set.

    likelihoods: log likelihood of each word under each language; rows: index of each document's first word. The sets
    tried are those of the languages with the largest shares, from one on for as long as one more improves the fit: it
    costs half the log of the number of words for each parameter, a share and the language itself. Ties go to the
    language that comes first. A document's shares do not depend on the others.
    """
    n_lang = likelihoods.shape[1]
    top = likelihoods.max(axis=1, keepdims=True)
    likelihood = np.exp(np.maximum(likelihoods - top, -60))
    count = np.diff(np.append(rows, len(likelihood)))
    share = _mixture(likelihood, rows, np.full((len(rows), n_lang), 1 / n_lang), STEPS)
    place = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best, out = np.full(len(rows), -np.inf), np.zeros((len(rows), n_lang))
    live = np.arange(len(rows))
    for size in range(1, n_lang + 1):
        words = np.concatenate([np.arange(rows[r], rows[r] + count[r]) for r in live]) if len(live) < len(rows) else slice(None)
        own, many = likelihood[words], count[live]
        first = np.cumsum(many) - many
        inside = np.where(place[live] < size, share[live], 0.0) + 1e-30
        inside /= inside.sum(axis=1, keepdims=True)
        if size > 1:
            inside = np.where(place[live] < size, _mixture(own, first, inside, SET_STEPS), 0.0) + 1e-30
            inside /= inside.sum(axis=1, keepdims=True)
        fit = np.add.reduceat(np.log((own * np.repeat(inside, many, axis=0)).sum(axis=1) + 1e-300), first) - 0.5 * (2 * size - 1) * np.log(many + 1)
        better = fit > best[live] + 1e-9
        live = live[better]
        if not len(live):
            break
        best[live] = fit[better]
        out[live] = np.where(place[live] < size, inside[better], 0.0)
    return out


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry's columns; lang_pred; score, the main language's share; and languages, the set that the text mixes, each
    with its share, the largest first. By the row's own whole text alone: neighbours and partitions change nothing.

    Null texts, texts without a letter, and all texts when no language was learned get 'und', 0 and an empty set. Very
    long texts are read whole. Only carry and the text are read, so other columns cannot clash; a carried column of the
    same name as a result stands beside it.
    """
    _, out = positional(documents, model, text_col, carry)
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score", "languages")


def positional(documents: DataFrame, model: tuple[list[str], np.ndarray], text_col: str, carry: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """predict() with carry's columns named c_0, c_1 and so on."""
    small_batches(documents.sparkSession)
    names, table = model
    shared = documents.sparkSession.sparkContext.broadcast(table)
    fields = documents.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("body"))
    held = [f"c_{i}" for i in range(len(carry))]
    pair = StructType([StructField("lang", StringType()), StructField("share", DoubleType())])
    schema = StructType([*(f for f in fields.schema.fields if f.name != "body"), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", ArrayType(pair))])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def guess(batches):
        only_for()
        for batch in batches:
            for part in batches_of(batch, "body", CHUNK * 4 // max(4, len(names))):
                shares = shares_of(part.column("body"), len(names), shared.value)
                order = np.argsort(-shares, axis=1, kind="stable")
                mixed = [[{"lang": names[k], "share": float(x[k])} for k in o if x[k] > 0] for x, o in zip(shares, order.tolist(), strict=True)]
                langs = [m[0]["lang"] if m else UNKNOWN for m in mixed]
                scores = [m[0]["share"] if m else 0.0 for m in mixed]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in held), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, kind)], names=[*held, "lang_pred", "score", "languages"])

    return held, fields.mapInArrow(guess, schema)


def shares_of(texts: pa.Array, n_lang: int, table: np.ndarray) -> np.ndarray:
    """The languages' shares in each text; none where there is no letter."""
    out = np.zeros((len(texts), n_lang))
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not n_lang or not lettered.any():
        return out
    data, begin = apart(*text_buffers(texts))
    full = ~_GAP[data]
    starts = full.copy()
    starts[1:] &= ~full[:-1]
    starts = np.flatnonzero(starts)
    first = np.searchsorted(starts, begin)
    # a word goes up to the next one's start or its text's end
    ends = np.minimum(np.append(starts[1:], len(data)), np.repeat(begin[1:] - 2, np.diff(first)))
    likelihoods = np.empty((len(starts), n_lang))
    for at in range(0, len(starts), PIECE):  # words are scored in pieces, to keep the gathered table rows small
        own = np.stack((starts[at : at + PIECE], ends[at : at + PIECE]), axis=1).reshape(-1)
        cells = cells_of(data[own[0] : own[-1] + 2])
        likelihoods[at : at + PIECE] = np.add.reduceat(table[cells].astype(np.float64), own - own[0], axis=0)[::2]
    some = np.flatnonzero(lettered & (np.diff(first) > 0))
    size = np.diff(first)[some]
    chosen = np.concatenate([np.arange(first[r], first[r + 1]) for r in some]) if len(some) < len(first) - 1 else slice(None)
    out[some] = infer(likelihoods[chosen], np.cumsum(size) - size)
    return out


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    """Whether the row is in the fold that is kept from learning: by the crc32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit_and_predict(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Learns outside the held-out fold and predicts every row."""
    model = learn(documents.where(~held_out(id_col)), lang_col, text_col, id_col)
    return predict(documents, model, text_col, carry or (id_col,))


def keep_known(documents: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is found, all columns as they are, but lang_col is the language found. No name can clash."""
    held, found = positional(documents, model, text_col, tuple(documents.columns))
    known = found.where(F.col("lang_pred") != UNKNOWN)
    return known.select(*[(F.col("lang_pred") if c == lang_col else F.col(h)).alias(c) for h, c in zip(held, documents.columns, strict=True)])
