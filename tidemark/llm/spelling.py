"""Spelling variants of a corpus' words: each word's commoner near word, by bands of letter-parity masks.

A word's mask has a bit for every letter class, set if the word holds an odd number of such letters. Inserting or
deleting a letter flips one bit and replacing one flips two or none, so of three bands of the bits one at least is
equal in two near words. Bands alone are shared by too many words of a large corpus, so equal bands join only where a
half is shared as well: one edit leaves the first half of the shorter word or the rest as it is. Where one half is
shared by many, a quarter of the letters more must be. The lengths are part of the key, the whole masks are compared in
the join, and what is left is verified by edit distance. A pair is made once: by the first band and the first part
that its words share.

Forms are followed to their roots by doubling: a form occurs twice as often as its word, so chains are short.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, keep

#: Letters of words: these are all ranges of the pattern.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bits of a mask and bands of them: bit k belongs to band k % BANDS.
BITS, BANDS = 60, 3
#: One occurrence in so many, by its document's and its own letters, loses a letter.
DAMAGED = 97
LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 5, 3, 2
#: Words that a task counts before it hands them on; bytes of text whose words are listed at once.
COUNTED, LISTED = 200_000, 1 << 20
#: Words that share one half, from which number on they meet by three quarters of their letters instead.
CROWDED = 2000
#: Joins of tables of words. Spark sizes them by their packed files and does not count what an explode adds, so it would take
#: some for small enough to be broadcast through the driver. Only the crowded halves are left to it: a row for 500 words at most.
SHUFFLED = "merge"


def _counts(doc_id: object, text: str) -> Counter:
    """Words of a text after the damage, with their occurrences."""
    low = text.encode("utf-8").translate(LOWER).decode("utf-8")
    runs = Counter(RUN.findall(low)) if len(low) <= LISTED else Counter(m.group() for m in RUN.finditer(low))
    name = "" if doc_id is None else str(doc_id)
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % DAMAGED == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of the words with enough letters and occurrences over all documents.

    Words are maximal runs of letters in A-Z, a-z and U+00C0 to U+00FF, A-Z made small. An occurrence whose
    crc32("<doc_id>:<word>") the number 97 divides loses the letter at that number modulo its length. A null text has no
    words; a null id counts as an empty one. Rows that repeat count again. Other columns are not read.
    """
    fields = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))

    def count(batches):
        held: Counter = Counter()

        def out():
            words = [w for w in held if len(w) >= LEAST_LETTERS]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("body"), strict=True):
                if text.is_valid:
                    held.update(_counts(doc_id.as_py(), text.as_py()))
                    if len(held) > COUNTED:
                        yield out()
                        held.clear()
        if held:
            yield out()

    counted = fields.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def mask(word: Column) -> Column:
    """The parities of a word's letter classes: a to z have bits of their own, other letters share the rest."""
    bit = lambda c: F.when((c >= 97) & (c <= 122), c - 97).otherwise(26 + c % (BITS - 26))
    flip = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.ascii(c)).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(flip(c))))


def _band(k: int) -> int:
    return sum(1 << b for b in range(k, BITS, BANDS))


def _parts(word: Column, size: Column, shorter: Column) -> list[Column]:
    """The letters by which a word meets near ones, when the shorter of both has so many: the first half, the rest, and
    for crowded ones each of these with the first or the last part of the other."""
    half = F.floor(shorter / 2).cast("int")
    rest = shorter - half
    quarter, fourth = F.floor(half / 2).cast("int"), F.floor(rest / 2).cast("int")
    first, last = lambda k: F.substring(word, F.lit(1), k), lambda k: F.substring(word, size - k + 1, k)
    both = lambda a, z: F.concat(first(a), F.lit("|"), last(z))
    return [first(half), last(rest), first(half + fourth), both(half, rest - fourth), both(quarter, rest), last(rest + half - quarter)]


def _numbered(parts: list[Column], *which: int) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("part"), parts[k].alias("letters")) for k in which])


KEY = ("shorter", "part", "letters", "band", "bits")


def _placed(words: DataFrame) -> DataFrame:
    """A row of each word (word, n, size, mask) for each shorter length that a near pair of it can have, part and band."""
    either = words.withColumn("shorter", F.explode(F.array(F.col("size"), F.col("size") - 1))).where(F.col("shorter") >= LEAST_LETTERS)
    parts = _parts(F.col("word"), F.col("size"), F.col("shorter"))
    halves = either.withColumn("p", F.explode(_numbered(parts, 0, 1))).select("word", "n", "size", "mask", "shorter", "p.*")
    key = ["shorter", "part", "letters"]
    crowded = halves.groupBy(*key).count().where(F.col("count") > CROWDED).select(*key, F.lit(True).alias("crowded"))
    finer = F.when(F.col("part") == 0, _numbered(parts, 2, 3)).otherwise(_numbered(parts, 4, 5))
    whole = F.array(F.struct("part", "letters"))
    placed = halves.join(crowded, key, "left").withColumn("p", F.explode(F.when(F.col("crowded"), finer).otherwise(whole))).select("word", "n", "size", "mask", "shorter", "p.*")
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.col("mask").bitwiseAND(F.lit(_band(k))).alias("bits")) for k in range(BANDS)])
    return placed.withColumn("b", F.explode(bands)).select("word", "n", "size", "mask", "shorter", "part", "letters", "b.*")


def near_words(counts: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of all pairs of words (word, n) that differ by one inserted, deleted or replaced letter, each once."""
    words = counts.withColumn("size", F.char_length("word")).withColumn("mask", mask(F.col("word")))
    placed = _placed(words)
    side = lambda x: placed.select(*KEY, *[F.col(c).alias(f"{c}_{x}") for c in ("word", "n", "size", "mask")])
    differ = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    flipped = F.bit_count(differ)
    fit = F.when(F.col("size_b") == F.col("shorter"), (F.col("word_a") < F.col("word_b")) & flipped.isin(0, 2)).otherwise(flipped == 1)
    for k in range(BANDS - 1):  # an earlier band that is equal makes the pair
        fit &= (F.col("band") <= k) | (differ.bitwiseAND(F.lit(_band(k))) != 0)
    met = side("a").where("size_a = shorter").join(side("b").hint(SHUFFLED), list(KEY)).where(fit)
    a, b = (_parts(F.col(f"word_{x}"), F.col(f"size_{x}"), F.col("shorter")) for x in "ab")
    later = F.col("part").isin(1, 4, 5) & (a[0] == b[0]) | (F.col("part") == 3) & (a[2] == b[2]) | (F.col("part") == 5) & (a[4] == b[4])
    near = met.where(F.levenshtein("word_a", "word_b", 1) == 1).where(~later)
    return near.select(F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form."""
    up = keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("more")), "roots")
    while up.where("more").limit(1).count():
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("more").alias("next_more"))
        last = up
        up = keep(up.join(over.hint(SHUFFLED), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.coalesce("next_more", F.lit(False)).alias("more")), "roots")
        drop(last)
    return up.select("word", "root")


def variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that word_counts gives.

    n_near counts the words that differ from it by one letter inserted, deleted or replaced. form is that of them with
    the most occurrences (of several the first in code-point order), NULL unless it occurs twice as often at least; root
    is where forms lead, the word itself without one. An empty table has no words. Nulls: see word_counts.
    """
    counts = keep(word_counts(documents, id_col, text_col), "words")
    pairs = keep(near_words(counts), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= FORM_TIMES * F.col("n")
    found = counts.join(best.hint(SHUFFLED), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    found = keep(found, "forms")
    drop(counts, pairs)
    roots = _roots(found.where("form is not null"))
    return found.join(roots.hint(SHUFFLED), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
