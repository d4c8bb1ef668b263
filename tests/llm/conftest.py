import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["id", "body", "tie", "rid", "n", "node", "grp", "size", "shard", "slot", "key", "item", "c_0", "media", "tile", "block", "words"]
CLASHING += ["n_words", "n_hit", "items", "longest", "base", "added", "spans", "joined_spans_", "score", "lang_pred", "languages", "n_tokens", "ids", "decoded", "id_", "tie_", "group_", "component_id", "n_shingles", "c_1"]


def _rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(r.randrange(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    rows = [
        (1, base, "en"),
        (2, base, "en"),
        (2, base, "en"),  # a repeated row
        (3, base.replace(" ", "  ") + " tail", "en"),
        (4, None, "en"),
        (5, "", None),
        (6, " \n\t ", "fr"),
        (7, "Le café était là où élève — mañana 日本語 <|endoftext|> 😀", "fr"),
        (8, "x" * 70_000, "en"),
        (9, prose(20_000), None),
        (None, "no id but a text of some words", "en"),
        (None, None, None),
        (10, "12345 67890 !!", "en"),
        (11, "a b", "en"),
        (12, "a b", "fr"),
        (2**40, "mail me at joe.bloggs@example.com or +1 (415) 555-0100, 192.168.1.77 and 4111 1111 1111 1111", "en"),
        (14, "joe [at] example [dot] com, ｊｏｅ＠example.org, plus four one five five five five zero one zero zero", "en"),
        (15, "the " * 500, "en"),
    ]
    return [(i, t, lang, None if k % 3 else "s", None if t is None else len(t)) for k, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    out = spark.createDataFrame(rows, SCHEMA)
    for k, c in enumerate(CLASHING):
        out = out.withColumn(c, F.lit(None).cast("string") if k % 2 else F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
