"""The corpus pipeline: language ID, near-duplicate removal, decontamination, redaction of personal data, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() chains them over the documents table. Nulls in
any column pass through; a null text counts as a text without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, ngramjoin, pii
from tidemark.llm.common import keep

#: No SQL states the language and automaton stages; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is found; lang becomes the predicted one. Other columns stay as they are."""
    return langid.keep_known(docs, langid.learn(docs.where(~langid.held_out("doc_id"))))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group linked by 5-word shingles at a similarity of 0.8."""
    return ngramjoin.keep_one(docs, size=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that benchmark items do not contaminate."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text; n_chars, where there is such a column, follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of ids and of what they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("PII", redact_personal_data),
    ("BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"stage{k}")
    return docs
