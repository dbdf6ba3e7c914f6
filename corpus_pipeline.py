"""A training-data pipeline over ``documents``: score, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and rereads it as the next stage's docs, so a lost executor repeats at most one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from culler.llm import bbit_minhash, mix, piece_bpe, qda, secret_scan
from culler.llm.common import prepare, written
from culler.llm.queries import tokenizer_path
from culler.session import read_table

#: Stages on shingles of five words link from a similarity of 0.80; the 0.85 of ``bbit_minhash.PERCENT`` is op7's.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labels of this input."""
    model = qda.fit_labelled(qda.document_statistics(docs), read_table(spark, sf_dir, "labels"))
    return qda.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (similarity of ``NEAR_PERCENT`` or more), the one with the smallest id."""
    return bbit_minhash.keep_one(docs, percent=NEAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``<kind>`` in the place of every secret; the documents stay and n_chars follows their text."""
    prepare(spark)
    clean = secret_scan.redact(docs, secret_scan.new_ledger(spark))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them: sources at their target weights."""
    return mix.mix_whole(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of every document of the mix, as counts and digests, and the digest of what they decode to."""
    return piece_bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("SentencePiece encoding", pieces),
]

#: SQL can't express the encoding; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
