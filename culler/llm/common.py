"""Small shared helpers: session set-up, tables in the shared folder, words, stable order keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from culler.session import ensure_checkpoint_dir, ship_package

#: A word: a run of characters other than the ASCII white space characters.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Order keys are numbers of this many bits; their top bits are the bucket.
KEY_BITS = 60


def prepare(spark: SparkSession) -> None:
    """Name the shared checkpoint folder and make the package importable in Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps read the files, so a lost
    executor costs no recomputation and both readers of the table see the same rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A never-null string that sorts as the source by code point, null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def order_key(seed: int, *parts: Column) -> Column:
    """A seeded pseudo-random number in [0, 2**60) that depends on the values alone, so that
    reruns, retries and other partitionings give the same order."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def key_bucket(key: Column, bits: int) -> Column:
    return F.shiftright(key, KEY_BITS - bits).cast("int")
