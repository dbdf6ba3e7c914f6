"""Sharding by proportional stratified interleaving.

Rows get a seeded-shuffled rank inside their source, rank r of n has the fractional rank
(2 r - 1) / (2 n), the fractional ranks of all sources are sorted into one sequence, and the sequence
is cut into shards of equal row counts (at most one apart). A stretch of the sequence holds each source in its
share of the whole, so every shard matches the mixture to within about a row per source.

Scale: the rank in a source is a row number inside a hash bucket plus the bucket's offset (a table of bounded size); the
place in the sequence comes from range partitions by fractional rank and order key that carry counts on. So neither a hot source
nor the whole sequence nor a fraction that very many small sources share meets in one task. Shuffled rows hold id, size,
checksum and keys, not the text.

Defined cases: a null text has size 1 and checksum 0 (as an empty one); a null source is a stratum of its
own; null and equal ids are placed like others (ties by id, size, checksum; equal rows may
swap places); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from culler.llm.common import key_bucket, order_key, prepare, source_key, written
from culler.operators.ranks import ranked

SEED = 30
SHARDS = 8
#: Groups per source (by order key), as a power of two.
BUCKET_BITS = 10


def interleave(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bits: int = BUCKET_BITS) -> DataFrame:
    """doc_id, size, text_crc32, source, fraction, position (0-based in the sequence), shard, slot."""
    prepare(docs.sparkSession)
    rows = docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("skey"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        order_key(seed, F.col("doc_id")).alias("key"),
    ).withColumn("bucket", key_bucket(F.col("key"), bits))
    rows = written(rows, "interleave")  # the texts are read once; what follows reads these few columns
    tie = ["key", F.col("doc_id").asc_nulls_last(), "size", "text_crc32"]
    local = rows.withColumn("r", F.row_number().over(W.partitionBy("skey", "bucket").orderBy(*tie)))
    inside = W.partitionBy("skey")
    offsets = rows.groupBy("skey", "bucket").agg(F.count("*").alias("n")).select(
        "skey", "bucket", (F.sum("n").over(inside.orderBy("bucket")) - F.col("n")).alias("offset"), F.sum("n").over(inside).alias("of"))
    fractions = local.join(offsets, ["skey", "bucket"]).withColumn(
        "fraction", (2 * (F.col("offset") + F.col("r")) - 1).cast("double") / (2 * F.col("of")).cast("double"))
    order = [F.col(c) if isinstance(c, str) else c for c in ["fraction", *tie[:1], "skey", *tie[1:]]]
    placed = ranked(fractions.select("doc_id", "source", "skey", "size", "text_crc32", "key", "fraction"), [], order, "position")
    placed = placed.withColumn("position", F.col("position") - 1).withColumn("all", F.lit(rows.count()))
    shard = F.expr(f"cast((position * {n_shards}) div all as int)")
    first = F.expr(f"(shard * all + {n_shards} - 1) div {n_shards}")  # smallest position of the shard
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first).select(
        "doc_id", "size", "text_crc32", "source", "fraction", "position", "shard", "slot")
