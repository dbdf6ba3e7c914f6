"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents stand in a seeded order and form one stream of words, repeated as often as
its target asks. The stream is cut into blocks of ``block_words`` words. A tree over the output
shards splits the vector of block quotas (one count per source): at each node the left half of the
shards draws its blocks without replacement from the node's blocks, which is one
multivariate-hypergeometric draw; the right half gets the rest. So every shard's block count per source is
fixed before any document moves and the counts add up exactly. A seeded permutation of a source's block numbers
(an affine map modulo their count) says which blocks these are: a shard takes the blocks whose permuted
places lie in its part, so the shards' blocks are disjoint and each shard has blocks of all passes. A document's
pieces follow from the blocks that its words lie in; each carries a random rank for the shuffle inside its shard.

Scale: the text is read once and only counted, the narrow rows (id, source, size, key) are a table of their
own. Places in the stream come from running sums inside (source, hash bucket) groups plus the groups' offsets,
so no task holds a source. The tree runs on one row per source. Blocks grow with the corpus beyond ``MAX_BLOCKS``.

Defined cases: a null or wordless text has size 0 and takes 0 words; a null source is a source of
its own, last in order; rows with equal ids are separate rows (equal rows may swap their shares);
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from culler.llm.common import key_bucket, n_words, order_key, prepare, source_key, written

SEED = 20
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEAT = 2
SHARDS = 8
BLOCK_WORDS = 4096
#: Blocks of all sources together; a larger mix has larger blocks, as numpy draws from fewer than 10**9.
MAX_BLOCKS = 1 << 28
#: A source's rows are dealt to 2**BUCKET_BITS groups by their order key.
BUCKET_BITS = 10


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Targets by water filling. ``sizes``: skey, source_size. The sources share ``share`` times all
    words by weight, dealt in turn in order of skey; none gets over ``max_repeat`` times its size.

    In order of cap / weight the capped sources come first, so one pass of running sums finds the level
    at which the others stand: the first source whose own level lies below its cap sets it.
    The windows run over one row per source."""
    one = W.orderBy("skey")
    ordered = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                      ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
    everything = W.partitionBy()
    by_ratio = W.orderBy("ratio", "skey")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    return (
        ordered.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("free", F.when(F.col("level") < F.col("ratio"), F.col("level")))
        .withColumn("water", F.first("free", ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select("skey", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def splitting_tree(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks per (shard, source). Shards are as equal as whole blocks allow; at each node the left
    shards' counts are one multivariate-hypergeometric draw from the node's quotas."""
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)
    nodes = [(0, n_shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        first, k, have = nodes.pop()
        if k == 1:
            out[first] = have
            continue
        left = k // 2
        draw = int(round(int(have.sum()) * left / k))
        rng = np.random.default_rng([seed, first, k])
        got = rng.multivariate_hypergeometric(have, draw, method="marginals")
        nodes += [(first, left, got), (first + left, k - left, have - got)]
    return out


def permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """(step, offset) of the map b -> (step * b + offset) mod n, a permutation of 0..n-1."""
    if n < 2:
        return 1, 0
    step = int(rng.integers(1, n))
    while math.gcd(step, n) > 1:
        step = int(rng.integers(1, n))
    return step, int(rng.integers(0, n))


def quota_table(rows: pd.DataFrame, n_shards: int, block_words: int, seed: int, max_blocks: int = MAX_BLOCKS) -> pd.DataFrame:
    """``rows``: skey, source_size, target, in order of skey. Adds the columns of ``shard_quotas``."""
    stream = np.floor(rows["target"].to_numpy() + 0.5).astype(np.int64)
    block_words = max(block_words, -(-int(stream.sum()) // max_blocks))
    blocks = -(-stream // block_words)
    per_shard = splitting_tree(blocks, n_shards, seed)
    maps = [permutation(int(n), np.random.default_rng([seed, i])) for i, n in enumerate(blocks)]
    cuts = [[0, *map(int, c)] for c in np.cumsum(per_shard, axis=0).T]
    return rows.assign(stream=stream, block_words=block_words, blocks=blocks, step=[m[0] for m in maps], offset=[m[1] for m in maps], cuts=cuts)


def shard_quotas(targets: DataFrame, n_shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``targets`` with stream (its words, whole), block_words, blocks (their number), step and offset (the permutation of
    block numbers) and cuts: n_shards + 1 permuted places; shard j takes the blocks permuted to
    [cuts[j], cuts[j + 1]). One task over one row per source."""

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        return quota_table(rows.sort_values("skey", ignore_index=True)[["skey", "source_size", "target"]], n_shards, block_words, seed)

    return targets.withColumn("node", F.lit("root")).groupBy("node").applyInPandas(
        tree, "skey string, source_size long, target double, stream long, block_words long, blocks long, step long, offset long, cuts array<long>")


def shard_of(block: Column) -> Column:
    """The shard that drew a block of the row's source."""
    place = F.pmod(F.col("step") * block + F.col("offset"), F.col("blocks"))
    return F.size(F.filter("cuts", lambda c: c <= place)) - 1


def stream_places(rows: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """Adds ``place``: words of the same source before the row, in order of (key, doc_id, size)."""
    rows = rows.withColumn("bucket", key_bucket(F.col("key"), bits))
    inside = W.partitionBy("skey", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    local = rows.withColumn("before", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    buckets = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    offsets = buckets.select("skey", "bucket", (F.sum("words").over(W.partitionBy("skey").orderBy("bucket")) - F.col("words")).alias("offset"))
    return local.join(offsets, ["skey", "bucket"]).withColumn("place", F.col("offset") + F.col("before")).drop("bucket", "before", "offset")


def _placed(docs: DataFrame, weights: Sequence[float], share: float, max_repeat: float, n_shards: int, block_words: int, seed: int) -> DataFrame:
    """The narrow rows with their place in the stream and their source's quotas."""
    prepare(docs.sparkSession)
    rows = written(docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"),
                               order_key(seed, F.col("doc_id")).alias("key")), "mix-rows")
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    quotas = written(shard_quotas(source_targets(sizes, weights, share, max_repeat), n_shards, block_words, seed), "mix-quotas")
    return stream_places(rows).join(quotas, "skey")


def _rank(seed: int, turn, block) -> Column:
    return F.xxhash64(F.lit(seed), "key", turn, block)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT,
        n_shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, place, stream and
    pieces array<struct<shard, pass, block, first_word, n_words, rank>>: which words of it go to which shard."""
    placed = _placed(docs, weights, share, max_repeat, n_shards, block_words, seed)
    turns = F.sequence(F.lit(0), F.lit(int(max_repeat)))

    def pieces_of(turn):
        start = turn * F.col("source_size") + F.col("place")
        stop = F.least(start + F.col("size"), F.col("stream"))
        first, last = F.floor(start / F.col("block_words")), F.floor((stop - 1) / F.col("block_words"))

        def piece(block):
            low = F.greatest(start, block * F.col("block_words"))
            high = F.least(stop, (block + 1) * F.col("block_words"))
            return F.struct(shard_of(block).alias("shard"), turn.alias("pass"), block.alias("block"), (low - start).alias("first_word"),
                            (high - low).alias("n_words"), _rank(seed, turn, block).alias("rank"))

        return F.transform(F.when(start < stop, F.sequence(first, last)).otherwise(F.array().cast("array<long>")), piece)

    return placed.select("doc_id", "source", "size", "source_size", "target", "place", "stream", F.flatten(F.transform(turns, pieces_of)).alias("pieces"))


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, rank, doc_id, text, one row per piece, in shard and shuffled order inside
    its partition; a piece of part of a document holds its words joined by spaces. Needs unique doc_ids."""
    pieces = mix(docs, **options).select("doc_id", "size", F.explode("pieces").alias("p"))
    words = F.regexp_extract_all(F.col("text"), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    part = F.array_join(F.slice(words, (F.col("p.first_word") + 1).cast("int"), F.col("p.n_words").cast("int")), " ")
    joined = pieces.join(docs.select("doc_id", "text"), "doc_id")
    return (
        joined.select("p.shard", "p.rank", "doc_id", F.when(F.col("p.n_words") == F.col("size"), F.col("text")).otherwise(part).alias("text"))
        .repartitionByRange("shard", "rank").sortWithinPartitions("shard", "rank")
    )


def mix_whole(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT,
              n_shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The same mix in whole documents: in every pass the block that holds a document's middle word takes all of it
    into the shard that drew the block. Columns of ``docs``, in order of the shards and shuffled inside each.
    Of rows with equal ids each is taken as often as the one that is taken most; rows with null ids are kept
    once, in the first shard. The drawn places are joined to the documents by id."""
    placed = _placed(docs, weights, share, max_repeat, n_shards, block_words, seed)
    middle = lambda t: t * F.col("source_size") + F.col("place") + F.floor(F.col("size") / 2)
    taken = F.filter(F.sequence(F.lit(0), F.lit(int(max_repeat))), lambda t: middle(t) < F.col("stream"))

    def drawn(turn):
        block = F.floor(middle(turn) / F.col("block_words"))
        return F.struct(shard_of(block).alias("shard"), _rank(seed, turn, block).alias("rank"))

    copies = F.transform(taken, drawn)
    drawn_by = placed.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(F.struct(F.size(copies).alias("n"), copies.alias("copies")))["copies"].alias("__copies"))
    joined = docs.join(drawn_by, F.col("doc_id") == F.col("__id"), "left")
    once = F.array(F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("rank")))
    spread = joined.select(*[docs[c] for c in docs.columns], F.explode(F.coalesce("__copies", once)).alias("__copy"))
    return (
        spread.repartitionByRange(F.col("__copy.shard"), F.col("__copy.rank")).sortWithinPartitions("__copy.shard", "__copy.rank").drop("__copy")
    )
