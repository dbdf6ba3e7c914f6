"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors become one class with a weight. Each table hashes a class by the signs of ``bits`` random
projections; classes that share a bucket in any table are compared by exact cosine in double precision. A pair is
counted only in the first table where it meets, so direct links are counted once without listing pairs. What
leaves a task are counts per class and the star edges of the task's own link components.

``bits`` follows the number of classes (buckets hold ``BUCKET`` on average, at every size), the number of tables
follows from ``bits`` and ``RECALL``, the chance to find a pair that lies just at the threshold; closer pairs are
surer: with 10 bits and 29 tables a pair of cosine 0.95 is missed once in 10**6.

Scale: the classes go to their buckets once per table; a bucket over ``BLOCK`` classes is split
into blocks, and each pair of blocks is a task of its own, so no task holds a hot bucket.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id link with
nothing (such a row is its own component and kept; without an id the component is null); vectors of
different lengths aren't compared; rows that repeat an id and a vector are one vertex and each has its row; rows that
repeat an id with other vectors are vertices of their own, which the id alone doesn't link; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from culler.llm.common import prepare, written
from culler.llm.components import connected_components, with_component, with_vertex

SEED = 2
THRESHOLD = 0.9
RECALL = 0.999
BUCKET = 64
MIN_BITS = 6
BLOCK = 1024


def usable(v: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(MIN_BITS, math.ceil(math.log2(max(1, n) / BUCKET)))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_buckets(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Bucket numbers, one row per vector and one column per table."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _hashed(parts: Iterator[pd.DataFrame], bits: int, tables: int, seed: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        for _, same in part.groupby(part["v"].map(len)):
            x = np.array(same["v"].tolist(), dtype=np.float64)
            buckets = sign_buckets(unit_rows(x), bits, tables, seed)
            yield pd.DataFrame({"rep": same["rep"].to_numpy(), "weight": same["weight"].to_numpy(), "vector": [r.tobytes() for r in x],
                                "dims": x.shape[1], "buckets": list(buckets), "all": [r.astype(np.int64).tobytes() for r in buckets]})


def local_components(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the smallest node of its component."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _links_in(tile: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts (rep, null, n) and edges (rep, other, 0) of one tile of one bucket."""
    table, cross = int(tile["tbl"].iloc[0]), tile["i"].iloc[0] != tile["j"].iloc[0]
    x = unit_rows(np.array([np.frombuffer(v) for v in tile["vector"]]))
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if cross:  # pairs inside a block belong to the block's own tile
        block = tile["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(linked)
    buckets = np.array([np.frombuffer(s, dtype=np.int64)[:table] for s in tile["all"]]).reshape(len(tile), table)
    for at in range(0, len(a), 100_000):  # pairs that met in an earlier table were counted there
        s = slice(at, at + 100_000)
        met = (buckets[a[s]] == buckets[b[s]]).any(axis=1)
        linked[a[s][met], b[s][met]] = False
    rep, weight = tile["rep"].to_numpy(), tile["weight"].to_numpy()
    n = linked @ weight
    low = local_components(linked)
    star = np.flatnonzero(low != np.arange(len(low)))
    some = np.flatnonzero(n > 0)
    counts = pd.DataFrame({"rep": rep[some], "other": pd.array([None] * len(some), dtype="Int64"), "n": n[some]})
    edges = pd.DataFrame({"rep": rep[star], "other": pd.array(rep[low[star]], dtype="Int64"), "n": 0})
    return pd.concat([counts, edges], ignore_index=True) if len(some) else counts


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``vectors``: vec_id, embedding. Returns vec_id, n_links, component_id, kept, one row per row."""
    prepare(vectors.sparkSession)
    ok = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.when(ok, F.md5(F.col("embedding").cast("string"))).alias("class"), F.when(ok, F.col("embedding")).alias("v"))
    classes = written(rows.filter("class is not null").groupBy("class").agg(
        F.min("vec_id").alias("named"), F.count("*").alias("weight"), F.first("v").alias("v")), "vector-classes")
    classes = with_vertex(classes, "class")
    bits, tables = tables_for(classes.count(), threshold, recall)
    hashed = written(classes.select("rep", "weight", "v").mapInPandas(
        lambda it: _hashed(it, bits, tables, seed), "rep long, weight long, vector binary, dims int, buckets array<long>, all binary"), "vector-buckets")
    # the bucket of every table; all of them as bytes, for the rule of the first meeting
    placed = hashed.select("rep", "weight", "vector", "dims", "all", F.posexplode("buckets").alias("tbl", "bucket"))
    sizes = hashed.select("dims", F.posexplode("buckets").alias("tbl", "bucket")).groupBy("dims", "tbl", "bucket").agg(F.count("*").alias("size"))
    large = written(sizes.filter(F.col("size") > block), "large-buckets")
    n_blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    blocked = placed.join(large, ["dims", "tbl", "bucket"], "left").withColumn("n", n_blocks).withColumn(
        "block", F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("n")).cast("int"))
    tiles = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "dims", "tbl", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "weight", "vector", "all")

    def links(tile: pd.DataFrame) -> pd.DataFrame:
        if len(tile) < 2:
            return pd.DataFrame({"rep": [], "other": [], "n": []})
        return _links_in(tile, threshold)

    found = written(tiles.groupBy("dims", "tbl", "bucket", "i", "j").applyInPandas(links, "rep long, other long, n long"), "vector-links")
    counts = found.filter("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    components = connected_components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = written(
        classes.select("class", "rep", "named", "weight").join(counts, "rep", "left").join(components, F.col("rep") == F.col("id"), "left")
        .select("class", "named", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("vertex")), "vector-results")
    of_class = with_component(of_class).drop("named", "vertex")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", "class").join(of_class, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
