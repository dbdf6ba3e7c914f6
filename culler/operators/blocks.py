"""Blocked pairwise kernels.

Exact all-pairs work inside a group (suite) is done block by block: every item
gets a block id ``pmod(xxhash64(seq), nb)`` with ``nb = ceil(n / block_size)``.
Blocks come in bundles and an item is replicated once per pair of bundles it
belongs to.  Each (group, bundle, bundle) is one ``applyInPandas`` call that sees
at most ``2 * BUNDLE * block_size`` rows and goes through their ``block_size x
block_size`` distance tiles in numpy.  The kernels only emit reduced rows (top-k
lists, counts, sums, forest edges); the similarity matrix alone emits its pairs.
A suite holding a third of all rows becomes many independent groups, so no task
holds an unbounded one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK = 2048
METRICS = ("cosine", "euclidean", "manhattan")
#: Numbers of a tile that are worked on at once.
STRIP = 16_384
#: Share of the squared lengths that the rounding of a matrix product stays below.
ROUNDING = 1e-12
#: Tasks that block pairs are dealt to at most, and numbers of tiles from which on a task is cut; bytes say little of a tile's work.
TASKS, TASK_NUMBERS = 2000, 1 << 20
#: Blocks are met in bundles, of which a group of rows has about COPIES and a bundle at most BUNDLE blocks: so often an item is copied.
COPIES, BUNDLE = 6, 8


def assign_blocks(items: DataFrame, keys: list[str], block_size: int = DEFAULT_BLOCK, seq: str = "method_seq") -> DataFrame:
    """Add ``blk`` and ``nb`` (blocks in the item's group); the group sizes are a
    small aggregate joined back (AQE broadcasts it when its runtime size is small)."""
    sizes = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_size))).cast("int")
    return (items.join(sizes, keys)
            .withColumn("nb", nb)
            .withColumn("blk", F.pmod(F.xxhash64(F.col(seq)), F.col("nb")).cast("int"))
            .drop("_n"))


def replicate_pairs(blocked: DataFrame) -> DataFrame:
    """One copy of each item per block pair (lo <= hi) that contains its block."""
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("_o")
    x = blocked.select("*", other)
    return (x.withColumn("lo", F.least("blk", "_o")).withColumn("hi", F.greatest("blk", "_o")).drop("_o"))


def key_type(df: DataFrame, col: str = "suite") -> str:
    return df.schema[col].dataType.simpleString()


def bundle_of(blocks):
    """Blocks of a bundle, of so many blocks in all (a column or a number)."""
    if isinstance(blocks, int):
        return max(1, min(BUNDLE, -(-blocks // COPIES)))
    return F.greatest(F.lit(1), F.least(F.lit(BUNDLE), F.ceil(blocks / COPIES))).cast("int")


def in_tiles(kernel: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The kernel on each tile of two bundles' blocks; with ``first`` and ``last`` a block meets that run of blocks alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, out = {int(blk): rows for blk, rows in pdf.groupby("blk")}, []
        one, other = (sorted(int(x) for x in pdf.loc[pdf["bundle"] == pdf[end], "blk"].unique()) for end in ("b_lo", "b_hi"))
        for lo in one:
            a = parts[lo]
            span = (a["first"].iloc[0], a["last"].iloc[0]) if "first" in pdf else (lo, np.inf)
            for hi in other:
                if hi >= lo and span[0] <= hi <= span[1]:
                    out.append(kernel((a if hi == lo else pd.concat([a, parts[hi]])).assign(lo=lo, hi=hi)))
        out = [x for x in out if len(x)] or out[:1]
        return pd.concat(out, ignore_index=True) if out else kernel(pdf.assign(lo=-1, hi=-1))

    return run


def run_pairs(items: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
              block_size: int = DEFAULT_BLOCK, bundled: bool = True) -> DataFrame:
    """``schema`` may use ``{suite}`` for the type of the suite column. A task gets two bundles of blocks and goes through their tiles;
    kernels whose tiles leave much aren't ``bundled``."""
    schema = schema.replace("{suite}", key_type(items))
    nb = F.ceil(F.col("count") / F.lit(block_size))
    work = items.groupBy(*keys).count().agg(F.sum(nb * (nb + 1) / 2), F.sum(F.col("count").cast("double") * F.col("count"))).first()
    blocked = assign_blocks(items, keys, block_size)
    if not bundled:
        return replicate_pairs(blocked).repartition(tasks(*work), *keys, "lo", "hi").groupBy(*keys, "lo", "hi").applyInPandas(kernel, schema)
    wide = bundle_of(F.col("nb"))
    blocked = blocked.withColumn("bundle", F.floor(F.col("blk") / wide).cast("int")).withColumn("nb", F.ceil(F.col("nb") / wide).cast("int"))
    rep = replicate_pairs(blocked.withColumnRenamed("blk", "_blk").withColumnRenamed("bundle", "blk"))
    rep = rep.withColumnsRenamed({"blk": "bundle", "_blk": "blk", "lo": "b_lo", "hi": "b_hi"})
    return rep.repartition(tasks(*work), *keys, "b_lo", "b_hi").groupBy(*keys, "b_lo", "b_hi").applyInPandas(in_tiles(kernel), schema)


def tasks(tiles: float | None, numbers: float | None) -> int:
    return int(max(1, min(TASKS, tiles or 0, -(-(numbers or 0) // TASK_NUMBERS))))


def run_queries(items: DataFrame, queries: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                block_size: int = DEFAULT_BLOCK, seq: str = "method_seq") -> DataFrame:
    """The kernel on (asked items, one block of candidates): ``queries`` (keys, seq) go to all blocks of their
    group, every item stays in its own block, so the group is moved once."""
    blocked = assign_blocks(items, keys, block_size, seq)
    asked = blocked.join(queries.select(*keys, seq), [*keys, seq], "left_semi")
    asked = asked.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("asked", F.lit(True))
    rows = blocked.withColumn("asked", F.lit(False)).unionByName(asked)
    return rows.groupBy(*keys, "blk").applyInPandas(kernel, schema.replace("{suite}", key_type(items)))


# ---------------- numpy tiles ----------------

def stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.values])


def accumulate(A: np.ndarray, B: np.ndarray, term: str) -> np.ndarray:
    """[i, j]: the sum over the dimensions, in order, of ``square`` or ``abs`` differences or of ``product``s of A[i] and B[j]. Strips of
    rows stay in the processor's cache; each number is added up alone, so it does not depend on the tile around it."""
    at, bt = np.ascontiguousarray(A.T), np.ascontiguousarray(B.T)
    strip = max(1, STRIP // max(1, len(B)))
    acc, buf = np.zeros((len(A), len(B))), np.empty((strip, len(B)))
    for i in range(0, len(A), strip):
        to = acc[i : i + strip]
        x = buf[: len(to)]
        for d in range(len(at)):
            if term == "product":
                np.multiply(at[d, i : i + strip, None], bt[d], out=x)
            else:
                np.subtract(at[d, i : i + strip, None], bt[d], out=x)
                np.abs(x, out=x) if term == "abs" else np.multiply(x, x, out=x)
            np.add(to, x, out=to)
    return acc


def distance_tile(A: np.ndarray, B: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of A and B.  Cosine: 1 - cos, zero vector has
    similarity 0.  Euclidean and Manhattan are accumulated per dimension, exact."""
    if metric == "cosine":
        na = np.linalg.norm(A, axis=1)
        nb = np.linalg.norm(B, axis=1)
        na[na == 0] = 1.0
        nb[nb == 0] = 1.0
        return 1.0 - (A / na[:, None]) @ (B / nb[:, None]).T
    return np.sqrt(accumulate(A, B, "square")) if metric == "euclidean" else accumulate(A, B, "abs")


def squared_bounds(A: np.ndarray, B: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared Euclidean distances by one matrix product, right up to rounding, and how far rounding can move a row's and a column's."""
    sa, sb = (A * A).sum(axis=1), (B * B).sum(axis=1)
    rough = sa[:, None] + sb[None, :]
    rough -= 2.0 * (A @ B.T)
    return rough, ROUNDING * (sa + sb.max(initial=0.0)), ROUNDING * (sb + sa.max(initial=0.0))


def pair_euclidean(A: np.ndarray, B: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of the pairs (A[i], B[j]), the same numbers as ``distance_tile``'s."""
    acc = np.zeros(len(i))
    for d in range(A.shape[1]):
        diff = A[i, d] - B[j, d]
        acc += diff * diff
    return np.sqrt(acc)


def euclidean_tile(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Euclidean distances for sums and means: by a matrix product; small ones, of which rounding would leave few digits, are added up."""
    if np.isfinite(A).all() and np.isfinite(B).all():
        rough, slack, _ = squared_bounds(A, B)
        i, j = np.nonzero(rough <= 1e9 * slack[:, None])
        if len(i) <= rough.size // 16:
            d = np.sqrt(np.maximum(rough, 0.0))
            d[i, j] = pair_euclidean(A, B, i, j)
            return d
    return distance_tile(A, B, "euclidean")


def pair_manhattan(A: np.ndarray, B: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of the pairs (A[i], B[j]), the same numbers as ``distance_tile``'s."""
    acc = np.zeros(len(i))
    for d in range(A.shape[1]):
        acc += np.abs(A[i, d] - B[j, d])
    return acc


PAIR_DISTANCE = {"euclidean": pair_euclidean, "manhattan": pair_manhattan}


def manhattan_bounds(A: np.ndarray, B: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """(distances in units as 16-bit numbers, units per 1, how many units a distance can be off). A distance is the two sums of
    parts less twice the sum of the smaller parts, all modulo 2**16; units are so small that no distance reaches that."""
    if not (len(A) and len(B) and 0 < A.shape[1] <= 1000 and np.isfinite(A).all() and np.isfinite(B).all()):
        return None
    middle = np.minimum(A.min(axis=0), B.min(axis=0)) / 2 + np.maximum(A.max(axis=0), B.max(axis=0)) / 2
    a, b = A - middle, B - middle
    reach, part = np.abs(a).sum(axis=1).max() + np.abs(b).sum(axis=1).max(), max(np.abs(a).max(), np.abs(b).max())
    if not 1e-100 < reach < 1e100 or reach < 1e-9 * np.abs(middle).max():  # equal rows, or hardly a digit apart
        return None
    scale = min(60_000 / reach, 32_000 / part)
    a, b = a * scale, b * scale
    qa, qb = np.rint(a), np.rint(b)
    off = np.abs(a - qa).sum(axis=1).max() + np.abs(b - qb).sum(axis=1).max() + 1.0
    at, bt = np.ascontiguousarray(qa.astype(np.int16).T), np.ascontiguousarray(qb.astype(np.int16).T)
    strip = max(1, 4 * STRIP // len(B))
    acc, buf = np.zeros((len(A), len(B)), dtype=np.int16), np.empty((strip, len(B)), dtype=np.int16)
    for i in range(0, len(A), strip):
        to = acc[i : i + strip]
        x = buf[: len(to)]
        for d in range(len(at)):
            np.minimum(at[d, i : i + strip, None], bt[d], out=x)
            np.add(to, x, out=to)
    np.left_shift(acc, 1, out=acc)
    np.subtract(at.sum(axis=0, dtype=np.int16)[:, None], acc, out=acc)
    np.add(acc, bt.sum(axis=0, dtype=np.int16), out=acc)
    return acc.view(np.uint16), scale, off


def rough_tile(A: np.ndarray, B: np.ndarray, metric: str) -> tuple[np.ndarray, Callable[[float], float], float] | None:
    """(numbers that grow with the distance, a distance as such a number, how far they can be off), a fast form of a tile; None where there is none."""
    if metric == "manhattan":
        found = manhattan_bounds(A, B)
        return found and (found[0], lambda d: d * found[1], found[2])
    if metric != "euclidean" or not (len(A) and len(B) and np.isfinite(A).all() and np.isfinite(B).all()):
        return None
    a, b = A.astype(np.float32), B.astype(np.float32)
    longest = float((A * A).sum(axis=1).max() + (B * B).sum(axis=1).max())
    if not 1e-20 < longest < 1e30:  # beyond what 32 bits hold
        return None
    rough = a @ b.T
    rough *= -2.0
    rough += (a * a).sum(axis=1)[:, None]
    rough += (b * b).sum(axis=1)
    return rough, lambda d: d * d, (A.shape[1] + 16) * 2.0**-22 * longest


def within_tile(A: np.ndarray, B: np.ndarray, metric: str, itself: tuple[np.ndarray, np.ndarray]) -> Callable[[float], np.ndarray]:
    """For any eps the booleans ``distance <= eps``, pairs of ``itself`` being at distance 0. A fast form decides all but the pairs
    close to eps, whose distances are added up; the answers are those of ``distance_tile``. Small tiles are added up at once."""
    rough = rough_tile(A, B, metric) if len(A) * len(B) > STRIP else None
    exact: list[np.ndarray] = []

    def plain(eps: float) -> np.ndarray:
        if not exact:
            exact.append(distance_tile(A, B, metric))
            if metric == "cosine":
                np.clip(exact[0], 0.0, 2.0, out=exact[0])
        return exact[0] <= eps

    def decided(eps: float) -> np.ndarray:
        numbers, level, off = rough
        at = level(eps)
        if numbers.dtype == np.uint16:
            low, high = (min(max(int(x), -1), 65_535) for x in (np.floor(at - off), np.ceil(at + off)))
            near, sure = numbers <= max(high, 0), numbers <= low if low >= 0 else np.zeros(numbers.shape, dtype=bool)
        else:
            near, sure = numbers <= np.float32(at + off), numbers <= np.float32(at - off)
        open_ = np.logical_xor(near, sure)
        if np.count_nonzero(open_) > open_.size // 8:
            return plain(eps)
        i, j = np.nonzero(open_)
        sure[i, j] = PAIR_DISTANCE[metric](A, B, i, j) <= eps
        return sure

    def within(eps: float) -> np.ndarray:
        if not 0 <= eps < 1e30:  # none, or null
            return plain(eps) if eps > 0 else np.zeros((len(A), len(B)), dtype=bool)
        near = plain(eps) if exact or rough is None else decided(eps)
        near[itself] = True
        return near

    return within


def same_items(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of equal ids."""
    if not np.isin(a, b).any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.nonzero(a[:, None] == b[None, :])


def nearest_pairs(A: np.ndarray, B: np.ndarray, k: int, itself: np.ndarray, own: float, axes: tuple[int, ...], metric: str) -> Iterator[tuple[np.ndarray, ...] | None]:
    """Per axis (1: rows of A ask, 0: rows of B ask) (asking, other, exact distance) of pairs among which are every asking row's k
    nearest with all ties; pairs of ``itself`` count as distance ``own`` (0, or inf: left out). None where a tile must be
    computed: cosine, vectors that aren't finite, or too many pairs that rounding can't tell apart."""
    if metric == "euclidean" and np.isfinite(A).all() and np.isfinite(B).all():
        rough, row_slack, col_slack = squared_bounds(A, B)
        top = np.inf
    elif metric == "manhattan" and len(A) * len(B) > STRIP and (found := manhattan_bounds(A, B)):
        rough, row_slack, col_slack, top = found[0], np.full(len(A), found[2]), np.full(len(B), found[2]), 65_535
    else:
        yield from (None for _ in axes)
        return
    rough[itself] = min(own, top)
    for axis in axes:
        x = rough if axis else np.ascontiguousarray(rough.T)
        kk = min(k, x.shape[1])
        least = np.partition(x, kk - 1, axis=1)[:, kk - 1] + 2 * (row_slack if axis else col_slack)
        if metric == "manhattan":
            least = np.minimum(np.ceil(least), 65_534).astype(np.uint16)
        i, j = np.nonzero((x <= least[:, None]) & (x < top))
        if len(i) > max(x.size // 16, 4 * kk * len(x)):
            yield None
            continue
        d = PAIR_DISTANCE[metric](A, B, i, j) if axis else PAIR_DISTANCE[metric](A, B, j, i)
        if own < np.inf:
            d[(itself if axis else itself.T)[i, j]] = own
        yield i, j, d


def similarity_from_distance(D: np.ndarray, metric: str) -> np.ndarray:
    """Cosine similarity, or 1 / (1 + d) for the other two."""
    return 1.0 - D if metric == "cosine" else 1.0 / (1.0 + D)


def split_tile(pdf: pd.DataFrame, vec: str = "vec"):
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    a = pdf[pdf["blk"] == lo]
    b = pdf[pdf["blk"] == hi] if hi != lo else a
    return a, b, lo == hi


def sides(pdf: pd.DataFrame, vec: str = "vec") -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray, tuple[int, ...]]:
    """(items, their vectors, other items, their vectors, axes): a tile computed once serves axis 1 (the first ask)
    and, where the blocks differ and both ask, axis 0."""
    if "asked" in pdf:
        q, c = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        return q, stack(q[vec]), c, stack(c[vec]), (1,)
    a, b, same = split_tile(pdf, vec)
    va = stack(a[vec])
    return a, va, b, va if same else stack(b[vec]), (1,) if same else (1, 0)


def directions(pdf: pd.DataFrame, vec: str = "vec") -> Iterator[tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]]:
    """(queries, their vectors, candidates, their vectors) for both directions of a tile."""
    if "asked" in pdf:
        q, c = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        yield q, stack(q[vec]), c, stack(c[vec])
        return
    a, b, same = split_tile(pdf, vec)
    va, vb = stack(a[vec]), stack(b[vec])
    yield a, va, b, vb
    if not same:
        yield b, vb, a, va
