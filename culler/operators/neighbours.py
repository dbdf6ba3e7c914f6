"""Cosine top-k over a whole corpus by inverted lists of a tree of coarse centroids.

A cell with more than ``SPLIT`` lists' worth of rows is split by spherical k-means centroids, fitted on a bounded sample
of its rows (``SAMPLE`` a centroid); its children are split in turn, so lists hold about ``LIST`` rows however large
or skewed the corpus is. A row is indexed in one list, the one that it reaches by nearest centroids, and searched in the
``PROBES`` lists whose centroids are nearest to it (a beam over the levels). So a row meets about ``PROBES * LIST`` others
at any size; the lists' rows are compared exactly.

Equal vectors would fill a list of their own: of a class of equal vectors only the k + 1 smallest ids are indexed and
searched, which holds every answer; the other members' neighbours are the k smallest ids of their class.

Scale: all steps are joins and grouped maps of bounded size. Rows meet a cell's centroids in groups of
``GROUP`` rows, a list that stays large (vectors that hardly differ) is compared in blocks. Centroids never reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from culler.session import cut_lineage

#: Rows of a list that the tree aims at; a cell of more than SPLIT times as many is split.
LIST = 256
SPLIT = 4
#: Children of a cell at most, levels at most (a cell's number holds its path), lists searched for a row.
BRANCH = 256
DEPTH = 7
PROBES = 16
#: Sampled rows per centroid, rounds of k-means, rows that meet a cell's centroids in one group, rows of a block.
SAMPLE = 64
ROUNDS = 8
GROUP = 8192
BLOCK = 1024
SEED = 7


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.values]) if len(col) else np.zeros((0, 0))


def spherical_means(x: np.ndarray, b: int, rounds: int = ROUNDS) -> np.ndarray:
    """``b`` unit centroids of the unit vectors ``x``, started from its first rows; an empty one keeps its place."""
    c = x[:b].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1)
        c[used[size > 0]] = sums[size > 0] / size[size > 0, None]
    return c


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pick")
    c = spherical_means(_stack(pdf["u"]), min(int(pdf["b"].iloc[0]), len(pdf)))
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "centroids": [c.ravel()], "b": [len(c)]})


def _children(rows: DataFrame, centroids: DataFrame, keep: int) -> DataFrame:
    """id, cell, score: for rows (id, cell, u) the ``keep`` nearest children of their cell."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    left = rows.join(sizes, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    right = centroids.join(sizes, "cell").select("cell", "centroids", "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "cell": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        c = np.asarray(r["centroids"].iloc[0], dtype=np.float64).reshape(int(r["b"].iloc[0]), -1)
        s = _stack(l["u"]) @ c.T
        k = min(keep, s.shape[1])
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"id": np.repeat(l["id"].to_numpy(), k), "cell": (l["cell"].to_numpy()[:, None] * (BRANCH + 1) + best + 1).ravel(),
                             "score": np.take_along_axis(s, best, axis=1).ravel()})

    return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInPandas(run, "id long, cell long, score double")


def inverted_lists(items: DataFrame, list_size: int = LIST, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """(id, cell) of every row's own list and (id, cell) of the lists it is searched in; ``items``: id, u (unit vectors)."""
    index = cut_lineage(items.select("id", F.lit(0).cast("long").alias("cell")))
    beam = index.withColumn("score", F.lit(0.0))
    for _ in range(DEPTH):
        large = index.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > list_size * SPLIT)
        large = cut_lineage(large.select("cell", F.least(F.lit(BRANCH), F.ceil(F.col("n") / list_size)).cast("int").alias("b")))
        if large.isEmpty():
            break
        inside = index.join(large, "cell").withColumn("pick", F.xxhash64("id", F.lit(SEED)))
        first = Window.partitionBy("cell").orderBy("pick", "id")
        sample = inside.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= BRANCH * SAMPLE).filter(F.col("r") <= F.col("b") * SAMPLE)
        fitted = cut_lineage(sample.join(items, "id").groupBy("cell").applyInPandas(_fit, "cell long, centroids array<double>, b int"))
        split = large.select("cell")
        moved = _children(inside.select("id", "cell").join(items, "id"), fitted, 1).select("id", "cell")
        index = cut_lineage(index.join(split, "cell", "left_anti").unionByName(moved))
        spread = _children(beam.join(split, "cell", "left_semi").join(items, "id"), fitted, probes)
        best = Window.partitionBy("id").orderBy(F.col("score").desc(), "cell")
        entries = beam.join(split, "cell", "left_anti").unionByName(spread)
        beam = cut_lineage(entries.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= probes).drop("r"))
    return index, beam.select("id", "cell")


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, held = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        a, b = asked["id"].to_numpy(), held["id"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        s = _stack(asked["u"]) @ _stack(held["u"]).T
        s[a[:, None] == b[None, :]] = -np.inf
        kk = min(k, len(b))
        least = np.partition(s, len(b) - kk, axis=1)[:, len(b) - kk]
        rows, cols = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        order = np.lexsort((b[cols], -s[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < kk
        rows, cols = rows[keep], cols[keep]
        return pd.DataFrame({"a": a[rows], "b": b[cols], "score": s[rows, cols]})

    return run


def compared(index: DataFrame, asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """a, b, score: the k best of each list for every row that is searched in it; ``index`` and ``asked``: (id, cell).
    A list of more than BLOCK rows, or asked by more than 4 BLOCK, is compared in blocks."""
    blocks = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ib"))
    chunks = asked.groupBy("cell").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("qb"))
    shape = cut_lineage(blocks.join(chunks, "cell"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.join(shape, "cell").withColumn("i", part("ib")).withColumn("q", every("qb")).withColumn("asked", F.lit(False))
    wants = asked.join(shape, "cell").withColumn("i", every("ib")).withColumn("q", part("qb")).withColumn("asked", F.lit(True))
    columns = ["cell", "i", "q", "id", "asked"]
    rows = held.select(*columns).unionByName(wants.select(*columns)).join(items, "id")
    return rows.groupBy("cell", "i", "q").applyInPandas(_search(k), "a long, b long, score double")


def ann_topk(items: DataFrame, k: int = 5, vec: str = "vec", list_size: int = LIST, probes: int = PROBES) -> DataFrame:
    """(a, rank, b, score), the k most similar others found for every row; ties go to the smaller id. Where a corpus
    has at most ``probes`` lists they are all searched and the result is exact. A row whose lists hold fewer
    than k others is compared with all rows. Null and zero vectors and those with null or non-finite parts take no part."""
    size = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x))
    rows = items.select(F.col("method_seq").cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).withColumn("n", size)
    rows = rows.filter((F.col("n") > 0) & (F.col("n") < float("inf")))  # a null or NaN part makes the size null or NaN
    rows = rows.filter(~F.isnan("n")).select("id", F.transform("v", lambda x: x / F.col("n")).alias("u"))
    # equal vectors: two independent 64-bit hashes name the class
    rows = rows.withColumn("c1", F.xxhash64("u")).withColumn("c2", F.xxhash64(F.lit(SEED), "u"))
    place = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("id"))
    first = cut_lineage(rows.withColumn("place", place).filter(F.col("place") <= k + 1))
    used = first.select("id", "u")
    index, asked = inverted_lists(used, list_size, probes)
    best = Window.partitionBy("a").orderBy(F.col("score").desc(), F.col("b"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("a", "rank", "b", "score")
    found = cut_lineage(ranked(compared(index, asked, used, k)))
    full = found.groupBy("a").count().filter(F.col("count") == k).select(F.col("a").alias("id"))
    short = cut_lineage(used.select("id").join(full, "id", "left_anti").withColumn("cell", F.lit(0).cast("long")))
    if not short.isEmpty():  # few others at all, or lists that hold too few
        rest = compared(used.select("id", F.lit(0).cast("long").alias("cell")), short, used, k)
        found = cut_lineage(found.join(short.select(F.col("id").alias("a")), "a", "left_anti").unionByName(ranked(rest)))
    # the other members of a class: its k smallest ids, as near as a vector is to itself
    own = F.aggregate(F.col("u"), F.lit(0.0), lambda s, x: s + x * x)
    heads = first.filter(F.col("place") <= k).select("c1", "c2", F.col("place").alias("rank"), F.col("id").alias("b"), own.alias("score"))
    others = rows.select("id", "c1", "c2").join(used.select("id"), "id", "left_anti")
    copies = others.join(heads, ["c1", "c2"]).select(F.col("id").alias("a"), "rank", "b", "score")
    return found.unionByName(copies)
