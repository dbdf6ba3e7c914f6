"""Clustering quality.

Silhouette per grid cell without outliers.  Blocks of items meet blocks of
clusters, and every item folds to its own cluster's sum and its least mean before
a row leaves the task: Manhattan sums come from sorted prefix sums, cosine sums from
the clusters' sums of unit vectors, Euclidean ones from a tile.  The score
is then plain aggregation.  Guard (Q4): 0.0 when fewer than two labels, when the
labels are one cluster plus outliers, when fewer than two non-outliers, or when
the silhouette is undefined (fewer than 2 or more than n-1 clusters).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from culler.operators import blocks as BK
from culler.session import cut_lineage

# Grid order used for ties in "best" (Q5): algorithms then metrics.
ALGORITHMS = ["dbscan", "kmeans", "hierarchical"]
METRICS = ["cosine", "euclidean", "manhattan"]
#: Items of a block of the silhouettes' fold: a cell's vectors are copied once for each block that they meet. Members that are met at once
#: (a larger cluster is met whole), numbers of a strip.
FOLD_BLOCK, FOLD_ROWS, FOLD_NUMBERS = 32_768, 1024, 1 << 22


#: Distance sums below this share of the magnitudes that they come from are rounding, and count as 0.
_ROUNDING = 1e-12


def manhattan_sums(q: np.ndarray, c: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """[i, g]: sum of the Manhattan distances from ``q[i]`` to the rows of ``c`` in group g, without pairs.

    Per dimension the rows are sorted once; with C rows of a group up to x, whose values sum to P, and N and T for all
    of them, the sum of |x - y| is x (2 C - N) + T - 2 P."""
    out, size = np.zeros((len(q), k)), np.bincount(group, minlength=k).astype(np.float64)
    scale = np.zeros((len(q), k))
    rows = np.arange(1, len(c) + 1)
    for d in range(c.shape[1]):
        order = np.argsort(c[:, d], kind="stable")
        v, g, x = c[order, d], group[order], q[:, d]
        upto = np.searchsorted(v, x, side="right")
        count, total = np.zeros((len(c) + 1, k)), np.zeros((len(c) + 1, k))
        count[rows, g], total[rows, g] = 1.0, v
        count, total = np.cumsum(count, axis=0), np.cumsum(total, axis=0)
        out += x[:, None] * (2 * count[upto] - size) + total[-1] - 2 * total[upto]
        scale += np.abs(x)[:, None] * size + np.bincount(group, weights=np.abs(c[:, d]), minlength=k)
    return np.where(out > _ROUNDING * scale, out, 0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1.0)[:, None]


def _fold_kernel(metrics: list[str]):
    """Items of one block against one block of clusters: what leaves is one row per item, with its least mean distance
    to the other clusters that lie whole in the block, and the sum to its own cluster or to the block's split one."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asked"]], pdf[~pdf["asked"]].sort_values("lab", kind="stable")
        own = q["lab"].to_numpy().astype(np.int64)
        out = pd.DataFrame({"suite": q["suite"], "cell": q["cell"], "a": q["method_seq"], "own": q["lab"]}).reset_index(drop=True)
        if q.empty or c.empty:
            return out.iloc[:0].assign(lab=pd.Series(dtype="Int32"), s=0.0, n=0, least=0.0)
        x, y = BK.stack(q["v"]), BK.stack(c["v"])
        labs, first, group = np.unique(c["lab"].to_numpy().astype(np.int64), return_index=True, return_inverse=True)
        ends, n = np.r_[first[1:], len(c)], c["n"].to_numpy()
        size = np.bincount(group, weights=n).astype(np.int64)
        metric, home = metrics[int(c["cell"].iloc[0])], c["home"].iloc[0] >= 0
        at = np.zeros(len(q), dtype=np.int64) if home else np.minimum(np.searchsorted(labs, own), len(labs) - 1)
        mine = np.ones(len(q), dtype=bool) if home else labs[at] == own
        s, least, lo = np.full(len(q), np.nan), np.full(len(q), np.inf), 0
        while lo < len(labs):  # some whole clusters, and a strip of the items, at once
            hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + FOLD_ROWS, side="right")))
            rows = slice(first[lo], ends[hi - 1])
            strip = max(1, FOLD_NUMBERS // max(hi - lo, len(y[rows]) if metric == "euclidean" else 1))
            for i in range(0, len(q), strip):
                part = slice(i, i + strip)
                if metric == "cosine":  # a cluster's row is the sum of its unit vectors
                    sums = size[lo:hi] - _unit(x[part]) @ y[rows].T
                    sums = np.where(sums > _ROUNDING * size[lo:hi], sums, 0.0)
                elif metric == "manhattan":
                    sums = manhattan_sums(x[part], y[rows], group[rows] - lo, hi - lo)
                else:
                    sums = np.add.reduceat(BK.euclidean_tile(x[part], y[rows]), first[lo:hi] - first[lo], axis=1)
                mean = sums / size[lo:hi]
                own_here = np.flatnonzero(mine[part] & (at[part] >= lo) & (at[part] < hi))
                s[i + own_here] = sums[own_here, at[i + own_here] - lo]
                mean[own_here, at[i + own_here] - lo] = np.inf
                least[part] = np.minimum(least[part], mean.min(axis=1))
            lo = hi
        if home:  # a part of one cluster: its sums are not yet means
            return out.assign(lab=pd.array(np.full(len(q), labs[0]), dtype="Int32"), s=s, n=size[0], least=np.nan)
        return out.assign(lab=pd.arrays.IntegerArray(own.astype(np.int32), ~mine), s=s, n=pd.arrays.IntegerArray(size[at], ~mine),
                          least=np.where(np.isfinite(least), least, np.nan))

    return kernel


def _distance_sums(base: DataFrame, metrics: list[str], vec: str, block_size: int) -> DataFrame:
    """suite, cell, a, own, lab, s, n, least: see ``_fold_kernel``.

    Clusters of up to half a block share hashed blocks and stay whole; larger ones get blocks of their own,
    split by item. So an item meets every block of its cell once, however many clusters there are. Cosine cells
    have a row per cluster (the sum of its unit vectors) in place of its members."""
    items = base.select("suite", "method_seq", F.col(vec).alias("v"), F.posexplode("labels").alias("cell", "lab")).filter("lab >= 0")
    is_cosine = F.col("cell").isin([i for i, m in enumerate(metrics) if m == "cosine"])
    sizes = items.groupBy("suite", "cell", "lab").agg(F.count("*").alias("size"))
    whole = is_cosine | (F.col("size") <= max(1, block_size // 2))
    weight = F.when(is_cosine, 1).otherwise(F.col("size"))
    parts = lambda n, width: F.greatest(F.lit(1), F.ceil(n / F.lit(width))).cast("int")
    split = F.when(~whole, F.struct(F.col("lab").alias("home"), parts(F.col("size"), block_size).alias("parts")))
    layout = sizes.groupBy("suite", "cell").agg(
        parts(F.sum("size"), block_size).alias("n_item"), parts(2 * F.sum(F.when(whole, weight)), block_size).alias("n_whole"),
        F.count_if(whole).alias("_w"), F.collect_list(split).alias("split"))
    layout = layout.withColumn("n_whole", F.when(F.col("_w") > 0, F.col("n_whole")).otherwise(0)).drop("_w")

    items = items.join(layout, ["suite", "cell"]).withColumn("ib", F.pmod(F.xxhash64("method_seq"), F.col("n_item")).cast("int"))
    blocks = lambda home, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(home.alias("home"), i.alias("part")))
    all_blocks = F.concat(F.when(F.col("n_whole") > 0, blocks(F.lit(-1), F.col("n_whole"))).otherwise(F.array().cast("array<struct<home:int,part:int>>")),
                          F.flatten(F.transform("split", lambda x: blocks(x["home"], x["parts"]))))
    keys = ["suite", "cell", "ib", "home", "part"]
    asked = items.withColumn("_b", F.explode(all_blocks)).select(
        "suite", "cell", "ib", "_b.home", "_b.part", F.lit(True).alias("asked"), "method_seq", "v", "lab", F.lit(1).cast("long").alias("n"))

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, y: t + y * y))
    unit = items.filter(is_cosine).withColumn("_n", norm).withColumn(
        "v", F.transform("v", lambda y: F.when(F.col("_n") > 0, y / F.col("_n")).otherwise(F.lit(0.0))))
    totals = unit.groupBy("suite", "cell", "lab").agg(Summarizer.sum(array_to_vector("v")).alias("_t"), F.count("*").alias("n"),
                                                      F.first("n_item").alias("n_item"), F.first("n_whole").alias("n_whole"))
    totals = totals.withColumn("home", F.lit(-1)).withColumn("part", F.pmod(F.xxhash64("lab"), F.col("n_whole")).cast("int")).select(
        "suite", "cell", "lab", "n_item", "home", "part", F.lit(None).cast("long").alias("method_seq"), vector_to_array("_t").alias("v"), "n")
    members = items.filter(~is_cosine).join(sizes, ["suite", "cell", "lab"])
    at = F.when(F.col("home") < 0, F.pmod(F.xxhash64("lab"), F.col("n_whole"))).otherwise(
        F.pmod(F.xxhash64("method_seq"), parts(F.col("size"), block_size)))
    members = members.withColumn("home", F.when(whole, -1).otherwise(F.col("lab"))).withColumn("part", at.cast("int")).select(
        "suite", "cell", "lab", "n_item", "home", "part", "method_seq", "v", F.lit(1).cast("long").alias("n"))
    met = totals.unionByName(members).withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("n_item") - 1))).withColumn("asked", F.lit(False))
    schema = f"suite {BK.key_type(base)}, cell int, a long, own int, lab int, s double, n long, least double"
    n = F.col("n").cast("double")
    pairs = sizes.groupBy("suite", "cell").agg(F.sum("size").alias("n")).agg(F.sum(F.pow(F.ceil(n / block_size), 2) + F.ceil(n / block_size)), F.sum(n * n)).first()
    rows = asked.unionByName(met.select(asked.columns)).repartition(BK.tasks(*pairs), *keys)
    return rows.groupBy(*keys).applyInPandas(_fold_kernel(metrics), schema)


def silhouette_grid(labeled: DataFrame, cells: list[tuple[str, str]], vec: str = "z",
                    block_size: int = FOLD_BLOCK) -> DataFrame:
    """Quality per (suite, cell).  ``labeled`` has ``labels array<int>`` with one label
    per cell (same order as ``cells``, each ``(algorithm, metric)``)."""
    labeled = cut_lineage(labeled.select("suite", "method_seq", vec, "labels"))  # read several times
    counts = label_counts(labeled, len(cells))
    # the guard comes first: cells whose score is 0.0 by rule compute no distances
    scored = counts.filter(~guarded()).groupBy("suite").agg(F.collect_set("cell").alias("_scored"))
    base = labeled.select("suite", "method_seq", vec, "labels").join(scored, "suite").withColumn(
        "labels", F.transform("labels", lambda l, i: F.when(F.array_contains("_scored", i), l).otherwise(F.lit(-1)).cast("int"))).drop("_scored")
    point = ["suite", "cell", "a", "own"]
    # one shuffle by item serves both steps: the parts of split clusters first, then the least mean
    sums = _distance_sums(base, [m for _, m in cells], vec, block_size).repartition(*point)
    sums = sums.groupBy(*point, "lab").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("least").alias("least"))
    per_point = sums.groupBy(*point).agg(
        F.max(F.when(F.col("lab") == F.col("own"), F.try_divide(F.col("s"), F.col("n") - 1))).alias("ai"),
        F.max(F.when(F.col("lab") == F.col("own"), F.col("n"))).alias("own_n"),
        F.min(F.least("least", F.when(F.col("lab") != F.col("own"), F.col("s") / F.col("n")))).alias("bi"),
    )
    s_i = (F.when(F.col("own_n") == 1, F.lit(0.0))
           .when(F.greatest("ai", "bi") == 0, F.lit(0.0))
           .otherwise(F.try_divide(F.col("bi") - F.col("ai"), F.greatest("ai", "bi"))))
    score = per_point.groupBy("suite", "cell").agg(F.avg(s_i).alias("sil"))
    res = counts.join(score, ["suite", "cell"], "left")
    cell_df = labeled.sparkSession.createDataFrame(
        [(i, a, m) for i, (a, m) in enumerate(cells)], "cell int, algorithm string, metric string")
    return res.join(F.broadcast(cell_df), "cell").select(
        "suite", "algorithm", "metric", "cell", "n_items", "n_clusters", "n_outliers",
        quality_guard(F.col("sil")).alias("quality"))


def label_counts(labeled: DataFrame, n_cells: int) -> DataFrame:
    """A2 per cell: items, clusters without -1, outliers."""
    x = labeled.select("suite", F.posexplode("labels").alias("cell", "lab"))
    return x.groupBy("suite", "cell").agg(
        F.count("*").alias("n_items"),
        F.count_distinct(F.when(F.col("lab") >= 0, F.col("lab"))).alias("n_clusters"),
        F.count_if(F.col("lab") == -1).alias("n_outliers"),
    )


def guarded():
    """Q4: the labels leave the silhouette undefined."""
    distinct_all = F.col("n_clusters") + F.when(F.col("n_outliers") > 0, 1).otherwise(0)
    non_out = F.col("n_items") - F.col("n_outliers")
    return ((distinct_all < 2) | ((distinct_all == 2) & (F.col("n_outliers") > 0)) | (non_out < 2)
            | (F.col("n_clusters") < 2) | (F.col("n_clusters") > non_out - 1))


def quality_guard(sil):
    """Q4: 0.0 whenever the silhouette is undefined for the labels."""
    return F.when(guarded(), F.lit(0.0)).otherwise(F.coalesce(sil, F.lit(0.0)))


def best_clustering(runs: DataFrame) -> DataFrame:
    """Q5: highest quality, strict >, starting from -1; ties keep grid order; failed
    (NULL quality) cells are skipped."""
    alg = F.array_position(F.array(*[F.lit(a) for a in ALGORITHMS]), F.col("algorithm"))
    met = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    ok = runs.filter(F.col("quality").isNotNull() & (F.col("quality") > -1))
    w = Window.partitionBy("suite").orderBy(F.col("quality").desc(), alg, met)
    return ok.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def outlier_pct(runs: DataFrame) -> DataFrame:
    """Outliers as % of items per cell."""
    return runs.withColumn("outlier_pct", F.col("n_outliers") * 100.0 / F.col("n_items"))


def grid_matrix(runs: DataFrame, value: str) -> DataFrame:
    """Algorithm x metric matrix per suite; failed cell 0; algorithms with no
    result in any metric are omitted."""
    ok = runs.filter(F.col(value).isNotNull())
    algs = ok.select("suite", "algorithm").distinct()
    piv = runs.groupBy("suite", "algorithm").pivot("metric", METRICS).agg(F.first(value))
    return algs.join(piv, ["suite", "algorithm"]).select(
        "suite", "algorithm", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in METRICS])
