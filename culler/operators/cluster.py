"""Clustering (K0-K11) keyed by suite, for all suites in one job.

* K2/K3 eps: k-th neighbour distances (blocked kernel), then Kneedle over blocks of the sorted curve per (suite, metric).
* K1/K4 DBSCAN: passes over the tiles that can hold a pair (``eps_tiles``): neighbourhood sizes (core
  points), stars of the core points' components inside a block, then of these between blocks (core points only),
  border points' smallest neighbouring core label (settings with core points and others only); and connected
  components by min-label propagation with pointer jumping.  Cluster ids are the
  dense rank of each component's smallest member, which reproduces sequential
  DBSCAN labels.  All 3 metrics x 6 settings run as one frame.
* K5-K9 k-means: Lloyd iterations of every k of the elbow scan and every restart together. Suites that a task can hold do all rounds
  inside some tasks; in larger ones chunks of a suite's items meet all its moving centroids and give partial sums.
* K10/K11 agglomerative: rounds that merge all mutually nearest clusters at once, each one blocked pass
  over cluster sizes and sums, or over members where these don't give a linkage's distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from culler.operators import blocks as BK
from culler.operators import eps_tiles as EPS
from culler.operators import vectors as V
from culler.operators.ranks import ranked
from culler.session import cut_lineage

# DBSCAN settings tried in order: (eps factor, min_samples divisor or None for 2)
DBSCAN_SETTINGS = [(1.0, 10), (0.8, 15), (1.2, 20), (0.6, None), (1.5, 8), (0.4, None)]
KNEE_S = 1.5
# Places of a sorted series that one window scans.
KNEE_BLOCK = 4096
MAX_OUTLIER_PCT = 30.0
ELBOW_MAX_K = 10
KMEANS_SEED = 42
KMEANS_RESTARTS = 10
ELBOW_RESTARTS = 5
# Items of a suite that meet its centroids in one task.
KMEANS_CHUNK = 4096
# Numbers of a suite's vectors up to which a task does all rounds of a run (64 MB), and tasks that few suites' runs are dealt to.
KMEANS_NUMBERS, KMEANS_TASKS = 1 << 23, 64
# Clusters of a suite from which on one task does the rest of its merges (their distances: 128 MB).
FINISH = 4096
# How many times FINISH clusters of a suite one task merges where sizes and sums give their distances (no matrix); numbers of a strip of these.
ALONE, ALONE_NUMBERS = 4, 1 << 21
# Items of a suite whose tree one task cuts; rows of a tile of members that are worked on at once.
CUT, STRIP_ROWS = 1 << 20, 1024
# A tile's graph is dense with more than this part of its pairs; components that are then walked one by one.
DENSE = 64
PEELED = 8
# The linkage of a metric's cell.
LINKAGES = {"cosine": "average", "euclidean": "ward", "manhattan": "complete"}
# Squared move below which a centroid stands still (rounding of the means' sums).
CENTROID_TOL = 1e-20


# ---------------- K3 knee, K2 optimal eps ----------------

def _placed(curve: DataFrame, keys: list[str], y: str, ids: list[str]) -> DataFrame:
    """The series with ``s`` (place from 0, ascending), ``n``, ``ymin`` and ``ymax``; ties by ``ids``."""
    curve = cut_lineage(curve.select(*keys, *ids, F.col(y).alias("y")))  # read twice
    rows = ranked(curve, keys, [F.col("y"), *map(F.col, ids)], "s").withColumn("s", F.col("s") - 1)
    return rows.join(curve.groupBy(*keys).agg(F.count("*").alias("n"), F.min("y").alias("ymin"), F.max("y").alias("ymax")), keys)


def _knee(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Kneedle in two levels: places fall into blocks of KNEE_BLOCK; a block holds its own rows and a row from each
    neighbour, so that every local extreme shows inside it; the last threshold of each block is carried to the
    blocks after it by a window over one row per block."""
    c = placed.filter((F.col("n") > 1) & (F.col("ymax") > F.col("ymin")))
    # difference curve in the reversed index: D(s) = x_norm(s) - y_norm(s), traversed s = n-1 .. 0
    c = c.withColumn("D", F.col("s") / (F.col("n") - 1) - (F.col("y") - F.col("ymin")) / (F.col("ymax") - F.col("ymin")))
    c = c.select(*keys, "n", "D", "y", (F.col("n") - 1 - F.col("s")).alias("r"))
    own = F.floor(F.col("r") / KNEE_BLOCK)
    near = F.array_distinct(F.array(own, F.floor((F.col("r") - 1) / KNEE_BLOCK), F.floor((F.col("r") + 1) / KNEE_BLOCK)))
    c = c.withColumn("own", own).withColumn("blk", F.explode(near))
    wb = Window.partitionBy(*keys, "blk").orderBy("r")
    prev, nxt = F.coalesce(F.lag("D").over(wb), F.col("D")), F.coalesce(F.lead("D").over(wb), F.col("D"))
    c = (c.withColumn("is_max", (F.col("D") >= prev) & (F.col("D") >= nxt)).withColumn("is_min", (F.col("D") <= prev) & (F.col("D") <= nxt))
         .withColumn("next_D", F.lead("D").over(wb)).filter(F.col("blk") == F.col("own")))
    c = cut_lineage(c.select(*keys, "n", "D", "y", "r", "blk", "is_max", "is_min", "next_D"))
    c = c.join(c.filter("is_max").groupBy(*keys).agg(F.min("r").alias("r0")), keys).filter(F.col("r") >= F.col("r0"))
    c = (c.withColumn("thr_val", F.when(F.col("is_min"), F.lit(0.0)).when(F.col("is_max"), F.col("D") - F.lit(KNEE_S) / (F.col("n") - 1)))
         .withColumn("thr_idx", F.when(F.col("is_max"), F.struct("r", "y"))))
    run = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = c.groupBy(*keys, "blk").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("r"))).alias(f"last_{v}") for v in ("thr_val", "thr_idx")])
    before = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "blk", *[F.last(f"last_{v}", ignorenulls=True).over(before).alias(f"old_{v}") for v in ("thr_val", "thr_idx")])
    c = c.withColumn("thr", F.last("thr_val", ignorenulls=True).over(run)).withColumn("at", F.last("thr_idx", ignorenulls=True).over(run))
    c = c.join(carried, [*keys, "blk"])
    hit = c.filter((F.col("r") <= F.col("n") - 2) & (F.col("next_D") < F.coalesce("thr", "old_thr_val")))
    return hit.groupBy(*keys).agg(F.min_by(F.coalesce("at", "old_thr_idx"), "r").alias("k")).select(*keys, F.col("k.y").alias("knee_y"))


def knee(curve: DataFrame, keys: list[str], y: str = "y", ids: list[str] = []) -> DataFrame:
    """Kneedle (convex, increasing, S=1.5) on the ascending series ``y`` per key; ``ids`` tell equal values apart.
    Returns keys + ``knee_y`` (no row where there is no knee)."""
    return _knee(_placed(curve, keys, y, ids), keys)


def optimal_eps(kd: DataFrame, keys: list[str] = ["suite", "metric"], ids: list[str] = ["a"]) -> DataFrame:
    """K2: knee of the sorted k-distances; none -> 90th percentile; 0 -> 95th. Percentiles are read off the ranks."""
    placed = cut_lineage(_placed(kd, keys, "kdist", ids))
    at = lambda i: F.max(F.when(F.col("s") == i, F.col("y")))
    share = lambda p: (at(F.floor(p * (F.col("n") - 1))), at(F.ceil(p * (F.col("n") - 1))), p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1)))
    lo90, hi90, f90 = share(0.9)
    lo95, hi95, f95 = share(0.95)
    p = placed.groupBy(*keys, "n").agg(lo90.alias("a0"), hi90.alias("a1"), lo95.alias("b0"), hi95.alias("b1"))
    p = p.select(*keys, (F.col("a0") + (F.col("a1") - F.col("a0")) * f90).alias("p90"), (F.col("b0") + (F.col("b1") - F.col("b0")) * f95).alias("p95"))
    e = p.join(_knee(placed, keys), keys, "left").withColumn("eps0", F.coalesce("knee_y", "p90"))
    return e.select(*keys, "knee_y", F.when(F.col("eps0") == 0, F.col("p95")).otherwise(F.col("eps0")).alias("eps"))


# ---------------- K1 DBSCAN ----------------

def _peeled(adj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs that join what the graph of ``adj`` joins: large components of a dense graph are walked along packed rows and give
    a tree each, the rest gives all its pairs."""
    qi, ci = [], []
    if np.count_nonzero(adj) > adj.size // DENSE:
        packed = np.packbits(adj, axis=1)
        rest = packed.any(axis=1)
        for _ in range(PEELED):
            if not rest.any():
                break
            mine = np.zeros(len(adj), dtype=bool)
            step = mine.copy()
            step[rest.argmax()] = True
            columns = np.zeros(packed.shape[1], dtype=np.uint8)
            while step.any():
                mine |= step
                columns |= np.bitwise_or.reduce(packed[step], axis=0)
                step = rest & ~mine
                step[step] = (packed[step] & columns).any(axis=1)
            rows, cols = np.flatnonzero(mine), np.flatnonzero(np.unpackbits(columns, count=adj.shape[1]))
            # all rows to the first column would need an edge there: the component is known, so any tree over it will do
            qi += [rows, np.full(len(cols), rows[0])]
            ci += [np.full(len(rows), cols[0]), cols]
            rest &= ~mine
        adj = adj & rest[:, None]
    more = np.nonzero(adj)
    return np.concatenate([*qi, more[0]]), np.concatenate([*ci, more[1]])


def _star_edges(adj: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of a tile's graph (query x candidate booleans) as stars: (vertex, smallest vertex of its component); several rows or
    columns may be one vertex. Roots hook to smaller roots along all edges at once, then paths are halved, until no edge joins two roots."""
    qi, ci = _peeled(adj)
    ids, place = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    u, v = place[: len(rows)][qi], place[len(rows) :][ci]
    root = np.arange(len(ids))
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _counted(within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(per column, per row) the number of true ones."""
    return within.sum(axis=0), np.bitwise_count(np.packbits(within, axis=1)).sum(axis=1, dtype=np.int64)


def _first_core(near: np.ndarray, ask: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking rows that are near a core, the smallest label among their cores)."""
    cores = np.flatnonzero(label >= 0)
    cores = cores[np.argsort(label[cores], kind="stable")]
    seen = near[np.ix_(ask, cores)]
    first = seen.argmax(axis=1)
    hit = seen[np.arange(len(ask)), first]
    return ask[hit], label[cores[first[hit]]]


def _dbscan_kernel(metrics: list[str], n_cfg: int, vec: str, phase: str):
    """A tile's part of a phase. ``degree``: per item the sizes of its neighbourhoods (a, v: one number per setting); ``edges``: stars of the core
    points' components per cell (cell, a, v), of their ``root``s where these are given; ``border``: the smallest component that a
    point that is no core is near to (cell, a, v). Distances are only taken where a phase has something to ask."""

    def asked(a: pd.DataFrame, b: pd.DataFrame, cells: list[int], column) -> list[int]:
        """Cells with something to do in the tile."""
        if phase == "edges":
            return [j for j in cells if column(a, "core", j).any() and column(b, "core", j).any()]
        if phase == "border":
            ends = {j: (column(a, "comp", j) < 0, column(b, "comp", j) < 0) for j in cells}
            return [j for j, (x, y) in ends.items() if (x.any() and not y.all()) or (y.any() and not x.all())]
        return cells

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        suite, metric = pdf["suite"].iloc[0], pdf["metric"].iloc[0]  # a tile is of one metric
        a, va, b, vb, axes = BK.sides(pdf, vec)
        stacked = {(id(side), name): np.stack(side[name].to_numpy()) for side in (a, b) for name in ("core", "comp", "root") if name in pdf and len(side)}
        column = lambda side, name, j: stacked[id(side), name][:, j]
        first = metrics.index(metric) * n_cfg
        cells = asked(a, b, list(range(first, first + n_cfg)), column) if len(a) and len(b) else []
        if cells:
            aseq, bseq = a["method_seq"].to_numpy(), b["method_seq"].to_numpy()
            near = BK.within_tile(va, vb, metric, BK.same_items(aseq, bseq))
            eps = a["eps"].iloc[0]
            if phase == "degree":
                sizes = [_counted(near(eps[j])) for j in cells]
                for axis in axes:
                    out.append(pd.DataFrame({"suite": suite, "metric": metric, "a": aseq if axis else bseq, "v": list(np.stack([s[axis] for s in sizes], axis=1))}))
            for j in cells if phase == "edges" else []:  # links go both ways: the tile's stars need one
                within = near(eps[j])
                within &= column(a, "core", j)[:, None]
                within &= column(b, "core", j)[None, :]
                one, other = _star_edges(within, *((column(a, "root", j), column(b, "root", j)) if "root" in pdf else (aseq, bseq)))
                out.append(pd.DataFrame({"suite": suite, "cell": j, "a": one, "v": other}))
            for j in cells if phase == "border" else []:  # smallest component id among core neighbours of non-core points
                within = near(eps[j])
                for axis in axes:
                    mine, seq, theirs, side = (a, aseq, b, within) if axis else (b, bseq, a, within.T)
                    ask, label = np.flatnonzero(column(mine, "comp", j) < 0), column(theirs, "comp", j)
                    if len(ask) and (label >= 0).any():
                        hit, least = _first_core(side, ask, label)
                        out.append(pd.DataFrame({"suite": suite, "cell": j, "a": seq[hit], "v": least}))
        if out:
            return pd.concat(out, ignore_index=True)
        empty = {"suite": pd.Series(dtype=pdf["suite"].dtype), "a": pd.Series(dtype="int64")}
        return pd.DataFrame({**empty, "metric": [], "v": []} if phase == "degree" else {**empty, "cell": pd.Series(dtype="int32"), "v": pd.Series(dtype="int64")})

    return kernel


DEGREES = "suite {suite}, metric string, a long, v array<long>"


def neighbourhoods(base: DataFrame, placed: DataFrame, tiles: DataFrame, metrics: list[str], n_cfg: int, vec: str = "z") -> DataFrame:
    """(suite, cell, a, deg): the sizes of all neighbourhoods; ``base`` has the items and per suite ``eps`` of every cell."""
    part = EPS.run(base, placed, tiles, _dbscan_kernel(metrics, n_cfg, vec, "degree"), DEGREES)
    sums = part.groupBy("suite", "metric", "a").agg(*[F.sum(F.col("v")[c]).alias(f"d{c}") for c in range(n_cfg)])
    first = (F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric")).cast("int") - 1) * n_cfg
    cells = F.explode(F.array(*[F.struct((first + c).alias("cell"), F.col(f"d{c}").alias("deg")) for c in range(n_cfg)])).alias("c")
    return sums.select("suite", "a", cells).select("suite", "c.cell", "a", "c.deg")


def connected_components(edges: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest vertex id per component: label propagation over both edge
    directions plus pointer jumping (label <- label of label), until stable.
    Every round is a reliable checkpoint."""
    und = edges.select(*keys, "a", "v").unionByName(edges.select(*keys, F.col("v").alias("a"), F.col("a").alias("v")))
    lab = vertices.select(*keys, "a", F.col("a").alias("l"))
    while True:
        nb = und.join(lab.withColumnRenamed("a", "v").withColumnRenamed("l", "lv"), keys + ["v"]).groupBy(*keys, "a").agg(
            F.min("lv").alias("m"))
        new = lab.join(nb, keys + ["a"], "left").select(*keys, "a", F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = new.join(new.select(*keys, F.col("a").alias("l"), F.col("l").alias("ll")), keys + ["l"], "left").select(
            *keys, "a", F.least("l", F.coalesce("ll", "l")).alias("l"))
        jump = cut_lineage(jump)
        stable = jump.join(lab.withColumnRenamed("l", "old"), keys + ["a"]).filter(F.col("l") != F.col("old")).isEmpty()
        lab = jump
        if stable:
            return lab


def dbscan_grid(z: DataFrame, eps: DataFrame, metrics: list[str] = list(BK.METRICS), vec: str = "z",
                block_size: int = BK.DEFAULT_BLOCK, tried: list[tuple[float, int | None]] = DBSCAN_SETTINGS) -> DataFrame:
    """K1 for every (suite, metric, setting of ``tried``): labels (suite, metric, cfg, method_seq, cluster).
    ``eps`` has (suite, metric, eps) from ``optimal_eps``."""
    n_cfg = len(tried)
    sizes = z.groupBy("suite").agg(F.count("*").alias("n"))
    cfg_rows = [(c, f, d) for c, (f, d) in enumerate(tried)]
    cfg = z.sparkSession.createDataFrame(cfg_rows, "cfg int, factor double, div int")
    met = z.sparkSession.createDataFrame([(i, m) for i, m in enumerate(metrics)], "mi int, metric string")
    settings = (eps.join(F.broadcast(met), "metric").crossJoin(F.broadcast(cfg)).join(sizes, "suite")
                .withColumn("cell", F.col("mi") * n_cfg + F.col("cfg"))
                .withColumn("e", F.col("eps") * F.col("factor"))
                .withColumn("min_samples", F.when(F.col("div").isNull(), F.lit(2)).otherwise(
                    F.greatest(F.lit(2), F.floor(F.col("n") / F.col("div")))).cast("long")))
    settings = cut_lineage(settings)
    eps_arr = settings.groupBy("suite").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "e"))), lambda s: s["e"]).alias("eps"))
    base = z.select("suite", "method_seq", vec).join(eps_arr, "suite")
    schema = "suite {suite}, cell int, a long, v long"
    placed, tiles = EPS.place(z, settings.groupBy("suite", "metric").agg(F.max("e").alias("eps")), vec, tuple(metrics), block_size)
    deg = neighbourhoods(base, placed, tiles, metrics, n_cfg, vec)
    core = deg.join(settings.select("suite", "cell", "metric", "min_samples"), ["suite", "cell"]).withColumn(
        "is_core", F.col("deg") >= F.col("min_samples"))
    core = cut_lineage(core)
    by_cell = lambda rows, value, name: rows.groupBy("suite", F.col("a").alias("method_seq")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", value))), lambda s: s[value]).alias(name))
    core_arr = by_cell(core, "is_core", "core")
    # core points alone have edges: first inside the blocks, then between blocks from the blocks' components
    verts = core.filter("is_core").select("suite", "cell", "a")
    held = placed.join(core.filter("is_core").select("suite", "metric", F.col("a").alias("method_seq")).distinct(), ["suite", "metric", "method_seq"], "left_semi")
    held = cut_lineage(held)
    inside = cut_lineage(EPS.run(base.join(core_arr, ["suite", "method_seq"]), held, tiles.filter("lo = hi"), _dbscan_kernel(metrics, n_cfg, vec, "edges"), schema))
    rooted = core.join(inside, ["suite", "cell", "a"], "left").withColumn("root", F.coalesce("v", "a"))
    base2 = base.join(core_arr, ["suite", "method_seq"]).join(by_cell(rooted, "root", "root"), ["suite", "method_seq"])
    between = EPS.run(base2, held, tiles.filter("lo < hi"), _dbscan_kernel(metrics, n_cfg, vec, "edges"), schema)
    edges = cut_lineage(inside.unionByName(between.distinct()))
    comp = connected_components(edges, verts, ["suite", "cell"])
    comp_all = core.select("suite", "cell", "metric", "a").join(comp, ["suite", "cell", "a"], "left").withColumn(
        "l", F.coalesce("l", F.lit(-1)).cast("long"))
    comp_all = cut_lineage(comp_all)
    # only where a setting has core points and others is there a border
    mixed = comp_all.groupBy("suite", "metric", "cell").agg(F.min("l").alias("least"), F.max("l").alias("most")).filter("least < 0 and most >= 0")
    base3 = base.join(by_cell(comp_all, "l", "comp"), ["suite", "method_seq"])
    bordered = placed.join(mixed.select("suite", "metric").distinct(), ["suite", "metric"], "left_semi")
    border = EPS.run(base3, bordered, tiles, _dbscan_kernel(metrics, n_cfg, vec, "border"), schema)
    border = border.groupBy("suite", "cell", "a").agg(F.min("v").alias("b"))
    comp_all = comp_all.drop("metric")
    lab = comp_all.join(border, ["suite", "cell", "a"], "left").withColumn(
        "root", F.when(F.col("l") >= 0, F.col("l")).otherwise(F.col("b")))
    roots = lab.filter(F.col("root").isNotNull()).select("suite", "cell", "root").distinct()
    roots = roots.withColumn("cluster", (F.dense_rank().over(Window.partitionBy("suite", "cell").orderBy("root")) - 1).cast("int"))
    out = lab.join(roots, ["suite", "cell", "root"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return out.join(settings.select("suite", "cell", "metric", "cfg", "e", "min_samples"), ["suite", "cell"]).select(
        "suite", "metric", "cfg", F.col("e").alias("eps"), "min_samples", F.col("a").alias("method_seq"), "cluster")


def dbscan_search(labels: DataFrame, count_points: bool = False) -> DataFrame:
    """K4: first accepted setting per (suite, metric), else setting 0.  Accepted:
    outliers < 30% and at least 2 clusters (``count_points`` = the reference's
    literal test on points).  Returns the chosen labels plus per-setting stats."""
    st = labels.groupBy("suite", "metric", "cfg").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_outliers"))
    st = st.withColumn("outlier_pct", F.col("n_outliers") * 100.0 / F.col("n"))
    many = (F.col("n") - F.when(F.col("n_outliers") > 0, 1).otherwise(0) > 2) if count_points else (F.col("n_clusters") >= 2)
    st = st.withColumn("accepted", many & (F.col("outlier_pct") < MAX_OUTLIER_PCT))
    pick = st.groupBy("suite", "metric").agg(F.min(F.when(F.col("accepted"), F.col("cfg"))).alias("c"))
    pick = pick.select("suite", "metric", F.coalesce("c", F.lit(0)).alias("cfg"))
    return labels.join(pick, ["suite", "metric", "cfg"]), st


# ---------------- K5-K9 k-means ----------------

def _init_centroids(z: DataFrame, runs: DataFrame, vec: str) -> DataFrame:
    """k distinct items per run, chosen by a seeded hash: a partial top-k of ids, then the vectors of the picks."""
    j = z.select("suite", "method_seq").join(runs, "suite")
    w = Window.partitionBy("suite", "k", "run").orderBy(F.md5(F.concat_ws("/", "method_seq", "k", "run", F.lit(KMEANS_SEED))), "method_seq")
    pick = j.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("k"))
    return pick.join(z.select("suite", "method_seq", vec), ["suite", "method_seq"]).select(
        "suite", "k", "run", (F.col("r") - 1).cast("int").alias("cluster"), F.col(vec).alias("centroid"))


def _nearest_centroids(x: np.ndarray, sx: np.ndarray, c: np.ndarray, ends: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per run (its centroids are the rows of ``c`` up to its end) the place of each item's nearest centroid, a tie to the first, and how much
    farther the next one is at least. A matrix product decides all but the items whose two nearest its rounding can't tell apart; their
    distances are added up."""
    starts = [0, *ends[:-1]]
    plain = lambda part, to: BK.distance_tile(x[part], to, "euclidean") ** 2
    sc = (c * c).sum(axis=1)
    if not (np.isfinite(sx).all() and np.isfinite(sc).all()):
        return [(plain(slice(None), c[i:j]).argmin(axis=1), np.zeros(len(x))) for i, j in zip(starts, ends)]
    scores = c @ x.T
    scores *= -2.0
    scores += sc[:, None]
    found = []
    for i, j in zip(starts, ends):
        near, best, second = np.zeros(len(x), dtype=np.int64), scores[i].copy(), np.full(len(x), np.inf)
        for at in range(i + 1, j):
            less = scores[at] < best
            np.minimum(second, np.where(less, best, scores[at]), out=second)
            np.minimum(best, scores[at], out=best)
            near[less] = at - i
        close = np.flatnonzero(second - best <= 2 * BK.ROUNDING * (sx + sc[i:j].max()))
        if len(close):
            near[close] = plain(close, c[i:j]).argmin(axis=1)
        gap = np.sqrt(np.maximum(second + sx, 0.0))
        gap -= np.sqrt(np.maximum(best + sx, 0.0)) + 1e-9 * np.where(np.isfinite(gap), gap, 0.0)
        gap[close] = 0.0
        found.append((near, gap))
    return found


def _member_sums(x: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    return (near[None, :] == np.arange(k)[:, None]).astype(float) @ x


def _lloyd_kernel(vec: str):
    """One round for a chunk of a suite's items and all centroids of the suite: per (k, run, cluster) the number and
    the sum of the items nearest to it and their squared distances. A tie goes to the smaller cluster."""

    def run(items: pd.DataFrame, cents: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(items) and len(cents):
            x, cents = BK.stack(items[vec]), cents.sort_values(["k", "run", "cluster"])
            c, sizes = BK.stack(cents["centroid"]), cents.groupby(["k", "run"], sort=False).size()
            ends = np.cumsum(sizes.to_numpy()).tolist()
            for (k, r), n, end, (near, _) in zip(sizes.index, sizes, ends, _nearest_centroids(x, (x * x).sum(axis=1), c, ends)):
                own = c[end - n : end]
                out.append(pd.DataFrame({"suite": items["suite"].iloc[0], "k": k, "run": r, "cluster": cents["cluster"].to_numpy()[end - n : end],
                                         "n": np.bincount(near, minlength=n).astype(float), "total": list(_member_sums(x, near, n)),
                                         "sq": np.bincount(near, weights=((x - own[near]) ** 2).sum(axis=1), minlength=n)}))
        columns = ["suite", "k", "run", "cluster", "n", "total", "sq"]
        made = pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in columns})
        return made[made["n"] > 0]

    return run


def _lloyd(x: np.ndarray, seeds: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, float]]:
    """(centroids, inertia) of each run of Lloyd's rounds from its seeds and their clusters' places (seeds of items whose ids repeat share one).
    Runs that stand still leave; sums follow the items that change their cluster, and are added up anew before a run may stand still. An item
    meets the centroids again once they may have moved as far as the gap between its two nearest."""
    sx = (x * x).sum(axis=1)
    strips = [slice(i, i + KMEANS_CHUNK) for i in range(0, len(x), KMEANS_CHUNK)]
    cents, place = [c for c, _ in seeds], [p for _, p in seeds]
    labels, gaps = [np.full(len(x), -1, dtype=np.int64) for _ in seeds], [np.zeros(len(x)) for _ in seeds]
    sums, inertia, live = [np.zeros((p.max() + 1, x.shape[1])) for p in place], [0.0] * len(seeds), list(range(len(seeds)))
    while live:
        changed = dict.fromkeys(live, 0)
        for r in live:
            open_ = np.flatnonzero(gaps[r] <= 0)
            k = np.arange(len(sums[r]))[:, None]
            for at in strips if len(open_) == len(x) else [open_[i : i + KMEANS_CHUNK] for i in range(0, len(open_), KMEANS_CHUNK)]:
                part, old = x[at], labels[r][at]
                near, gaps[r][at] = _nearest_centroids(part, sx[at], cents[r], [len(cents[r])])[0]
                near = place[r][near]
                moved = np.flatnonzero(near != old)
                if len(moved):
                    changed[r] += len(moved)
                    sums[r] += ((near[moved] == k).astype(float) - (old[moved] == k)) @ part[moved]
                    labels[r][at] = near
        still = []
        for r in live:
            size = np.bincount(labels[r], minlength=len(sums[r]))
            if not changed[r]:
                sums[r] = sum(_member_sums(x[at], labels[r][at], len(size)) for at in strips)
            # empty clusters keep their previous centroid
            new = np.where(size[place[r], None] > 0, (sums[r] / np.maximum(size, 1)[:, None])[place[r]], cents[r])
            shift = ((new - cents[r]) ** 2).sum(axis=1)
            if not changed[r] and not shift.max() > CENTROID_TOL:
                first = np.unique(place[r], return_index=True)[1]
                sq = sum(np.bincount(labels[r][at], weights=((x[at] - cents[r][first[labels[r][at]]]) ** 2).sum(axis=1), minlength=len(first)) for at in strips)
                inertia[r] = float(sq[place[r]].sum())
                still.append(r)
            cents[r] = new
            step, own = np.sqrt(shift), np.zeros(len(sums[r]))
            np.maximum.at(own, place[r], step)
            gaps[r] -= own[labels[r]] + step.max()
        live = [r for r in live if r not in still]
    return list(zip(cents, inertia))


def _whole_runs_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    """All rounds of some runs of a suite: rows with a cluster are seeds, the others the suite's items."""
    seeds = pdf[pdf["cluster"].notna()].sort_values(["k", "run", "cluster"])
    x = BK.stack(pdf[pdf["cluster"].isna()].sort_values("method_seq")["v"])
    if not len(seeds) or not len(x):
        return pd.DataFrame({"suite": pd.Series(dtype=pdf["suite"].dtype), "k": [], "run": [], "cluster": [], "centroid": [], "inertia": []})
    groups = [(k, r, part) for (k, r), part in seeds.groupby(["k", "run"], sort=False)]
    found = _lloyd(x, [(BK.stack(part["v"]), np.unique(part["cluster"], return_inverse=True)[1]) for _, _, part in groups])
    return pd.concat([pd.DataFrame({"suite": pdf["suite"].iloc[0], "k": int(k), "run": int(r), "cluster": part["cluster"].astype("int32").to_numpy(),
                                    "centroid": list(c), "inertia": i}) for (k, r, part), (c, i) in zip(groups, found)], ignore_index=True)


def _runs_in_tasks(z: DataFrame, cents: DataFrame, vec: str) -> DataFrame:
    """(suite, k, run, cluster, centroid, inertia) of suites that a task can hold: their runs are dealt to some tasks, each with a copy of the items."""
    per = cents.select("suite", "k", "run").distinct().groupBy("suite").agg(F.count("*").alias("runs")).join(z.groupBy("suite").agg(F.count("*").alias("n")), "suite")
    suites = per.count()
    slots = F.least("runs", F.lit(max(1, KMEANS_TASKS // max(1, suites))), F.ceil(F.col("n") / 1024)).cast("int")
    per = per.select("suite", slots.alias("slots"))
    place = F.dense_rank().over(Window.partitionBy("suite").orderBy("k", "run")) - 1
    seeds = cents.withColumn("_p", place).join(per, "suite").select("suite", F.pmod("_p", "slots").alias("slot"), F.lit(None).cast("long").alias("method_seq"), "k", "run", "cluster", F.col("centroid").alias("v"))
    none = F.lit(None).cast("int")
    items = z.join(per, "suite").select("suite", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "method_seq", none.alias("k"), none.alias("run"), none.alias("cluster"), F.col(vec).alias("v"))
    rows = items.unionByName(seeds).repartition(min(BK.TASKS, 2 * max(suites, KMEANS_TASKS)), "suite", "slot")
    schema = f"suite {BK.key_type(z)}, k int, run int, cluster int, centroid array<double>, inertia double"
    return cut_lineage(rows.groupBy("suite", "slot").applyInPandas(_whole_runs_kernel, schema))


def _runs_by_rounds(z: DataFrame, cents: DataFrame, vec: str) -> DataFrame:
    """``_runs_in_tasks`` for suites of any size. The items are one table, dealt to chunks once for all runs; a round sends the
    centroids of a suite's unfinished runs to its chunks and gets one partial row per chunk and centroid back."""
    keys = ["suite", "k", "run"]
    chunks = z.groupBy("suite").agg(F.ceil(F.count("*") / KMEANS_CHUNK).cast("int").alias("chunks"))
    items = cut_lineage(z.select("suite", "method_seq", vec).join(chunks, "suite").withColumn("chunk", F.pmod(F.xxhash64("method_seq"), F.col("chunks")).cast("int")))
    every = cut_lineage(items.select("suite", "chunk").distinct())
    schema = f"suite {BK.key_type(z)}, k int, run int, cluster int, n double, total array<double>, sq double"
    done = None
    while True:
        sent = cents.join(every, "suite").select(*keys, "cluster", "centroid", "chunk")
        part = items.groupBy("suite", "chunk").cogroup(sent.groupBy("suite", "chunk")).applyInPandas(_lloyd_kernel(vec), schema)
        part = part.groupBy(*keys, "cluster").agg(Summarizer.sum(array_to_vector("total")).alias("t"), F.sum("n").alias("n"), F.sum("sq").alias("sq"))
        part = part.select(*keys, "cluster", F.col("n").alias("size"), "sq", vector_to_array("t").alias("t"))
        # empty clusters keep their previous centroid
        mean = F.when(F.col("size") > 0, F.transform("t", lambda x: x / F.col("size"))).otherwise(F.col("centroid"))
        new = cut_lineage(cents.join(part, [*keys, "cluster"], "left").select(*keys, "cluster", mean.alias("centroid"), "sq", V.sq_dist(mean, F.col("centroid")).alias("moved")))
        moves = (F.col("m") > CENTROID_TOL) & ~F.isnan("m")
        run = new.groupBy(*keys).agg(F.max("moved").alias("m"), F.coalesce(F.sum("sq"), F.lit(0.0)).alias("inertia")).withColumn("moves", F.coalesce(moves, F.lit(False)))
        rows = cut_lineage(new.join(run.select(*keys, "inertia", "moves"), keys))
        still = rows.filter("not moves").select(*keys, "cluster", "centroid", "inertia")
        done = still if done is None else done.unionByName(still) if not still.isEmpty() else done
        cents = rows.filter("moves").select(*keys, "cluster", "centroid")
        if cents.isEmpty():
            return cut_lineage(done)


def kmeans_runs(z: DataFrame, runs: DataFrame, vec: str = "z") -> tuple[DataFrame, DataFrame]:
    """Lloyd iterations for every run (suite, k, run) at once, until no centroid moves.  Each iteration lowers the
    inertia of an unfinished run, so the loop ends.  Returns (inertia: suite, k, run, inertia; centroids: suite, k, run,
    cluster, centroid).  A suite of at most ``KMEANS_NUMBERS`` numbers does all rounds of a run inside a task; a larger one
    does its rounds in passes over chunks of its items."""
    keys = ["suite", "k", "run"]
    z = z.select("suite", "method_seq", vec)
    cents = cut_lineage(_init_centroids(z, runs, vec))
    large = cut_lineage(z.groupBy("suite").agg(F.sum(F.size(vec)).alias("n")).filter(F.col("n") > KMEANS_NUMBERS).select("suite"))
    if large.isEmpty():
        found = _runs_in_tasks(z, cents, vec)
    else:
        small = [df.join(large, "suite", "left_anti") for df in (z, cents)]
        found = _runs_by_rounds(*[df.join(large, "suite", "left_semi") for df in (z, cents)], vec).unionByName(_runs_in_tasks(*small, vec))
    return found.groupBy(*keys).agg(F.max("inertia").alias("inertia")), found.select(*keys, "cluster", "centroid")


def elbow_k_from_inertia(inertia: DataFrame) -> DataFrame:
    """K5 rule on an inertia table (suite, k, inertia) with k = 2..max_k:
    k at argmax of the second difference + 2; 3 when there are at most 2 values."""
    w = Window.partitionBy("suite").orderBy("k")
    x = inertia.withColumn("i1", F.lead("inertia", 1).over(w)).withColumn("i2", F.lead("inertia", 2).over(w))
    x = x.withColumn("d2", (F.col("i2") - F.col("i1")) - (F.col("i1") - F.col("inertia")))
    cnt = inertia.groupBy("suite").agg(F.count("*").alias("m"), F.max("k").alias("max_k"))
    best = x.filter(F.col("d2").isNotNull()).groupBy("suite").agg(
        F.min_by("k", F.struct(-F.col("d2"), F.col("k"))).alias("k_at"))
    # index of argmax is (k_at - 2); answer is k_range[idx + 2] = k_at + 2, capped at max_k
    return cnt.join(best, "suite", "left").select(
        "suite", F.when(F.col("m") > 2, F.least(F.col("k_at") + 2, F.col("max_k"))).otherwise(F.lit(3)).alias("k"))


def elbow_inertias(z: DataFrame, vec: str = "z") -> DataFrame:
    """K5: (suite, k, inertia) for k = 2..min(10, n // 3), the best of 5 restarts each."""
    sizes = z.groupBy("suite").agg(F.least(F.lit(ELBOW_MAX_K), F.floor(F.count("*") / 3)).cast("int").alias("max_k"))
    ks = sizes.filter(F.col("max_k") >= 2).select("suite", F.explode(F.sequence(F.lit(2), F.col("max_k"))).alias("k"))
    runs = cut_lineage(ks.select("suite", "k", F.explode(F.sequence(F.lit(0), F.lit(ELBOW_RESTARTS - 1))).alias("run")))
    inertia, _ = kmeans_runs(z, runs, vec)
    return inertia.groupBy("suite", "k").agg(F.min("inertia").alias("inertia"))


def chosen_k(z: DataFrame, inertias: DataFrame) -> DataFrame:
    """K5: (suite, k), the elbow of a suite's inertias; 2 where there are none; at most its items."""
    chosen = z.groupBy("suite").agg(F.count("*").alias("n")).join(elbow_k_from_inertia(inertias), "suite", "left")
    return chosen.select("suite", F.least(F.coalesce("k", F.lit(2)), "n").cast("int").alias("k"))


def kmeans_auto(z: DataFrame, vec: str = "z") -> tuple[DataFrame, DataFrame]:
    """K5 + K6: the k of the elbow, then the best of 10 restarts by inertia.
    Returns (labels: suite, method_seq, cluster; chosen k per suite)."""
    chosen = cut_lineage(chosen_k(z, elbow_inertias(z, vec)))
    runs = cut_lineage(chosen.select("suite", "k", F.explode(F.sequence(F.lit(100), F.lit(100 + KMEANS_RESTARTS - 1))).alias("run")))
    inertia, cents = kmeans_runs(z, runs, vec)
    best = inertia.groupBy("suite").agg(F.min_by("run", F.struct("inertia", "run")).alias("run"))
    own = cents.join(best, ["suite", "run"]).select("suite", "cluster", "centroid")
    lab = V.assign_nearest(z.select("suite", "method_seq", vec), own, vec).select("suite", "method_seq", "cluster")
    # number clusters by their smallest member (deterministic order)
    roots = lab.groupBy("suite", "cluster").agg(F.min("method_seq").alias("root"))
    roots = roots.withColumn("c2", (F.dense_rank().over(Window.partitionBy("suite").orderBy("root")) - 1).cast("int"))
    lab = lab.join(roots, ["suite", "cluster"]).select("suite", "method_seq", F.col("c2").alias("cluster"))
    return lab, chosen


# ---------------- K10/K11 agglomerative ----------------

def _linkage(va: np.ndarray, na: np.ndarray, vb: np.ndarray, nb: np.ndarray, linkage: str) -> np.ndarray:
    """Distances between clusters of the given vector sums and sizes. They are accumulated per dimension, so
    that both directions of a pair give the same number wherever it is computed."""
    na, nb = na[:, None], nb[None, :]
    if linkage == "ward":
        return BK.distance_tile(va / na, vb / nb.T, "euclidean") * np.sqrt(2.0 * na * nb / (na + nb))
    return np.clip(1.0 - BK.accumulate(va, vb, "product") / (na * nb), 0.0, 2.0)


def _linkage_pairs(va: np.ndarray, na: np.ndarray, vb: np.ndarray, nb: np.ndarray, linkage: str) -> np.ndarray:
    """``_linkage`` of row i of the first and row i of the second, the same number as in a tile."""
    total = np.zeros(len(va))
    for k in range(va.shape[1]):
        if linkage == "ward":
            diff = va[:, k] / na - vb[:, k] / nb
            total += diff * diff
        else:
            total += va[:, k] * vb[:, k]
    if linkage == "ward":
        return np.sqrt(total) * np.sqrt(2.0 * na * nb / (na + nb))
    return np.clip(1.0 - total / (na * nb), 0.0, 2.0)


def _linkage_bounds(va: np.ndarray, na: np.ndarray, vb: np.ndarray, nb: np.ndarray, linkage: str) -> tuple[np.ndarray, np.ndarray]:
    """(a number that orders the pairs as ``_linkage`` does up to rounding, how far rounding can move it), from one matrix product."""
    ma, mb = va / na[:, None], vb / nb[:, None]
    if linkage != "ward":
        return 1.0 - ma @ mb.T, np.full((1, 1), 1e-12)
    sa, sb = (ma * ma).sum(axis=1)[:, None], (mb * mb).sum(axis=1)[None, :]
    w = 2.0 * na[:, None] * nb[None, :] / (na[:, None] + nb[None, :])
    both = sa + sb
    return (both - 2.0 * (ma @ mb.T)) * w, 1e-12 * both * w


def _nearest_cluster_kernel(linkage: str):
    """The nearest other cluster of each cluster of a tile: a matrix product leaves the few that rounding can't rule out, and their
    distances decide. A tile is computed once for both directions."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        a, b, same = BK.split_tile(pdf)
        if len(a) and len(b):
            (va, na, ia), (vb, nb, ib) = [(BK.stack(x["v"]), x["size"].to_numpy(dtype=float), x["method_seq"].to_numpy()) for x in (a, b)]
            itself = ia[:, None] == ib[None, :]
            finite = np.isfinite(va).all() and np.isfinite(vb).all()
            rough, slack = _linkage_bounds(va, na, vb, nb, linkage) if finite else (None, None)
            if finite:
                rough[itself] = np.inf
            exact = None
            for axis in (1,) if same else (1, 0):
                if finite:
                    least = np.min(rough + slack, axis=axis, keepdims=True)
                    i, j = np.nonzero((rough - slack <= least) & ~itself)
                if finite and len(i) <= rough.size // 16:
                    d = _linkage_pairs(va[i], na[i], vb[j], nb[j], linkage)
                    asked, other = (i, j) if axis == 1 else (j, i)
                    aid, bid = (ia, ib) if axis == 1 else (ib, ia)
                    order = np.lexsort((bid[other], d, asked))  # of equally near ones the smallest id
                    asked, other, d = asked[order], other[order], d[order]
                    first = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]][: len(asked)])
                    out.append(pd.DataFrame({"suite": pdf["suite"].iloc[0], "a": aid[asked[first]], "b": bid[other[first]], "d": d[first]}))
                    continue
                if exact is None:
                    exact = _linkage(va, na, vb, nb, linkage)
                    exact[itself] = np.inf
                d, aid, bid = (exact, ia, ib) if axis == 1 else (exact.T, ib, ia)
                least = d.min(axis=1)
                to = np.where(d == least[:, None], bid[None, :], np.iinfo(np.int64).max).min(axis=1)
                ok = np.isfinite(least)
                out.append(pd.DataFrame({"suite": pdf["suite"].iloc[0], "a": aid[ok], "b": to[ok], "d": least[ok]}))
        if not out:
            return pd.DataFrame({"suite": pd.Series(dtype=pdf["suite"].dtype), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"),
                                 "d": pd.Series(dtype="float64")})
        return pd.concat(out, ignore_index=True)

    return kernel


def _nearest_rows(v: np.ndarray, n: np.ndarray, asked: np.ndarray, linkage: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the nearest other cluster of the ``asked`` ones, of equally near ones the first: strips of a matrix product, and the
    distances of the pairs that its rounding can't tell apart."""
    to, least = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), np.inf)
    width = max(1, ALONE_NUMBERS // max(1, len(n)))
    for at in range(0, len(asked), width):
        rows = asked[at : at + width]
        rough, slack = _linkage_bounds(v[rows], n[rows], v, n, linkage)
        rough[np.arange(len(rows)), rows] = np.inf
        near = np.min(rough + slack, axis=1, keepdims=True)
        rough -= slack
        i, j = np.nonzero((rough <= near) & (rough < np.inf))
        if len(i) <= rough.size // 16:
            d = _linkage_pairs(v[rows[i]], n[rows[i]], v[j], n[j], linkage)
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
            to[at + i[first]], least[at + i[first]] = j[first], d[first]
        else:
            d = _linkage(v[rows], n[rows], v, n, linkage)
            d[np.arange(len(rows)), rows] = np.inf
            to[at : at + width] = d.argmin(axis=1)
            least[at : at + width] = d.min(axis=1)
    return to, least


def _come_closer(v: np.ndarray, n: np.ndarray, kept: np.ndarray, merged: np.ndarray, to: np.ndarray, least: np.ndarray, linkage: str) -> None:
    """``kept`` clusters to which a merged one is as near as their nearest, and comes first, go over to it. None is nearer than that, but for rounding."""
    width = max(1, ALONE_NUMBERS // max(1, len(merged)))
    for at in range(0, len(kept), width):
        rows = kept[at : at + width]
        rough, slack = _linkage_bounds(v[rows], n[rows], v[merged], n[merged], linkage)
        level = least[rows, None] ** 2 if linkage == "ward" else least[rows, None]
        i, j = np.nonzero(rough - slack <= level * (1 + 1e-12))
        if len(i):
            d = _linkage_pairs(v[rows[i]], n[rows[i]], v[merged[j]], n[merged[j]], linkage)
            order = np.lexsort((merged[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            who, row, d = merged[j[first]], rows[i[first]], d[first]
            closer = (d < least[row]) | ((d == least[row]) & (who < to[row]))
            to[row[closer]], least[row[closer]] = who[closer], d[closer]


def _alone(ids: np.ndarray, n: np.ndarray, v: np.ndarray, linkage: str, finish: int, out: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merge_tree``'s rounds without a matrix, until ``finish`` clusters are left; a nearest one is sought anew only where it was merged."""
    if len(ids) <= finish:
        return ids, n, v
    to, least = _nearest_rows(v, n, np.arange(len(ids)), linkage)
    while len(ids) > finish:
        at = np.flatnonzero(np.isfinite(least))
        a = at[(to[to[at]] == at) & (at < to[at]) & np.isfinite(least[to[at]])]
        if not len(a):
            break
        b = to[a]
        out.append(np.stack([ids[a], n[a], ids[b], n[b], least[a]]).T.astype(object))
        out[-1][:, [0, 2]] = np.stack([ids[a], ids[b]]).T
        v[a] += v[b]
        n[a] += n[b]
        touched, live = np.zeros(len(ids), dtype=bool), np.ones(len(ids), dtype=bool)
        touched[a] = touched[b] = True
        live[b] = False
        anew, place = (touched[to] | touched)[live], np.cumsum(live) - 1
        ids, n, v, to, least = ids[live], n[live], v[live], place[to[live]], least[live]
        asked = np.flatnonzero(anew)
        to[asked], least[asked] = _nearest_rows(v, n, asked, linkage)
        _come_closer(v, n, np.flatnonzero(~anew), place[a], to, least, linkage)
    return ids, n, v


def _finish_kernel(linkage: str, finish: int):
    """All rounds that are left for few clusters of a suite: the same rounds as ``merge_tree``'s, from ``finish`` clusters on a
    matrix of which a round computes the rows of merged clusters; a nearest one is sought anew only where it was merged."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("method_seq")
        out = []
        ids, n, v = _alone(pdf["method_seq"].to_numpy(), pdf["size"].to_numpy(dtype=float), BK.stack(pdf["v"]), linkage, finish, out)
        d = _linkage(v, n, v, n, linkage)
        np.fill_diagonal(d, np.inf)
        to = d.argmin(axis=1)  # rows are in id order: of equally near ones the smallest id
        least = d[np.arange(len(ids)), to]
        live = np.ones(len(ids), dtype=bool)
        while True:
            at = np.flatnonzero(live & np.isfinite(least))
            a = at[(to[to[at]] == at) & (at < to[at]) & np.isfinite(least[to[at]])]
            if not len(a):
                break
            b = to[a]
            out.append(np.stack([ids[a], n[a], ids[b], n[b], least[a]]).T.astype(object))
            out[-1][:, [0, 2]] = np.stack([ids[a], ids[b]]).T
            v[a] += v[b]
            n[a] += n[b]
            live[b] = False
            d[b], d[:, b], least[b] = np.inf, np.inf, np.inf
            others = np.flatnonzero(live)
            d[np.ix_(a, others)] = _linkage(v[a], n[a], v[others], n[others], linkage)
            d[a, a] = np.inf
            d[np.ix_(others, a)] = d[np.ix_(a, others)].T
            touched = np.zeros(len(ids), dtype=bool)
            touched[a] = touched[b] = True
            anew = others[touched[to[others]] | touched[others]]
            to[anew] = d[anew].argmin(axis=1)
            least[anew] = d[anew, to[anew]]
            kept = others[~(touched[to[others]] | touched[others])]
            if len(kept):  # a merged cluster is as near as the nearest at best
                near = d[np.ix_(kept, a)]
                best = near.argmin(axis=1)
                dist, who = near[np.arange(len(kept)), best], a[best]
                closer = (dist < least[kept]) | ((dist == least[kept]) & (who < to[kept]))
                least[kept[closer]], to[kept[closer]] = dist[closer], who[closer]
            if 4 * len(others) < 3 * len(ids):  # drop what is merged
                place = np.cumsum(live) - 1
                d, to, least = d[np.ix_(others, others)], place[to[others]], least[others]
                ids, n, v, live = ids[others], n[others], v[others], live[others]
        rows = np.concatenate(out) if out else np.zeros((0, 5), dtype=object)
        made = pd.DataFrame({"left": rows[:, 0].astype("int64"), "left_size": rows[:, 1].astype("int64"), "right": rows[:, 2].astype("int64"),
                             "right_size": rows[:, 3].astype("int64"), "height": rows[:, 4].astype("float64")})
        made.insert(0, "suite", pd.Series([pdf["suite"].iloc[0]] * len(made), dtype=pdf["suite"].dtype))
        return made

    return kernel


def merge_tree(items: DataFrame, linkage: str, vec: str = "vec", block_size: int = BK.DEFAULT_BLOCK) -> DataFrame:
    """All merges of an agglomerative clustering per suite: (suite, left, left_size, right, right_size, height).
    A cluster is named by its smallest member; the merged one has the name ``left``.

    ``ward`` (on Euclidean distance) and ``average`` (on cosine distance) are reducible, so in every round all pairs of
    mutually nearest clusters merge at once and the tree is the one of merging the globally nearest pair each time.
    Both distances follow from a cluster's size and vector sum (of unit vectors for cosine), so a round is one blocked
    nearest-neighbour pass over clusters; no suite is a task. At least one pair of a suite merges per round, usually a share of its
    clusters; points at 1, 2, 4, 8, ... merge one pair a round. The rounds are many once few clusters are left, so a suite that
    is down to ``ALONE * FINISH`` clusters does the rest of them in one task of that bounded size (suites whose ids repeat or
    whose vectors aren't finite stay with the passes)."""
    if linkage not in ("ward", "average"):
        raise ValueError(f"no reducible summary for linkage: {linkage}")
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    v = F.col(vec) if linkage == "ward" else F.transform(vec, lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(F.lit(0.0)))
    clusters = cut_lineage(items.withColumn("_n", norm).select("suite", "method_seq", F.lit(1).cast("long").alias("size"), v.alias("v")))
    schema = f"suite {BK.key_type(items)}, left {BK.key_type(items, 'method_seq')}, left_size long, right {BK.key_type(items, 'method_seq')}, right_size long, height double"
    odd = F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | F.col("method_seq").isNull()
    merges = None
    while True:
        few = clusters.groupBy("suite").agg(F.count("*").alias("n"), F.count_distinct("method_seq").alias("ids"), F.count_if(odd).alias("odd"))
        few = cut_lineage(few.filter((F.col("n") <= ALONE * FINISH) & (F.col("n") == F.col("ids")) & (F.col("odd") == 0) & F.col("suite").isNotNull()).select("suite"))
        if not few.isEmpty():
            last = cut_lineage(clusters.join(few, "suite", "left_semi").groupBy("suite").applyInPandas(_finish_kernel(linkage, FINISH), schema))
            merges = last if merges is None else merges.unionByName(last)
            clusters = cut_lineage(clusters.join(few, "suite", "left_anti"))
            if clusters.isEmpty():
                break
        near = BK.run_pairs(clusters, ["suite"], _nearest_cluster_kernel(linkage), "suite {suite}, a long, b long, d double", block_size)
        near = cut_lineage(near.groupBy("suite", "a").agg(F.min(F.struct("d", "b")).alias("m")).select("suite", "a", "m.b", "m.d"))
        back = near.select("suite", F.col("a").alias("b"), F.col("b").alias("a"))
        pairs = near.filter(F.col("a") < F.col("b")).join(back, ["suite", "a", "b"], "left_semi")
        side = lambda name: clusters.select("suite", F.col("method_seq").alias(name), F.struct("size", "v").alias(f"_{name}"))
        done = cut_lineage(pairs.join(side("a"), ["suite", "a"]).join(side("b"), ["suite", "b"]))
        if done.isEmpty():
            break
        new = done.select("suite", F.col("a").alias("left"), F.col("_a.size").alias("left_size"), F.col("b").alias("right"),
                          F.col("_b.size").alias("right_size"), F.col("d").alias("height"))
        merges = new if merges is None else merges.unionByName(new)
        merged = done.select("suite", F.col("a").alias("method_seq"), (F.col("_a.size") + F.col("_b.size")).alias("size"),
                             F.zip_with("_a.v", "_b.v", lambda x, y: x + y).alias("v"))
        gone = done.select("suite", F.explode(F.array("a", "b")).alias("method_seq"))
        clusters = cut_lineage(clusters.join(gone, ["suite", "method_seq"], "left_anti").unionByName(merged))
    if merges is None:
        merges = clusters.select("suite", F.col("method_seq").alias("left"), F.col("size").alias("left_size"), F.col("method_seq").alias("right"),
                                 F.col("size").alias("right_size"), F.lit(0.0).alias("height")).filter("false")
    return cut_lineage(merges)


# ---------------- linkages that need the members' distances ----------------

def _cluster_side(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(vectors, weights, clusters, their first rows, their weights, whether they are split) of a block, ordered by cluster."""
    rows = rows.sort_values(["c", "method_seq"])
    c, w = rows["c"].to_numpy(), rows["w"].to_numpy(dtype=float)
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]][: len(c)])
    return BK.stack(rows["v"]), w, c[first], first, np.add.reduceat(w, first), rows["split"].to_numpy(dtype=bool)[first]


def _between(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], linkage: str) -> np.ndarray:
    """[i, j]: the sum (average linkage, Euclidean) or the largest (complete linkage, Manhattan) of the distances between the members of two
    clusters. Strips of whole clusters are worked on at once."""
    (va, wa, ca, fa, _, _), (vb, wb, cb, fb, _, _) = one, other
    fold = np.add if linkage == "average" else np.maximum
    out, ends, i = np.empty((len(ca), len(cb))), np.r_[fa[1:], len(va)], 0
    while i < len(ca):
        j = max(i + 1, int(np.searchsorted(ends, fa[i] + STRIP_ROWS, side="right")))
        at = slice(fa[i], ends[j - 1])
        d = BK.euclidean_tile(va[at], vb) if linkage == "average" else BK.distance_tile(va[at], vb, "manhattan")
        if linkage == "average" and not (wa[at].max() == wb.max() == 1.0):
            d = d * wa[at, None] * wb
        if len(cb) < len(vb):
            d = fold.reduceat(d, fb, axis=1)
        out[i:j] = d if j - i == len(va[at]) else fold.reduceat(d, fa[i:j] - fa[i], axis=0)
        i = j
    return out


def _largest(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], all_pairs: np.ndarray | bool) -> np.ndarray:
    """``_between`` of complete linkage from 16-bit distances: those that may be the largest of their pair are added up. Of pairs that aren't in
    ``all_pairs`` only the ones that may be the nearest of a row or a column get their distance, the others inf."""
    (va, _, ca, fa, _, _), (vb, _, cb, fb, _, _) = one, other
    found = BK.manhattan_bounds(va, vb) if len(va) * len(vb) > BK.STRIP else None
    if found:
        rough, slack = found[0], int(np.ceil(2 * found[2])) + 1
        most = rough if len(cb) == len(vb) else np.maximum.reduceat(rough, fb, axis=1)
        most = (most if len(ca) == len(va) else np.maximum.reduceat(most, fa, axis=0)).astype(np.int32)
        wanted = np.broadcast_to(all_pairs, most.shape)
        if not wanted.all():
            others = np.where(ca[:, None] == cb[None, :], 1 << 20, most)
            wanted = wanted | (((others <= others.min(axis=1, keepdims=True) + slack) | (others <= others.min(axis=0, keepdims=True) + slack)) & (others < 1 << 20))
        ga, gb = (np.repeat(np.arange(len(f)), np.diff(np.r_[f, n])) for f, n in ((fa, len(va)), (fb, len(vb))))
        least = np.where(wanted, most - slack, 1 << 20)
        i, j = np.nonzero(rough >= (least if least.shape == rough.shape else least[ga][:, gb]))
        if len(i) <= rough.size // 4:
            out = np.where(wanted, -1.0, np.inf)
            np.maximum.at(out, (ga[i], gb[j]), BK.pair_manhattan(va, vb, i, j))
            return out
    return _between(one, other, "complete")


def _member_kernel(linkage: str, matrix: bool):
    """A tile of members as a tile of clusters: all of it (``matrix``: ids and sums or maxima as bytes), or the nearest other cluster of each
    cluster that lies whole in its block, and the parts (``open``) of pairs with a cluster that is split over blocks."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = BK.split_tile(pdf)
        suite, key = pdf["suite"].iloc[0], pdf["suite"].dtype
        out = []
        if len(a) and len(b):
            one = _cluster_side(a)
            other = one if same else _cluster_side(b)
            ca, cb, split = one[2], other[2], one[5][:, None] | other[5][None, :]
            m = _between(one, other, linkage) if linkage == "average" else _largest(one, other, matrix or split)
            if matrix:
                return pd.DataFrame({"suite": [suite], "same": [same], "a": [ca], "b": [cb], "m": [m.tobytes()]})
            if split.any():
                i, j = np.nonzero(split & ((ca[:, None] < cb[None, :]) if same else (ca[:, None] != cb[None, :])))
                out.append(pd.DataFrame({"suite": suite, "a": np.minimum(ca[i], cb[j]), "b": np.maximum(ca[i], cb[j]), "d": m[i, j], "open": True}))
            if linkage == "average":
                m /= one[4][:, None] * other[4][None, :]
            m[split | (ca[:, None] == cb[None, :]) | np.isnan(m)] = np.inf
            for d, ids, others in ((m, ca, cb),) if same else ((m, ca, cb), (m.T, cb, ca)):
                to = d.argmin(axis=1)  # clusters are in id order: of equally near ones the smallest id
                least = d[np.arange(len(ids)), to]
                ok = np.isfinite(least)
                out.append(pd.DataFrame({"suite": suite, "a": ids[ok], "b": others[to[ok]], "d": least[ok], "open": False}))
        if out:
            return pd.concat(out, ignore_index=True)
        empty = {"suite": pd.Series(dtype=key), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")}
        return pd.DataFrame({"suite": empty["suite"], "same": [], "a": [], "b": [], "m": []} if matrix else {**empty, "open": pd.Series(dtype="bool")})

    return kernel


def _chain(d: np.ndarray, n: np.ndarray, linkage: str) -> list[tuple[int, float, int, float, float]]:
    """All merges (kept place, its size, the other's, its size, height) of clusters with distances ``d`` (inf: never), by chains of nearest
    neighbours: average and complete linkage are reducible, so two that are each other's nearest merge whatever else does."""
    d, n, out, chain = d.copy(), n.copy(), [], []
    place = np.arange(len(n))
    live = np.ones(len(n), dtype=bool)
    while True:
        if not chain:
            starts = np.flatnonzero(live)
            if len(starts) < 2:
                return out
            if 2 * len(starts) < len(live):  # drop what is merged
                d, n, place, live = d[np.ix_(starts, starts)], n[starts], place[starts], live[starts]
                starts = np.arange(len(starts))
            chain = [int(starts[0])]
        at = chain[-1]
        to = int(d[at].argmin())
        if len(chain) > 1 and d[at, chain[-2]] == d[at, to]:
            to = chain[-2]
        if not np.isfinite(d[at, to]):  # as near to nothing
            live[at] = False
            d[at], d[:, at] = np.inf, np.inf
            chain.pop()
        elif len(chain) > 1 and to == chain[-2]:
            i, j = min(at, to), max(at, to)
            out.append((int(place[i]), n[i], int(place[j]), n[j], float(d[i, j])))
            row = np.maximum(d[i], d[j]) if linkage == "complete" else (n[i] * d[i] + n[j] * d[j]) / (n[i] + n[j])
            row[[i, j]] = np.inf
            d[i], d[:, i] = row, row
            d[j], d[:, j] = np.inf, np.inf
            n[i] += n[j]
            live[j] = False
            del chain[-2:]
        else:
            chain.append(to)


def _chain_kernel(linkage: str):
    """The merges of a suite that is down to ``FINISH`` clusters, from its tiles of cluster distances."""

    def kernel(sizes: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("c")
        ids, n = sizes["c"].to_numpy(), sizes["size"].to_numpy(dtype=float)
        d = np.zeros((len(ids), len(ids)))
        for same, a, b, m in zip(tiles["same"], tiles["a"], tiles["b"], tiles["m"]):
            part = np.frombuffer(m).reshape(len(a), len(b))
            i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
            for x, y, p in ((i, j, part),) if same else ((i, j, part), (j, i, part.T)):  # a cluster comes once in a block
                d[np.ix_(x, y)] = np.maximum(d[np.ix_(x, y)], p) if linkage == "complete" else d[np.ix_(x, y)] + p
        if linkage == "average":
            d /= n[:, None] * n[None, :]
        d[np.isnan(d)] = np.inf
        np.fill_diagonal(d, np.inf)
        rows = _chain(d, n, linkage)
        left, right = (ids[[r[i] for r in rows]] if rows else ids[:0] for i in (0, 2))
        return pd.DataFrame({"suite": pd.Series([sizes["suite"].iloc[0] if len(sizes) else None] * len(rows), dtype=sizes["suite"].dtype), "left": left,
                             "left_size": np.array([r[1] for r in rows], dtype="int64"), "right": right, "right_size": np.array([r[3] for r in rows], dtype="int64"),
                             "height": np.array([r[4] for r in rows], dtype="float64")})

    return kernel


def member_tree(items: DataFrame, linkage: str, vec: str = "z", block_size: int = BK.DEFAULT_BLOCK) -> DataFrame:
    """``merge_tree`` for linkages that no size and sum gives: ``average`` on Euclidean and ``complete`` on Manhattan distance, from the
    distances of the members. Both are reducible: a round merges all pairs of mutually nearest clusters. Small clusters lie whole in one block of
    members, large ones are split over all blocks; a tile of members gives a tile of clusters. A suite that is down to ``FINISH`` clusters
    sends their distances to one task of that bounded size, which does the other merges. Rows that share an id are one item of their number's weight."""
    if linkage not in ("average", "complete"):
        raise ValueError(f"not a linkage of members' distances: {linkage}")
    members = items.groupBy("suite", "method_seq").agg(F.min(vec).alias("v"), F.count("*").alias("w"))
    members = cut_lineage(members.withColumn("c", F.col("method_seq")))
    key, seq = BK.key_type(items), BK.key_type(items, "method_seq")
    schema = f"suite {key}, left {seq}, left_size long, right {seq}, right_size long, height double"
    merges = None
    while True:
        sizes = cut_lineage(members.groupBy("suite", "c").agg(F.sum("w").alias("size"), F.count("*").alias("_rows")))
        suites = sizes.groupBy("suite").agg(F.count("*").alias("clusters"), F.greatest(F.lit(1), F.ceil(F.sum("_rows") / block_size)).cast("int").alias("nb"))
        suites = cut_lineage(suites.withColumn("few", F.col("clusters") <= FINISH))
        # a cluster of more than half a block is split
        placed = members.join(sizes.select("suite", "c", (F.col("_rows") > block_size // 2).alias("split")), ["suite", "c"]).join(suites.select("suite", "nb", "few"), "suite")
        blk = F.pmod(F.xxhash64(F.when(F.col("split"), F.col("method_seq")).otherwise(F.col("c"))), F.col("nb")).cast("int")
        placed = BK.replicate_pairs(placed.withColumn("blk", blk))
        work = sizes.groupBy("suite").agg(F.sum("_rows").cast("double").alias("n")).agg(F.sum(F.ceil(F.col("n") / block_size) * (F.ceil(F.col("n") / block_size) + 1) / 2), F.sum(F.col("n") * F.col("n"))).first()
        dealt = placed.repartition(BK.tasks(*work), "suite", "lo", "hi")
        few = suites.filter("few").select("suite")
        if not few.isEmpty():
            tiles = dealt.filter("few").groupBy("suite", "lo", "hi").applyInPandas(_member_kernel(linkage, True), f"suite {key}, same boolean, a array<{seq}>, b array<{seq}>, m binary")
            ends = sizes.join(few, "suite", "left_semi").select("suite", "c", "size")
            last = cut_lineage(ends.groupBy("suite").cogroup(tiles.groupBy("suite")).applyInPandas(_chain_kernel(linkage), schema))
            merges = last if merges is None else merges.unionByName(last)
            members = cut_lineage(members.join(few, "suite", "left_anti"))
            if members.isEmpty():
                break
        rows = dealt.filter("not few").groupBy("suite", "lo", "hi").applyInPandas(_member_kernel(linkage, False), f"suite {key}, a {seq}, b {seq}, d double, open boolean")
        rows = cut_lineage(rows)
        near, parts = rows.filter("not open").select("suite", "a", "b", "d"), rows.filter("open").groupBy("suite", "a", "b")
        size_of = lambda name: sizes.select("suite", F.col("c").alias(name), F.col("size").alias(f"_{name}"))
        whole = parts.agg((F.sum("d") if linkage == "average" else F.max("d")).alias("d")).join(size_of("a"), ["suite", "a"]).join(size_of("b"), ["suite", "b"])
        whole = whole.withColumn("d", F.col("d") / (F.col("_a") * F.col("_b")) if linkage == "average" else F.col("d")).filter(~F.isnan("d") & (F.col("d") < float("inf")))
        whole = cut_lineage(whole.select("suite", "a", "b", "d"))  # one number for both directions
        near = near.unionByName(whole).unionByName(whole.select("suite", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        near = cut_lineage(near.groupBy("suite", "a").agg(F.min(F.struct("d", "b")).alias("m")).select("suite", "a", "m.b", "m.d"))
        back = near.select("suite", F.col("a").alias("b"), F.col("b").alias("a"))
        done = near.filter(F.col("a") < F.col("b")).join(back, ["suite", "a", "b"], "left_semi").join(size_of("a"), ["suite", "a"]).join(size_of("b"), ["suite", "b"])
        done = cut_lineage(done.select("suite", F.col("a").alias("left"), F.col("_a").alias("left_size"), F.col("b").alias("right"), F.col("_b").alias("right_size"), F.col("d").alias("height")))
        if done.isEmpty():
            break
        merges = done if merges is None else merges.unionByName(done)
        moved = done.select("suite", F.col("right").alias("c"), F.col("left").alias("_to"))
        members = cut_lineage(members.join(moved, ["suite", "c"], "left").withColumn("c", F.coalesce("_to", "c")).select("suite", "method_seq", "v", "w", "c"))
    return cut_lineage(merges)


def _cut_kernel(vertices: pd.DataFrame, merges: pd.DataFrame) -> pd.DataFrame:
    """A suite's items with their clusters: the tree without its last k - 1 merges. A cluster's name goes out with it, so each merge is the one
    step that a name takes to a smaller one."""
    ids = np.unique(vertices["method_seq"].to_numpy())
    to = np.arange(len(ids))
    k = vertices["k"].iloc[0] if len(vertices) else None
    if len(merges) and not pd.isna(k):
        merges = merges.assign(size=merges["left_size"] + merges["right_size"]).sort_values(["height", "size", "left"], ascending=[False, False, True]).iloc[max(0, int(k) - 1) :]
        to[np.searchsorted(ids, merges["right"].to_numpy())] = np.searchsorted(ids, merges["left"].to_numpy())
        while (to[to] != to).any():
            to = to[to]
    return pd.DataFrame({"suite": pd.Series([vertices["suite"].iloc[0] if len(vertices) else None] * len(ids), dtype=vertices["suite"].dtype), "method_seq": ids,
                         "cluster": np.unique(to, return_inverse=True)[1].astype("int32")})


def hierarchical(z: DataFrame, k: DataFrame, vec: str = "z", linkage: str = "ward") -> DataFrame:
    """The tree without its last k - 1 merges, (suite, method_seq, cluster) with clusters numbered by their smallest member. ``k``:
    (suite, k); ``linkage``: ``ward`` (Euclidean), ``average`` (Euclidean) or ``complete`` (Manhattan). Suites of up to ``CUT`` items
    are cut in a task, larger ones and such whose ids repeat by passes."""
    merges = merge_tree(z, "ward", vec) if linkage == "ward" else member_tree(z, linkage, vec)
    items = z.select("suite", "method_seq") if linkage == "ward" else z.select("suite", "method_seq").distinct()
    schema = f"suite {BK.key_type(z)}, method_seq {BK.key_type(z, 'method_seq')}, cluster int"
    odd = items.groupBy("suite").agg(F.count("*").alias("n"), F.count_distinct("method_seq").alias("ids"))
    odd = cut_lineage(odd.filter((F.col("n") != F.col("ids")) | (F.col("n") > CUT)).select("suite"))
    if odd.isEmpty():
        return items.join(k.select("suite", "k"), "suite", "left").groupBy("suite").cogroup(merges.groupBy("suite")).applyInPandas(_cut_kernel, schema)
    plain = [df.join(odd, "suite", "left_anti") for df in (items.join(k.select("suite", "k"), "suite", "left"), merges)]
    rest = _cut_by_passes(merges.join(odd, "suite", "left_semi").join(k.select("suite", "k"), "suite"), items.join(odd, "suite", "left_semi"))
    return plain[0].groupBy("suite").cogroup(plain[1].groupBy("suite")).applyInPandas(_cut_kernel, schema).unionByName(rest)


def _cut_by_passes(merges: DataFrame, items: DataFrame) -> DataFrame:
    last = [F.col("height").desc(), (F.col("left_size") + F.col("right_size")).desc(), F.col("left")]
    top = ranked(merges, ["suite"], last, "_r").filter(F.col("_r") < F.col("k")).select("suite", "left", "right")
    kept = merges.join(top, ["suite", "left", "right"], "left_anti").select("suite", F.col("left").alias("a"), F.col("right").alias("v"))
    roots = connected_components(kept, items.select("suite", F.col("method_seq").alias("a")), ["suite"])
    number = F.dense_rank().over(Window.partitionBy("suite").orderBy("l")) - 1
    names = roots.select("suite", "l").distinct().withColumn("cluster", number.cast("int"))
    return roots.join(names, ["suite", "l"]).select("suite", F.col("a").alias("method_seq"), "cluster")


def linkage_table(vectors: DataFrame, metric: str = "cosine", vec: str = "vec", max_depth: int = 5) -> DataFrame:
    """The merge tree of the raw vectors (cosine -> average linkage on cosine distance, otherwise ward) down to
    ``max_depth`` levels from the root: suite, metric, depth, left, left_size, right, right_size, height, size.
    Walked from the root by joins on (name, size), so only the levels asked for are read."""
    merges = merge_tree(vectors, "average" if metric == "cosine" else "ward", vec).withColumn("size", F.col("left_size") + F.col("right_size"))
    whole = vectors.groupBy("suite").agg(F.count("*").alias("size"))
    level = merges.join(whole, ["suite", "size"]).withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, max_depth):
        level = cut_lineage(level)
        below = level.select("suite", F.explode(F.array(F.struct(F.col("left").alias("left"), F.col("left_size").alias("size")),
                                                        F.struct(F.col("right").alias("left"), F.col("right_size").alias("size")))).alias("c")).select("suite", "c.*")
        level = merges.join(below, ["suite", "left", "size"]).withColumn("depth", F.lit(depth))
        out = out.unionByName(level)
    return out.select("suite", F.lit(metric).alias("metric"), "depth", "left", "left_size", "right", "right_size", "height", "size")
