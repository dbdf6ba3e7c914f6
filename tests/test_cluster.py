"""Clustering operators against small sequential numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from culler.operators import cluster as C
from culler.operators import vectors as V


def kneedle(y, S=1.5):
    """Sequential Kneedle (convex, increasing) on ascending y; returns knee y or None."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 or y.max() == y.min():
        return None
    x = np.arange(1, n + 1)
    xn = (x - x.min()) / (x.max() - x.min())
    yn = (y - y.min()) / (y.max() - y.min())
    yt = (yn.max() - yn)[::-1]
    d = yt - xn
    pad_l, pad_r = np.r_[d[0], d[:-1]], np.r_[d[1:], d[-1]]
    mx = np.where((d >= pad_l) & (d >= pad_r))[0]
    mn = np.where((d <= pad_l) & (d <= pad_r))[0]
    if not len(mx):
        return None
    tmx = d[mx] - S * np.abs(np.diff(xn).mean())
    thr, ti, mi = None, None, 0
    for i in range(n):
        if i < mx[0]:
            continue
        if xn[i] == 1.0:
            break
        if i in mx:
            thr, ti = tmx[mi], i
            mi += 1
        if i in mn:
            thr = 0.0
        if d[i + 1] < thr:
            return y[n - 1 - ti]
    return None


@pytest.mark.parametrize("seed", range(4))
def test_knee_matches_sequential(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "KNEE_BLOCK", (4096, 3, 1, 7)[seed])  # curves over one block and over many
    rng = np.random.default_rng(seed)
    curves = {s: np.sort(rng.gamma(1.0 + s, size=rng.integers(5, 40))) for s in range(6)}
    curves[6] = np.repeat(curves[0], 3)
    rows = [(s, float(v)) for s, ys in curves.items() for v in ys]
    got = {r["suite"]: r["knee_y"] for r in C.knee(spark.createDataFrame(rows, "suite int, y double"), ["suite"]).collect()}
    for s, ys in curves.items():
        exp = kneedle(ys)
        assert got.get(s) == (None if exp is None else pytest.approx(exp))


def dbscan_seq(X, eps, min_samples):
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = [np.where(D[i] <= eps)[0] for i in range(n)]
    core = np.array([len(v) >= min_samples for v in nb])
    lab = -np.ones(n, int)
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if lab[j] != -1:
                continue
            lab[j] = c
            if core[j]:
                stack += [q for q in nb[j] if lab[q] == -1]
        c += 1
    return lab


@pytest.mark.parametrize("seed", range(3))
def test_dbscan_matches_sequential(spark, seed):
    rng = np.random.default_rng(seed)
    X = np.vstack([rng.normal(0, .3, (15, 2)), rng.normal(3, .3, (12, 2)), rng.uniform(-3, 6, (6, 2))])
    rng.shuffle(X)
    df = spark.createDataFrame([(0, i, X[i].tolist()) for i in range(len(X))], "suite int, method_seq long, z array<double>")
    eps = spark.createDataFrame([(0, "euclidean", 0.5)], "suite int, metric string, eps double")
    lab = C.dbscan_grid(df, eps, metrics=["euclidean"], block_size=8).filter("cfg = 0")
    got = {r["method_seq"]: r["cluster"] for r in lab.collect()}
    ms = max(2, len(X) // 10)
    exp = dbscan_seq(X, 0.5, ms)
    assert [got[i] for i in range(len(X))] == exp.tolist()


def test_kmeans_invariants(spark, monkeypatch):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(c, .2, (10, 3)) for c in (0, 4, 8)])
    df = spark.createDataFrame([("s", i, X[i].tolist()) for i in range(len(X))], "suite string, method_seq long, z array<double>")
    runs = spark.createDataFrame([("s", 3, 0)], "suite string, k int, run int")
    monkeypatch.setattr(C, "KMEANS_CHUNK", 7)  # several chunks of a suite
    inertia, cents = C.kmeans_runs(df, runs)
    c = np.array([r["centroid"] for r in cents.orderBy("cluster").collect()])
    d = ((X[:, None] - c[None]) ** 2).sum(axis=2)
    assert inertia.first()["inertia"] == pytest.approx(d.min(axis=1).sum())
    for k in range(3):  # centroids are the means of their items
        assert c[k] == pytest.approx(X[d.argmin(axis=1) == k].mean(axis=0))


def test_kmeans_in_tasks_and_by_rounds(spark, monkeypatch):
    """The same runs with all rounds inside tasks, without a pass of Spark jobs per round, and in passes over chunks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    x[40], x[41] = x[7], x[7]  # copies: centroids may start equal
    df = spark.createDataFrame([(s, i, x[i].tolist()) for s in ("s", "t") for i in range(300 if s == "s" else 5)], "suite string, method_seq long, z array<double>")
    runs = spark.createDataFrame([("s", k, r) for k in (2, 5, 9) for r in range(3)] + [("t", 2, 0)], "suite string, k int, run int")
    passes, cut, found = [], C.cut_lineage, []
    monkeypatch.setattr(C, "cut_lineage", lambda df: passes.append(1) or cut(df))
    monkeypatch.setattr(C, "KMEANS_CHUNK", 64)
    for numbers in (1 << 23, 100):
        monkeypatch.setattr(C, "KMEANS_NUMBERS", numbers)
        passes.clear()
        inertia, cents = C.kmeans_runs(df, runs)
        assert len(passes) <= 3 or numbers == 100
        found.append({(r.suite, r.k, r.run): r.inertia for r in inertia.collect()})
        for (suite, k, run), want in found[-1].items():
            c = np.array([r.centroid for r in cents.filter(f"suite = '{suite}' and k = {k} and run = {run}").collect()])
            assert ((x[: 300 if suite == "s" else 5, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum() == pytest.approx(want)
    assert len(found[0]) == 10 and found[0] == pytest.approx(found[1])


def test_elbow_rule(spark):
    t = spark.createDataFrame([("a", k, v) for k, v in zip(range(2, 7), [100., 60., 50., 45., 43.])] + [("b", 2, 5.0), ("b", 3, 4.0)],
                              "suite string, k int, inertia double")
    got = {r["suite"]: r["k"] for r in C.elbow_k_from_inertia(t).collect()}
    d2 = np.diff(np.diff([100., 60., 50., 45., 43.]))
    assert got["a"] == min(list(range(2, 7))[int(np.argmax(d2)) + 2], 6)
    assert got["b"] == 3


def greedy_heights(x, linkage):
    """Heights of merging the nearest pair again and again, from the linkages' definitions on members."""
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1.0)
    groups, heights = [[i] for i in range(len(x))], []

    def far(a, b):
        if linkage == "average":
            return float(np.mean([1 - unit[i] @ unit[j] for i in a for j in b]))
        both = x[a + b]
        spread = lambda g: ((x[g] - x[g].mean(axis=0)) ** 2).sum()
        return float(np.sqrt(2 * (((both - both.mean(axis=0)) ** 2).sum() - spread(a) - spread(b))))

    while len(groups) > 1:
        d, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(d)
        groups[i] += groups.pop(j)
    return heights


@pytest.mark.parametrize("linkage", ["average", "ward"])
def test_merge_tree_is_the_greedy_one(spark, linkage):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(24, 3)).round(2)
    x[7] = x[3]
    rows = [("s", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("one", 0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "suite string, method_seq long, vec array<double>")
    got = sorted(r.height for r in C.merge_tree(df, linkage, block_size=10).collect())
    assert got == pytest.approx(sorted(greedy_heights(x, linkage)), abs=1e-9)


def test_large_suite_is_complete(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(172, 2)) + c for c in ((0, 0), (40, 0), (0, 40))])
    df = spark.createDataFrame([("s", i, [float(v) for v in r]) for i, r in enumerate(x)], "suite string, method_seq long, z array<double>")
    k = spark.createDataFrame([("s", 3)], "suite string, k int")
    lab = {r.method_seq: r.cluster for r in C.hierarchical(df, k).collect()}
    assert [lab[i] for i in range(516)] == [i // 172 for i in range(516)]


def test_linkage_table_walks_from_the_root(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("s", i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(20, 2)))],
                               "suite string, method_seq long, vec array<double>")
    tree = C.linkage_table(df, "euclidean", max_depth=3).collect()
    assert {r.depth for r in tree} == {0, 1, 2} and [r["size"] for r in tree if r.depth == 0] == [20]
    for r in tree:
        assert r.left_size + r.right_size == r["size"]
    below = sorted(r["size"] for r in tree if r.depth == 1)
    root = next(r for r in tree if r.depth == 0)
    assert below == sorted(n for n in (root.left_size, root.right_size) if n > 1)


def test_hierarchical_gives_any_k(spark):
    rng = np.random.default_rng(12)
    rows = [("s", i, rng.normal(size=3).tolist()) for i in range(60)]
    z = spark.createDataFrame(rows, "suite string, method_seq long, z array<double>")
    lab = C.hierarchical(z, spark.createDataFrame([("s", 30)], "suite string, k int"))
    assert lab.select("cluster").distinct().count() == 30


@pytest.mark.parametrize("linkage", ["average", "ward"])
def test_merge_tree_is_the_same_by_passes_and_in_one_task(spark, linkage, monkeypatch):
    x = np.random.default_rng(5).normal(size=(40, 3)).round(1)
    x[9], x[30], x[31] = x[2], x[2], x[17]  # copies: equal distances
    df = spark.createDataFrame([("s", i, [float(v) for v in r]) for i, r in enumerate(x)], "suite string, method_seq long, vec array<double>")
    trees = []
    for few in (0, 7, 4096):
        monkeypatch.setattr(C, "FINISH", few)
        trees.append(sorted(map(tuple, C.merge_tree(df, linkage, block_size=10).collect())))
    assert len(trees[0]) == 39 and trees[0] == trees[1] == trees[2]


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_member_tree_is_the_greedy_one(spark, linkage, monkeypatch):
    """By passes (also with clusters that are split over blocks) and in one task; equal points and a lone one."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3))
    x[9], x[30] = x[2], x[2]
    x[12:25] = x[11] + 0.01 * rng.normal(size=(13, 3))  # a cluster larger than half a block
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) if linkage == "average" else np.abs(x[:, None] - x[None]).sum(-1)
    groups, want, cut = [[i] for i in range(40)], [], None
    while len(groups) > 1:
        fold = np.mean if linkage == "average" else np.max
        d, i, j = min((fold(far[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        want.append(d)
        groups[i] = groups[i] + groups.pop(j)
        cut = [sorted(g) for g in groups] if len(groups) == 6 else cut
    rows = [("s", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("one", 0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "suite string, method_seq long, z array<double>")
    for few in (0, 7, 4096):
        monkeypatch.setattr(C, "FINISH", few)
        got = sorted(r.height for r in C.member_tree(df, linkage, block_size=10).collect())
        assert got == pytest.approx(sorted(want), abs=1e-9)
    lab = {r.method_seq: r.cluster for r in C.hierarchical(df, spark.createDataFrame([("s", 6), ("one", 1)], "suite string, k int"), linkage=linkage).filter("suite = 's'").collect()}
    assert sorted([i for i in lab if lab[i] == c] for c in set(lab.values())) == sorted(cut)


def test_largest_distances_by_the_fast_form():
    """Clusters' largest Manhattan distances from 16-bit numbers are those of the plain tile; asked for the nearest, they are among them."""
    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.normal(size=(420, 4)).round(1)
    side = lambda at, c: C._cluster_side(pd.DataFrame({"c": c, "method_seq": at, "v": list(x[at]), "w": 1, "split": False}))
    one, other = side(np.arange(200), np.repeat(np.arange(100), 2)), side(np.arange(200, 420), 200 + np.arange(220) % 70)
    for a, b in ((one, other), (one, one)):
        plain = C._between(a, b, "complete")
        assert (C._largest(a, b, True) == plain).all()
        apart = np.where(a[2][:, None] == b[2][None, :], np.inf, plain)
        near = C._largest(a, b, False)
        near[a[2][:, None] == b[2][None, :]] = np.inf
        assert (near[np.isfinite(near)] == apart[np.isfinite(near)]).all() and np.isinf(near).any()
        assert (near.min(axis=1) == apart.min(axis=1)).all() and (near.min(axis=0) == apart.min(axis=0)).all()
        assert (near.argmin(axis=1) == apart.argmin(axis=1)).all()


@pytest.mark.parametrize("linkage", ["average", "ward"])
def test_merges_without_a_matrix_are_the_passes_ones(linkage, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3)).round(1)
    x[40:60] = x[7] + rng.normal(size=(20, 3)).round(1) / 10
    if linkage == "average":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(C, "ALONE_NUMBERS", 1000)
    got = []
    for finish in (0, 20, 90):
        pdf = pd.DataFrame({"suite": "s", "method_seq": np.arange(90), "size": 1, "v": list(x)})
        got.append(sorted(map(tuple, C._finish_kernel(linkage, finish)(pdf).to_numpy())))
    assert len(got[0]) == 89 and got[0] == got[1] == got[2]


def test_grid_has_all_nine_cells(spark):
    from culler.plans.pipeline import cluster_grid
    rng = np.random.default_rng(2)
    z = spark.createDataFrame([("s", i, (rng.normal(size=3) + 8 * (i % 3)).tolist()) for i in range(30)], "suite string, method_seq long, z array<double>")
    runs, _, cells = cluster_grid(z)
    got = {(r.algorithm, r.metric): r.quality for r in runs.collect()}
    assert len(cells) == 9 and set(got) == set(cells) and got["hierarchical", "cosine"] > 0 and got["hierarchical", "manhattan"] > 0


def test_merge_tree_needs_few_passes(spark, monkeypatch):
    """Points of which one pair merges a round: no pass of Spark jobs a merge."""
    passes, run_pairs = [], C.BK.run_pairs
    monkeypatch.setattr(C.BK, "run_pairs", lambda *a, **k: passes.append(1) or run_pairs(*a, **k))
    df = spark.createDataFrame([("s", i, [2.0**i]) for i in range(20)], "suite string, method_seq long, vec array<double>")
    assert C.merge_tree(df, "ward").count() == 19
    assert len(passes) <= 1


def test_dbscan_links_leave_a_tile_once(monkeypatch):
    """One distance tile and one set of stars for both directions of two blocks; degrees are of both."""
    import pandas as pd

    x = np.random.default_rng(3).normal(size=(40, 2))
    pdf = pd.DataFrame({"suite": 0, "metric": "euclidean", "method_seq": np.arange(40), "z": list(x), "eps": [np.array([0.7])] * 40,
                        "core": [np.array([True])] * 40, "comp": [np.array([i if i % 3 else -1]) for i in range(40)], "lo": 0, "hi": 1, "blk": np.repeat([0, 1], 20)})
    tiles, tile = [], C.BK.distance_tile
    monkeypatch.setattr(C.BK, "distance_tile", lambda *a: tiles.append(1) or tile(*a))
    out = {p: C._dbscan_kernel(["euclidean"], 1, "z", p)(pdf) for p in ("degree", "edges", "border")}
    assert len(tiles) == 3 and not out["edges"]["a"].duplicated().any()
    near = tile(x, x, "euclidean") <= 0.7
    for a in range(40):
        other = np.arange(20, 40) if a < 20 else np.arange(20)
        assert out["degree"].set_index("a").v[a] == near[a, other].sum()
        cores = [o for o in other[near[a, other]] if o % 3]
        assert out["border"].set_index("a").v.get(a) == (min(cores) if a % 3 == 0 and cores else None)


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e200])
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_fast_tiles_decide_like_plain_ones(metric, scale, monkeypatch):
    """Also where an eps is exactly a distance, and for numbers beyond what the fast form holds."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(200, 5)) * scale, rng.normal(size=(150, 5)) * scale
    b[:20] = a[:20]
    tile, plain = C.BK.distance_tile(a, b, metric), []
    monkeypatch.setattr(C.BK, "distance_tile", lambda *x: plain.append(1) or tile)
    within = C.BK.within_tile(a, b, metric, (np.array([3]), np.array([90])))
    for eps in (0.0, float(tile[30, 40]), float(np.median(tile)), float(tile.max()), float("nan")):
        want = tile <= eps
        want[3, 90] |= eps >= 0
        assert (within(eps) == want).all()
    assert scale != 1.0 or not plain


def test_dbscan_between_blocks_links_components_not_points(monkeypatch):
    """Two blocks whose points are one component each have one link; without core points no distance is taken."""
    import pandas as pd

    n = 300
    x = np.random.default_rng(3).normal(size=(n, 2))
    pdf = pd.DataFrame({"suite": 0, "metric": "euclidean", "method_seq": np.arange(n), "z": list(x), "eps": [np.array([9.0])] * n, "core": [np.array([True])] * n,
                        "root": [np.array([0 if i < 150 else 150]) for i in range(n)], "lo": 0, "hi": 1, "blk": np.repeat([0, 1], 150)})
    kernel = C._dbscan_kernel(["euclidean"], 1, "z", "edges")
    assert kernel(pdf)[["a", "v"]].values.tolist() == [[150, 0]]
    monkeypatch.setattr(C.BK, "within_tile", lambda *a: pytest.fail("a tile was computed"))
    assert len(kernel(pdf.assign(core=[np.array([False])] * n))) == 0


def test_stars_of_dense_and_sparse_graphs(monkeypatch):
    rng = np.random.default_rng(9)
    for share in (0.001, 0.02, 0.3, 1.0):
        adj = rng.random((130, 90)) < share
        adj[:60, 40:] = adj[60:, :40] = False
        stars = []
        for dense in (1, 10**9):
            monkeypatch.setattr(C, "DENSE", dense)
            stars.append([x.tolist() for x in C._star_edges(adj, np.arange(130) // 2, 1000 + np.arange(90))])
        assert stars[0] == stars[1]
