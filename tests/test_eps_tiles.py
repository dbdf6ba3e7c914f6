"""Pruned tiles: no pair within eps is lost, and tiles out of reach are never met."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from culler.operators import blocks as BK
from culler.operators import eps_tiles as EPS


def _count(eps):
    def kernel(pdf):
        out = []
        metric = pdf["metric"].iloc[0]
        for qa, va, cb, vb in BK.directions(pdf, "z"):
            if len(qa) and len(cb):
                near = (BK.distance_tile(va, vb, metric) <= eps[metric]) | (qa["method_seq"].to_numpy()[:, None] == cb["method_seq"].to_numpy()[None, :])
                out.append(pd.DataFrame({"suite": pdf["suite"].iloc[0], "metric": metric, "a": qa["method_seq"], "n": near.sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"suite": [], "metric": [], "a": [], "n": []})

    return kernel


@pytest.mark.parametrize("eps", [{"cosine": 0.01, "euclidean": 0.3, "manhattan": 0.4}, {"cosine": 1.0, "euclidean": 9.0, "manhattan": 30.0}])
def test_no_pair_is_lost(spark, eps):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 3)) * 4
    x = np.concatenate([centres[rng.integers(0, 6, 200)] + rng.normal(size=(200, 3)) * 0.1, np.zeros((2, 3)), np.ones((30, 3))])
    z = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "suite string, method_seq long, z array<double>")
    asked = spark.createDataFrame([("s", m, e) for m, e in eps.items()], "suite string, metric string, eps double")
    placed, tiles = EPS.place(z, asked, block_size=9)
    got = EPS.run(z, placed, tiles, _count(eps), "suite {suite}, metric string, a long, n long").groupBy("metric", "a").agg(F.sum("n").alias("n")).collect()
    for m in BK.METRICS:
        near = BK.distance_tile(x, x, m) <= eps[m]
        np.fill_diagonal(near, True)
        assert {r.a: r.n for r in got if r.metric == m} == dict(enumerate(near.sum(axis=1)))
    met = {r.metric: r.tiles / r.all_tiles for r in EPS.share(placed, tiles).collect()}
    assert met["euclidean"] < 0.5 if eps["euclidean"] < 1 else met["manhattan"] > 0.9


@pytest.mark.parametrize("copies", [2, 1000])
def test_items_are_copied_once_for_a_bundle_of_blocks(spark, copies, monkeypatch):
    """Tiles of bundles are all tiles, each once; an item goes to a bundle pair, not to each pair of blocks."""
    monkeypatch.setattr(BK, "COPIES", copies)
    items = spark.createDataFrame([("s", i) for i in range(60)] + [("t", 0)], "suite string, method_seq long")

    def kernel(pdf):
        a, b, same = BK.split_tile(pdf)
        pairs = [(i, j) for i in a["method_seq"] for j in b["method_seq"] if not same or i < j]
        return pd.DataFrame({"suite": pdf["suite"].iloc[0], "a": [min(p) for p in pairs], "b": [max(p) for p in pairs]})

    made = BK.run_pairs(items, ["suite"], kernel, "suite {suite}, a long, b long", block_size=4)
    got = [(r.a, r.b) for r in made.collect()]
    assert sorted(got) == [(i, j) for i in range(60) for j in range(i + 1, 60)]
    per = BK.bundle_of(15)
    assert -(-15 // per) == (2 if copies == 2 else 15)
