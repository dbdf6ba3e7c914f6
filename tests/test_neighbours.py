"""Inverted-list neighbour search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from culler.operators import neighbours as N
from culler.plans.fixtures import method_vectors


def exact(rows, k):
    """id -> [(score, other)] of the k most similar others, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {int(i): sorted((-round(s[a, b], 9), int(j)) for b, j in enumerate(ids) if j != i)[:k] for a, i in enumerate(ids)}


def found(df, **kw):
    out = {}
    for r in df.sparkSession.createDataFrame(N.ann_topk(df, **kw).collect()).orderBy("a", "rank").collect():
        out.setdefault(r.a, []).append((-round(r.score, 9), r.b))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, sf):
    rows = [(r.method_seq, r.vec) for r in method_vectors(spark, f"/root/testdata/{sf}").select("method_seq", "vec").collect()]
    want = exact(rows, 5)
    got = found(method_vectors(spark, f"/root/testdata/{sf}"), k=5)
    hits = sum(len({b for _, b in got[i]} & {b for _, b in want[i]}) for i in want)
    assert hits >= 0.9 * 5 * len(want) and all(len(got[i]) == 5 for i in want)


def clustered(rng, n, dims=8):
    centres = rng.normal(size=(12, dims)) * 3
    return [(i, (centres[rng.integers(12)] + rng.normal(size=dims)).tolist()) for i in range(n)]


def test_deep_trees_copies_and_vectors_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(N, "BRANCH", 4)
    monkeypatch.setattr(N, "GROUP", 100)
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = clustered(rng, 400)
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # a large class of copies
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] + [1.0] * 7), (5003, [None] + [1.0] * 7), (5004, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows + odd], "method_seq long, vec array<double>, suite string, u double")
    index, asked = N.inverted_lists(df.filter("method_seq < 400").select(F.col("method_seq").alias("id"), F.col("vec").alias("u")), 8, 6)
    assert index.count() == 400 and index.groupBy("cell").count().agg(F.max("count")).first()[0] <= 8 * N.SPLIT
    assert asked.groupBy("id").count().agg(F.max("count")).first()[0] <= 6
    got, want = found(df, k=4, list_size=8, probes=6), exact(rows, 4)
    assert set(got) == set(want) and all(len(v) == 4 for v in got.values())
    for i in (5, 1000, 1001, 1004, 1005, 1199):  # copies: the smallest other ids of the class
        assert [b for _, b in got[i]] == [b for _, b in want[i]]
    hits = sum(len(set(got[i]) & set(want[i])) for i in range(400))
    assert hits >= 0.85 * 4 * 400


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0])], "method_seq long, vec array<double>")
    assert {i: [b for _, b in v] for i, v in found(df, k=5).items()} == {1: [2, 3], 2: [1, 3], 3: [2, 1]}
    assert N.ann_topk(df.filter("false")).count() == 0 and N.ann_topk(df.limit(1)).count() == 0
