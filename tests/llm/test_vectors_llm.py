"""Embedding near-duplicates and neighbour search against brute force; components against union-find."""

import random
from collections import defaultdict

import numpy as np
import pytest

from culler.llm import cross_polytope, embed_dedup
from culler.llm.components import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int, dims string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y") for i, v in rows], SCHEMA)


def vectors(n=400, d=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    rows = [(i, v) for i, v in enumerate(base)]
    at = n
    for c in range(12):  # near copies around the threshold, and chains of them
        v = base[c]
        for _ in range(int(rng.integers(1, 12))):
            v = v + rng.standard_normal(d) * 0.4
            rows.append((at, v))
            at += 1
    rows += [(at + i, base[50]) for i in range(60)]  # equal vectors
    at += 60
    near = base[60] + rng.standard_normal((150, d)) * 0.05  # a hot group of near copies
    rows += [(at + i, v) for i, v in enumerate(near)]
    at += 150
    bad = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [None] + [1.0] * (d - 1), []]
    rows += [(at + i, v) for i, v in enumerate(bad)]
    rows += [(at + 50, [2.0 * x for x in base[50]]), (at + 51, [1.0, 2.0]), (at + 52, [2.0, 4.0]), (3, base[3])]
    return rows


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def unit(v):
    x = np.asarray(v, dtype=np.float32).astype(float)
    return x / np.sqrt((x * x).sum())


def components_of(ids, pairs):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 32])
def test_near_duplicates(spark, block):
    rows = vectors()
    out = embed_dedup.near_duplicates(frame(spark, rows), recall=0.9999, block=block).collect()
    ok = [(k, i, unit(v)) for k, (i, v) in enumerate(rows) if good(v)]
    links, pairs = defaultdict(int), []
    for k, i, x in ok:
        for m, j, y in ok:
            if k != m and len(x) == len(y) and x @ y >= 0.9:
                links[k] += 1
                pairs.append((i, j))
    comp = components_of({i for i, _ in rows}, pairs)
    want = sorted((i, links[k], comp[i], comp[i] == i) for k, (i, _) in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == want


def test_near_duplicates_without_ids_or_rows(spark):
    df = frame(spark, [(None, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0])])
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert out == {None: (0, None, True), 2: (1, 1, False), 1: (1, 1, True)}
    assert embed_dedup.near_duplicates(df.filter("false")).count() == 0


def test_near_duplicates_of_ids_that_repeat(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, x), (5, y), (5, y), (7, [1.0, 0.01, 0.0]), (9, [0.0, 1.0, 0.01]), (3, z), (5, [0.01, 0.0, 1.0]), (8, [2.0, 0.0, 0.0])]
    out = embed_dedup.near_duplicates(frame(spark, rows), recall=0.9999).collect()
    want = [(5, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 2, 5), (3, 1, 3), (5, 1, 3), (8, 2, 5)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == sorted(want)


def test_tables_reach_the_recall():
    rng = np.random.default_rng(0)
    bits, tables = embed_dedup.tables_for(50_000)
    x = embed_dedup.unit_rows(rng.standard_normal((3000, 32)))
    r = rng.standard_normal(x.shape)
    r = embed_dedup.unit_rows(r - (r * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * r
    met = (embed_dedup.sign_buckets(x, bits, tables) == embed_dedup.sign_buckets(y, bits, tables)).any(axis=1)
    assert met.mean() > 0.995


@pytest.mark.parametrize("chunk", [2048, 64])
def test_neighbours(spark, chunk):
    rows = vectors(n=900)
    out = cross_polytope.nearest(frame(spark, rows), chunk=chunk).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = {i: unit(v) for i, v in rows if good(v)}
    hit = total = 0
    for q in [i for i in ok if i % 50 == 0]:
        score = {i: float(ok[q] @ x) for i, x in ok.items() if i != q and len(x) == len(ok[q])}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert [k for k, _, _ in found[q]] == list(range(1, len(best) + 1))
        for _, i, s in found[q]:
            assert s == pytest.approx(score[i], abs=1e-12)
        hit += len({i for _, i, _ in found[q]} & set(best))
        total += len(best)
    assert set(found) == {i for i in ok if i % 50 == 0}
    assert hit / total >= 0.97


def test_few_candidates_are_all_found(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16)) for i in range(48, 53)] + [(100, [1.0, 2.0, 3.0]), (0, None), (150, [1.0])]
    out = cross_polytope.nearest(frame(spark, rows), tables=1, probes=1).collect()
    assert sorted(r.vec_id for r in out if r.query_id == 50) == [48, 49, 51, 52]
    assert {r.query_id for r in out} == {50}
    assert cross_polytope.nearest(frame(spark, rows[:0])).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 16))
    h = cross_polytope.hadamard(x)
    assert np.allclose((h * h).sum(axis=1), (x * x).sum(axis=1)) and np.allclose(cross_polytope.hadamard(h), x)


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)]  # a chain
    pairs += [(1000, 1000 + i) for i in range(1, 200)]  # a hub
    pairs += [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(230)] + [(7, 7), (61, 2500)]
    rnd.shuffle(pairs)
    df = spark.createDataFrame([*pairs, *pairs[:9], (None, 5)], "a long, b long")
    want = components_of({x for p in pairs for x in p}, pairs)
    want = {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert {r.id: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.filter("false")).count() == 0
