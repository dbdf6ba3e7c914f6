"""Round-robin selection and CIP against a direct loop over the documented rules."""

import random

import pytest

from culler.operators import coverage as C
from culler.operators import select as S


def loop_select(items, n):
    """Sequential statement of L3: firsts of clusters in order, outliers, then round robin."""
    clusters = {}
    for seq, c in sorted(items):
        clusters.setdefault(c, []).append(seq)
    regular = sorted(k for k in clusters if k >= 0)
    picked, idx = [], {k: 0 for k in regular}
    for k in regular:
        if len(picked) < n:
            picked.append(clusters[k][0])
            idx[k] = 1
    if len(picked) < n:
        picked += clusters.get(-1, [])[: n - len(picked)]
    while len(picked) < n and any(idx[k] < len(clusters[k]) for k in regular):
        for k in regular:
            if len(picked) < n and idx[k] < len(clusters[k]):
                picked.append(clusters[k][idx[k]])
                idx[k] += 1
    return picked


@pytest.mark.parametrize("seed", range(6))
def test_round_robin_matches_loop(spark, seed):
    rnd = random.Random(seed)
    rows, expect = [], {}
    for s in range(3):
        size = rnd.choice([1, 2, 5, 6, 11, 12])
        items = [(i, rnd.choice([-1, 0, 1, 2, 3])) for i in range(size)]
        n = rnd.choice([0, 1, 2, 3, 10, 20])
        rows += [(f"s{s}", i, c, n) for i, c in items]
        expect[f"s{s}"] = (loop_select(items, n), n)
    df = spark.createDataFrame(rows, "suite string, method_seq long, cluster int, n int")
    for suite, (exp, n) in expect.items():
        got = S.select_round_robin(df.filter(f"suite = '{suite}'"), n).orderBy("pick_order").select("method_seq").collect()
        assert [r[0] for r in got] == exp


def test_only_outliers_and_empty(spark):
    df = spark.createDataFrame([("a", i, -1) for i in range(4)], "suite string, method_seq long, cluster int")
    assert [r[0] for r in S.select_round_robin(df, 2).orderBy("pick_order").select("method_seq").collect()] == [0, 1]
    assert S.select_round_robin(df, 0).count() == 0


def test_cip(spark):
    ex = spark.createDataFrame([("a", 1, "x\ny\n"), ("a", 2, "y\nz"), ("a", 3, "  \n"), ("b", 1, "")],
                               "suite string, method_seq long, code string")
    sel = spark.createDataFrame([("a", 1)], "suite string, method_seq long")
    got = {r["suite"]: (r["total"], r["covered"], r["cip"]) for r in C.cip(ex, sel).collect()}
    assert got["a"] == (3, 2, pytest.approx(200 / 3))
    assert got["b"] == (0, 0, 0.0)


def test_positional_join_of_different_lengths_is_an_error(spark):
    from culler.operators import select as S

    a = spark.createDataFrame([("s", 1, "x"), ("s", 2, None)], "suite string, method_seq long, name string")
    b = spark.createDataFrame([("s", 1, "c"), ("s", 2, "d")], "suite string, method_seq long, clean string")
    assert S.join_positional(a, b).count() == 2
    for left, right in ((a, b.limit(1)), (a.limit(1), b)):
        with pytest.raises(Exception, match="lists of different length"):
            S.join_positional(left, right).collect()
