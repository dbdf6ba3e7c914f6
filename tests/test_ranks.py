"""Ranks over range partitions against sorted lists."""

import random

from pyspark.sql import functions as F

from culler.operators.ranks import ranked


def test_ranks_of_groups_that_span_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(50), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, x int, id long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(df, ["g"], [F.col("x").desc(), F.col("id")]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for g in {r[0] for r in rows}:
        for k, (_, i) in enumerate(sorted((-x, i) for h, x, i in rows if h == g), 1):
            want[i] = k
    assert {r.id: r["rank"] for r in out} == want and len(out) == len(rows)


def test_ranks_without_groups_and_of_nothing(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("id"))
    assert all(r.place == r.id + 1 for r in ranked(df, [], [F.col("id")], "place").collect())
    assert ranked(df.filter("false"), [], [F.col("id")]).count() == 0


def test_quantiles_against_numpy(spark):
    import numpy as np

    from culler.operators.ranks import quantiles

    rng = np.random.default_rng(1)
    rows = [(g, None if rng.random() < 0.1 else float(rng.integers(0, 7) if g == "few" else rng.normal())) for g in ["few"] * 500 + ["many"] * 800 + ["one"] + [None] * 9]
    out = quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.97}).collect()
    for r in out:
        values = [x for g, x in rows if g == r.g and x is not None]
        assert np.allclose([r.lo, r.mid, r.hi], np.quantile(values, [0.1, 0.5, 0.97]))
    assert len(out) == len({g for g, x in rows if x is not None})
