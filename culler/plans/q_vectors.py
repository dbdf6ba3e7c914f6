"""Queries over F2 (embeddings as vectors), F1 (hashing embedder) and F4 (token
vectors): B1-B16, K7-K9, Q1-Q5, A2, A8, G1-G3, L1, L2, L5, W1, W2, U4."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from culler.operators import quality as Q
from culler.operators import neighbours as N
from culler.operators import vectors as V
from culler.operators.ranks import ranked
from culler.plans.fixtures import F1_SQL, F2_SQL, F2O_SQL, F4_SQL, method_vectors, round6, suite_methods, token_vectors
from culler.plans.registry import register
from culler.session import cut_lineage


def _long(df, vec, name="value"):
    return df.select("suite", "method_seq", F.posexplode(vec).alias("dim", name)).select(
        "suite", "method_seq", F.col("dim").cast("long").alias("dim"), round6(name).alias(name))


# ---------------- SQL building blocks ----------------

def z_sql(src: str = F2_SQL) -> str:
    """Standardized vectors per suite (population std, zero -> 1), as lists."""
    return f"""
f AS ({src}),
u AS (SELECT f.suite, f.method_seq, f.cluster, t.x, t.i - 1 AS dim FROM f, unnest(f.vec) WITH ORDINALITY AS t(x, i)),
st AS (SELECT suite, dim, avg(x) AS mu, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM u GROUP BY ALL),
zl AS (SELECT u.suite, u.method_seq, u.cluster, u.dim, (u.x - st.mu) / st.sd AS z FROM u JOIN st USING (suite, dim)),
z AS (SELECT suite, method_seq, any_value(cluster) AS cluster, list(z ORDER BY dim) AS v FROM zl GROUP BY suite, method_seq)"""


def pairs_sql(src_view: str) -> str:
    """All pairs inside a suite with the three distances (oracle side only)."""
    return f"""
pairs AS (SELECT a.suite, a.method_seq AS a, b.method_seq AS b, a.cluster AS ca, b.cluster AS cb,
    greatest(0.0, least(2.0, 1 - list_cosine_similarity(a.v, b.v))) AS cosine,
    list_distance(a.v, b.v) AS euclidean,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) AS manhattan
  FROM {src_view} a JOIN {src_view} b ON a.suite = b.suite)"""


RAW_SQL = f"""f AS ({F2_SQL}), r AS (SELECT suite, method_seq, cluster, vec AS v FROM f)"""


@register("standardize", f"WITH {z_sql()} SELECT suite, method_seq, CAST(dim AS BIGINT) AS dim, round(z, 6) AS value FROM zl")
def q_standardize(spark, sf):
    return _long(V.standardize(method_vectors(spark, sf)), "z")


# ---------------- distances of each item to its cluster centroid ----------------

CENT_SQL = f"""
WITH {RAW_SQL},
u AS (SELECT r.suite, r.cluster, t.x, t.i AS dim FROM r, unnest(r.v) WITH ORDINALITY AS t(x, i)),
c AS (SELECT suite, cluster, list(mu ORDER BY dim) AS cv FROM (SELECT suite, cluster, dim, avg(x) AS mu FROM u GROUP BY ALL) GROUP BY ALL)"""


def _dist_query(metric, sql_expr):
    def q(spark, sf):
        m = method_vectors(spark, sf)
        c = V.centroids(m, "vec")
        j = m.join(c.select("suite", "cluster", "centroid"), ["suite", "cluster"])
        return j.select("suite", "method_seq", round6(V.DIST[metric](F.col("vec"), F.col("centroid"))).alias("d"))

    register(f"dist_{metric}", f"""{CENT_SQL}
SELECT r.suite, r.method_seq, round({sql_expr}, 6) AS d FROM r JOIN c USING (suite, cluster)""")(q)


_dist_query("cosine", "1 - list_cosine_similarity(r.v, c.cv)")
_dist_query("euclidean", "list_distance(r.v, c.cv)")
_dist_query("manhattan", "list_sum(list_transform(list_zip(r.v, c.cv), lambda p: abs(p[1] - p[2])))")


@register("centroids", f"""{CENT_SQL}
SELECT suite, CAST(cluster AS BIGINT) AS cluster, CAST(t.i - 1 AS BIGINT) AS dim, round(t.x, 6) AS value
FROM c, unnest(c.cv) WITH ORDINALITY AS t(x, i)""")
def q_centroids(spark, sf):
    c = V.centroids(method_vectors(spark, sf), "vec")
    return c.select("suite", F.col("cluster").cast("long").alias("cluster"), F.posexplode("centroid").alias("dim", "value")).select(
        "suite", "cluster", F.col("dim").cast("long").alias("dim"), round6("value").alias("value"))


@register("assign_nearest", f"""{CENT_SQL},
d AS (SELECT r.suite, r.method_seq, c.cluster, list_sum(list_transform(list_zip(r.v, c.cv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
      FROM r JOIN c USING (suite))
SELECT suite, method_seq, CAST(cluster AS BIGINT) AS cluster, round(d, 6) AS sq_dist FROM (
  SELECT *, row_number() OVER (PARTITION BY suite, method_seq ORDER BY d, cluster) AS k FROM d) WHERE k = 1""")
def q_assign_nearest(spark, sf):
    m = method_vectors(spark, sf)
    a = V.assign_nearest(m.select("suite", "method_seq", "vec"), V.centroids(m, "vec"))
    return a.select("suite", "method_seq", F.col("cluster").cast("long").alias("cluster"), round6("sq_dist").alias("sq_dist"))


@register("inertia", f"""{CENT_SQL}
SELECT r.suite, round(sum(list_sum(list_transform(list_zip(r.v, c.cv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS inertia
FROM r JOIN c USING (suite, cluster) GROUP BY r.suite""")
def q_inertia(spark, sf):
    m = method_vectors(spark, sf)
    return V.inertia(m, V.centroids(m, "vec")).select("suite", round6("inertia").alias("inertia"))


@register("covariance", f"""
WITH {RAW_SQL},
u AS (SELECT r.suite, r.method_seq, t.x, t.i - 1 AS dim FROM r, unnest(r.v) WITH ORDINALITY AS t(x, i))
SELECT a.suite, CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(covar_samp(a.x, b.x), 6) AS cov
FROM u a JOIN u b ON a.suite = b.suite AND a.method_seq = b.method_seq GROUP BY a.suite, a.dim, b.dim""")
def q_covariance(spark, sf):
    c = V.covariance(method_vectors(spark, sf))
    return c.select("suite", "i", "j", round6("cov").alias("cov"))


# ---------------- similarity ranking ----------------

SIM_SQL = f"""
WITH {RAW_SQL}, {pairs_sql('r')},
sims AS (
  SELECT suite, 'cosine' AS metric, a, b, 1 - cosine AS score FROM pairs WHERE a <> b
  UNION ALL SELECT suite, 'euclidean', a, b, 1 / (1 + euclidean) FROM pairs WHERE a <> b
  UNION ALL SELECT suite, 'manhattan', a, b, 1 / (1 + manhattan) FROM pairs WHERE a <> b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY suite, metric, a ORDER BY score DESC, b) AS rank FROM sims)"""


def _topk(spark, sf, k):
    t = V.topk_similar(method_vectors(spark, sf), k=k, vec="vec")
    return t.select("suite", "metric", "a", F.col("rank").cast("long").alias("rank"), "b", round6("score").alias("score"))


@register("topk_similar", f"{SIM_SQL} SELECT suite, metric, a, CAST(rank AS BIGINT) AS rank, b, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def q_topk_similar(spark, sf):
    return _topk(spark, sf, V.TOPK_FIND)


@register("topk_desc", f"{SIM_SQL} SELECT suite, metric, a, CAST(rank AS BIGINT) AS rank, b, round(score, 6) AS score FROM ranked WHERE rank <= 3")
def q_topk_desc(spark, sf):
    """L2: the ranking kept in the result document (3 of the 5 found)."""
    return _topk(spark, sf, V.TOPK_FIND).filter(F.col("rank") <= V.TOPK_KEEP)


@register("top_report", f"""{SIM_SQL},
firsts AS (SELECT suite, method_seq FROM (SELECT suite, method_seq, row_number() OVER (PARTITION BY suite ORDER BY method_seq) AS r FROM r) WHERE r <= 5)
SELECT k.suite, k.a, CAST(k.rank AS BIGINT) AS rank, k.b, round(k.score, 6) AS score FROM ranked k
JOIN firsts f ON k.suite = f.suite AND k.a = f.method_seq WHERE k.metric = 'cosine' AND k.rank <= 3""")
def q_top_report(spark, sf):
    """First 5 items of each suite with their first 3 cosine neighbours."""
    m = method_vectors(spark, sf)
    w = Window.partitionBy("suite").orderBy("method_seq")
    firsts = m.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("suite", "method_seq")
    t = V.topk_similar(m, k=3, metrics=("cosine",), vec="vec", queries=firsts)
    return t.select("suite", "a", F.col("rank").cast("long").alias("rank"), "b", round6("score").alias("score"))


# ---------------- k-th neighbour distances on standardized vectors ----------------

KDIST_SQL = f"""
WITH {z_sql()}, {pairs_sql('z')},
n AS (SELECT suite, count(*) AS n FROM z GROUP BY suite),
kk AS (SELECT suite, CASE WHEN k0 <= 0 THEN 1 ELSE k0 END AS k FROM (
        SELECT suite, CASE WHEN greatest(2, least(4, n // 20)) >= n THEN n - 1 ELSE greatest(2, least(4, n // 20)) END AS k0 FROM n)),
d AS (SELECT suite, 'cosine' AS metric, a, CASE WHEN a = b THEN 0.0 ELSE cosine END AS d FROM pairs
      UNION ALL SELECT suite, 'euclidean', a, CASE WHEN a = b THEN 0.0 ELSE euclidean END FROM pairs
      UNION ALL SELECT suite, 'manhattan', a, CASE WHEN a = b THEN 0.0 ELSE manhattan END FROM pairs),
r AS (SELECT d.*, kk.k, row_number() OVER (PARTITION BY d.suite, metric, a ORDER BY d.d) AS rn FROM d JOIN kk USING (suite)),
kd AS (SELECT suite, metric, a, k, d AS kdist FROM r WHERE rn = k)"""


def _kdist(spark, sf):
    z = V.standardize(method_vectors(spark, sf))
    return V.kth_neighbour_distance(z, vec="z")


@register("kth_neighbour_distance", f"{KDIST_SQL} SELECT suite, metric, a, CAST(k AS INTEGER) AS k, round(kdist, 6) AS kdist FROM kd")
def q_kth(spark, sf):
    return _kdist(spark, sf).select("suite", "metric", "a", F.col("k").cast("int").alias("k"), round6("kdist").alias("kdist"))


@register("sort_kdist", f"""{KDIST_SQL}
SELECT suite, metric, CAST(row_number() OVER (PARTITION BY suite, metric ORDER BY kdist, a) AS BIGINT) AS rank, round(kdist, 6) AS kdist FROM kd""")
def q_sort_kdist(spark, sf):
    """L1: ascending k-distances with rank 1..n per (suite, metric)."""
    k = ranked(_kdist(spark, sf), ["suite", "metric"], [F.col("kdist"), F.col("a")])
    return k.select("suite", "metric", "rank", round6("kdist").alias("kdist"))


@register("rank_windows", f"""{KDIST_SQL}
SELECT suite, a, CAST(row_number() OVER (PARTITION BY suite ORDER BY kdist DESC, a) AS BIGINT) AS isolation_rank
FROM kd WHERE metric = 'euclidean'""")
def q_rank_windows(spark, sf):
    """Items ranked per suite by their k-th neighbour distance (most isolated first)."""
    k = _kdist(spark, sf).filter(F.col("metric") == "euclidean")
    return ranked(k, ["suite"], [F.col("kdist").desc(), F.col("a")], "isolation_rank").select("suite", "a", "isolation_rank")


# ---------------- silhouettes, guard, best, matrices ----------------

SQL_DIST = {
    "cosine": "greatest(0.0, least(2.0, 1 - list_cosine_similarity(a.v, b.v)))",
    "euclidean": "list_distance(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda q: abs(q[1] - q[2])))",
}


def sil_sql(label_expr: str, metric: str, src_cte: str = "z") -> str:
    """Silhouette for one label assignment and metric, with the Q4 guard (oracle)."""
    return f"""(
WITH lab AS (SELECT suite, method_seq, v, CAST({label_expr} AS BIGINT) AS l FROM {src_cte}),
cnt AS (SELECT suite, count(*) AS n_items, count(DISTINCT l) FILTER (WHERE l >= 0) AS n_clusters,
               count(*) FILTER (WHERE l = -1) AS n_outliers FROM lab GROUP BY suite),
p AS (SELECT a.suite, a.method_seq AS i, a.l AS li, b.l AS lj,
        {SQL_DIST[metric]} AS d
      FROM lab a JOIN lab b ON a.suite = b.suite WHERE a.l >= 0 AND b.l >= 0),
g AS (SELECT suite, i, li, lj, sum(d) AS s, count(*) AS c FROM p GROUP BY ALL),
pt AS (SELECT suite, i, max(CASE WHEN li = lj THEN s / nullif(c - 1, 0) END) AS ai, max(CASE WHEN li = lj THEN c END) AS own_n,
              min(CASE WHEN li <> lj THEN s / c END) AS bi FROM g GROUP BY suite, i),
sc AS (SELECT suite, avg(CASE WHEN own_n = 1 THEN 0.0 WHEN greatest(ai, bi) = 0 THEN 0.0 ELSE (bi - ai) / greatest(ai, bi) END) AS sil
       FROM pt GROUP BY suite)
SELECT cnt.*, CASE WHEN (n_clusters + CASE WHEN n_outliers > 0 THEN 1 ELSE 0 END) < 2
                     OR (n_clusters + CASE WHEN n_outliers > 0 THEN 1 ELSE 0 END = 2 AND n_outliers > 0)
                     OR n_items - n_outliers < 2 OR n_clusters < 2 OR n_clusters > n_items - n_outliers - 1
                   THEN 0.0 ELSE coalesce(sc.sil, 0.0) END AS quality
FROM cnt LEFT JOIN sc USING (suite))"""


def _z_outliers(spark, sf):
    return V.standardize(method_vectors(spark, sf, outliers=True))


def _sil_query(metric):
    def q(spark, sf):
        z = _z_outliers(spark, sf).withColumn("labels", F.array("cluster"))
        r = Q.silhouette_grid(z, [("given", metric)])
        return r.select("suite", round6("quality").alias("quality"))

    register(f"silhouette_{metric}", f"WITH {z_sql(F2O_SQL)} SELECT suite, round(quality, 6) AS quality FROM {sil_sql('cluster', metric)}")(q)


for _m in Q.METRICS:
    _sil_query(_m)

GUARD_VARIANTS = [
    ("halves", "cluster % 2", lambda c: c % 2),
    ("one_plus_outliers", "CASE WHEN cluster = -1 THEN -1 ELSE 0 END", lambda c: F.when(c == -1, -1).otherwise(0)),
    ("singletons", "method_seq", None),
    ("constant", "0", lambda c: F.lit(0)),
]


@register("quality_guard", f"WITH {z_sql(F2O_SQL)} " + " UNION ALL ".join(
    f"SELECT suite, '{name}' AS variant, round(quality, 6) AS quality FROM {sil_sql(expr, 'euclidean')}"
    for name, expr, _ in GUARD_VARIANTS))
def q_quality_guard(spark, sf):
    """Q4 on label variants: two clusters, one cluster + outliers, all singletons, one label."""
    z = _z_outliers(spark, sf)
    labs = [F.col("method_seq").cast("int") if fn is None else fn(F.col("cluster")).cast("int") for _, _, fn in GUARD_VARIANTS]
    z = z.withColumn("labels", F.array(*labs))
    cells = [(name, "euclidean") for name, _, _ in GUARD_VARIANTS]
    r = Q.silhouette_grid(z, cells)
    return r.select("suite", F.col("algorithm").alias("variant"), round6("quality").alias("quality"))


# grid of label variants standing for the three algorithms (fixture of §7.4)
GRID_VARIANTS = [
    ("dbscan", "CASE WHEN cluster >= 8 THEN -1 ELSE cluster END", lambda c: F.when(c >= 8, -1).otherwise(c)),
    ("kmeans", "cluster", lambda c: c),
    ("hierarchical", "cluster % 5", lambda c: c % 5),
]


def _grid_sql() -> str:
    parts = [f"SELECT suite, '{a}' AS algorithm, '{m}' AS metric, n_items, n_clusters, n_outliers, quality FROM {sil_sql(expr, m)}"
             for a, expr, _ in GRID_VARIANTS for m in Q.METRICS]
    return f"WITH {z_sql()}, runs AS ({' UNION ALL '.join(parts)})"


def _grid(spark, sf):
    z = V.standardize(method_vectors(spark, sf))
    z = z.withColumn("labels", F.array(*[fn(F.col("cluster")).cast("int") for _, _, fn in GRID_VARIANTS for _m in Q.METRICS]))
    cells = [(a, m) for a, _, _ in GRID_VARIANTS for m in Q.METRICS]
    return Q.silhouette_grid(z, cells)


@register("best_clustering", f"""{_grid_sql()}
SELECT suite, algorithm, metric, round(quality, 6) AS quality FROM (
  SELECT *, row_number() OVER (PARTITION BY suite ORDER BY quality DESC,
     CASE algorithm WHEN 'dbscan' THEN 1 WHEN 'kmeans' THEN 2 ELSE 3 END,
     CASE metric WHEN 'cosine' THEN 1 WHEN 'euclidean' THEN 2 ELSE 3 END) AS r FROM runs WHERE quality > -1) WHERE r = 1""")
def q_best_clustering(spark, sf):
    b = Q.best_clustering(_grid(spark, sf))
    return b.select("suite", "algorithm", "metric", round6("quality").alias("quality"))


def _matrix_sql(value_sql):
    return f"""{_grid_sql()}
SELECT suite, algorithm,
  round(coalesce(max(CASE WHEN metric = 'cosine' THEN {value_sql} END), 0), 6) AS cosine,
  round(coalesce(max(CASE WHEN metric = 'euclidean' THEN {value_sql} END), 0), 6) AS euclidean,
  round(coalesce(max(CASE WHEN metric = 'manhattan' THEN {value_sql} END), 0), 6) AS manhattan
FROM runs GROUP BY suite, algorithm"""


def _matrix_query(key, value_col, value_sql):
    def q(spark, sf):
        g = Q.outlier_pct(_grid(spark, sf))
        mtx = Q.grid_matrix(g, value_col)
        return mtx.select("suite", "algorithm", *[round6(F.col(m).cast("double")).alias(m) for m in Q.METRICS])

    register(key, _matrix_sql(value_sql))(q)


_matrix_query("quality_matrix", "quality", "quality")
_matrix_query("n_clusters_matrix", "n_clusters", "CAST(n_clusters AS DOUBLE)")
_matrix_query("outlier_pct_matrix", "outlier_pct", "n_outliers * 100.0 / n_items")


@register("cluster_counts", f"""{_grid_sql()}
SELECT suite, algorithm, metric, CAST(n_clusters AS BIGINT) AS n_clusters, CAST(n_outliers AS BIGINT) AS n_outliers FROM runs""")
def q_cluster_counts(spark, sf):
    g = _grid(spark, sf)
    return g.select("suite", "algorithm", "metric", F.col("n_clusters").cast("long").alias("n_clusters"),
                    F.col("n_outliers").cast("long").alias("n_outliers"))


@register("outlier_pct", f"""{_grid_sql()}
SELECT suite, algorithm, metric, round(n_outliers * 100.0 / n_items, 6) AS outlier_pct FROM runs""")
def q_outlier_pct(spark, sf):
    g = Q.outlier_pct(_grid(spark, sf))
    return g.select("suite", "algorithm", "metric", round6("outlier_pct").alias("outlier_pct"))


@register("distinct_labels", f"SELECT DISTINCT suite, CAST(cluster AS BIGINT) AS cluster FROM ({F2O_SQL})")
def q_distinct_labels(spark, sf):
    """U4: distinct cluster ids per suite."""
    return method_vectors(spark, sf, outliers=True).select("suite", F.col("cluster").cast("long").alias("cluster")).distinct()


# ---------------- embedding, truncation, pooling ----------------

EMB_SQL = f"""
WITH f AS ({F1_SQL}),
t AS (SELECT f.suite, f.method_seq, x.tok, x.i FROM f, unnest(regexp_extract_all(f.code, '\\S+')) WITH ORDINALITY AS x(tok, i)),
h AS (SELECT suite, method_seq, CAST(('0x' || substr(md5(tok), 1, 8)) AS UBIGINT) % {V.HASH_DIMS} AS dim,
             CASE WHEN CAST(('0x' || substr(md5(tok), 9, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS s
      FROM t),
g AS (SELECT suite, method_seq, dim, sum(s) AS v FROM h GROUP BY ALL),
nn AS (SELECT suite, method_seq, sqrt(sum(v * v)) AS nrm FROM g GROUP BY ALL)
SELECT g.suite, g.method_seq, CAST(g.dim AS BIGINT) AS dim, round(g.v / nn.nrm, 6) AS value
FROM g JOIN nn USING (suite, method_seq) WHERE g.v <> 0"""


@register("embed_text", EMB_SQL)
def q_embed_text(spark, sf):
    e = V.hashing_embed(suite_methods(spark, sf), "code")
    return _long(e, "vec").filter(F.col("value") != 0)


@register("truncate_tokens", f"""
WITH f AS ({F1_SQL}), t AS (SELECT suite, method_seq, regexp_extract_all(code, '\\S+')[1:{V.MAX_TOKENS}] AS toks FROM f)
SELECT suite, method_seq, CAST(len(toks) AS BIGINT) AS n_tokens, toks[len(toks)] AS last_token FROM t""")
def q_truncate_tokens(spark, sf):
    m = suite_methods(spark, sf)
    t = m.select("suite", "method_seq", V.truncate_tokens(V.tokens("code")).alias("toks"))
    return t.select("suite", "method_seq", F.size("toks").cast("long").alias("n_tokens"),
                    F.when(F.size("toks") > 0, F.element_at("toks", -1)).alias("last_token"))


@register("pool_cls", f"""
WITH tv AS ({F4_SQL})
SELECT suite, method_seq, CAST(x.i - 1 AS BIGINT) AS dim, round(x.v, 6) AS value
FROM tv, unnest(tv.vec) WITH ORDINALITY AS x(v, i) WHERE pos = 0""")
def q_pool_cls(spark, sf):
    return _long(V.pool_cls(token_vectors(spark, sf)), "vec")


@register("pool_mean", f"""
WITH tv AS ({F4_SQL})
SELECT suite, method_seq, CAST(x.i - 1 AS BIGINT) AS dim, round(avg(x.v), 6) AS value
FROM tv, unnest(tv.vec) WITH ORDINALITY AS x(v, i) GROUP BY suite, method_seq, x.i""")
def q_pool_mean(spark, sf):
    return _long(V.pool_mean(token_vectors(spark, sf)), "vec")


@register("pool_direct", f"""
WITH f AS ({F2_SQL})
SELECT suite, method_seq, CAST(x.i - 1 AS BIGINT) AS dim, round(x.v, 6) AS value FROM f, unnest(f.vec) WITH ORDINALITY AS x(v, i)""")
def q_pool_direct(spark, sf):
    m = method_vectors(spark, sf)
    return _long(V.pool_direct(m, "vec"), "vec")


def _toy_model():
    """A toy plug-in model: per text [characters, words, lines, digits] scaled by log1p."""
    def encode(texts):
        return np.log1p(np.array([[len(t), len(t.split()), t.count("\n") + 1, sum(ch.isdigit() for ch in t)] for t in texts],
                                 dtype=np.float64))

    return encode


_TOY_SQL = """[ln(1 + length(code)), ln(1 + len(regexp_extract_all(code, '\\S+'))),
   ln(1 + length(code) - length(replace(code, chr(10), '')) + 1), ln(1 + len(regexp_extract_all(code, '[0-9]')))]"""


@register("embedder_plugin", f"SELECT suite, method_seq, list_transform({_TOY_SQL}, lambda x: round(x, 6)) AS vec FROM ({F1_SQL})")
def q_embedder_plugin(spark, sf):
    """UF1: a user model plugged in through mapInPandas."""
    e = V.PandasEmbedder(_toy_model).embed(suite_methods(spark, sf).select("suite", "method_seq", "code"))
    return e.select("suite", "method_seq", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@register("embedder_registry", f"""SELECT 'hashing' AS embedder, * FROM ({EMB_SQL}) WHERE value <> 0
UNION ALL SELECT 'toy', suite, method_seq, CAST(x.i - 1 AS BIGINT), round(x.v, 6) FROM ({F1_SQL}), unnest({_TOY_SQL}) WITH ORDINALITY AS x(v, i) WHERE x.v <> 0""")
def q_embedder_registry(spark, sf):
    """B2: embedders looked up by name embed the same items; the vectors' parts that aren't zero."""
    V.register_embedder("toy", lambda: V.PandasEmbedder(_toy_model))
    m = suite_methods(spark, sf).select("suite", "method_seq", "code")
    made = [_long(V.get_embedder(name).embed(m), "vec").filter(F.col("value") != 0).select(F.lit(name).alias("embedder"), "*") for name in ("hashing", "toy")]
    return made[0].unionByName(made[1])


@register("embed_text_idf", f"""
WITH f AS ({F1_SQL}),
t AS (SELECT suite, method_seq, unnest(regexp_extract_all(code, '\\S+')) AS tok FROM f),
df AS (SELECT tok, ln((1.0 + (SELECT count(*) FROM f)) / (1.0 + count(DISTINCT (suite, method_seq)))) + 1 AS idf FROM t GROUP BY tok),
h AS (SELECT suite, method_seq, CAST(('0x' || substr(md5(tok), 1, 8)) AS UBIGINT) % {V.HASH_DIMS} AS dim,
             idf * CASE WHEN CAST(('0x' || substr(md5(tok), 9, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS s FROM t JOIN df USING (tok)),
g AS (SELECT suite, method_seq, dim, sum(s) AS v FROM h GROUP BY ALL),
nn AS (SELECT suite, method_seq, sqrt(sum(v * v)) AS nrm FROM g GROUP BY ALL)
SELECT g.suite, g.method_seq, CAST(g.dim AS BIGINT) AS dim, round(g.v / nn.nrm, 6) AS value FROM g JOIN nn USING (suite, method_seq)
WHERE abs(round(g.v / nn.nrm, 6)) > 0""")
def q_embed_text_idf(spark, sf):
    """B1 with IDF weights: tokens count by how few items hold them."""
    e = V.hashing_embed_idf(suite_methods(spark, sf), "code")
    return _long(e, "vec").filter(F.abs("value") > 0)


@register("similarity_pairs", f"""
WITH {RAW_SQL}, {pairs_sql('r')},
entries AS (SELECT suite, 'cosine' AS metric, a, b, 1 - cosine AS score FROM pairs
  UNION ALL SELECT suite, 'euclidean', a, b, 1 / (1 + euclidean) FROM pairs UNION ALL SELECT suite, 'manhattan', a, b, 1 / (1 + manhattan) FROM pairs)
SELECT suite, metric, a, b, round(score, 6) AS similarity, round(avg(score) FILTER (a <> b) OVER w, 6) AS mean_similarity,
       round(max(score) FILTER (a <> b) OVER w, 6) AS max_similarity
FROM entries WINDOW w AS (PARTITION BY suite, metric, a)""")
def q_similarity_pairs(spark, sf):
    """The pairwise similarity matrix of every suite and metric, each entry with the mean and max of its row's other entries."""
    s = V.similarity_matrix(cut_lineage(method_vectors(spark, sf)))
    return s.select("suite", "metric", "a", "b", *[round6(c).alias(c) for c in ("similarity", "mean_similarity", "max_similarity")])


@register("self_pairs", f"SELECT suite, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM ({F2_SQL}) GROUP BY suite")
def q_self_pairs(spark, sf):
    """J7 re-aimed: pairs covered by the block-pair enumeration per suite (never emitted)."""
    return V.pair_count(method_vectors(spark, sf))


@register("ann_topk", f"""
WITH v AS (SELECT method_seq, vec FROM ({F2_SQL})),
c AS (SELECT x.method_seq AS a, y.method_seq AS b, list_cosine_similarity(x.vec, y.vec) AS score FROM v x JOIN v y ON x.method_seq <> y.method_seq)
SELECT a, rank, b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM c) WHERE rank <= {V.TOPK_FIND}""")
def q_ann_topk(spark, sf):
    """Corpus-wide cosine top-5 by inverted lists. The SQL is the exact result, which it equals while the corpus
    has no more lists than are searched; the README states the recall beyond."""
    t = N.ann_topk(method_vectors(spark, sf), V.TOPK_FIND)
    return t.select("a", F.col("rank").cast("long").alias("rank"), "b", round6("score").alias("score"))
