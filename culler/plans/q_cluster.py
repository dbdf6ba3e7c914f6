"""Queries for clustering over F2."""

from __future__ import annotations

from pyspark.sql import functions as F

from culler.operators import blocks as BK
from culler.operators import cluster as C
from culler.operators import eps_tiles as EPS
from culler.operators import quality as Q
from culler.operators import vectors as V
from culler.plans.fixtures import F2_SQL, method_vectors, round6
from culler.plans.q_vectors import KDIST_SQL, z_sql
from culler.plans.registry import register
from culler.session import cut_lineage

KNEE_SQL = f"""{KDIST_SQL},
c0 AS (SELECT suite, metric, kdist AS y, row_number() OVER (PARTITION BY suite, metric ORDER BY kdist) - 1 AS s,
              count(*) OVER w AS n, min(kdist) OVER w AS ymin, max(kdist) OVER w AS ymax
       FROM kd WINDOW w AS (PARTITION BY suite, metric)),
c1 AS (SELECT *, s / (n - 1) - (y - ymin) / (ymax - ymin) AS D, n - 1 - s AS r FROM c0 WHERE n > 1 AND ymax > ymin),
c2 AS (SELECT *, coalesce(lag(D) OVER wr, D) AS pD, coalesce(lead(D) OVER wr, D) AS nD, lead(D) OVER wr AS next_D
       FROM c1 WINDOW wr AS (PARTITION BY suite, metric ORDER BY r)),
c3 AS (SELECT *, (D >= pD AND D >= nD) AS is_max, (D <= pD AND D <= nD) AS is_min FROM c2),
fm AS (SELECT suite, metric, min(r) AS r0 FROM c3 WHERE is_max GROUP BY ALL),
c4 AS (SELECT c3.*, CASE WHEN is_min THEN 0.0 WHEN is_max THEN D - {C.KNEE_S} / (n - 1) END AS thr_val,
              CASE WHEN is_max THEN r END AS thr_idx FROM c3 JOIN fm USING (suite, metric) WHERE r >= r0),
c5 AS (SELECT *, last_value(thr_val IGNORE NULLS) OVER wr2 AS thr, last_value(thr_idx IGNORE NULLS) OVER wr2 AS t_idx
       FROM c4 WINDOW wr2 AS (PARTITION BY suite, metric ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hit AS (SELECT suite, metric, arg_min(t_idx, r) AS t_idx, any_value(n) AS n FROM c5 WHERE r <= n - 2 AND next_D < thr GROUP BY ALL),
kn AS (SELECT h.suite, h.metric, c0.y AS knee_y FROM hit h JOIN c0 ON h.suite = c0.suite AND h.metric = c0.metric
       AND c0.s = h.n - 1 - h.t_idx),
pc AS (SELECT suite, metric, quantile_cont(kdist, 0.9) AS p90, quantile_cont(kdist, 0.95) AS p95 FROM kd GROUP BY ALL),
eps AS (SELECT pc.suite, pc.metric, kn.knee_y,
               CASE WHEN coalesce(kn.knee_y, p90) = 0 THEN p95 ELSE coalesce(kn.knee_y, p90) END AS eps
        FROM pc LEFT JOIN kn USING (suite, metric))"""


def _z(spark, sf):
    return V.standardize(method_vectors(spark, sf))


def _eps(spark, sf, z=None):
    z = _z(spark, sf) if z is None else z
    return C.optimal_eps(V.kth_neighbour_distance(z, vec="z"))


@register("knee", f"{KNEE_SQL} SELECT suite, metric, round(knee_y, 6) AS knee_y FROM kn")
def q_knee(spark, sf):
    kd = V.kth_neighbour_distance(_z(spark, sf), vec="z")
    k = C.knee(kd, ["suite", "metric"], "kdist", ["a"])
    return k.select("suite", "metric", round6("knee_y").alias("knee_y"))


@register("optimal_eps", f"{KNEE_SQL} SELECT suite, metric, round(eps, 6) AS eps FROM eps")
def q_optimal_eps(spark, sf):
    return _eps(spark, sf).select("suite", "metric", round6("eps").alias("eps"))


@register("eps_join", f"""{KNEE_SQL}
SELECT p.suite, d.metric, p.a, CAST(count(*) AS BIGINT) AS n_neighbours FROM pairs p
JOIN (SELECT suite, metric, eps FROM eps) d ON p.suite = d.suite
WHERE (d.metric = 'cosine' AND (p.a = p.b OR p.cosine <= d.eps)) OR (d.metric = 'euclidean' AND (p.a = p.b OR p.euclidean <= d.eps))
   OR (d.metric = 'manhattan' AND (p.a = p.b OR p.manhattan <= d.eps))
GROUP BY p.suite, d.metric, p.a""")
def q_eps_join(spark, sf):
    """Size of each item's eps-neighbourhood (inclusive, self counted) per metric
    at the optimal eps; the pairs themselves are never materialised, and only tiles that can hold one are compared."""
    z = cut_lineage(_z(spark, sf))
    eps = cut_lineage(_eps(spark, sf, z))
    metrics = list(BK.METRICS)
    by_metric = F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric")).alias("p"), "eps")))
    arr = eps.groupBy("suite").agg(F.transform(by_metric, lambda s: s["eps"]).alias("eps"))
    base = z.select("suite", "method_seq", "z").join(arr, "suite")
    placed, tiles = EPS.place(z, eps)
    deg = C.neighbourhoods(base, placed, tiles, metrics, 1)
    met = F.element_at(F.array(*[F.lit(m) for m in metrics]), F.col("cell") + 1)
    return deg.select("suite", met.alias("metric"), "a", F.col("deg").cast("long").alias("n_neighbours"))


# all settings of the search on the pairs of KDIST_SQL; components by transitive closure over core points
DBSCAN_SQL = KNEE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
cfgs(cfg, factor, div) AS (VALUES """ + ", ".join(f"({c}, {f}::DOUBLE, {'NULL' if d is None else d})" for c, (f, d) in enumerate(C.DBSCAN_SETTINGS)) + """),
sizes AS (SELECT suite, count(*) AS n FROM z GROUP BY suite),
cell AS (SELECT eps.suite, metric, cfg, eps * factor AS e, CASE WHEN div IS NULL THEN 2 ELSE greatest(2, n // div) END AS min_samples
         FROM eps JOIN sizes USING (suite), cfgs),
pd AS (SELECT suite, a, b, 'cosine' AS metric, cosine AS d FROM pairs UNION ALL SELECT suite, a, b, 'euclidean', euclidean FROM pairs
       UNION ALL SELECT suite, a, b, 'manhattan', manhattan FROM pairs),
near AS (SELECT suite, metric, cfg, a, b, min_samples FROM pd JOIN cell USING (suite, metric) WHERE a = b OR d <= e),
core AS (SELECT suite, metric, cfg, a FROM near GROUP BY suite, metric, cfg, a HAVING count(*) >= any_value(min_samples)),
edge AS (SELECT n.suite, n.metric, n.cfg, n.a, n.b FROM near n SEMI JOIN core c ON c.suite = n.suite AND c.metric = n.metric AND c.cfg = n.cfg AND c.a = n.a
         SEMI JOIN core c2 ON c2.suite = n.suite AND c2.metric = n.metric AND c2.cfg = n.cfg AND c2.a = n.b),
reach AS (SELECT suite, metric, cfg, a, a AS b FROM core UNION
          SELECT r.suite, r.metric, r.cfg, r.a, e.b FROM reach r JOIN edge e ON e.suite = r.suite AND e.metric = r.metric AND e.cfg = r.cfg AND e.a = r.b),
root AS (SELECT suite, metric, cfg, a, min(b) AS root FROM reach GROUP BY suite, metric, cfg, a),
touch AS (SELECT n.suite, n.metric, n.cfg, n.a, min(r.root) AS root FROM near n JOIN root r ON r.suite = n.suite AND r.metric = n.metric AND r.cfg = n.cfg AND r.a = n.b GROUP BY ALL),
found AS (SELECT c.suite, c.metric, c.cfg, c.e AS eps, c.min_samples, z.method_seq, coalesce(r.root, t.root) AS root FROM cell c JOIN z ON z.suite = c.suite
          LEFT JOIN root r ON r.suite = c.suite AND r.metric = c.metric AND r.cfg = c.cfg AND r.a = z.method_seq
          LEFT JOIN touch t ON t.suite = c.suite AND t.metric = c.metric AND t.cfg = c.cfg AND t.a = z.method_seq),
lab AS (SELECT * EXCLUDE (root), CASE WHEN root IS NULL THEN -1
               ELSE dense_rank() OVER (PARTITION BY suite, metric, cfg ORDER BY root NULLS LAST) - 1 END::INTEGER AS cluster FROM found),
gate AS (SELECT suite, metric, cfg, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS n_clusters, count(*) FILTER (cluster = -1) AS n_outliers,
                100.0 * count(*) FILTER (cluster = -1) / count(*) AS outlier_pct FROM lab GROUP BY suite, metric, cfg),
pick AS (SELECT suite, metric, coalesce(min(cfg) FILTER (n_clusters >= 2 AND outlier_pct < 30), 0) AS cfg FROM gate GROUP BY suite, metric)"""


def _dbscan(spark, sf, tried=C.DBSCAN_SETTINGS):
    z = cut_lineage(_z(spark, sf))
    return C.dbscan_grid(z, _eps(spark, sf, z), tried=tried)


@register("dbscan", f"{DBSCAN_SQL} SELECT suite, metric, method_seq, cluster FROM lab WHERE cfg = 0")
def q_dbscan(spark, sf):
    """K1: labels of the first setting (optimal eps, max(2, n // 10)) per suite and metric."""
    return _dbscan(spark, sf, C.DBSCAN_SETTINGS[:1]).select("suite", "metric", "method_seq", "cluster")


@register("dbscan_search", f"""{DBSCAN_SQL} SELECT suite, metric, cfg, round(eps, 6) AS eps, CAST(min_samples AS BIGINT) AS min_samples, method_seq, cluster
FROM lab SEMI JOIN pick USING (suite, metric, cfg)""")
def q_dbscan_search(spark, sf):
    """K4: chosen setting and its labels per suite and metric."""
    chosen, _ = C.dbscan_search(_dbscan(spark, sf))
    return chosen.select("suite", "metric", "cfg", round6("eps").alias("eps"), "min_samples", "method_seq", "cluster")


@register("outlier_rate_gate", f"""{DBSCAN_SQL} SELECT suite, metric, cfg, n_clusters, n_outliers, round(outlier_pct, 6) AS outlier_pct,
n_clusters >= 2 AND outlier_pct < 30 AS accepted FROM gate""")
def q_outlier_rate_gate(spark, sf):
    """Outlier % and acceptance of every DBSCAN setting."""
    _, st = C.dbscan_search(cut_lineage(_dbscan(spark, sf)))
    return st.select("suite", "metric", "cfg", "n_clusters", "n_outliers", round6("outlier_pct").alias("outlier_pct"), "accepted")


# ---------------- k-means: the elbow's inertias, the labels ----------------

LLOYD_ROUNDS = 25  # more than these inputs need to stand still


def _lloyd_sql(name: str, runs: str) -> str:
    """CTEs {name}_0, {name}_1, ...: the centroids of each round, from the same seeds; {name}_a: the last assignment."""
    out = [f"""{name}_0 AS MATERIALIZED (SELECT suite, k, run, cluster, c FROM (
  SELECT z.suite, r.k, r.run, v AS c, row_number() OVER (PARTITION BY z.suite, r.k, r.run
         ORDER BY md5(concat_ws('/', method_seq, r.k, r.run, {C.KMEANS_SEED})), method_seq) - 1 AS cluster FROM z JOIN {runs} r ON r.suite = z.suite) WHERE cluster < k)"""]
    near = lambda i, tag: f"""{name}_{tag} AS MATERIALIZED (SELECT c.suite, c.k, c.run, z.method_seq, arg_min(c.cluster, list_distance(z.v, c.c)) AS cluster,
  min(list_distance(z.v, c.c)) AS d FROM {name}_{i} c JOIN z ON z.suite = c.suite GROUP BY ALL)"""  # noqa: E731
    for i in range(LLOYD_ROUNDS):
        out += [near(i, f"n{i}"), f"""{name}_{i + 1} AS MATERIALIZED (SELECT o.suite, o.k, o.run, o.cluster, coalesce(n.c, o.c) AS c FROM {name}_{i} o LEFT JOIN (
  SELECT suite, k, run, cluster, list(m ORDER BY dim) AS c FROM (SELECT a.suite, a.k, a.run, a.cluster, l.dim, avg(l.z) AS m
  FROM {name}_n{i} a JOIN zl l ON l.suite = a.suite AND l.method_seq = a.method_seq GROUP BY ALL) GROUP BY ALL) n
  ON n.suite = o.suite AND n.k = o.k AND n.run = o.run AND n.cluster = o.cluster)"""]
    return ",\n".join([*out, near(LLOYD_ROUNDS, "a")])


INERTIA_SQL = f"""
WITH {z_sql()},
nn AS (SELECT suite, count(*) AS n, least({C.ELBOW_MAX_K}, count(*) // 3) AS max_k FROM z GROUP BY suite),
er AS (SELECT suite, unnest(generate_series(2, max_k)) AS k, run FROM nn, range({C.ELBOW_RESTARTS}) t(run) WHERE max_k >= 2),
{_lloyd_sql("e", "er")},
inert AS MATERIALIZED (SELECT suite, k, min(i) AS inertia FROM (SELECT suite, k, run, sum(d * d) AS i FROM e_a GROUP BY ALL) GROUP BY ALL),
dw AS (SELECT *, lead(inertia, 1) OVER w - inertia AS d1,
              (lead(inertia, 2) OVER w - lead(inertia, 1) OVER w) - (lead(inertia, 1) OVER w - inertia) AS d2
       FROM inert WINDOW w AS (PARTITION BY suite ORDER BY k)),
cnt AS (SELECT suite, count(*) AS m, max(k) AS max_k FROM inert GROUP BY suite),
best AS (SELECT suite, arg_min(k, -d2) AS k_at FROM dw WHERE d2 IS NOT NULL GROUP BY suite),
ek AS (SELECT cnt.suite, CAST(CASE WHEN m > 2 THEN least(k_at + 2, max_k) ELSE 3 END AS BIGINT) AS k FROM cnt LEFT JOIN best USING (suite))"""


@register("elbow_k", f"{INERTIA_SQL} SELECT suite, k FROM ek")
def q_elbow_k(spark, sf):
    """K5: the elbow of the inertias of fitted runs."""
    e = C.elbow_k_from_inertia(C.elbow_inertias(cut_lineage(_z(spark, sf))))
    return e.select("suite", F.col("k").cast("long").alias("k"))


@register("diff_windows", f"{INERTIA_SQL} SELECT suite, CAST(k AS BIGINT) AS k, round(inertia, 6) AS inertia, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM dw")
def q_diff_windows(spark, sf):
    """First and second differences of the inertias of fitted runs (lead windows)."""
    from pyspark.sql import Window
    t = C.elbow_inertias(cut_lineage(_z(spark, sf)))
    w = Window.partitionBy("suite").orderBy("k")
    i1, i2 = F.lead("inertia", 1).over(w), F.lead("inertia", 2).over(w)
    return t.select("suite", F.col("k").cast("long").alias("k"), round6("inertia").alias("inertia"),
                    round6(i1 - F.col("inertia")).alias("d1"), round6((i2 - i1) - (i1 - F.col("inertia"))).alias("d2"))


# ---------------- k-means, hierarchical, linkage, grid, PCA ----------------

FINAL_SQL = f"""fr AS (SELECT nn.suite, least(coalesce(ek.k, 2), nn.n) AS k, run FROM nn LEFT JOIN ek USING (suite), range(100, {100 + C.KMEANS_RESTARTS}) t(run)),
{_lloyd_sql("f", "fr")},
win AS (SELECT suite, arg_min(run, i) AS run FROM (SELECT suite, run, sum(d * d) AS i FROM f_a GROUP BY ALL) GROUP BY suite),
km AS (SELECT suite, method_seq, min(method_seq) OVER (PARTITION BY suite, cluster) AS root FROM f_a SEMI JOIN win USING (suite, run))"""


@register("kmeans", f"""{INERTIA_SQL}, {FINAL_SQL}
SELECT suite, method_seq, CAST(dense_rank() OVER (PARTITION BY suite ORDER BY root) - 1 AS INTEGER) AS cluster FROM km""")
def q_kmeans(spark, sf):
    """K6: labels of the elbow-chosen k (best of 10 restarts by inertia)."""
    lab, _ = C.kmeans_auto(cut_lineage(_z(spark, sf)))
    return lab


def _merge_sql(name: str, src: str, distance: str) -> str:
    """CTEs of the tree that merges the globally nearest pair again and again: {name} has every step's clusters (id, the smallest
    member; m, the mean; mem, the members), the merged one with its height; {name}_m the merges."""
    return f"""{name} AS (
  SELECT suite, 0 AS step, method_seq AS id, 1.0::DOUBLE AS n, v AS m, [method_seq] AS mem, NULL::BIGINT AS other, NULL::DOUBLE AS other_n, NULL::DOUBLE AS h FROM {src}
  UNION ALL
  SELECT t.suite, t.step + 1, t.id, CASE WHEN t.id = p.a THEN t.n + u.n ELSE t.n END,
         CASE WHEN t.id = p.a THEN list_transform(list_zip(t.m, u.m), lambda x: (x[1] * t.n + x[2] * u.n) / (t.n + u.n)) ELSE t.m END,
         CASE WHEN t.id = p.a THEN list_concat(t.mem, u.mem) ELSE t.mem END,
         CASE WHEN t.id = p.a THEN u.id END, CASE WHEN t.id = p.a THEN u.n END, CASE WHEN t.id = p.a THEN p.d END
  FROM {name} t JOIN (SELECT suite, arg_min(a, d) AS a, arg_min(b, d) AS b, min(d) AS d
                      FROM (SELECT i.suite, i.id AS a, j.id AS b, {distance} AS d FROM {name} i JOIN {name} j ON i.suite = j.suite AND i.id < j.id) GROUP BY suite) p
       ON p.suite = t.suite JOIN {name} u ON u.suite = p.suite AND u.id = p.b WHERE t.id <> p.b),
{name}_m AS MATERIALIZED (SELECT suite, id AS "left", CAST(n - other_n AS BIGINT) AS left_size, other AS "right", CAST(other_n AS BIGINT) AS right_size, h AS height, CAST(n AS BIGINT) AS size
  FROM {name} WHERE h IS NOT NULL)"""


_WARD = "list_distance(i.m, j.m) * sqrt(2 * i.n * j.n / (i.n + j.n))"
_AVERAGE = "greatest(0.0, least(2.0, 1 - list_inner_product(i.m, j.m)))"


def _levels_sql(name: str, metric: str) -> str:
    """The merges down to 5 levels from the root."""
    return f"""{name}_l AS (
  SELECT m.*, 0 AS depth FROM {name}_m m WHERE size = (SELECT max(size) FROM {name}_m x WHERE x.suite = m.suite)
  UNION ALL SELECT m.*, l.depth + 1 FROM {name}_l l JOIN {name}_m m ON m.suite = l.suite
            AND ((m."left" = l."left" AND m.size = l.left_size) OR (m."left" = l."right" AND m.size = l.right_size)) WHERE l.depth < 4),
{name}_o AS (SELECT suite, '{metric}' AS metric, depth, "left", left_size, "right", right_size, round(height, 6) AS height, size FROM {name}_l)"""


_TREE_SRC = f"""WITH RECURSIVE raw AS (SELECT suite, method_seq, vec AS v FROM ({F2_SQL})),
unit AS (SELECT suite, method_seq, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM raw)"""


@register("hierarchical", INERTIA_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
hk AS (SELECT nn.suite, nn.n, least(coalesce(ek.k, 2), nn.n) AS k FROM nn LEFT JOIN ek USING (suite)),
{_merge_sql("w", "z", _WARD)}
SELECT suite, unnest(mem) AS method_seq, CAST(c AS INTEGER) AS cluster FROM (
  SELECT w.suite, mem, dense_rank() OVER (PARTITION BY w.suite ORDER BY id) - 1 AS c FROM w JOIN hk ON hk.suite = w.suite AND w.step = hk.n - hk.k)""")
def q_hierarchical(spark, sf):
    """Agglomerative labels (Ward), k from the elbow."""
    z = cut_lineage(_z(spark, sf))
    return C.hierarchical(z, C.chosen_k(z, C.elbow_inertias(z)))


def _rounded(tree):
    return tree.withColumn("height", round6("height"))


@register("linkage_table", f"{_TREE_SRC}, {_merge_sql('c', 'unit', _AVERAGE)}, {_levels_sql('c', 'cosine')} SELECT * FROM c_o")
def q_linkage_table(spark, sf):
    """Merge tree (cosine -> average) of the raw vectors, 5 levels from the root."""
    return _rounded(C.linkage_table(method_vectors(spark, sf), "cosine"))


@register("dendrogram_data", f"""{_TREE_SRC}, {_merge_sql('c', 'unit', _AVERAGE)}, {_levels_sql('c', 'cosine')},
{_merge_sql('w', 'raw', _WARD)}, {_levels_sql('w', 'euclidean')} SELECT * FROM c_o UNION ALL SELECT * FROM w_o""")
def q_dendrogram_data(spark, sf):
    """The merge trees for cosine and euclidean."""
    m = method_vectors(spark, sf)
    return _rounded(C.linkage_table(m, "cosine").unionByName(C.linkage_table(m, "euclidean")))


def cluster_grid(spark, sf):
    """K0: 3 algorithms x 3 metrics on standardized vectors with quality per cell."""
    from culler.plans.pipeline import cluster_grid as grid
    return grid(cut_lineage(_z(spark, sf)))


def _pair_merge_sql(name: str, metric: str, merged: str) -> str:
    """CTEs of the tree that merges the nearest pair again and again, from the pairs' distances: {name} has every step's pairs of clusters (both
    directions) with the merge that led to it; {name}_c the items' clusters when k are left. ``merged``: x and y as one cluster's distance."""
    return f"""{name} AS (
  SELECT suite, 0 AS step, a, 1.0::DOUBLE AS na, b, 1.0::DOUBLE AS nb, d, NULL::BIGINT AS "left", NULL::BIGINT AS "right" FROM pd WHERE metric = '{metric}' AND a <> b
  UNION ALL
  SELECT t.suite, t.step + 1, t.a, CASE WHEN t.a = q.a THEN q.na + q.nb ELSE t.na END, t.b, CASE WHEN t.b = q.a THEN q.na + q.nb ELSE t.nb END,
         CASE WHEN t.a = q.a THEN {merged.format(x="t.d", y="u.d")} WHEN t.b = q.a THEN {merged.format(x="t.d", y="w.d")} ELSE t.d END, q.a, q.b
  FROM {name} t JOIN (SELECT suite, min({{'d': d, 'a': a, 'b': b}}) AS p FROM {name} WHERE a < b GROUP BY suite) m ON m.suite = t.suite
       JOIN {name} q ON q.suite = m.suite AND q.a = m.p.a AND q.b = m.p.b
       LEFT JOIN {name} u ON u.suite = t.suite AND u.a = q.b AND u.b = t.b LEFT JOIN {name} w ON w.suite = t.suite AND w.a = t.a AND w.b = q.b
  WHERE t.a <> q.b AND t.b <> q.b),
{name}_m AS MATERIALIZED (SELECT DISTINCT suite, "left", "right" FROM {name} JOIN hk USING (suite) WHERE step BETWEEN 1 AND n - k),
{name}_r AS (SELECT suite, method_seq, method_seq AS root FROM z UNION ALL
  SELECT r.suite, r.method_seq, m."left" FROM {name}_r r JOIN {name}_m m ON m.suite = r.suite AND m."right" = r.root),
{name}_c AS (SELECT suite, method_seq, min(root) AS cluster FROM {name}_r GROUP BY ALL)"""


_AVERAGED = "(q.na * {x} + q.nb * {y}) / (q.na + q.nb)"
_LARGEST = "greatest({x}, {y})"

# the nine cells' labels from the SQL above, silhouettes from all pairs
GRID_SQL = DBSCAN_SQL + ",\nnn AS" + INERTIA_SQL.split(",\nnn AS", 1)[1] + f""",
{FINAL_SQL},
hk AS (SELECT nn.suite, nn.n, least(coalesce(ek.k, 2), nn.n) AS k FROM nn LEFT JOIN ek USING (suite)),
{_merge_sql("w", "z", _WARD)},
ward AS (SELECT suite, unnest(mem) AS method_seq, id AS cluster FROM (SELECT w.suite, w.mem, w.id FROM w JOIN hk ON hk.suite = w.suite AND w.step = hk.n - hk.k)),
{_pair_merge_sql("av", "euclidean", _AVERAGED)},
{_pair_merge_sql("co", "manhattan", _LARGEST)},
cells AS (SELECT suite, 'dbscan' AS algorithm, metric, method_seq, cluster FROM lab SEMI JOIN pick USING (suite, metric, cfg)
          UNION ALL SELECT suite, 'kmeans', metric, method_seq, root FROM km, (VALUES ('cosine'), ('euclidean'), ('manhattan')) v(metric)
          UNION ALL SELECT suite, 'hierarchical', 'euclidean', method_seq, cluster FROM ward
          UNION ALL SELECT suite, 'hierarchical', 'cosine', method_seq, cluster FROM av_c UNION ALL SELECT suite, 'hierarchical', 'manhattan', method_seq, cluster FROM co_c),
side AS (SELECT x.suite, x.algorithm, x.metric, x.method_seq AS a, x.cluster AS own, y.cluster AS other, sum(CASE WHEN p.a <> p.b THEN p.d ELSE 0 END) AS s, count(*) AS n
         FROM cells x JOIN pd p ON p.suite = x.suite AND p.metric = x.metric AND p.a = x.method_seq
         JOIN cells y ON y.suite = x.suite AND y.algorithm = x.algorithm AND y.metric = x.metric AND y.method_seq = p.b
         WHERE x.cluster >= 0 AND y.cluster >= 0 GROUP BY ALL),
item AS (SELECT suite, algorithm, metric, a, max(n) FILTER (other = own) AS own_n, max(s / (n - 1)) FILTER (other = own AND n > 1) AS ai,
                min(s / n) FILTER (other <> own) AS bi FROM side GROUP BY ALL),
sil AS (SELECT suite, algorithm, metric, avg(CASE WHEN own_n = 1 OR greatest(ai, bi) = 0 THEN 0 ELSE (bi - ai) / greatest(ai, bi) END) AS sil FROM item GROUP BY ALL),
num AS (SELECT suite, algorithm, metric, count(*) AS n, count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters, count(*) FILTER (cluster = -1) AS n_outliers
        FROM cells GROUP BY ALL)
SELECT suite, algorithm, metric, n_clusters, n_outliers,
       CASE WHEN n_clusters < 2 OR n_clusters > n - n_outliers - 1 THEN 0.0 ELSE round(sil, 6) END AS quality FROM num LEFT JOIN sil USING (suite, algorithm, metric)"""


@register("cluster_grid", GRID_SQL)
def q_cluster_grid(spark, sf):
    runs, _, _ = cluster_grid(spark, sf)
    return runs.select("suite", "algorithm", "metric", "n_clusters", "n_outliers", round6("quality").alias("quality"))


SQUARINGS = 12  # M ** 4096: the other directions are gone


def _axis_sql(name: str, start: str) -> str:
    """CTEs of the first principal axis of the long matrix ``start`` (suite, i, j, v) by repeated squaring: {name} (suite, i, v), of
    length 1, its largest part positive."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT suite, i, j, v / max(abs(v)) OVER (PARTITION BY suite) AS v FROM {start})"]
    for k in range(SQUARINGS):
        out.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT suite, i, j, v / max(abs(v)) OVER (PARTITION BY suite) AS v FROM (
  SELECT a.suite, a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k} a JOIN {name}_{k} b ON b.suite = a.suite AND b.i = a.j GROUP BY ALL))""")
    return ",\n".join(out) + f""",
{name}_c AS (SELECT suite, arg_max(j, v) AS j FROM {name}_{SQUARINGS} WHERE i = j GROUP BY suite),
{name} AS MATERIALIZED (SELECT m.suite, m.i, m.v / sqrt(sum(m.v * m.v) OVER w) * sign(arg_max(m.v, abs(m.v)) OVER w) AS v
  FROM {name}_{SQUARINGS} m JOIN {name}_c c ON c.suite = m.suite AND c.j = m.j WINDOW w AS (PARTITION BY m.suite))"""


PCA_CTES = f"""px AS (SELECT suite, method_seq, t.i AS i, t.x - avg(t.x) OVER (PARTITION BY suite, t.i) AS x FROM ({F2_SQL}), unnest(vec) WITH ORDINALITY AS t(x, i)),
p0 AS MATERIALIZED (SELECT a.suite, a.i, b.i AS j, sum(a.x * b.x) AS v FROM px a JOIN px b ON b.suite = a.suite AND b.method_seq = a.method_seq GROUP BY ALL),
{_axis_sql("v1", "p0")},
l1 AS (SELECT p0.suite, sum(p0.v * a.v * b.v) AS l FROM p0 JOIN v1 a ON a.suite = p0.suite AND a.i = p0.i JOIN v1 b ON b.suite = p0.suite AND b.i = p0.j GROUP BY p0.suite),
p1 AS MATERIALIZED (SELECT p0.suite, p0.i, p0.j, p0.v - l1.l * a.v * b.v AS v FROM p0 JOIN l1 ON l1.suite = p0.suite
                    JOIN v1 a ON a.suite = p0.suite AND a.i = p0.i JOIN v1 b ON b.suite = p0.suite AND b.i = p0.j),
{_axis_sql("v2", "p1")},
pca AS (SELECT px.suite, px.method_seq, round(sum(px.x * v1.v), 6) AS x, round(sum(px.x * v2.v), 6) AS y
        FROM px JOIN v1 ON v1.suite = px.suite AND v1.i = px.i JOIN v2 ON v2.suite = px.suite AND v2.i = px.i GROUP BY ALL)"""


@register("pca_2d", f"WITH {PCA_CTES} SELECT * FROM pca")
def q_pca_2d(spark, sf):
    """2-D projection of the raw vectors per suite."""
    p = V.pca_2d(method_vectors(spark, sf))
    return p.select("suite", "method_seq", round6("x").alias("x"), round6("y").alias("y"))


@register("scatter_pca", GRID_SQL[:GRID_SQL.index(",\nside AS")] + f""",
{PCA_CTES}
SELECT c.suite, algorithm, metric, c.method_seq, x, y, c.cluster = -1 AS outlier,
       CASE WHEN c.cluster = -1 THEN -1 ELSE dense_rank() OVER (PARTITION BY c.suite, algorithm, metric, c.cluster = -1 ORDER BY c.cluster) - 1 END::INTEGER AS cluster
FROM cells c JOIN pca ON pca.suite = c.suite AND pca.method_seq = c.method_seq""")
def q_scatter_pca(spark, sf):
    """PCA coordinates with the label of every grid cell (outliers flagged)."""
    _, lab, cells = cluster_grid(spark, sf)
    name = F.element_at(F.array(*[F.struct(F.lit(a).alias("algorithm"), F.lit(m).alias("metric")) for a, m in cells]), F.col("cell") + 1)
    lab = lab.select("suite", "method_seq", F.posexplode("labels").alias("cell", "cluster")).withColumn("c", name)
    return V.pca_2d(method_vectors(spark, sf)).join(lab, ["suite", "method_seq"]).select(
        "suite", "c.algorithm", "c.metric", "method_seq", round6("x").alias("x"), round6("y").alias("y"), "cluster", (F.col("cluster") == -1).alias("outlier"))
