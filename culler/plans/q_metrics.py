"""Queries over F1 (documents as methods) and F5 (pages as code): text metrics,
summaries and chart data (X1-X8, P4, T4, W3, A1, A3-A5, A10, A11, G4-G9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from culler.functions import metrics as M
from culler.functions.text import clean_code, is_nonblank, split_lines
from culler.operators import report as R
from culler.operators import vectors as V
from culler.plans.fixtures import F1_SQL, F2_SQL, F5_SQL, method_vectors, pages_code, round6, suite_methods
from culler.plans.q_vectors import SIM_SQL
from culler.plans.registry import dcount, register

WORD_SQL = r"[\pL\pN_]"


def _kw_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def features_sql(src_sql: str = F1_SQL) -> str:
    """DuckDB: the five metrics and Halstead per item, written independently with
    unnest + window functions (running sums) instead of folds."""
    cyc = " + ".join(dcount("lower(code)", kw) for kw in M.CYCLOMATIC_KEYWORDS)
    ops_n1 = " + ".join(f"(CASE WHEN {dcount('code', op)} > 0 THEN 1 ELSE 0 END)" for op in M.HALSTEAD_OPERATORS)
    ops_N1 = " + ".join(dcount("code", op) for op in M.HALSTEAD_OPERATORS)
    weight = " + ".join(f"(CASE WHEN instr(lower(l), '{kw}') > 0 THEN {w} ELSE 0 END)" for kw, w in M.COGNITIVE_WEIGHTS.items())
    return f"""
WITH src AS ({src_sql}),
nest AS (
  SELECT suite, method_seq, greatest(0, max(run)) AS nesting_depth FROM (
    SELECT s.suite, s.method_seq,
           sum(CASE WHEN t.ch = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY s.suite, s.method_seq ORDER BY t.i
                                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
    FROM src s, unnest(regexp_extract_all(s.code, '[{{}}]')) WITH ORDINALITY AS t(ch, i)) GROUP BY ALL),
lines AS (
  SELECT s.suite, s.method_seq, t.i, {dcount('t.l', '{')} - {dcount('t.l', '}')} AS d,
         ({weight.replace('(l)', '(t.l)')}) AS w
  FROM src s, unnest(string_split(s.code, chr(10))) WITH ORDINALITY AS t(l, i)),
pre AS (
  SELECT *, sum(d) OVER (PARTITION BY suite, method_seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sd
  FROM lines),
lvl AS (
  SELECT *, sd - least(0, min(sd) OVER (PARTITION BY suite, method_seq ORDER BY i
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS level FROM pre),
cog AS (SELECT suite, method_seq, sum(w * (1 + level)) AS cognitive_complexity FROM lvl GROUP BY ALL),
hal AS (
  SELECT suite, method_seq, n1u, n1t, len(list_distinct(operands)) AS n2u, len(operands) AS n2t FROM (
    SELECT suite, method_seq, {ops_n1} AS n1u, {ops_N1} AS n1t,
           list_filter(regexp_extract_all(code, '{WORD_SQL}+'), lambda w: NOT list_contains({_kw_list(M.HALSTEAD_KEYWORDS)}, lower(w))) AS operands
    FROM src)),
base AS (
  SELECT s.*,
         len(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS lines_of_code,
         1 + {cyc} AS cyclomatic_complexity,
         len(regexp_extract_all(code, '{WORD_SQL}+\\s*\\(')) AS method_calls
  FROM src s)
SELECT base.*, coalesce(nest.nesting_depth, 0) AS nesting_depth, cog.cognitive_complexity,
       n1u + n2u AS vocabulary, n1t + n2t AS length,
       CASE WHEN n2u > 0 AND n1u > 0 THEN n1u * log2(n1u) + n2u * log2(n2u) ELSE 0.0 END AS estimated_length,
       CASE WHEN n2u > 0 THEN (n1t + n2t) * log2(n1u + n2u) ELSE 0.0 END AS volume,
       CASE WHEN n2u > 0 THEN (n1u / 2.0) * (n2t / n2u) ELSE 0.0 END AS difficulty,
       CASE WHEN n2u > 0 THEN (n1u / 2.0) * (n2t / n2u) * (n1t + n2t) * log2(n1u + n2u) ELSE 0.0 END AS effort
FROM base LEFT JOIN nest USING (suite, method_seq) JOIN cog USING (suite, method_seq) JOIN hal USING (suite, method_seq)"""


FEAT_SQL = features_sql()


def _feat(spark, sf):
    return R.features(suite_methods(spark, sf))


def _ids(df):
    return [F.col("suite"), F.col("method_seq").cast("long").alias("method_seq")]


# ---------------- per-item metrics ----------------

def _metric_query(key, expr_fn, out):
    def q(spark, sf):
        m = suite_methods(spark, sf)
        return m.select(*_ids(m), expr_fn("code").cast("long").alias(out))

    register(key, f"WITH f AS ({FEAT_SQL}) SELECT suite, method_seq, CAST({out} AS BIGINT) AS {out} FROM f")(q)


_metric_query("lines_of_code", M.lines_of_code, "lines_of_code")
_metric_query("cyclomatic", M.cyclomatic, "cyclomatic_complexity")
_metric_query("method_calls", M.method_calls, "method_calls")
_metric_query("cognitive", M.cognitive, "cognitive_complexity")


@register("nesting_depth", f"""
WITH f AS ({features_sql(F5_SQL)}) SELECT suite, method_seq, CAST(nesting_depth AS BIGINT) AS nesting_depth FROM f""")
def q_nesting_depth(spark, sf):
    p = pages_code(spark, sf)
    return p.select(*_ids(p), M.nesting_depth("code").cast("long").alias("nesting_depth"))


HAL_COLS = ["vocabulary", "length", "estimated_length", "volume", "difficulty", "effort"]


def _hal_select(h):
    return [F.col(f"{h}.vocabulary").cast("long").alias("vocabulary"), F.col(f"{h}.length").cast("long").alias("length")] + [
        round6(F.col(f"{h}.{c}")).alias(c) for c in HAL_COLS[2:]]


HAL_SQL_COLS = ("CAST(vocabulary AS BIGINT) AS vocabulary, CAST(length AS BIGINT) AS length, "
                + ", ".join(f"round({c}, 6) AS {c}" for c in HAL_COLS[2:]))


@register("halstead", f"WITH f AS ({FEAT_SQL}) SELECT suite, method_seq, {HAL_SQL_COLS} FROM f")
def q_halstead(spark, sf):
    m = suite_methods(spark, sf)
    return m.select(*_ids(m), M.halstead("code").alias("h")).select("suite", "method_seq", *_hal_select("h"))


INT_FEATS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in R.FEATURE_COLS)


@register("code_metrics", f"WITH f AS ({FEAT_SQL}) SELECT suite, method_seq, name, {INT_FEATS}, {HAL_SQL_COLS} FROM f")
def q_code_metrics(spark, sf):
    f = _feat(spark, sf)
    return f.select(*_ids(f), "name", *[F.col(c).cast("long").alias(c) for c in R.FEATURE_COLS], *_hal_select("halstead"))


@register("nonblank_lines", f"""
SELECT suite, CAST(method_seq AS BIGINT) AS method_seq, CAST(t.i AS BIGINT) AS line_no, t.l AS line
FROM ({F1_SQL}) s, unnest(string_split(s.code, chr(10))) WITH ORDINALITY AS t(l, i)
WHERE regexp_matches(t.l, '\\S')""")
def q_nonblank_lines(spark, sf):
    m = suite_methods(spark, sf)
    lines = m.select("suite", "method_seq", F.posexplode(split_lines("code")).alias("pos", "line"))
    return lines.filter(is_nonblank(F.col("line"))).select(
        "suite", F.col("method_seq").cast("long").alias("method_seq"), (F.col("pos") + 1).cast("long").alias("line_no"), "line")


@register("clean_code", f"""
SELECT suite, method_seq,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code,
    '(?m)//.*$', '', 'g'), '(?m)#.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\n\\s*\\n', chr(10), 'g'),
    '(?m)^\\s+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean
FROM ({F5_SQL})""")
def q_clean_code(spark, sf):
    p = pages_code(spark, sf)
    return p.select("suite", "method_seq", clean_code("code").alias("clean"))


@register("prefix_windows", f"""
WITH b AS (
  SELECT s.suite, s.method_seq, t.i, CASE WHEN t.ch = '{{' THEN 1 ELSE -1 END AS d
  FROM ({F5_SQL}) s, unnest(regexp_extract_all(s.code, '[{{}}]')) WITH ORDINALITY AS t(ch, i)),
r AS (SELECT *, sum(d) OVER (PARTITION BY suite, method_seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM b)
SELECT suite, method_seq, CAST(max(level) AS BIGINT) AS max_level, CAST(min(level) AS BIGINT) AS min_level,
       CAST(sum(CASE WHEN d = 1 THEN 1 ELSE 0 END) AS BIGINT) AS opens
FROM r GROUP BY suite, method_seq""")
def q_prefix_windows(spark, sf):
    """Running brace level over the brace positions of each page (window form)."""
    from pyspark.sql import Window
    p = pages_code(spark, sf)
    b = p.select("suite", "method_seq", F.posexplode(F.regexp_extract_all("code", F.lit("([{}])"), 1)).alias("i", "ch"))
    b = b.withColumn("d", F.when(F.col("ch") == "{", 1).otherwise(-1))
    w = Window.partitionBy("suite", "method_seq").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = b.withColumn("level", F.sum("d").over(w))
    return r.groupBy("suite", "method_seq").agg(
        F.max("level").cast("long").alias("max_level"), F.min("level").cast("long").alias("min_level"),
        F.sum(F.when(F.col("d") == 1, 1).otherwise(0)).cast("long").alias("opens"))


# ---------------- cluster-level summaries on F1 (cluster = language) ----------------

PROFILE_SQL = f"""
SELECT suite, CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS method_count,
       round(avg(cyclomatic_complexity), 6) AS avg_complexity, round(avg(lines_of_code), 6) AS avg_lines,
       CASE WHEN cluster = -1 THEN '{M.OUTLIER_LABEL}'
            WHEN avg(cyclomatic_complexity) < 5 AND avg(lines_of_code) < 20 THEN '{M.SIMPLE_LABEL}'
            WHEN avg(cyclomatic_complexity) >= 10 OR avg(lines_of_code) >= 50 THEN '{M.COMPLEX_LABEL}'
            ELSE '{M.MEDIUM_LABEL}' END AS characteristics
FROM ({FEAT_SQL}) GROUP BY suite, cluster"""


@register("cluster_profile", PROFILE_SQL)
def q_cluster_profile(spark, sf):
    p = R.cluster_profile(_feat(spark, sf))
    return p.select("suite", F.col("cluster").cast("long").alias("cluster"), F.col("method_count").cast("long").alias("method_count"),
                    round6("avg_complexity").alias("avg_complexity"), round6("avg_lines").alias("avg_lines"), "characteristics")


@register("describe_cluster", f"""
SELECT suite, CAST(cluster AS BIGINT) AS cluster,
       CASE WHEN avg(cyclomatic_complexity) < 5 AND avg(lines_of_code) < 20 THEN '{M.SIMPLE_LABEL}'
            WHEN avg(cyclomatic_complexity) >= 10 OR avg(lines_of_code) >= 50 THEN '{M.COMPLEX_LABEL}'
            ELSE '{M.MEDIUM_LABEL}' END AS characteristics
FROM ({FEAT_SQL}) GROUP BY suite, cluster""")
def q_describe_cluster(spark, sf):
    g = _feat(spark, sf).groupBy("suite", "cluster").agg(
        F.avg("cyclomatic_complexity").alias("a"), F.avg("lines_of_code").alias("l"))
    return g.select("suite", F.col("cluster").cast("long").alias("cluster"), M.describe_cluster("a", "l").alias("characteristics"))


@register("complexity_summary", f"""
SELECT suite, round(avg(cyclomatic_complexity), 6) AS avg_cyclomatic, round(avg(lines_of_code), 6) AS avg_lines,
       round(avg(cognitive_complexity), 6) AS avg_cognitive FROM ({FEAT_SQL}) GROUP BY suite""")
def q_complexity_summary(spark, sf):
    s = R.complexity_summary(_feat(spark, sf))
    return s.select("suite", *[round6(c).alias(c) for c in ["avg_cyclomatic", "avg_lines", "avg_cognitive"]])


@register("describe", f"""
SELECT suite, CAST(count(cyclomatic_complexity) AS BIGINT) AS count, round(avg(cyclomatic_complexity), 6) AS mean,
       round(stddev_samp(cyclomatic_complexity), 6) AS std, CAST(min(cyclomatic_complexity) AS DOUBLE) AS min,
       round(quantile_cont(CAST(cyclomatic_complexity AS DOUBLE), 0.25), 6) AS p25,
       round(quantile_cont(CAST(cyclomatic_complexity AS DOUBLE), 0.5), 6) AS p50,
       round(quantile_cont(CAST(cyclomatic_complexity AS DOUBLE), 0.75), 6) AS p75,
       CAST(max(cyclomatic_complexity) AS DOUBLE) AS max
FROM ({FEAT_SQL}) GROUP BY suite""")
def q_describe(spark, sf):
    d = R.describe(_feat(spark, sf))
    return d.select("suite", F.col("count").cast("long").alias("count"),
                    *[round6(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@register("run_summary", f"""
SELECT suite, CAST(count(*) AS BIGINT) AS total_methods, CAST(count(DISTINCT cluster) AS BIGINT) AS n_clusters,
       round(avg(cyclomatic_complexity), 6) AS avg_complexity FROM ({FEAT_SQL}) GROUP BY suite""")
def q_run_summary(spark, sf):
    s = R.run_summary(_feat(spark, sf))
    return s.select("suite", F.col("total_methods").cast("long").alias("total_methods"),
                    F.col("n_clusters").cast("long").alias("n_clusters"), round6("avg_complexity").alias("avg_complexity"))


_CORR_PAIRS = " UNION ALL ".join(
    f"SELECT suite, '{a}' AS metric_a, '{b}' AS metric_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM f GROUP BY suite"
    for a in R.FEATURE_COLS for b in R.FEATURE_COLS)


@register("corr_matrix", f"WITH f AS ({FEAT_SQL}) SELECT suite, metric_a, metric_b, CASE WHEN isnan(corr) THEN NULL ELSE corr END AS corr FROM ({_CORR_PAIRS})")
def q_corr_matrix(spark, sf):
    c = R.corr_matrix(_feat(spark, sf))
    return c.select("suite", "metric_a", "metric_b", F.when(F.isnan("corr"), None).otherwise(round6("corr")).alias("corr"))


@register("hist_nesting", f"""
WITH f AS ({FEAT_SQL}),
r AS (SELECT suite, CAST(min(nesting_depth) AS DOUBLE) AS mn, CAST(max(nesting_depth) AS DOUBLE) AS mx FROM f GROUP BY suite),
g AS (SELECT suite, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM r),
s AS (SELECT suite, lo, (hi - lo) / 15 AS step FROM g),
b AS (SELECT f.suite, 1 + (SELECT count(*) FROM range(1, 15) t(i) WHERE CAST(f.nesting_depth AS DOUBLE) >= t.i * s.step + s.lo) AS bin
      FROM f JOIN s USING (suite)),
c AS (SELECT suite, bin, count(*) AS n FROM b GROUP BY ALL),
grid AS (SELECT suite, lo, step, t.bin FROM s, range(1, 16) t(bin))
SELECT grid.suite, CAST(grid.bin AS BIGINT) AS bin, round((grid.bin - 1) * step + lo, 6) AS edge_lo,
       round(CASE WHEN grid.bin = 15 THEN lo + step * 15 ELSE grid.bin * step + lo END, 6) AS edge_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM grid LEFT JOIN c ON grid.suite = c.suite AND grid.bin = c.bin""")
def q_hist_nesting(spark, sf):
    h = R.hist(_feat(spark, sf), "nesting_depth", 15)
    return h.select("suite", F.col("bin").cast("long").alias("bin"), round6("edge_lo").alias("edge_lo"),
                    round6("edge_hi").alias("edge_hi"), F.col("count").cast("long").alias("count"))


def _box_sql(col):
    return f"""
WITH f AS ({FEAT_SQL}),
reg AS (SELECT suite, cluster, CAST({col} AS DOUBLE) AS x FROM f WHERE cluster >= 0),
q AS (SELECT suite, cluster, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
      FROM reg GROUP BY ALL),
j AS (SELECT reg.*, q1, med, q3, (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS inside FROM reg JOIN q USING (suite, cluster))
SELECT suite, CAST(cluster AS BIGINT) AS cluster, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
       round(min(x) FILTER (WHERE inside), 6) AS whislo, round(max(x) FILTER (WHERE inside), 6) AS whishi,
       CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_fliers,
       round(min(x) FILTER (WHERE NOT inside), 6) AS flier_min, round(max(x) FILTER (WHERE NOT inside), 6) AS flier_max
FROM j GROUP BY suite, cluster, q1, med, q3"""


def _box_query(key, col):
    def q(spark, sf):
        b = R.boxplot(_feat(spark, sf), col)
        return b.select("suite", F.col("cluster").cast("long").alias("cluster"),
                        *[round6(c).alias(c) for c in ["q1", "med", "q3", "whislo", "whishi"]],
                        F.col("n_fliers").cast("long").alias("n_fliers"),
                        round6("flier_min").alias("flier_min"), round6("flier_max").alias("flier_max"))

    register(key, _box_sql(col))(q)


_box_query("boxplot_cyclomatic", "cyclomatic_complexity")
_box_query("boxplot_cognitive", "cognitive_complexity")
_box_query("boxplot_calls", "method_calls")


@register("scatter_loc_complexity", f"""
SELECT suite, method_seq, CAST(lines_of_code AS BIGINT) AS lines_of_code,
       CAST(cyclomatic_complexity AS BIGINT) AS cyclomatic_complexity, CAST(cluster AS BIGINT) AS cluster FROM ({FEAT_SQL})""")
def q_scatter(spark, sf):
    f = _feat(spark, sf)
    return f.select(*_ids(f), F.col("lines_of_code").cast("long").alias("lines_of_code"),
                    F.col("cyclomatic_complexity").cast("long").alias("cyclomatic_complexity"),
                    F.col("cluster").cast("long").alias("cluster"))


@register("group_collect", f"SELECT suite, CAST(cluster AS BIGINT) AS cluster, method_seq, name FROM ({F1_SQL})")
def q_group_collect(spark, sf):
    g = R.group_collect(suite_methods(spark, sf))
    return g.select("suite", F.col("cluster").cast("long").alias("cluster"), "method_seq", "name")


@register("text_report", f"""
WITH f AS ({FEAT_SQL}),
s AS (SELECT suite, count(*) AS total_methods, count(DISTINCT cluster) AS n_clusters, avg(cyclomatic_complexity) AS avg_c FROM f GROUP BY suite),
p AS ({PROFILE_SQL.replace('round(avg(cyclomatic_complexity), 6)', 'avg(cyclomatic_complexity)').replace('round(avg(lines_of_code), 6)', 'avg(lines_of_code)')}),
fm AS (SELECT suite, cluster, string_agg(name, ', ' ORDER BY method_seq) AS first_methods FROM (
        SELECT suite, cluster, name, method_seq, row_number() OVER (PARTITION BY suite, cluster ORDER BY method_seq) AS r FROM f)
       WHERE r <= 5 GROUP BY ALL),
pp AS (SELECT p.*, fm.first_methods, 1000 + p.cluster * 10 AS base,
              CASE WHEN p.cluster = -1 THEN 'outliers' ELSE concat('cluster_', p.cluster) END AS cat
       FROM p JOIN fm ON p.suite = fm.suite AND p.cluster = fm.cluster)
SELECT suite, 1 AS line_no, concat('Total methods: ', total_methods) AS line FROM s
UNION ALL SELECT suite, 2, concat('Clusters: ', n_clusters) FROM s
UNION ALL SELECT suite, 3, concat('Average complexity: ', CAST(round(avg_c, 2) AS VARCHAR)) FROM s
UNION ALL SELECT suite, base, concat(cat, ': ', method_count, ' methods') FROM pp
UNION ALL SELECT suite, base + 1, concat('  avg complexity ', CAST(round(avg_complexity, 2) AS VARCHAR), ', avg lines ',
                                         CAST(round(avg_lines, 2) AS VARCHAR)) FROM pp
UNION ALL SELECT suite, base + 2, concat('  ', characteristics) FROM pp
UNION ALL SELECT suite, base + 3, concat('  ', first_methods) FROM pp
UNION ALL SELECT DISTINCT CAST(suite AS VARCHAR), 100000, 'Similar methods:' FROM ({F2_SQL})
UNION ALL SELECT * FROM ({SIM_SQL},
  fm AS (SELECT suite, method_seq, row_number() OVER (PARTITION BY suite ORDER BY method_seq) AS r FROM ({F2_SQL}))
  SELECT CAST(x.suite AS VARCHAR), 100000 + fm.r, concat('  m', x.a, ': ', string_agg(concat('m', x.b, ' (', CAST(round(x.score, 3) AS VARCHAR), ')'), ', ' ORDER BY x.rank))
  FROM ranked x JOIN fm ON fm.suite = x.suite AND fm.method_seq = x.a WHERE x.metric = 'cosine' AND x.rank <= 3 AND fm.r <= 5 GROUP BY x.suite, x.a, fm.r)""")
def q_text_report(spark, sf):
    """Totals and clusters of the F1 suites, the neighbour block of the F2 suites (the ones with vectors)."""
    vectors = method_vectors(spark, sf).withColumn("suite", F.col("suite").cast("string")).withColumn("name", F.concat(F.lit("m"), F.col("method_seq")))
    names = vectors.select("suite", "method_seq", "name")
    asked = V.topk_similar(vectors, k=3, metrics=("cosine",), queries=R.first_rows(names, 5))
    r = R.text_report(_feat(spark, sf)).unionByName(R.similar_block(asked, names))
    return r.select("suite", F.col("line_no").cast("long").alias("line_no"), "line")
