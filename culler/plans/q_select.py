"""Queries over F1 for selection, coverage, sets and joins
(L3, L4, A6, A7, U1-U3, J1-J6, J10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from culler.functions import metrics as M
from culler.functions.text import clean_code
from culler.operators import coverage as C
from culler.operators import select as S
from culler.plans.fixtures import F1_SQL, round6, suite_methods
from culler.plans.registry import register

RR_SQL = f"""
WITH f AS ({F1_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY suite, cluster ORDER BY method_seq) AS rn FROM f),
p AS (SELECT *, CASE WHEN cluster >= 0 AND rn = 1 THEN 0 WHEN cluster = -1 THEN 1 ELSE 2 END AS phase FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY phase, rn, cluster) AS pick_order FROM p)
SELECT suite, CAST(cluster AS BIGINT) AS cluster, method_seq, name, CAST(pick_order AS BIGINT) AS pick_order
FROM o WHERE pick_order <= {{n}}"""


def rr_sql(n: int) -> str:
    return RR_SQL.replace("{n}", str(n))


def _sel(spark, sf, n=S.DEFAULT_N):
    return S.select_round_robin(suite_methods(spark, sf), n)


def _out(sel):
    return sel.select("suite", F.col("cluster").cast("long").alias("cluster"), "method_seq", "name",
                      F.col("pick_order").cast("long").alias("pick_order"))


@register("select_round_robin", rr_sql(10))
def q_select_round_robin(spark, sf):
    return _out(_sel(spark, sf, 10))


@register("select_limits", f"""
SELECT 2 AS n, * FROM ({rr_sql(2)}) UNION ALL SELECT 60 AS n, * FROM ({rr_sql(60)})""")
def q_select_limits(spark, sf):
    """L4: n below the cluster count cuts clusters; n above the suite size returns all."""
    a = _out(_sel(spark, sf, 2)).select(F.lit(2).alias("n"), "*")
    b = _out(_sel(spark, sf, 60)).select(F.lit(60).alias("n"), "*")
    return a.unionByName(b)


INTER_SQL = f"""
SELECT suite, method_seq, unnest(list_filter(string_split(regexp_replace(code, '^\\s+|\\s+$', '', 'g'), chr(10)),
                                             lambda l: l <> '')) AS interaction
FROM ({F1_SQL})"""

CIP_SQL = f"""
WITH i AS ({INTER_SQL}), s AS ({rr_sql(10)}),
m AS (SELECT i.suite, i.interaction, max(CASE WHEN s.method_seq IS NULL THEN 0 ELSE 1 END) AS picked
      FROM i LEFT JOIN s ON i.suite = s.suite AND i.method_seq = s.method_seq GROUP BY ALL),
c AS (SELECT suite, count(*) AS total, sum(picked) AS covered FROM m GROUP BY suite),
su AS (SELECT DISTINCT suite FROM ({F1_SQL}))
SELECT su.suite, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(covered, 0) AS BIGINT) AS covered,
       round(CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE covered * 100.0 / total END, 6) AS cip
FROM su LEFT JOIN c USING (suite)"""


def _cip(spark, sf):
    m = suite_methods(spark, sf)
    return C.cip(m, S.select_round_robin(m, 10))


@register("cip", CIP_SQL)
def q_cip(spark, sf):
    return _cip(spark, sf).select("suite", "total", "covered", round6("cip").alias("cip"))


@register("interaction_counts", f"SELECT suite, total, covered FROM ({CIP_SQL})")
def q_interaction_counts(spark, sf):
    return _cip(spark, sf).select("suite", "total", "covered")


@register("distinct_interactions", f"SELECT DISTINCT suite, interaction FROM ({INTER_SQL})")
def q_distinct_interactions(spark, sf):
    return C.distinct_interactions(suite_methods(spark, sf))


@register("union_selected", f"SELECT DISTINCT suite, method_seq FROM ({rr_sql(10)})")
def q_union_selected(spark, sf):
    return S.union_selected(_sel(spark, sf))


@register("except_selected", f"SELECT suite, method_seq FROM ({F1_SQL}) EXCEPT ALL SELECT suite, method_seq FROM ({rr_sql(10)})")
def q_except_selected(spark, sf):
    keys = suite_methods(spark, sf).select("suite", "method_seq")
    return keys.exceptAll(_sel(spark, sf).select("suite", "method_seq"))


@register("semi_selected", f"""
SELECT suite, method_seq, name FROM ({F1_SQL}) f
WHERE EXISTS (SELECT 1 FROM ({rr_sql(10)}) s WHERE s.suite = f.suite AND s.method_seq = f.method_seq)""")
def q_semi_selected(spark, sf):
    m = suite_methods(spark, sf)
    return S.semi_selected(m, S.select_round_robin(m, 10)).select("suite", "method_seq", "name")


@register("anti_selected", f"""
SELECT suite, method_seq, name FROM ({F1_SQL}) f
WHERE NOT EXISTS (SELECT 1 FROM ({rr_sql(10)}) s WHERE s.suite = f.suite AND s.method_seq = f.method_seq)""")
def q_anti_selected(spark, sf):
    m = suite_methods(spark, sf)
    return S.anti_selected(m, S.select_round_robin(m, 10)).select("suite", "method_seq", "name")


@register("join_positional", f"""
SELECT f.suite, f.method_seq, f.name, CAST(strlen(c.clean) AS BIGINT) AS code_bytes
FROM ({F1_SQL}) f JOIN (SELECT suite, method_seq,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code,
    '(?m)//.*$', '', 'g'), '(?m)#.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\n\\s*\\n', chr(10), 'g'),
    '(?m)^\\s+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM ({F1_SQL})) c USING (suite, method_seq)""")
def q_join_positional(spark, sf):
    """Method records paired with their cleaned code by (suite, position)."""
    m = suite_methods(spark, sf)
    codes = m.select("suite", "method_seq", clean_code("code").alias("clean"))
    return S.join_positional(m.select("suite", "method_seq", "name"), codes).select(
        "suite", "method_seq", "name", F.octet_length("clean").cast("long").alias("code_bytes"))


@register("join_complete_loc", f"""
WITH f AS ({F1_SQL}),
s AS (SELECT suite, method_seq, list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '^[^#]*\\S')) AS kept FROM f)
SELECT f.suite, f.method_seq,
       CAST(len(list_filter(string_split(f.code, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS BIGINT) AS lines_of_code,
       CAST(len(list_filter(s.kept, lambda l: regexp_matches(l, '\\S'))) AS BIGINT) AS stripped_lines
FROM f JOIN s USING (suite, method_seq)""")
def q_join_complete_loc(spark, sf):
    """lines_of_code from the complete body, the other metric from a stripped body
    (here: lines with code before any ``#``)."""
    m = suite_methods(spark, sf)
    stripped = m.select("suite", "method_seq",
                        F.array_join(F.filter(F.split("code", "\n", -1), lambda l: l.rlike(r"^[^#]*\S")), "\n").alias("code"))
    from culler.operators.report import features
    f = features(stripped.select("suite", "method_seq", "code"), "code", complete=m.select("suite", "method_seq", "code"))
    st = stripped.select("suite", "method_seq", M.lines_of_code("code").alias("stripped_lines"))
    return f.select("suite", "method_seq", F.col("lines_of_code").cast("long").alias("lines_of_code")).join(
        st, ["suite", "method_seq"]).select("suite", "method_seq", "lines_of_code", F.col("stripped_lines").cast("long").alias("stripped_lines"))


# names that several methods share, made from the whole text
NAMES = 40
NAMEKEY_SQL = f"concat('n', CAST(('0x' || substr(md5(code), 1, 8)) AS BIGINT) % {NAMES})"


def _by_name(spark, sf, last: bool):
    m = suite_methods(spark, sf).withColumn(
        "name_key", F.concat(F.lit("n"), F.conv(F.substring(F.md5("code"), 1, 8), 16, 10).cast("long") % NAMES))
    order = F.col("method_seq").desc() if last else F.col("method_seq")
    w = Window.partitionBy("suite", "name_key").orderBy(order)
    pick = m.withColumn("r", F.row_number().over(w)).filter("r = 1").select("suite", "name_key", "method_seq")
    keys = m.select("suite", "name_key").distinct()
    return keys.join(pick, ["suite", "name_key"]).select("suite", "name_key", "method_seq")


def _by_name_sql(last: bool) -> str:
    order = "method_seq DESC" if last else "method_seq"
    return f"""
WITH m AS (SELECT *, {NAMEKEY_SQL} AS name_key FROM ({F1_SQL})),
p AS (SELECT suite, name_key, method_seq, row_number() OVER (PARTITION BY suite, name_key ORDER BY {order}) AS r FROM m)
SELECT k.suite, k.name_key, p.method_seq FROM (SELECT DISTINCT suite, name_key FROM m) k
JOIN p ON k.suite = p.suite AND k.name_key = p.name_key AND p.r = 1"""


@register("join_first_by_name", _by_name_sql(False))
def q_join_first_by_name(spark, sf):
    """Record by name, first match (names collide: a hash of the text)."""
    return _by_name(spark, sf, False)


@register("join_last_by_name", _by_name_sql(True))
def q_join_last_by_name(spark, sf):
    """Name -> record map where the last duplicate wins."""
    return _by_name(spark, sf, True)


@register("label_join", f"""
WITH f AS ({F1_SQL})
SELECT suite, method_seq, CAST(cluster AS BIGINT) AS cluster,
       CAST(len(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS BIGINT) AS lines_of_code
FROM f""")
def q_label_join(spark, sf):
    """Attach the labels to the feature frame by (suite, method_seq)."""
    m = suite_methods(spark, sf)
    feat = m.select("suite", "method_seq", M.lines_of_code("code").cast("long").alias("lines_of_code"))
    labels = m.select("suite", "method_seq", F.col("cluster").cast("long").alias("cluster"))
    return feat.join(labels, ["suite", "method_seq"]).select("suite", "method_seq", "cluster", "lines_of_code")
