"""Sources and sinks as round trips: write with Spark to a fresh folder under the
shared checkpoint location, read back, and report what was read (S1, S3-S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from culler.operators import extract as X
from culler.operators import report as R
from culler.operators import select as S
from culler.operators import transform as T
from culler.operators import vectors as V
from culler.plans.fixtures import F1_SQL, F3_SQL, method_vectors, src_files, suite_methods
from culler.plans.q_extract import EXP_SQL, KEEP
from culler.plans.q_metrics import FEAT_SQL, PROFILE_SQL
from culler.plans.q_select import rr_sql
from culler.plans.q_vectors import SIM_SQL
from culler.plans.registry import register
from culler.session import cut_lineage
from culler.sources import files as SRC
from culler.sources import sinks as SNK


@register("scan_files", f"SELECT path, CAST(strlen(content) AS BIGINT) AS n_bytes, md5(content) AS content_md5 FROM ({F3_SQL})")
def q_scan_files(spark, sf):
    """Source files written as text, read back whole (UTF-8)."""
    out = SNK.scratch_dir(spark, "files")
    src_files(spark, sf).select("path", F.col("content").alias("value")).write.mode("overwrite").partitionBy("path").text(out)
    back = SRC.scan_files(spark, out, trailing_newline=True)
    return back.select("path", F.octet_length("content").cast("long").alias("n_bytes"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _md5(column):
    return F.md5(F.col(column).cast("binary"))


@register("sink_extracted", f"SELECT suite, method_seq, name, md5(code) AS code_md5 FROM ({F1_SQL})")
def q_sink_extracted(spark, sf):
    """Extracted records written as JSON lines per suite and read back, codes and all."""
    out = SNK.scratch_dir(spark, "extracted")
    SNK.sink_extracted(suite_methods(spark, sf), out)
    back = spark.read.schema("suite string, method_seq long, name string, code string").json(out)
    return back.select("suite", "method_seq", "name", _md5("code").alias("code_md5"))


@register("scan_methods_json", f"SELECT form, name, md5(code) AS code_md5 FROM ({F1_SQL}), (VALUES ('lines'), ('array')) v(form)")
def q_scan_methods_json(spark, sf):
    """S3: ``{name, code}`` records with the fixed schema, from JSON lines and from files that hold one array each."""
    lines, arrays = SNK.scratch_dir(spark, "methods"), SNK.scratch_dir(spark, "arrays")
    methods = suite_methods(spark, sf)
    SNK.sink_extracted(methods, lines)
    SNK.sink_arrays(methods, arrays)
    read = {"lines": SRC.scan_methods_json(spark, lines), "array": SRC.scan_methods_json(spark, arrays, multiline=True)}
    out = [df.select(F.lit(form).alias("form"), "name", _md5("code").alias("code_md5")) for form, df in read.items()]
    return out[0].unionByName(out[1])


_MEMBERS = ["lines_of_code", "cyclomatic_complexity", "nesting_depth", "method_calls", "cognitive_complexity"]


@register("sink_results", f"""
WITH f AS ({FEAT_SQL}), p AS ({PROFILE_SQL})
SELECT 'features' AS part, suite, CAST(method_seq AS VARCHAR) AS item, concat_ws('|', name, {", ".join(_MEMBERS)}) AS label, NULL::DOUBLE AS value FROM f
UNION ALL SELECT 'profiles', suite, CAST(cluster AS VARCHAR), concat_ws('|', method_count, characteristics), avg_complexity FROM p
UNION ALL SELECT 'summary', suite, 'avg_cognitive', CAST(count(*) AS VARCHAR), round(avg(cognitive_complexity), 6) FROM f GROUP BY suite
UNION ALL SELECT 'summary', suite, 'p50', CAST(count(*) AS VARCHAR), round(quantile_cont(CAST(cyclomatic_complexity AS DOUBLE), 0.5), 6) FROM f GROUP BY suite
UNION ALL SELECT 'similar', suite, concat('m', a, '/', metric), string_agg(concat('m', b), '|' ORDER BY rank), round(max(score), 6)
          FROM ({SIM_SQL} SELECT * FROM ranked WHERE rank <= {V.TOPK_KEEP}) GROUP BY suite, a, metric""")
def q_sink_results(spark, sf):
    """The result document's parts, nested as the document nests them (per method and metric its neighbours, per
    suite its summary with the distribution), written per suite, read back and opened up again."""
    out = SNK.scratch_dir(spark, "results")
    feat = R.features(suite_methods(spark, sf)).drop("code")
    vectors = method_vectors(spark, sf).withColumn("name", F.concat(F.lit("m"), F.col("method_seq")))
    SNK.sink_results(R.result_document(feat, vectors.select("suite", "method_seq", "name"), V.topk_similar(vectors, k=V.TOPK_KEEP)), out)
    read = lambda part: spark.read.option("primitivesAsString", "true").json(f"{out}/{part}")
    row = lambda df, part, item, label, value: df.select(F.lit(part).alias("part"), F.col("suite").cast("string").alias("suite"), item.cast("string").alias("item"),
                                                         label.cast("string").alias("label"), F.round(value.cast("double"), 6).alias("value"))
    f, p, s, n = (read(x) for x in ("features", "profiles", "summary", "similar_methods"))
    n = n.withColumn("s", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"similar.{m}").alias("near")) for m in ("cosine", "euclidean", "manhattan")])))
    d = F.col("complexity_distribution")
    parts = [row(f, "features", F.col("method_seq"), F.concat_ws("|", "name", *_MEMBERS), F.lit(None)),
             row(p, "profiles", F.col("cluster"), F.concat_ws("|", "method_count", "characteristics"), F.col("avg_complexity")),
             row(s, "summary", F.lit("avg_cognitive"), d["count"], F.col("avg_cognitive")), row(s, "summary", F.lit("p50"), d["count"], d["p50"]),
             row(n, "similar", F.concat_ws("/", "name", "s.metric"), F.array_join(F.transform("s.near", lambda x: x["name"]), "|"), F.col("s.near")[0]["score"])]
    res = parts[0]
    for x in parts[1:]:
        res = res.unionByName(x)
    return res


@register("sink_selection", f"""
SELECT suite, CASE WHEN cluster = -1 THEN 'outliers' ELSE concat('cluster_', cluster) END AS category,
       CAST(count(*) AS BIGINT) AS method_count, string_agg(name, '|' ORDER BY pick_order) AS methods FROM ({rr_sql(10)}) GROUP BY ALL""")
def q_sink_selection(spark, sf):
    """A saved result read back, n picked per suite from it, the categories written and read back."""
    saved, out = SNK.scratch_dir(spark, "labels"), SNK.scratch_dir(spark, "selection")
    SNK.sink_results({"labels": suite_methods(spark, sf).select("suite", "method_seq", "name", "cluster")}, saved)
    labels = spark.read.schema("suite string, method_seq long, name string, cluster int").json(f"{saved}/labels")
    SNK.sink_selection(S.selection_categories(S.select_round_robin(labels, 10)), out)
    back = spark.read.json(out)
    return back.select(F.col("suite").cast("string").alias("suite"), "category", F.col("method_count").cast("long").alias("method_count"),
                       F.array_join("methods", "|").alias("methods"))


@register("export_by_cluster", f"SELECT suite, CAST(cluster AS BIGINT) AS cluster, method_seq, name, md5(code) AS code_md5 FROM ({F1_SQL})")
def q_export_by_cluster(spark, sf):
    """Members and their bodies written one folder per (suite, cluster) and read back."""
    out = SNK.scratch_dir(spark, "clusters")
    SNK.export_by_cluster(suite_methods(spark, sf).select("suite", "cluster", "method_seq", "name", F.col("code").alias("body")), out)
    back = spark.read.schema("suite string, cluster long, method_seq long, name string, body string").json(out)
    return back.select("suite", "cluster", "method_seq", "name", _md5("body").alias("code_md5"))


@register("sink_commented", f"""
WITH {EXP_SQL}, tests AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_start) AS r FROM em WHERE NOT helper),
drop_m AS (SELECT * FROM tests WHERE r > {KEEP}),
sym AS (SELECT DISTINCT path, CASE WHEN lang_id IN (0, 6) THEN '#' ELSE '//' END AS s FROM em),
lines AS (SELECT f.path, t.i, t.l FROM ({F3_SQL}) f, unnest(string_split(f.content, chr(10))) WITH ORDINALITY AS t(l, i)
          WHERE f.path IN (SELECT path FROM drop_m)),
c AS (SELECT l.path, l.i, CASE WHEN d.path IS NOT NULL AND regexp_matches(l.l, '\\S') THEN concat(sym.s, ' ', rtrim(l.l)) ELSE l.l END AS line
      FROM lines l JOIN sym USING (path) LEFT JOIN drop_m d ON l.path = d.path AND l.i BETWEEN d.line_start AND d.line_end)
SELECT regexp_replace(path, '(\\.[^./]+)$', '_commented\\1') AS target, CAST(count(*) AS BIGINT) AS n_lines,
       md5(string_agg(line, chr(10) ORDER BY i)) AS content_md5 FROM c GROUP BY path""")
def q_sink_commented(spark, sf):
    """Commented copies written per file and read back whole."""
    files = cut_lineage(X.detect_language(src_files(spark, sf)))
    tests = cut_lineage(X.filter_mocks(X.filter_tests(X.extract_methods(files))))  # read by the picks and both range joins
    picks = S.select_round_robin(tests.withColumn("cluster", F.lit(-1)), KEEP)
    lines = T.comment_out(X.explode_lines(files), tests, picks)
    out = SNK.scratch_dir(spark, "commented")
    SNK.sink_commented(lines, out)
    back = spark.read.text(out, wholetext=True).withColumn("value", F.regexp_replace("value", r"\n\z", ""))
    return back.select("target", F.size(F.split("value", "\n", -1)).cast("long").alias("n_lines"), _md5("value").alias("content_md5"))
