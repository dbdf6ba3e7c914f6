"""Derived views over the driver tables (FIXTURES.md §3), in Spark and in SQL.

Every view is a projection/aggregation of a given table, so its size grows with
the table.  The SQL strings are DuckDB CTE bodies used by the oracle.
``method_seq`` is the source row id (``doc_id``/``vec_id``/``page_id``): it has
the same order as a per-suite ``row_number`` but needs no window over a suite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culler.session import read_table

# F1 cluster ids: position of the language in (de, en, es, fr); fr is the outlier group.
F1_CLUSTER_SQL = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE -1 END"


def suite_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as methods of suites (suite = source)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("suite"),
        F.col("doc_id").alias("method_seq"),
        F.concat(F.lit("m"), F.col("doc_id")).alias("name"),
        F.col("text").alias("code"),
        F.expr(F1_CLUSTER_SQL).cast("int").alias("cluster"),
    )


F1_SQL = f"""
SELECT source AS suite, doc_id AS method_seq, concat('m', doc_id) AS name, text AS code,
       CAST({F1_CLUSTER_SQL} AS INTEGER) AS cluster
FROM documents"""


def method_vectors(spark: SparkSession, sf_dir: str, outliers: bool = False) -> DataFrame:
    """embeddings as vectors (suite = vec_id % 8); ``outliers`` maps label 9 to -1."""
    e = read_table(spark, sf_dir, "embeddings")
    cluster = F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")) if outliers else F.col("label")
    return e.select(
        (F.col("vec_id") % 8).alias("suite"),
        F.col("vec_id").alias("method_seq"),
        F.concat(F.lit("v"), F.col("vec_id")).alias("name"),
        F.col("embedding").cast("array<double>").alias("vec"),
        cluster.cast("int").alias("cluster"),
    )


def f2_sql(outliers: bool = False) -> str:
    cluster = "CASE WHEN label = 9 THEN -1 ELSE label END" if outliers else "label"
    return f"""
SELECT vec_id % 8 AS suite, vec_id AS method_seq, concat('v', vec_id) AS name,
       CAST(embedding AS DOUBLE[]) AS vec, CAST({cluster} AS INTEGER) AS cluster
FROM embeddings"""


F2_SQL = f2_sql(False)
F2O_SQL = f2_sql(True)

# one synthetic test file per user, 7 languages.  The template is a fixed value
# of the fixture definition (FIXTURES.md §3), stated as SQL once and used by both engines.
F3_EXT_SQL = (
    "CASE user_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.cs' WHEN 3 THEN '.go' "
    "WHEN 4 THEN '.js' WHEN 5 THEN '.php' ELSE '.rb' END"
)

F3_METHOD_TEXT_SQL = r"""
CASE
 WHEN event_id % 7 = 0 THEN CASE user_id % 7
   WHEN 0 THEN concat('def helper_e', event_id, '(x):~    return x~')
   WHEN 1 THEN concat('private int helperE', event_id, '(int x) {~  return x;~}~')
   WHEN 2 THEN concat('private int HelperE', event_id, '(int x) {~  return x;~}~')
   WHEN 3 THEN concat('func helperE', event_id, '(x int) int {~  return x~}~')
   WHEN 4 THEN concat(CASE event_id % 3 WHEN 0 THEN 'function ' WHEN 1 THEN '* ' ELSE 'set ' END, 'helperE', event_id, '(x) {~  return x;~}~')
   WHEN 5 THEN concat('private function helperE', event_id, '($x) {~  return $x;~}~')
   ELSE concat('def helper_e', event_id, '(x)~  x~end~') END
 ELSE CASE user_id % 7
   WHEN 0 THEN concat('@patch("svc.', event_type, '")~def test_e', event_id, '(self, m):~    self.', event_type, '.return_value = ', event_id % 10, '  # set~~    if m:~        m.', event_type, '(', event_id % 10, ')~    self.', event_type, '.assert_called_once_with(', event_id % 10, ')~')
   WHEN 1 THEN concat('@Test~public void testE', event_id, '() throws Exception {~  // call~  mockMvc.perform(get("/', event_type, '/', event_id % 10, '")).andExpect(ok());~  if (a && b) { for (;;) { c(); } }~}~')
   WHEN 2 THEN concat('[Test]~public void E', event_id, '() {~  svc.Setup(x => x.', event_type, '(', event_id % 10, ')).Returns(', event_id % 10, ');~}~')
   WHEN 3 THEN concat('// E', event_id, ' checks~func TestE', event_id, '(t *testing.T) {~  m.EXPECT().', event_type, '(', event_id % 10, ').Return(', event_id % 10, ')~}~')
   WHEN 4 THEN concat('it("e', event_id, '", () => {~  svc.', event_type, '.mockReturnValue(', event_id % 10, ');~});~')
   WHEN 5 THEN concat('/** @test */~public function test_e', event_id, '(): void {~  $svc->expects($this->once())->method("', event_type, '");~}~')
   ELSE concat('def test_e', event_id, '~  allow(svc).to receive(:', event_type, ').and_return(', event_id % 10, ')~end~') END
END"""

# Other layouts of the same methods: every fifth test has its brace on a line of its own, or a wrapped signature;
# every fifth after that has its attribute on the header's line; every fifth after that holds literals and comments with
# braces, brackets and text in column 0.
F3_LAYOUT_SQL = r'''
CASE WHEN event_id % 7 = 0 THEN t
 WHEN event_id % 5 = 0 THEN CASE user_id % 7
   WHEN 0 THEN replace(t, '(self, m):', '(self,~        m: int = 3):')
   WHEN 1 THEN replace(t, 'throws Exception {', 'throws Exception~{')
   WHEN 2 THEN replace(t, '() {~', '()~{~')
   WHEN 3 THEN replace(t, '(t *testing.T)', '(~  t *testing.T)')
   WHEN 4 THEN replace(t, '() => {', '() =>~{')
   WHEN 5 THEN replace(t, ': void {', ': void~{')
   ELSE t END
 WHEN event_id % 5 = 1 THEN CASE user_id % 7
   WHEN 1 THEN replace(t, '@Test~public', '@Test public')
   WHEN 2 THEN replace(t, '[Test]~public', '[Test] public')
   ELSE t END
 WHEN event_id % 5 = 2 THEN CASE user_id % 7
   WHEN 0 THEN replace(t, '(self, m):~', '(self, m):~    q = """~select 1 {~  (# no~"""~# note~')
   WHEN 1 THEN replace(t, 'throws Exception {~', concat('throws Exception {~  String s = "}{{;("; char c = ', chr(39), '{', chr(39), '; // }~  /* { ~ } } */~'))
   WHEN 2 THEN replace(t, '() {~', concat('() {~  var s = $"{{" + @"}""{" + ', chr(39), '{', chr(39), '; // }~'))
   WHEN 3 THEN replace(t, '(t *testing.T) {~', concat('(t *testing.T) {~  s, r := "{" + `}}`, ', chr(39), '{', chr(39), ' // }~'))
   WHEN 4 THEN replace(t, '() => {~', concat('() => {~  const r = /[{]/, s = `}$', '{a}{`, c = "}"; // }~'))
   WHEN 5 THEN replace(t, '(): void {~', concat('(): void {~  $s = ', chr(39), '{', chr(39), ' . "}}"; # }~  $h = <<<EOT~}~EOT;~'))
   ELSE t END
 ELSE t END'''

F3_LANG_SQL = (
    "CASE user_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'csharp' WHEN 3 THEN 'go' "
    "WHEN 4 THEN 'javascript' WHEN 5 THEN 'php' ELSE 'ruby' END"
)


def method_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One method text per event (the template rows before they are joined into files)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "user_id", "event_id", "event_type",
        (F.col("user_id") % 7).alias("lang_id"),
        F.expr(F3_METHOD_TEXT_SQL).alias("t"),
    ).withColumn("method_text", F.expr(F3_LAYOUT_SQL)).drop("t")


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``suite, path, content`` — one file per user, methods in event order."""
    t = method_texts(spark, sf_dir)
    files = t.groupBy("user_id").agg(
        F.expr("listagg(method_text, '~') WITHIN GROUP (ORDER BY event_id)").alias("joined")
    )
    return files.select(
        F.concat(F.lit("u"), F.col("user_id"), F.expr(F3_EXT_SQL)).alias("suite"),
        F.concat(F.lit("u"), F.col("user_id"), F.expr(F3_EXT_SQL)).alias("path"),
        F.translate("joined", "~", "\n").alias("content"),
    )


F3_TEXTS_SQL = f"""
SELECT user_id, event_id, event_type, user_id % 7 AS lang_id, {F3_LAYOUT_SQL} AS method_text
FROM (SELECT *, {F3_METHOD_TEXT_SQL} AS t FROM events)"""

F3_SQL = f"""
SELECT concat('u', user_id, {F3_EXT_SQL}) AS suite, concat('u', user_id, {F3_EXT_SQL}) AS path,
       replace(string_agg(method_text, '~' ORDER BY event_id), '~', chr(10)) AS content
FROM ({F3_TEXTS_SQL}) GROUP BY user_id"""


def token_vectors(spark: SparkSession, sf_dir: str, dims: int = 8) -> DataFrame:
    """per-token model output stand-in: token position and an 8-number vector from md5."""
    m = suite_methods(spark, sf_dir)
    toks = m.select("suite", "method_seq", F.posexplode(F.regexp_extract_all("code", F.lit(r"(\S+)"), 1)).alias("pos", "token"))
    vec = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda j: F.conv(F.substring(F.md5(F.concat(F.col("token"), j.cast("string"))), 1, 8), 16, 10).cast("double")
        / F.lit(4294967296.0),
    )
    return toks.select("suite", "method_seq", "pos", "token", vec.alias("vec"))


F4_SQL = f"""
WITH toks AS (
  SELECT suite, method_seq, unnest(regexp_extract_all(code, '\\S+')) AS token,
         unnest(generate_series(0, len(regexp_extract_all(code, '\\S+')) - 1)) AS pos
  FROM ({F1_SQL})
)
SELECT suite, method_seq, pos, token,
       list_transform(generate_series(0, 7),
         lambda j: CAST(('0x' || substr(md5(concat(token, CAST(j AS VARCHAR))), 1, 8)) AS UBIGINT) / 4294967296.0) AS vec
FROM toks"""


def pages_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as code with braces, comments and URLs."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(
        (F.col("page_id") % 10).cast("string").alias("suite"),
        F.col("page_id").alias("method_seq"),
        F.concat(F.lit("p"), F.col("page_id")).alias("name"),
        F.col("html").alias("code"),
    )


F5_SQL = """
SELECT CAST(page_id % 10 AS VARCHAR) AS suite, page_id AS method_seq, concat('p', page_id) AS name, html AS code
FROM pages"""


def round6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
