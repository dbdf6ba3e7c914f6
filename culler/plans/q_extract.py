"""Queries over F3 (synthetic source files): S1, S2, E1-E16, P1-P3, T1-T3, T5,
T6, J9, W4, UF2.  The oracle derives the expected rows from the template of
each event (its line offsets are known), with no parsing at all."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from culler.functions import lang_rules as LR
from culler.operators import extract as X
from culler.operators import transform as T
from culler.plans.fixtures import F3_EXT_SQL, F3_LANG_SQL, F3_SQL, F3_TEXTS_SQL, src_files
from culler.plans.registry import register
from culler.session import cut_lineage

def _methods(spark, sf):
    return X.extract_methods(src_files(spark, sf))


# ---------------- the oracle's view of the corpus ----------------
# per (language id, helper?): (start offset, header offset, end offset, name prefix, params, return type, access)
_TPL = {
    (0, False): (0, 1, 6, "test_e", "self, m", "", "public"), (0, True): (0, 0, 1, "helper_e", "x", "", "public"),
    (1, False): (0, 1, 5, "testE", "", "void", "public"), (1, True): (0, 0, 2, "helperE", "int x", "int", "private"),
    (2, False): (0, 1, 3, "E", "", "void", "public"), (2, True): (0, 0, 2, "HelperE", "int x", "int", "private"),
    (3, False): (1, 1, 3, "TestE", "t *testing.T", "", "public"), (3, True): (0, 0, 2, "helperE", "x int", "int", "private"),
    (4, False): (0, 0, 2, "e", "", "", "public"), (4, True): (0, 0, 2, "helperE", "x", "", "public"),
    (5, False): (1, 1, 3, "test_e", "", "void", "public"), (5, True): (0, 0, 2, "helperE", "$x", "", "private"),
    (6, False): (0, 0, 2, "test_e", "", "", "public"), (6, True): (0, 0, 2, "helper_e", "x", "", "public"),
}


def _case(idx: int, quote: bool = False) -> str:
    parts = []
    for (lid, helper), v in _TPL.items():
        val = f"'{v[idx]}'" if quote else str(v[idx])
        parts.append(f"WHEN lang_id = {lid} AND helper = {str(helper).upper()} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


# expected mock-line subjects (T1) per language, as SQL over the event columns
_SUBJECT_SQL = """CASE lang_id
  WHEN 0 THEN event_type
  WHEN 1 THEN concat('get("/', event_type, '/', event_id % 10, '")')
  WHEN 2 THEN concat('svc.Setup(x => x.', event_type, '(', event_id % 10, ')).Returns(', event_id % 10, ');')
  WHEN 3 THEN concat('m.EXPECT().', event_type, '(', event_id % 10, ').Return(', event_id % 10, ')')
  WHEN 4 THEN concat('svc.', event_type, '.mockReturnValue(', event_id % 10, ');')
  WHEN 5 THEN concat('$svc->expects($this->once())->method("', event_type, '");')
  ELSE concat('allow(svc).to receive(:', event_type, ').and_return(', event_id % 10, ')') END"""

# body line positions of mock lines in test methods (0-based within the body)
_MOCK_POS_SQL = ("list_transform(CASE lang_id WHEN 0 THEN [0, 2, 6] WHEN 1 THEN [3] WHEN 2 THEN [2] ELSE [1] END, "
                 "lambda p: CASE WHEN p = 0 THEN 0 ELSE p + shift END)")
# lines that a layout adds to a test before its mock lines (brace or parameter on a line of its own, literals) or takes (inline attribute)
_SHIFT_SQL = """CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 5 = 0 AND lang_id <= 5 THEN 1
     WHEN event_id % 5 = 1 AND lang_id IN (1, 2) THEN -1
     WHEN event_id % 5 = 2 THEN CASE lang_id WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 0 ELSE 1 END ELSE 0 END"""

EXP_SQL = f"""
t AS (SELECT *, event_id % 7 = 0 AS helper, {_SHIFT_SQL} AS shift, strlen(method_text) - strlen(replace(method_text, '~', '')) AS nl
      FROM ({F3_TEXTS_SQL})),
pos AS (SELECT *, 1 + coalesce(sum(nl + 1) OVER (PARTITION BY user_id ORDER BY event_id
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord,
               lag(event_id % 7 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_helper,
               lag(shift) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_shift FROM t),
em AS (SELECT concat('u', user_id, {F3_EXT_SQL}) AS path, {F3_LANG_SQL} AS language, user_id, event_id, event_type, lang_id,
              helper, ord, prev_helper, prev_shift, shift, base + {_case(0)} AS line_start, base + {_case(1)} + least(shift, 0) AS header_line,
              base + {_case(2)} + shift AS line_end, concat({_case(3, True)}, event_id) AS name,
              CASE WHEN lang_id = 3 AND NOT helper AND event_id % 5 = 0 THEN concat(chr(10), '  t *testing.T') ELSE {_case(4, True)} END AS parameters, {_case(5, True)} AS return_type,
              {_case(6, True)} AS access_modifier,
              CASE WHEN helper AND lang_id = 3 AND prev_helper = FALSE AND prev_shift = 0 THEN '// documented'
                   WHEN helper THEN ''
                   WHEN lang_id = 0 THEN concat('@patch("svc.', event_type, '")')
                   WHEN lang_id = 1 THEN '@Test' WHEN lang_id = 2 THEN '[Test]'
                   WHEN lang_id = 3 THEN CASE WHEN ord = 1 THEN '// documented|test' ELSE 'test' END
                   WHEN lang_id = 5 THEN '@test' ELSE '' END AS attributes
       FROM pos)"""


def _exp(select: str) -> str:
    return f"WITH {EXP_SQL} {select}"


def _m_out(df, cols):
    return df.select(*cols)


M_COLS_SQL = ("path, CAST(ord AS BIGINT) AS method_seq, name, language, CAST(line_start AS INTEGER) AS line_start, "
              "CAST(line_end AS INTEGER) AS line_end, access_modifier, parameters, return_type, attributes")


def _m_cols(m):
    return m.select("path", F.col("method_seq").cast("long").alias("method_seq"), "name", "language",
                    F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"),
                    "access_modifier", "parameters", "return_type", F.array_join("attributes", "|").alias("attributes"))


@register("extract_methods", _exp(f"SELECT {M_COLS_SQL} FROM em"))
def q_extract_methods(spark, sf):
    return _m_cols(_methods(spark, sf))


for _lang in LR.EXTENSIONS.values():
    def _q(spark, sf, lang=_lang):
        return _m_cols(X.extract_methods(src_files(spark, sf), [lang]))

    register(f"extract_{_lang}", _exp(f"SELECT {M_COLS_SQL} FROM em WHERE language = '{_lang}'"))(_q)


def _span_query(key, langs):
    def q(spark, sf):
        m = X.extract_methods(src_files(spark, sf), langs)
        return m.select("path", F.col("header_line").cast("int").alias("header_line"), F.col("line_end").cast("int").alias("line_end"))

    inlist = ", ".join(f"'{l}'" for l in langs)
    register(key, _exp(f"SELECT path, CAST(header_line AS INTEGER) AS header_line, CAST(line_end AS INTEGER) AS line_end "
                       f"FROM em WHERE language IN ({inlist})"))(q)


_span_query("brace_spans", ["java", "csharp", "go", "javascript", "php"])
_span_query("indent_spans", ["python"])
_span_query("ruby_spans", ["ruby"])


@register("access_modifier", _exp("SELECT path, CAST(ord AS BIGINT) AS method_seq, access_modifier FROM em"))
def q_access_modifier(spark, sf):
    return _methods(spark, sf).select("path", F.col("method_seq").cast("long").alias("method_seq"), "access_modifier")


@register("line_range", _exp("SELECT path, CAST(ord AS BIGINT) AS method_seq, CAST(line_start AS INTEGER) AS line_start, "
                             "CAST(line_end AS INTEGER) AS line_end FROM em"))
def q_line_range(spark, sf):
    return _methods(spark, sf).select("path", F.col("method_seq").cast("long").alias("method_seq"),
                                      F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"))


@register("language_stats", _exp("SELECT language, CAST(count(*) AS BIGINT) AS n_methods FROM em GROUP BY language"))
def q_language_stats(spark, sf):
    return X.language_stats(_methods(spark, sf)).select("language", F.col("n_methods").cast("long").alias("n_methods"))


@register("supported_languages", f"SELECT DISTINCT {F3_LANG_SQL} AS language FROM events")
def q_supported_languages(spark, sf):
    """Languages with a rule set, among those present in the corpus."""
    return X.supported_languages(spark, src_files(spark, sf))


@register("detect_language", f"SELECT path, CASE regexp_extract(path, '(\\.[^./]+)$', 1) "
                             + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in LR.EXTENSIONS.items()) + f" END AS language FROM ({F3_SQL})")
def q_detect_language(spark, sf):
    return X.detect_language(src_files(spark, sf)).select("path", "language")


@register("explode_lines", f"""
SELECT f.path, CAST(t.i AS INTEGER) AS line_no, t.l AS line
FROM ({F3_SQL}) f, unnest(string_split(f.content, chr(10))) WITH ORDINALITY AS t(l, i)""")
def q_explode_lines(spark, sf):
    files = X.detect_language(src_files(spark, sf))
    return X.explode_lines(files).select("path", F.col("line_no").cast("int").alias("line_no"), "line")


@register("filter_tests", _exp("SELECT path, CAST(ord AS BIGINT) AS method_seq, name FROM em WHERE NOT helper"))
def q_filter_tests(spark, sf):
    return X.filter_tests(_methods(spark, sf)).select("path", F.col("method_seq").cast("long").alias("method_seq"), "name")


@register("filter_mocks", _exp("SELECT path, CAST(ord AS BIGINT) AS method_seq, name FROM em WHERE NOT helper"))
def q_filter_mocks(spark, sf):
    m = X.filter_mocks(X.filter_tests(_methods(spark, sf)))
    return m.select("path", F.col("method_seq").cast("long").alias("method_seq"), "name")


@register("filter_mock_lines", _exp(f"""
SELECT path, CAST(ord AS BIGINT) AS method_seq, CAST(p AS INTEGER) AS pos
FROM em, unnest({_MOCK_POS_SQL}) AS u(p) WHERE NOT helper"""))
def q_filter_mock_lines(spark, sf):
    ml = X.mock_lines(X.filter_tests(_methods(spark, sf)))
    return ml.select("path", F.col("method_seq").cast("long").alias("method_seq"), F.col("pos").cast("int").alias("pos"))


@register("strip_to_interactions", _exp(f"""
SELECT path, CAST(ord AS BIGINT) AS method_seq, name,
       CASE WHEN lang_id = 0 THEN concat(event_type, chr(10), event_type) ELSE {_SUBJECT_SQL} END AS body
FROM em WHERE NOT helper"""))
def q_strip(spark, sf):
    m = X.strip_to_interactions(X.filter_mocks(X.filter_tests(_methods(spark, sf))))
    return m.select("path", F.col("method_seq").cast("long").alias("method_seq"), "name", "body")


def _subject_query(key, lang, lid):
    def q(spark, sf):
        ml = X.mock_lines(X.extract_methods(src_files(spark, sf), [lang])).filter(F.col("subject") != "")
        return ml.select("path", F.col("method_seq").cast("long").alias("method_seq"), F.col("pos").cast("int").alias("pos"), "subject")

    pos = "p <> 0" if lid == 0 else "TRUE"
    register(key, _exp(f"""
SELECT path, CAST(ord AS BIGINT) AS method_seq, CAST(p AS INTEGER) AS pos, {_SUBJECT_SQL} AS subject
FROM em, unnest({_MOCK_POS_SQL}) AS u(p) WHERE NOT helper AND lang_id = {lid} AND {pos}"""))(q)


_subject_query("mock_subject_python", "python", 0)
_subject_query("mock_subject_java", "java", 1)


@register("method_header", _exp("SELECT path, CAST(header_line AS INTEGER) AS line_no, name FROM em"))
def q_method_header(spark, sf):
    h = X.method_headers(src_files(spark, sf))
    return h.select("path", F.col("line_no").cast("int").alias("line_no"), "name")


@register("lookback_windows", _exp("""
SELECT path, CAST(ord AS BIGINT) AS method_seq,
       coalesce(lang_id = 3 AND ((NOT helper AND ord = 1) OR (helper AND prev_helper = FALSE AND prev_shift = 0)), FALSE) AS documented
FROM em WHERE lang_id IN (3, 6)"""))
def q_lookback(spark, sf):
    m = X.extract_methods(src_files(spark, sf), ["go", "ruby"])
    return m.select("path", F.col("method_seq").cast("long").alias("method_seq"),
                    F.exists("attributes", lambda a: a.endswith("documented")).alias("documented"))


@register("range_lines", _exp(f"""
SELECT em.path, CAST(em.ord AS BIGINT) AS method_seq, CAST(t.i AS INTEGER) AS line_no
FROM em JOIN ({F3_SQL}) f ON em.path = f.path, unnest(string_split(f.content, chr(10))) WITH ORDINALITY AS t(l, i)
WHERE t.i BETWEEN em.line_start AND em.line_end"""))
def q_range_lines(spark, sf):
    files = X.detect_language(src_files(spark, sf))
    r = T.range_lines(X.explode_lines(files), _methods(spark, sf))
    return r.select("path", F.col("method_seq").cast("long").alias("method_seq"), F.col("line_no").cast("int").alias("line_no"))


KEEP = 3  # tests kept per file by the comment_out query (round robin over one outlier group)


@register("comment_out", _exp(f"""
, tests AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_start) AS r FROM em WHERE NOT helper),
drop_m AS (SELECT * FROM tests WHERE r > {KEEP}),
sym AS (SELECT path, CASE WHEN lang_id IN (0, 6) THEN '#' ELSE '//' END AS s FROM em GROUP BY path, lang_id),
lines AS (SELECT f.path, CAST(t.i AS INTEGER) AS line_no, t.l AS line FROM ({F3_SQL}) f,
          unnest(string_split(f.content, chr(10))) WITH ORDINALITY AS t(l, i))
SELECT l.path, l.line_no,
       CASE WHEN d.path IS NOT NULL AND regexp_matches(l.line, '\\S') THEN concat(sym.s, ' ', rtrim(l.line)) ELSE l.line END AS line
FROM lines l JOIN sym ON l.path = sym.path
LEFT JOIN drop_m d ON l.path = d.path AND l.line_no BETWEEN d.line_start AND d.line_end
WHERE l.path IN (SELECT path FROM drop_m)""").replace("em)\n, tests", "em), tests"))
def q_comment_out(spark, sf):
    files = cut_lineage(X.detect_language(src_files(spark, sf)))
    tests = cut_lineage(X.filter_mocks(X.filter_tests(X.extract_methods(files))))  # read by the picks and both range joins
    from culler.operators.select import select_round_robin
    picks = select_round_robin(tests.withColumn("cluster", F.lit(-1)), KEEP)
    out = T.comment_out(X.explode_lines(files), tests, picks)
    return out.select("path", F.col("line_no").cast("int").alias("line_no"), "line")


@register("language_plugin", _exp("""SELECT 'ecmascript' AS language, CAST(count(*) AS BIGINT) AS n_methods,
CAST(count(*) FILTER (NOT helper) AS BIGINT) AS n_tests, CAST(count(*) FILTER (NOT helper) AS BIGINT) AS n_mocks FROM em WHERE lang_id = 4"""))
def q_language_plugin(spark, sf):
    """UF2: a user rule set passed along (here: the JavaScript rules under another name, bound to
    ``.js``) is used by detection, extraction and the filters for tests and mocks."""
    rules = LR.with_language(dataclasses.replace(LR.RULES["javascript"], language="ecmascript", acts_as="javascript"))
    m = X.extract_methods(src_files(spark, sf), rules=rules).filter(F.col("language") == "ecmascript")
    mocks = X.has_mock(F.col("body"), rules)
    return m.groupBy("language").agg(F.count("*").alias("n_methods"), F.count_if(X.is_test(m, rules)).alias("n_tests"),
                                     F.count_if(X.is_test(m, rules) & mocks).alias("n_mocks"))
