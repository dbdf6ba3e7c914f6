"""Text metrics of a code snippet as native column expressions (no UDF).

All counts follow the documented semantics: case-folded substring counts, so
``notify`` contains ``if`` and ``foreach`` counts for ``for`` and ``foreach``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's for equal results ----
# Keywords whose occurrences raise the cyclomatic estimate (each +1).
CYCLOMATIC_KEYWORDS = ["if", "else", "while", "for", "foreach", "switch", "case", "catch", "&&", "||"]
# Cognitive keywords and weights; a keyword present in a line adds weight * (1 + nesting level).
COGNITIVE_WEIGHTS = {
    "if": 1, "else": 1, "while": 1, "for": 1, "foreach": 1, "switch": 1, "case": 1,
    "catch": 2, "finally": 1, "&&": 1, "||": 1, "?": 1,
}
# Halstead operator literals, each counted independently.
HALSTEAD_OPERATORS = ["+", "-", "*", "/", "=", "==", "!=", "<", ">", "<=", ">=",
                      "&&", "||", "!", "&", "|", "^", "<<", ">>", "++", "--"]
# Words that are not operands (compared lower-cased).
HALSTEAD_KEYWORDS = ["if", "else", "while", "for", "return", "int", "string", "bool",
                     "public", "private", "void", "class", "namespace"]
# Cluster description thresholds and labels.
SIMPLE_LABEL = "Metodi semplici e corti"
COMPLEX_LABEL = "Metodi complessi e lunghi"
MEDIUM_LABEL = "Metodi di complessità media"
OUTLIER_LABEL = "Metodi outlier (unici/anomali)"
# -------------------------------------------------------------------------

# A word character as Python's Unicode ``\w`` sees it (letters, numbers, underscore).
WORD = r"[\p{L}\p{N}_]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_substr(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal (``str.count`` semantics)."""
    return F.floor(
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle.encode()))
    ).cast("long")


def _sql_count(text_sql: str, needle: str) -> str:
    lit = needle.replace("'", "''")
    return f"((octet_length({text_sql}) - octet_length(replace({text_sql}, '{lit}', ''))) div {len(needle.encode())})"


def lines_of_code(code: Column | str) -> Column:
    """Non-blank lines."""
    return F.size(F.filter(F.split(_col(code), "\n", -1), lambda l: l.rlike(r"\S"))).cast("int")


def cyclomatic(code: Column | str) -> Column:
    """1 + keyword occurrences in the lower-cased text."""
    low = F.lower(_col(code))
    total = F.lit(1).cast("long")
    for kw in CYCLOMATIC_KEYWORDS:
        total = total + count_substr(low, kw)
    return total.cast("int")


def nesting_depth(code: Column | str) -> Column:
    """Maximum running ``{``/``}`` balance (floor 0, balance not clamped)."""
    braces = F.regexp_extract_all(_col(code), F.lit("([{}])"), 1)
    return F.aggregate(
        braces,
        F.struct(F.lit(0).alias("cur"), F.lit(0).alias("mx")),
        lambda acc, b: F.struct(
            (acc["cur"] + F.when(b == "{", 1).otherwise(-1)).alias("cur"),
            F.greatest(acc["mx"], acc["cur"] + F.when(b == "{", 1).otherwise(-1)).alias("mx"),
        ),
        lambda acc: acc["mx"],
    ).cast("int")


def method_call_names(code: Column | str) -> Column:
    """X4 names: identifiers directly followed by ``(`` (optional white space)."""
    return F.transform(
        F.regexp_extract_all(_col(code), F.lit(f"({WORD}+)\\s*\\("), 1), lambda s: F.trim(s)
    )


def method_calls(code: Column | str) -> Column:
    """Number of call sites."""
    return F.regexp_count(_col(code), F.lit(f"{WORD}+\\s*\\(")).cast("int")


def _cognitive_sql(code_sql: str) -> str:
    opens, closes = _sql_count("l", "{"), _sql_count("l", "}")
    weight = " + ".join(f"IF(instr(b.ll, '{kw}') > 0, {w}, 0)" for kw, w in COGNITIVE_WEIGHTS.items())
    # the new level and the lower-cased line are bound once per line (one-element arrays)
    return (
        f"aggregate(split({code_sql}, '\\n', -1), named_struct('lvl', 0L, 'tot', 0L), "
        f"(acc, l) -> transform(array(named_struct('nl', CAST(greatest(0, acc.lvl + {opens} - {closes}) AS BIGINT), "
        f"'ll', lower(l))), b -> named_struct('lvl', b.nl, 'tot', acc.tot + "
        f"({weight}) * (1 + b.nl)))[0], acc -> CAST(acc.tot AS INT))"
    )


def cognitive(code: str = "code") -> Column:
    """Per line the clamped nesting level, then weighted keywords present in the line."""
    return F.expr(_cognitive_sql(f"`{code}`"))


def halstead(code: Column | str) -> Column:
    """Halstead record (vocabulary, length, estimated_length, volume, difficulty, effort).
    Operator counts and operands are bound once (one-element array) and reused."""
    c = _col(code)
    counts = F.array(*[count_substr(c, op) for op in HALSTEAD_OPERATORS])
    words = F.regexp_extract_all(c, F.lit(f"({WORD}+)"), 1)
    kw = F.array(*[F.lit(k) for k in HALSTEAD_KEYWORDS])
    operands = F.filter(words, lambda w: ~F.array_contains(kw, F.lower(w)))
    bound = F.array(F.struct(counts.alias("cnt"), operands.alias("ops")))

    def record(b):
        n1 = F.size(F.filter(b["cnt"], lambda k: k > 0))
        N1 = F.aggregate(b["cnt"], F.lit(0).cast("long"), lambda a, k: a + k)
        n2 = F.size(F.array_distinct(b["ops"]))
        N2 = F.size(b["ops"])
        return F.transform(F.array(F.struct(n1.alias("u1"), N1.alias("t1"), n2.alias("u2"), N2.alias("t2"))), lambda v: _hal(v))[0]

    return F.transform(bound, record)[0]


def _hal(v: Column) -> Column:
    n1, N1, n2, N2 = v["u1"], v["t1"], v["u2"], v["t2"]
    vocab = n1 + n2
    length = N1 + N2
    has = n2 > 0
    est = F.when(has & (n1 > 0), n1 * F.log2(n1) + n2 * F.log2(n2)).otherwise(F.lit(0.0))
    volume = F.when(has & (vocab > 0), length * F.log2(vocab)).otherwise(F.lit(0.0))
    difficulty = F.when(has, (n1 / 2.0) * (N2 / n2)).otherwise(F.lit(0.0))
    return F.struct(
        vocab.cast("int").alias("vocabulary"),
        length.cast("int").alias("length"),
        est.cast("double").alias("estimated_length"),
        volume.cast("double").alias("volume"),
        difficulty.cast("double").alias("difficulty"),
        (difficulty * volume).cast("double").alias("effort"),
    )


def code_metrics(code: str = "code") -> list[Column]:
    """Every metric of a snippet as flat columns plus the Halstead struct."""
    return [
        lines_of_code(code).alias("lines_of_code"),
        cyclomatic(code).alias("cyclomatic_complexity"),
        nesting_depth(code).alias("nesting_depth"),
        method_calls(code).alias("method_calls"),
        cognitive(code).alias("cognitive_complexity"),
        halstead(code).alias("halstead"),
    ]


def describe_cluster(avg_complexity: Column | str, avg_lines: Column | str) -> Column:
    """A label from the mean cyclomatic complexity and mean line count."""
    a, l = _col(avg_complexity), _col(avg_lines)
    return (
        F.when((a < 5) & (l < 20), F.lit(SIMPLE_LABEL))
        .when((a >= 10) | (l >= 50), F.lit(COMPLEX_LABEL))
        .otherwise(F.lit(MEDIUM_LABEL))
    )
