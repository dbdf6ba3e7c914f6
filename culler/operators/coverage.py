"""Coverage of integration points.

Interactions are whole non-empty lines of the (stripped) method code, compared
exactly.  The plan deduplicates on (suite, interaction) first — a partial
aggregate keyed by the line, so a huge suite spreads over all reducers — and
only then counts per suite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culler.functions.text import interaction_lines


def interactions(extracted: DataFrame, code: str = "code") -> DataFrame:
    """One row per (suite, method_seq, interaction)."""
    return extracted.select("suite", "method_seq", F.explode(interaction_lines(code)).alias("interaction"))


def distinct_interactions(extracted: DataFrame, code: str = "code") -> DataFrame:
    """The set of interactions per suite."""
    return interactions(extracted, code).select("suite", "interaction").distinct()


def cip(extracted: DataFrame, selection: DataFrame, code: str = "code") -> DataFrame:
    """Per suite the distinct interactions, those covered by the picks, and
    100 * covered / total (0.0 when a suite has none)."""
    picked = selection.select("suite", "method_seq").distinct().withColumn("picked", F.lit(1))
    per_line = (
        interactions(extracted, code)
        .join(picked, ["suite", "method_seq"], "left")
        .groupBy("suite", "interaction")
        .agg(F.max(F.coalesce("picked", F.lit(0))).alias("picked"))
    )
    suites = extracted.select("suite").distinct()
    counts = per_line.groupBy("suite").agg(
        F.count("*").alias("total"), F.sum("picked").alias("covered")
    )
    return (
        suites.join(counts, "suite", "left")
        .select(
            "suite",
            F.coalesce("total", F.lit(0)).cast("long").alias("total"),
            F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
        )
        .withColumn(
            "cip",
            F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("covered") * 100.0 / F.col("total")),
        )
    )
