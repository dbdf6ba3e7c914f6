"""Features, profiles, summaries and the numbers behind each chart
(X7, J2, A1, A3-A5, A10, A11, G4-G9).  All keyed by suite; all aggregates are
partial (map-side) so a huge suite does not funnel through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from culler.functions import metrics as M
from culler.operators.ranks import quantiles

FEATURE_COLS = ["lines_of_code", "cyclomatic_complexity", "nesting_depth", "method_calls", "cognitive_complexity"]


def features(items: DataFrame, code: str = "code", complete: DataFrame | None = None) -> DataFrame:
    """X7 per item; with ``complete`` (J2) lines_of_code comes from the complete bodies."""
    out = items.select("*", *M.code_metrics(code))
    if complete is not None:
        loc = complete.select("suite", "method_seq", M.lines_of_code(code).alias("complete_loc"))
        out = (out.join(loc, ["suite", "method_seq"], "left")
               .withColumn("lines_of_code", F.coalesce("complete_loc", "lines_of_code")).drop("complete_loc"))
    return out


def cluster_profile(labeled: DataFrame) -> DataFrame:
    """A1: per (suite, cluster) count, mean complexity, mean LOC and label.  The
    member names stay a long table (``group_collect``): a cluster may hold a third
    of all rows, so it is never gathered into one array."""
    g = labeled.groupBy("suite", "cluster").agg(
        F.count("*").alias("method_count"),
        F.avg("cyclomatic_complexity").alias("avg_complexity"),
        F.avg("lines_of_code").alias("avg_lines"),
    )
    return g.withColumn(
        "characteristics",
        F.when(F.col("cluster") == -1, F.lit(M.OUTLIER_LABEL)).otherwise(M.describe_cluster("avg_complexity", "avg_lines")),
    )


def complexity_summary(feat: DataFrame) -> DataFrame:
    """A3: means of cyclomatic, LOC and cognitive per suite."""
    return feat.groupBy("suite").agg(
        F.avg("cyclomatic_complexity").alias("avg_cyclomatic"),
        F.avg("lines_of_code").alias("avg_lines"),
        F.avg("cognitive_complexity").alias("avg_cognitive"),
    )


def describe(feat: DataFrame, col: str = "cyclomatic_complexity") -> DataFrame:
    """A4: count, mean, sample std, min, quartiles (linear interpolation), max."""
    moments = feat.groupBy("suite").agg(
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"),
        F.max(col).cast("double").alias("max"),
    )
    return moments.join(quantiles(feat, ["suite"], col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "suite", "left").select(
        "suite", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def run_summary(labeled: DataFrame) -> DataFrame:
    """A5: total methods, distinct cluster ids, mean complexity."""
    return labeled.groupBy("suite").agg(
        F.count("*").alias("total_methods"),
        F.countDistinct("cluster").alias("n_clusters"),
        F.avg("cyclomatic_complexity").alias("avg_complexity"),
    )


def group_collect(labeled: DataFrame, name: str = "name") -> DataFrame:
    """A10: members per cluster, as (suite, cluster, method_seq, name) rows in ranges sorted by (suite, cluster, item):
    the list form without one unbounded array or task per cluster."""
    return (labeled.select("suite", "cluster", "method_seq", name)
            .repartitionByRange("suite", "cluster", "method_seq").sortWithinPartitions("suite", "cluster", "method_seq"))


def first_members(labeled: DataFrame, k: int = 5, name: str = "name") -> DataFrame:
    """The first ``k`` names per cluster as an array (rank <= k: a partial top-k)."""
    w = Window.partitionBy("suite", "cluster").orderBy("method_seq")
    top = labeled.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy("suite", "cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", name))), lambda s: s[name]).alias("first_methods"))


def result_document(feat: DataFrame, names: DataFrame, neighbours: DataFrame) -> dict[str, DataFrame]:
    """The parts of the result document, each nested as the document nests it. ``feat``: features with cluster;
    ``names``: suite, method_seq, name; ``neighbours``: B12 rows. ``similar_methods`` holds per method and metric its
    neighbours as (name, score) in rank order, ``summary`` per suite the means and the distribution of the complexity."""
    near = neighbours.join(names.select("suite", F.col("method_seq").alias("b"), F.col("name").alias("_other")), ["suite", "b"])
    entry = F.struct("rank", F.col("_other").alias("name"), "score")
    ranked_of = lambda m: F.transform(F.array_sort(F.collect_list(F.when(F.col("metric") == m, entry))),
                                      lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score"))).alias(m)
    similar = near.groupBy("suite", F.col("a").alias("method_seq")).agg(F.struct(*[ranked_of(m) for m in ("cosine", "euclidean", "manhattan")]).alias("similar"))
    distribution = F.struct("count", "mean", "std", "min", "p25", "p50", "p75", "max").alias("complexity_distribution")
    summary = complexity_summary(feat).join(describe(feat).select("suite", distribution), "suite")
    return {"features": feat, "similar_methods": similar.join(names, ["suite", "method_seq"]), "profiles": cluster_profile(feat), "summary": summary}


def corr_matrix(feat: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """Pearson correlation of every metric pair per suite (constant column -> NULL)."""
    # covar/(std*std) with try_divide: a constant column gives NULL instead of an ANSI error
    aggs = [F.try_divide(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")),
                         F.stddev_pop(F.col(a).cast("double")) * F.stddev_pop(F.col(b).cast("double"))).alias(f"{a}__{b}")
            for a in cols for b in cols]
    wide = feat.groupBy("suite").agg(*aggs)
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a in cols for b in cols)
    return wide.select("suite", F.expr(f"stack({len(cols) ** 2}, {stack}) AS (metric_a, metric_b, corr)"))


def hist(feat: DataFrame, col: str = "nesting_depth", bins: int = 15) -> DataFrame:
    """Equal-width histogram per suite, every bin present; a bin holds x with
    edge_i <= x < edge_{i+1}, the last bin also its top edge; min = max widens by 0.5."""
    rng = feat.groupBy("suite").agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx"))
    rng = rng.select(
        "suite",
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"),
    ).withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    x = F.col(col).cast("double")
    binned = feat.join(rng, "suite").select(
        "suite",
        (F.lit(1) + F.size(F.filter(F.sequence(F.lit(1), F.lit(bins - 1)),
                                    lambda i: x >= i * F.col("step") + F.col("lo")))).alias("bin"),
    )
    counts = binned.groupBy("suite", "bin").agg(F.count("*").alias("count"))
    grid = rng.select("suite", "lo", "step", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, ["suite", "bin"], "left").select(
        "suite", "bin",
        ((F.col("bin") - 1) * F.col("step") + F.col("lo")).alias("edge_lo"),
        F.when(F.col("bin") == bins, F.col("lo") + F.col("step") * bins)
        .otherwise(F.col("bin") * F.col("step") + F.col("lo")).alias("edge_hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def boxplot(labeled: DataFrame, col: str) -> DataFrame:
    """Per non-outlier cluster: quartiles, whiskers at 1.5 IQR (most extreme
    data inside the fences), and the points outside (fliers)."""
    x = F.col(col).cast("double")
    reg = labeled.filter(F.col("cluster") >= 0)
    q = quantiles(reg, ["suite", "cluster"], col, {"q1": 0.25, "med": 0.5, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    j = reg.join(q, ["suite", "cluster"])
    inside = (x >= F.col("q1") - 1.5 * F.col("iqr")) & (x <= F.col("q3") + 1.5 * F.col("iqr"))
    return j.groupBy("suite", "cluster", "q1", "med", "q3").agg(
        F.min(F.when(inside, x)).alias("whislo"),
        F.max(F.when(inside, x)).alias("whishi"),
        F.count_if(~inside).alias("n_fliers"),
        F.min(F.when(~inside, x)).alias("flier_min"),
        F.max(F.when(~inside, x)).alias("flier_max"),
    )


def text_report(labeled: DataFrame, name: str = "name") -> DataFrame:
    """Report lines with an order key: totals, then one block per cluster."""
    s = run_summary(labeled)
    head = s.select(
        "suite",
        F.explode(F.array(
            F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("Total methods: "), F.col("total_methods")).alias("line")),
            F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("Clusters: "), F.col("n_clusters")).alias("line")),
            F.struct(F.lit(3).alias("line_no"), F.concat(F.lit("Average complexity: "),
                                                         F.round("avg_complexity", 2).cast("string")).alias("line")),
        )).alias("r"),
    ).select("suite", "r.line_no", "r.line")
    p = cluster_profile(labeled).join(first_members(labeled, 5, name), ["suite", "cluster"])
    body = p.select(
        "suite",
        (F.lit(1000) + F.col("cluster") * 10).alias("base"),
        F.when(F.col("cluster") == -1, F.lit("outliers")).otherwise(F.concat(F.lit("cluster_"), F.col("cluster"))).alias("cat"),
        "method_count", "avg_complexity", "avg_lines", "first_methods", "characteristics",
    ).select(
        "suite",
        F.explode(F.array(
            F.struct(F.col("base").alias("line_no"), F.concat(F.col("cat"), F.lit(": "), F.col("method_count"), F.lit(" methods")).alias("line")),
            F.struct((F.col("base") + 1).alias("line_no"), F.concat(F.lit("  avg complexity "), F.round("avg_complexity", 2).cast("string"),
                                                                     F.lit(", avg lines "), F.round("avg_lines", 2).cast("string")).alias("line")),
            F.struct((F.col("base") + 2).alias("line_no"), F.concat(F.lit("  "), F.col("characteristics")).alias("line")),
            F.struct((F.col("base") + 3).alias("line_no"), F.concat(F.lit("  "), F.array_join("first_methods", ", ")).alias("line")),
        )).alias("r"),
    ).select("suite", "r.line_no", "r.line")
    return head.unionByName(body)


def first_rows(names: DataFrame, k: int) -> DataFrame:
    """The first ``k`` items of each suite by method_seq."""
    w = Window.partitionBy("suite").orderBy("method_seq")
    return names.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def similar_block(neighbours: DataFrame, names: DataFrame, first: int = 5, top: int = 3) -> DataFrame:
    """The report's neighbour block: (suite, line_no, line) for a suite's first ``first`` methods with their ``top`` most
    similar others. ``neighbours``: B12 rows of one metric; ``names``: suite, method_seq, name."""
    w = Window.partitionBy("suite").orderBy("method_seq")
    asked = names.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    near = neighbours.filter(F.col("rank") <= top).join(asked.select("suite", F.col("method_seq").alias("a"), "name", "_r"), ["suite", "a"])
    near = near.join(names.select("suite", F.col("method_seq").alias("b"), F.col("name").alias("_other")), ["suite", "b"])
    entry = F.struct("rank", F.concat("_other", F.lit(" ("), F.round("score", 3).cast("string"), F.lit(")")).alias("t"))
    rows = near.groupBy("suite", "_r", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ", ").alias("t"))
    lines = rows.select("suite", (F.lit(100_000) + F.col("_r")).alias("line_no"), F.concat(F.lit("  "), F.col("name"), F.lit(": "), F.col("t")).alias("line"))
    return asked.select("suite").distinct().select("suite", F.lit(100_000).alias("line_no"), F.lit("Similar methods:").alias("line")).unionByName(lines)
