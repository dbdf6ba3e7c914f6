"""End-to-end compositions (§3.1-3.3): files -> methods -> analysis -> selection
-> commented copies and coverage.  Every stage is a DataFrame keyed by suite;
nothing of a suite is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culler.operators import cluster as C
from culler.operators import coverage as COV
from culler.operators import extract as X
from culler.operators import quality as Q
from culler.operators import report as R
from culler.operators import select as S
from culler.operators import transform as T
from culler.operators import vectors as V
from culler.session import cut_lineage


def prepare(files: DataFrame, full_tests: bool = False) -> dict[str, DataFrame]:
    """Stages 2-9: methods of test files, tests only, with mocks, stripped to their
    interactions (unless ``full_tests``), cleaned.  Returns ``extracted`` (what is
    analysed), ``complete`` (cleaned full bodies) and ``methods`` (with line ranges)."""
    methods = X.filter_mocks(X.filter_tests(X.extract_methods(files)))
    complete = X.to_extracted(methods)
    if full_tests:
        return {"methods": methods, "extracted": complete, "complete": None}
    stripped = X.to_extracted(X.strip_to_interactions(methods))
    return {"methods": methods, "extracted": stripped, "complete": complete}


def cluster_grid(z: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """K0: 3 algorithms x 3 metrics on standardized vectors ``z``; quality per cell.  Hierarchical clustering takes
    average linkage on Euclidean distance for cosine, Ward for euclidean and complete linkage for manhattan."""
    eps = C.optimal_eps(V.kth_neighbour_distance(z, vec="z"))
    db, _ = C.dbscan_search(C.dbscan_grid(z, eps))
    db = cut_lineage(db)  # read by three cells: materialise once
    km, k = C.kmeans_auto(z)
    km = cut_lineage(km)
    hier = {m: cut_lineage(C.hierarchical(z, k, linkage=linkage)) for m, linkage in C.LINKAGES.items()}
    cells = [(a, m) for a in Q.ALGORITHMS for m in Q.METRICS]
    lab = z.select("suite", "method_seq", "z")
    cols = []
    for i, (a, m) in enumerate(cells):
        if a == "dbscan":
            src = db.filter(F.col("metric") == m).select("suite", "method_seq", "cluster")
        elif a == "kmeans":
            src = km
        else:
            src = hier[m]
        lab = lab.join(src.withColumnRenamed("cluster", f"c{i}"), ["suite", "method_seq"], "left")
        lost = F.raise_error(F.concat(F.lit(f"no {a}/{m} label for item "), F.col("method_seq").cast("string")))
        cols.append(F.coalesce(F.col(f"c{i}"), lost.cast("int")).cast("int"))
    lab = lab.withColumn("labels", F.array(*cols)).drop(*[f"c{i}" for i in range(len(cells))])
    return Q.silhouette_grid(lab, cells), lab, cells


def analyze(extracted: DataFrame, complete: DataFrame | None = None, embedder: str = "hashing") -> dict[str, DataFrame]:
    """§3.3: embeddings, features (J2), neighbours (3 kept of 5), clustering grid,
    best clustering, labels, profiles, summary."""
    items = extracted.select("suite", "method_seq", "name", "code")
    vec = V.get_embedder(embedder).embed(items, "code").select("suite", "method_seq", "vec")
    feat = R.features(items, "code", complete).drop("code")
    neighbours = V.topk_similar(vec, k=V.TOPK_FIND).filter(F.col("rank") <= V.TOPK_KEEP)
    z = V.standardize(vec).cache()
    runs, lab, cells = cluster_grid(z)
    best = Q.best_clustering(runs)
    best_labels = (lab.select("suite", "method_seq", F.posexplode("labels").alias("cell", "cluster"))
                   .join(best.select("suite", "cell"), ["suite", "cell"]).drop("cell"))
    labeled = feat.join(best_labels, ["suite", "method_seq"])
    return {"vectors": vec, "features": feat, "neighbours": neighbours, "runs": runs, "best": best,
            "labels": labeled, "profiles": R.cluster_profile(labeled), "summary": R.complexity_summary(feat)}


def select_and_score(analysis: dict[str, DataFrame], extracted: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Stages 15 and 17: n picks per suite and the CIP of the picks."""
    sel = S.select_round_robin(analysis["labels"], n)
    return {"selection": sel, "categories": S.selection_categories(sel), "cip": COV.cip(extracted, sel)}


def run(files: DataFrame, n: int = 10, embedder: str = "hashing", full_tests: bool = False) -> dict[str, DataFrame]:
    """§3.1/3.2 for a whole corpus of test files (one suite per file)."""
    p = prepare(files, full_tests)
    a = analyze(p["extracted"], p["complete"], embedder)
    s = select_and_score(a, p["extracted"], n)
    picks = s["selection"].select("suite", "method_seq").join(p["methods"].select("suite", "path", "method_seq").distinct(),
                                                              ["suite", "method_seq"])
    lines = X.explode_lines(X.detect_language(files) if "language" not in files.columns else files)
    commented = T.comment_out(lines, p["methods"], picks)
    out = {**a, **s, "commented": commented}
    if full_tests:
        out.pop("cip")
    return out
