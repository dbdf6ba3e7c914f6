"""Embedding and vector operators (B1-B12, B14-B16, K7-K9; B13 is in ``neighbours``).

Vectors are ``array<double>`` columns.  Per-suite statistics use MLlib's
``Summarizer`` (a JVM aggregate with map-side partial merge); pairwise work
goes through the blocked kernels in ``blocks``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culler.operators import blocks as BK
from culler.session import cut_lineage

# Default number of neighbours found and the number kept in the result document.
TOPK_FIND = 5
TOPK_KEEP = 3
# Default of the explicit truncation operator (most model windows: 512); the hashing embedder has no window.
MAX_TOKENS = 512
HASH_DIMS = 64
# A token is common in more items than one in so many, and than so many; bytes of common tokens that are broadcast.
COMMON_SHARE, COMMON_LEAST = 1000, 100
VOCABULARY = 32 << 20
# Items of a block whose tiles leave the task entry by entry (all metrics and both directions: 25 MB).
MATRIX_BLOCK = 512


# ---------------- B7 standardize ----------------

def suite_stats(items: DataFrame, vec: str = "vec", keys: list[str] = ["suite"]) -> DataFrame:
    """Per group: n, mean vector and population std vector (zero std -> 1)."""
    s = items.select(*keys, array_to_vector(F.col(vec)).alias("_v")).groupBy(*keys).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("_s"))
    n = F.col("_s.count").cast("double")
    mean = vector_to_array(F.col("_s.mean"))
    var = vector_to_array(F.col("_s.variance"))
    std = F.transform(var, lambda v: F.when(n > 1, F.sqrt(v * (n - 1) / n)).otherwise(F.lit(0.0)))
    return s.select(*keys, n.alias("n"), mean.alias("mean"),
                    F.transform(std, lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)).alias("std"))


def standardize(items: DataFrame, vec: str = "vec", out: str = "z", keys: list[str] = ["suite"]) -> DataFrame:
    """(x - mean) / population std per suite and dimension; used for clustering only."""
    st = suite_stats(items, vec, keys)
    z = F.transform(F.col(vec), lambda x, i: (x - F.col("mean")[i]) / F.col("std")[i])
    return items.join(st.select(*keys, "mean", "std"), keys).withColumn(out, z).drop("mean", "std")


# ---------------- B8-B10 distances as column expressions ----------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def dist_cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; a zero vector has similarity 0."""
    na, nb = norm(a), norm(b)
    sim = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return F.lit(1.0) - sim


def dist_euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def dist_manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


DIST = {"cosine": dist_cosine, "euclidean": dist_euclidean, "manhattan": dist_manhattan}


def similarity(metric: str, d: Column) -> Column:
    """Cosine similarity, or 1 / (1 + d)."""
    if metric not in DIST:
        raise ValueError(f"unsupported metric: {metric}")
    return F.lit(1.0) - d if metric == "cosine" else F.lit(1.0) / (F.lit(1.0) + d)


# ---------------- B12 top-k, B14 k-th neighbour ----------------

def _first_k(asking: np.ndarray, other: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs each asking row's first k: similarity desc, candidate id asc."""
    order = np.lexsort((ids[other], -score, asking))
    asking, other, score = asking[order], other[order], score[order]
    keep = np.arange(len(asking)) - np.searchsorted(asking, asking) < k
    return asking[keep], other[keep], score[keep]


def _topk_kernel(k: int, metrics: tuple[str, ...], vec: str):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        suite = pdf["suite"].iloc[0]
        a, va, b, vb, axes = BK.sides(pdf, vec)
        if len(a) and len(b):
            aseq, bseq = a["method_seq"].to_numpy(), b["method_seq"].to_numpy()
            itself = aseq[:, None] == bseq[None, :]  # self excluded by id (V3)
            for m in metrics:
                near = BK.nearest_pairs(va, vb, k, itself, np.inf, axes, m)
                tile = None
                for axis, found in zip(axes, near):
                    asks, others = (aseq, bseq) if axis else (bseq, aseq)
                    kk = min(k, len(others))
                    if found is not None:
                        rows, cols, d = found
                        score = BK.similarity_from_distance(d, m)
                    else:
                        if tile is None:
                            tile = BK.similarity_from_distance(BK.distance_tile(va, vb, m), m)
                            tile[itself] = -np.inf
                        S = tile if axis else np.ascontiguousarray(tile.T)
                        # all candidates at or above the kk-th similarity
                        least = np.partition(S, S.shape[1] - kk, axis=1)[:, S.shape[1] - kk]
                        rows, cols = np.nonzero((S >= least[:, None]) & np.isfinite(S))
                        score = S[rows, cols]
                    rows, cols, score = _first_k(rows, cols, score, others, kk)
                    out.append(pd.DataFrame({"suite": suite, "metric": m, "a": asks[rows], "b": others[cols], "score": score}))
        if not out:
            return pd.DataFrame({"suite": pd.Series(dtype=pdf["suite"].dtype), "metric": [], "a": [], "b": [], "score": []})
        return pd.concat(out, ignore_index=True)

    return kernel


def topk_similar(items: DataFrame, k: int = TOPK_FIND, metrics: tuple[str, ...] = BK.METRICS, vec: str = "vec",
                 block_size: int = BK.DEFAULT_BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """Per item its k most similar other items per metric: (suite, metric, a, rank, b, score).
    Ties: higher similarity first, then smaller id.  With ``queries`` (suite, method_seq) only those
    items are asked: they go to every block of their suite, and every other item stays in its own."""
    base = items.select("suite", "method_seq", vec)
    schema = "suite {suite}, metric string, a long, b long, score double"
    kernel = _topk_kernel(k, metrics, vec)
    if queries is None:
        cand = BK.run_pairs(base, ["suite"], kernel, schema, block_size)
    else:
        cand = BK.run_queries(base, queries, ["suite"], kernel, schema, block_size)
    w = Window.partitionBy("suite", "metric", "a").orderBy(F.col("score").desc(), F.col("b"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _kdist_kernel(metrics: tuple[str, ...], vec: str):
    """Per item and metric one row: its k least distances in the tile."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        suite = pdf["suite"].iloc[0]
        a, va, b, vb, axes = BK.sides(pdf, vec)
        if len(a) and len(b):
            aseq, bseq = a["method_seq"].to_numpy(), b["method_seq"].to_numpy()
            itself = aseq[:, None] == bseq[None, :]  # self at distance 0 (counted as first neighbour)
            k = int(pdf["k"].max())
            for m in metrics:
                near = BK.nearest_pairs(va, vb, k, itself, 0.0, axes, m)
                tile = None
                for axis, found in zip(axes, near):
                    asks, kq = (aseq, a["k"].to_numpy()) if axis else (bseq, b["k"].to_numpy())
                    kk = min(k, va.shape[0] if not axis else vb.shape[0])
                    if found is not None:
                        rows, _, d = found
                        order = np.lexsort((d, rows))
                        rows, d = rows[order], d[order]
                        part = d[np.arange(len(rows)) - np.searchsorted(rows, rows) < kk].reshape(len(asks), kk)
                    else:
                        if tile is None:
                            tile = BK.distance_tile(va, vb, m)
                            if m == "cosine":
                                np.clip(tile, 0.0, 2.0, out=tile)
                            tile[itself] = 0.0
                        part = np.partition(tile if axis else np.ascontiguousarray(tile.T), kk - 1, axis=1)[:, :kk]
                    out.append(pd.DataFrame({"suite": suite, "metric": m, "a": asks, "d": list(part), "k": kq}))
        if not out:
            return pd.DataFrame({"suite": pd.Series(dtype=pdf["suite"].dtype), "metric": [], "a": [], "d": [], "k": []})
        return pd.concat(out, ignore_index=True)

    return kernel


def neighbour_k(n: Column) -> Column:
    """K2: k = max(2, min(4, n // 20)), at most n - 1, at least 1."""
    k = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(n / 20)))
    k = F.when(k >= n, n - 1).otherwise(k)
    return F.when(k <= 0, F.lit(1)).otherwise(k).cast("int")


def kth_neighbour_distance(items: DataFrame, metrics: tuple[str, ...] = BK.METRICS, vec: str = "z",
                           block_size: int = BK.DEFAULT_BLOCK) -> DataFrame:
    """Per item and metric the distance to its k-th nearest item, self counted first."""
    sizes = items.groupBy("suite").agg(F.count("*").alias("n"))
    base = items.select("suite", "method_seq", vec).join(sizes, "suite").withColumn("k", neighbour_k(F.col("n")))
    schema = "suite {suite}, metric string, a long, d array<double>, k int"
    cand = BK.run_pairs(base.drop("n"), ["suite"], _kdist_kernel(metrics, vec), schema, block_size)
    least = cand.groupBy("suite", "metric", "a", "k").agg(F.array_sort(F.flatten(F.collect_list("d"))).alias("d"))
    return least.filter(F.size("d") >= F.col("k")).select("suite", "metric", "a", "k", F.element_at("d", F.col("k")).alias("kdist"))


# ---------------- K7-K9 centroids, nearest, inertia ----------------

def centroids(labeled: DataFrame, vec: str = "vec", keys: list[str] = ["suite", "cluster"]) -> DataFrame:
    """K8: mean vector per (suite, cluster)."""
    s = labeled.select(*keys, array_to_vector(F.col(vec)).alias("_v")).groupBy(*keys).agg(
        Summarizer.mean(F.col("_v")).alias("_m"), F.count("*").alias("size"))
    return s.select(*keys, vector_to_array("_m").alias("centroid"), "size")


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def assign_nearest(items: DataFrame, cents: DataFrame, vec: str = "vec", keys: list[str] = ["suite"]) -> DataFrame:
    """K7: nearest centroid (squared L2; ties to the smaller cluster id).  The join
    is items x centroids of the same suite: k rows per item, k small."""
    j = items.join(cents.select(*keys, F.col("cluster").alias("_c"), "centroid"), keys)
    j = j.withColumn("_d", sq_dist(F.col(vec), F.col("centroid")))
    cols = [c for c in items.columns]
    return j.groupBy(*cols).agg(F.min_by(F.col("_c"), F.struct(F.col("_d"), F.col("_c"))).alias("cluster"),
                                F.min("_d").alias("sq_dist"))


def inertia(labeled: DataFrame, cents: DataFrame, vec: str = "vec", keys: list[str] = ["suite", "cluster"],
            group: list[str] = ["suite"]) -> DataFrame:
    """K9: sum of squared distances to the own centroid."""
    j = labeled.join(cents.select(*keys, "centroid"), keys)
    return j.groupBy(*group).agg(F.sum(sq_dist(F.col(vec), F.col("centroid"))).alias("inertia"))


# ---------------- B16 covariance, B15 PCA ----------------

def _partial_scatter():
    def fn(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            for s, g in pdf.groupby("suite", sort=False):
                X = np.stack([np.asarray(v, dtype=np.float64) for v in g["c"].values])
                yield pd.DataFrame({"suite": [s], "m": [(X.T @ X).ravel().tolist()], "cnt": [len(X)]})

    return fn


def covariance(items: DataFrame, vec: str = "vec") -> DataFrame:
    """Sample covariance matrix per suite as (suite, i, j, cov).  Each partition
    emits its partial centred scatter matrix per suite (map-side combine), then the
    partials are summed per suite: the data is read once, no pair rows."""
    st = suite_stats(items, vec)
    c = items.join(st.select("suite", "mean", "n"), "suite").select(
        "suite", F.transform(F.col(vec), lambda x, i: x - F.col("mean")[i]).alias("c"))
    part = c.mapInPandas(_partial_scatter(), f"suite {BK.key_type(items)}, m array<double>, cnt long")
    tot = part.select("suite", array_to_vector("m").alias("m"), "cnt").groupBy("suite").agg(
        Summarizer.sum(F.col("m")).alias("m"), F.sum("cnt").alias("cnt"))
    flat = tot.select("suite", "cnt", F.posexplode(vector_to_array("m")).alias("p", "s"))
    dims_df = flat.groupBy("suite").agg(F.sqrt(F.count("*")).cast("int").alias("dims"))
    return flat.join(dims_df, "suite").select(
        "suite", (F.col("p") / F.col("dims")).cast("int").alias("i"), (F.col("p") % F.col("dims")).cast("int").alias("j"),
        F.when(F.col("cnt") > 1, F.col("s") / (F.col("cnt") - 1)).alias("cov"))


def _pca_kernel():
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["i"].max()) + 1
        C = np.zeros((d, d))
        C[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["cov"].fillna(0.0).to_numpy()
        w, V = np.linalg.eigh(C)
        order = np.argsort(w)[::-1][:2]
        comps = []
        for idx in order:
            v = V[:, idx]
            if v[np.argmax(np.abs(v))] < 0:
                v = -v
            comps.append(v.tolist())
        while len(comps) < 2:
            comps.append([0.0] * d)
        return pd.DataFrame({"suite": [pdf["suite"].iloc[0]], "pc1": [comps[0]], "pc2": [comps[1]],
                             "ev1": [float(w[order[0]])], "ev2": [float(w[order[1]]) if len(order) > 1 else 0.0]})

    return fn


def pca_2d(items: DataFrame, vec: str = "vec") -> DataFrame:
    """Two principal components of the centred raw vectors per suite.  The
    eigen problem is d x d per suite (bounded by the dimension, not the data);
    sign convention: the largest-magnitude loading is positive."""
    cov = covariance(items, vec)
    comps = cov.groupBy("suite").applyInPandas(
        _pca_kernel(), f"suite {BK.key_type(items)}, pc1 array<double>, pc2 array<double>, ev1 double, ev2 double")
    st = suite_stats(items, vec)
    j = items.join(st.select("suite", "mean"), "suite").join(comps, "suite")
    cvec = F.transform(F.col(vec), lambda x, i: x - F.col("mean")[i])
    return j.select("suite", "method_seq", dot(cvec, F.col("pc1")).alias("x"), dot(cvec, F.col("pc2")).alias("y"))


# ---------------- B1/B3 built-in hashing embedder, B4-B6 pooling ----------------

def tokens(code: Column | str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), 1)


def truncate_tokens(toks: Column, max_length: int = MAX_TOKENS) -> Column:
    """The first ``max_length`` tokens."""
    return F.slice(toks, 1, max_length)


class _TokenBuckets(dict):
    """token -> (bucket, sign); starts anew when it holds a million tokens; long tokens aren't kept."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, token: bytes) -> tuple[int, float]:
        if len(self) >= 1_000_000:
            self.clear()
        h = hashlib.md5(token).hexdigest()
        v = (int(h[:8], 16) % self.dims, 1.0 if int(h[8], 16) < 8 else -1.0)
        if len(token) <= 64:
            self[token] = v
        return v


def hashing_embed(items: DataFrame, code: str = "code", dims: int = HASH_DIMS, max_length: int | None = None,
                  out: str = "vec") -> DataFrame:
    """B1 built-in embedder: signed feature hashing of all tokens (bucket = md5 prefix mod dims, sign from the
    next hex digit), L2 normalised; ``max_length`` truncates only when a caller asks for it.  A map over Arrow
    batches that appends one column: no shuffle and no join back.  Items without tokens get zeros."""
    schema = T.StructType([f for f in items.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches):
        buckets = _TokenBuckets(dims)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(code)).to_pylist()
            v = np.zeros((len(texts), dims))
            for i, text in enumerate(texts):
                toks = (text or "").encode("utf-8", "surrogatepass").split()[:max_length]
                if toks:
                    at, sign = zip(*map(buckets.__getitem__, toks))
                    v[i] = np.bincount(at, weights=sign, minlength=dims)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, norm, out=v, where=norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(list(v), pa.list_(pa.float64()))],
                                             names=[*keep, out])

    return items.mapInArrow(run, schema)


def hashing_embed_idf(items: DataFrame, code: str = "code", dims: int = HASH_DIMS, out: str = "vec") -> DataFrame:
    """B1 with inverse document frequencies: a token weighs ln((1 + items) / (1 + items that hold it)) + 1 an occurrence.
    (suite, method_seq, ``out``). Texts are dealt by item, so that an item's tokens are counted where it is. The weights of common tokens (held by
    more than one item in ``COMMON_SHARE``: few, however many items there are) go to every task, where most of an item's vector is summed; only
    rows of the other tokens are joined by token. Buckets and signs as ``hashing_embed``."""
    dealt = items.select("suite", "method_seq", code).repartition("suite", "method_seq")
    found = dealt.select("suite", "method_seq", F.explode(tokens(code)).alias("tok")).groupBy("suite", "method_seq", "tok").agg(F.count("*").alias("n"))
    total = items.count()
    idf = F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0
    table = cut_lineage(found.groupBy("tok").agg(F.count("*").alias("df")).select("tok", "df", idf.alias("idf")))
    common = F.col("df") > max(COMMON_LEAST, total // COMMON_SHARE)
    often, seldom = table.filter(common).select("tok", "idf"), table.filter(~common).select("tok", "idf")
    size = often.agg(F.sum(F.octet_length("tok") + 24).alias("b")).first()["b"] or 0
    often = often.withColumnRenamed("idf", "_idf")
    met = found.join(F.broadcast(often) if size <= VOCABULARY else often, "tok", "left")
    hit = met.filter(F.col("_idf").isNotNull()).select("suite", "method_seq", "tok", "n", F.col("_idf").alias("idf"))
    rows = hit.unionByName(met.filter(F.col("_idf").isNull()).drop("_idf").join(seldom, "tok").select(hit.columns))
    digest = F.md5("tok")
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    parts = rows.groupBy("suite", "method_seq", bucket.alias("k")).agg(F.sum(F.col("n") * F.col("idf") * sign).alias("v"))
    made = parts.groupBy("suite", "method_seq").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n"))
    joined = items.select("suite", "method_seq").join(made, ["suite", "method_seq"], "left")
    part = lambda i: F.when(F.col("_n") > 0, F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_n")).otherwise(F.lit(0.0))
    return joined.select("suite", "method_seq", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), part).alias(out))


def _pooled(token_vecs: DataFrame, vec: str, value: Callable[[Column], Column]) -> DataFrame:
    """One aggregate per item and dimension. Numbers in the buffers keep it a hash aggregate, which folds an item's
    tokens before the shuffle; an array or a summarizer in them makes Spark sort all tokens instead. Vectors have one length."""
    one = token_vecs.select(F.size(vec).alias("d")).first()
    dims = max(one["d"], 0) if one and one["d"] is not None else 0
    odd = F.raise_error(F.lit(f"token vectors of different length: not all have {dims} parts")).cast("array<double>")
    same = token_vecs.withColumn(vec, F.when(F.size(vec) == dims, F.col(vec)).otherwise(odd))
    made = same.groupBy("suite", "method_seq").agg(F.count("*").alias("_n"), *[value(F.col(vec)[i]).alias(f"_{i}") for i in range(dims)])
    return made.select("suite", "method_seq", F.array(*[f"_{i}" for i in range(dims)]).cast("array<double>").alias(vec))


def pool_cls(token_vecs: DataFrame, vec: str = "vec") -> DataFrame:
    """The first token's vector per item."""
    at = F.shiftleft(F.col("pos").cast("long"), 32) + F.pmod(F.xxhash64(vec), F.lit(1 << 32))  # one token's whole vector where places repeat
    return _pooled(token_vecs.withColumn("_at", at), vec, lambda x: F.min_by(x, "_at"))


def pool_mean(token_vecs: DataFrame, vec: str = "vec") -> DataFrame:
    """Element-wise mean over an item's tokens."""
    return _pooled(token_vecs, vec, F.avg)


def pool_direct(df: DataFrame, col: str, out: str = "vec") -> DataFrame:
    """The plug-in's output used as the vector."""
    return df.withColumn(out, F.col(col).cast("array<double>"))


# ---------------- B2 / UF1 embedder registry and plug-ins ----------------

class Embedder:
    """Contract shared by all embedders: DataFrame with a text column in,
    the same rows with an ``array<double>`` vector column out."""

    def embed(self, df: DataFrame, text_col: str = "code", out: str = "vec") -> DataFrame:
        raise NotImplementedError


class HashingEmbedder(Embedder):
    def __init__(self, dims: int = HASH_DIMS, max_length: int | None = None):
        self.dims, self.max_length = dims, max_length

    def embed(self, df, text_col="code", out="vec"):
        return hashing_embed(df, text_col, self.dims, self.max_length, out)


class PandasEmbedder(Embedder):
    """A user model as ``mapInPandas``: ``load()`` runs once per task and returns
    ``encode(list[str]) -> np.ndarray``; batches arrive as Arrow record batches."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], batch_rows: int = 256):
        self.load, self.batch_rows = load, batch_rows

    def embed(self, df, text_col="code", out="vec"):
        load, text, rows = self.load, text_col, self.batch_rows
        from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
        schema = StructType(df.schema.fields + [StructField(out, ArrayType(DoubleType()))])

        def fn(it):
            encode = load()
            for pdf in it:
                if len(pdf) == 0:
                    continue
                for at in range(0, len(pdf), rows):
                    part = pdf.iloc[at : at + rows]
                    m = np.asarray(encode(part[text].fillna("").tolist()), dtype=np.float64)
                    yield part.assign(**{out: list(m)})

        return df.mapInPandas(fn, schema)


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder}


def register_embedder(name: str, factory: Callable[[], Embedder]) -> None:
    EMBEDDERS[name] = factory


def get_embedder(name: str) -> Embedder:
    """B2: name -> embedder; an unknown name is an error."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {name}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]()


# ---------------- B11 similarity matrix summaries, J7 pair enumeration ----------------

def _similarities(va: np.ndarray, vb: np.ndarray, metric: str) -> np.ndarray:
    return BK.similarity_from_distance(BK.euclidean_tile(va, vb) if metric == "euclidean" else BK.distance_tile(va, vb, metric), metric)


def _rowsum_kernel(metrics: tuple[str, ...], vec: str):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        suite = pdf["suite"].iloc[0]
        a, va, b, vb, axes = BK.sides(pdf, vec)
        if len(a) and len(b):
            aseq, bseq = a["method_seq"].to_numpy(), b["method_seq"].to_numpy()
            itself = aseq[:, None] == bseq[None, :]
            for m in metrics:
                S = _similarities(va, vb, m)
                S[itself] = -np.inf
                most = [np.fmax.reduce(S, axis=axis, initial=-np.inf) for axis in axes]
                S[itself] = 0.0
                for axis, mx in zip(axes, most):
                    s = np.nansum(S, axis=axis)
                    out.append(pd.DataFrame({"suite": suite, "metric": m, "a": aseq if axis else bseq, "s": s, "mx": mx, "n": (~itself).sum(axis=axis)}))
        if not out:
            return pd.DataFrame({"suite": pd.Series(dtype=pdf["suite"].dtype), "metric": [], "a": [], "s": [], "mx": [], "n": []})
        return pd.concat(out, ignore_index=True)

    return kernel


def similarity_summary(items: DataFrame, metrics: tuple[str, ...] = BK.METRICS, vec: str = "vec",
                       block_size: int = BK.DEFAULT_BLOCK) -> DataFrame:
    """The rows of each suite's similarity matrix reduced to their mean and max similarity to the other items (null where there are none),
    tile by tile. ``similarity_matrix`` has the matrix."""
    schema = "suite {suite}, metric string, a long, s double, mx double, n long"
    part = BK.run_pairs(items.select("suite", "method_seq", vec), ["suite"], _rowsum_kernel(metrics, vec), schema, block_size)
    return part.groupBy("suite", "metric", "a").agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("mean_similarity"), F.when(F.sum("n") > 0, F.max("mx")).alias("max_similarity"))


def _matrix_kernel(metrics: tuple[str, ...], vec: str):
    """Per metric and item of a tile one row: the other block's items and the similarities to them."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        suite = pdf["suite"].iloc[0]
        a, va, b, vb, axes = BK.sides(pdf, vec)
        if len(a) and len(b):
            for i, m in enumerate(metrics):
                S = _similarities(va, vb, m)
                for axis in axes:
                    mine, others, tile = (a, b, S) if axis else (b, a, S.T)
                    seq = others["method_seq"].to_numpy()
                    out.append(pd.DataFrame({"suite": suite, "metric": m, "a": mine["method_seq"].to_numpy(), "b": [seq] * len(mine), "score": list(np.ascontiguousarray(tile)),
                                             "mean_similarity": [x[i] for x in mine["means"]], "max_similarity": [x[i] for x in mine["mosts"]]}))
        if not out:
            return pd.DataFrame({"suite": pd.Series(dtype=pdf["suite"].dtype), "metric": [], "a": [], "b": [], "score": [], "mean_similarity": [], "max_similarity": []})
        return pd.concat(out, ignore_index=True)

    return kernel


def similarity_matrix(items: DataFrame, metrics: tuple[str, ...] = BK.METRICS, vec: str = "vec", block_size: int = MATRIX_BLOCK) -> DataFrame:
    """The whole pairwise similarity matrix of each suite and metric, both directions and the diagonal, a row per entry:
    (suite, metric, a, b, similarity), and with it its row's mean and max (``similarity_summary``). The summaries travel with the items, so
    the entries aren't joined or shuffled: they leave the tiles as one array per item and are opened where they are."""
    summary = cut_lineage(similarity_summary(items, metrics, vec))
    at = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    by_metric = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col(c)))), lambda x: x[c])
    rows = summary.groupBy("suite", F.col("a").alias("method_seq")).agg(by_metric("mean_similarity").alias("means"), by_metric("max_similarity").alias("mosts"))
    schema = "suite {suite}, metric string, a long, b array<long>, score array<double>, mean_similarity double, max_similarity double"
    base = items.select("suite", "method_seq", vec).join(rows, ["suite", "method_seq"])
    entries = BK.run_pairs(base, ["suite"], _matrix_kernel(metrics, vec), schema, block_size, bundled=False)
    entries = entries.select("suite", "metric", "a", "mean_similarity", "max_similarity", F.explode(F.arrays_zip("b", "score")).alias("e"))
    return entries.select("suite", "metric", "a", F.col("e.b").alias("b"), F.col("e.score").alias("similarity"), "mean_similarity", "max_similarity")


def pair_count(items: DataFrame, block_size: int = BK.DEFAULT_BLOCK) -> DataFrame:
    """J7 re-aimed: how many unordered pairs the block-pair enumeration covers per
    suite (each pair exactly once: n (n - 1) / 2) — without emitting them."""
    rep = BK.replicate_pairs(BK.assign_blocks(items.select("suite", "method_seq"), ["suite"], block_size))
    per_tile = rep.groupBy("suite", "lo", "hi").agg(
        F.count_if(F.col("blk") == F.col("lo")).alias("na"), F.count_if(F.col("blk") == F.col("hi")).alias("nb"))
    pairs = F.when(F.col("lo") == F.col("hi"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    return per_tile.groupBy("suite").agg(F.sum(pairs).cast("long").alias("pairs"))
