"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a short vector of statistics (shares of character classes, repetition, word shape), each
put through a logarithm that spreads small shares. Per class the training rows give a mean and a
covariance, which is shrunk towards the pooled diagonal, ``(1 - a) S + a diag(pooled)``, and factored once by
Cholesky; the factor's inverse is kept. A score is the logistic of the difference of the two Gaussian
log densities over a temperature plus the log odds of the classes in training: each density is minus half the
squared Mahalanobis distance, |L^-1 (x - m)|^2, minus the sum of log diag L.

Shrinkage and temperature are chosen among ``SHRINKAGES`` and ``TEMPERATURES`` by cross-validation inside the
training rows: each of ``FOLDS`` folds is scored by models of the other folds, and the pair with the smallest mean
log loss wins (the first of equals). Held-out rows take no part in any choice.

Scale: texts are read once for the statistics and once more where documents themselves are filtered; no text is
shuffled. Fitting sums counts, sums and products per (fold, class) with partial aggregation: two rows a fold
reach the driver, of a size that depends on the number of statistics alone, then one sum per pair of settings.

Defined cases: a null or empty text has the statistics of no words, and a score like any other; a null id is
never labelled or held out; of several labels of one id their mean decides (1 from a half up), null labels
don't count; repeated rows keep a row each; with training rows in one fold only the first settings are taken; without training rows of both classes the score is the share of
label 1 among the training rows, smoothed by one of each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from culler.llm.common import prepare, written

SHRINKAGES = (0.01, 0.05, 0.2, 0.5)
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0)
FOLDS = 5
RIDGE = 1e-4
THRESHOLD = 0.7
#: Ids whose CRC-32 modulo 4 is this are held out.
HELD_OUT = 2

_CLASSES = (
    bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?!|"),  # symbols
    b"|", b"!", b".,;:", b"\n", bytes(range(48, 58)), bytes(range(65, 91)),
)
STATISTICS = ("symbols", "bars", "exclamations", "stops", "line_ends", "digits", "capitals", "repeats", "distinct", "word_length", "words")
_EPS = 1e-3


def text_statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    out = [np.log(_EPS + (len(raw) - len(raw.translate(None, c))) / n) for c in _CLASSES]
    words = raw.lower().split()
    k = len(words)
    out.append(np.log(_EPS + sum(map(eq, words, words[1:])) / max(1, k - 1)))
    # distinct words as a power of all words: near 1 in short texts and steady in long ones
    out.append(np.log(max(1, len(set(words)))) / np.log(k) if k > 1 else 1.0)
    out.append(np.log(1 + (sum(map(len, words)) / k if k else 0.0)))
    out.append(np.log1p(k) / 4)
    return out


def statistics(texts: list[str | None]) -> np.ndarray:
    return np.array([text_statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors by class; ``prior`` alone where a class had no rows."""

    prior: float
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    log_diag: np.ndarray | None = None
    temperature: float = 1.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0; 0 without classes."""
        if self.means is None:
            return np.zeros(len(x))
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - d for m, w, d in zip(self.means, self.whiten, self.log_diag)]
        return density[1] - density[0]

    def odds(self, log_ratio: np.ndarray, temperature: float) -> np.ndarray:
        return np.clip(log_ratio / temperature + np.log(self.prior / (1 - self.prior)), -500, 500)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(self.log_ratio(x), self.temperature)))


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    """The cross-validation fold: the part of the id's CRC-32 that doesn't decide whether it is held out."""
    return (F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 4) % folds).cast("int")


def moments(rows: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """(fold, label) -> count, sums and sums of products of ``rows``: fold, label, x."""
    d = len(STATISTICS)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in upper]
    out = {}
    for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n"), *sums, *products).collect():
        p = np.zeros((d, d))
        for i, j in upper:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r["fold"], r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), p)
    return out


def discriminant(found: dict, shrinkage: float, temperature: float = 1.0, without: int | None = None) -> Discriminant:
    """The model of all folds but ``without``."""
    d = len(STATISTICS)
    parts = [[v for (fold, c), v in sorted(found.items()) if c == label and fold != without] for label in (0, 1)]
    counts = [sum(v[0] for v in p) for p in parts]
    prior = (counts[1] + 1) / (sum(counts) + 2)
    if not min(counts):
        return Discriminant(prior)
    means = [sum((v[1] for v in p), np.zeros(d)) / n for p, n in zip(parts, counts)]
    covariances = [sum((v[2] for v in p), np.zeros((d, d))) / n - np.outer(m, m) for p, n, m in zip(parts, counts, means)]
    pooled = sum(n * s for n, s in zip(counts, covariances)) / sum(counts)
    target = np.diag(np.diag(pooled)) + RIDGE * np.eye(d)
    factors = [np.linalg.cholesky((1 - shrinkage) * s + shrinkage * target) for s in covariances]
    return Discriminant(prior, np.array(means), np.array([np.linalg.inv(f) for f in factors]),
                        np.array([np.log(np.diag(f)).sum() for f in factors]), temperature)


def fit(rows: DataFrame, shrinkages: Sequence[float] = SHRINKAGES, temperatures: Sequence[float] = TEMPERATURES) -> Discriminant:
    """``rows``: fold, label (0 or 1), x (array of the statistics). Settings by cross-validation over the folds."""
    found = moments(rows)
    folds = sorted({fold for fold, _ in found})
    settings = [(a, t) for a in shrinkages for t in temperatures]
    if len(folds) < 2 or len({label for _, label in found}) < 2:
        return discriminant(found, *settings[0])
    models = {(fold, a): discriminant(found, a, without=fold) for fold in folds for a in shrinkages}

    def losses(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(settings))
        for part in parts:
            for fold, piece in part.groupby("fold"):
                x, sign = np.array(piece["x"].tolist(), dtype=np.float64), 1 - 2 * piece["label"].to_numpy()
                ratio = {a: models[fold, a].log_ratio(x) for a in shrinkages}
                total += [np.logaddexp(0, sign * models[fold, a].odds(ratio[a], t)).sum() for a, t in settings]
        yield pd.DataFrame({"setting": np.arange(len(settings)), "loss": total})

    n = sum(v[0] for v in found.values())
    summed = rows.select("fold", "label", "x").mapInPandas(losses, "setting int, loss double").groupBy("setting").agg(F.sum("loss").alias("loss")).collect()
    best = min((round(r["loss"] / n, 9), r["setting"]) for r in summed)[1]
    return discriminant(found, *settings[best])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: a small table in the shared folder, one row per document."""
    prepare(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return written(narrow.mapInArrow(_features, "doc_id long, x array<double>"), "quality-statistics")


def fit_labelled(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on the labelled documents that aren't held out; the training rows are a small table of their own."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(
        (F.avg("quality") >= 0.5).cast("int").alias("label"))
    training = stats.filter(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("__id"))
    return fit(written(training.select(fold_of(F.col("doc_id")).alias("fold"), "label", "x"), "quality-training"))


def score_statistics(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted from the table of statistics."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.array(part["x"].tolist(), dtype=np.float64).reshape(len(part), len(STATISTICS))
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": model.score(x)})

    scored = stats.select("doc_id", "x", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more. A map: nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(statistics(batch.column(at).to_pylist()))
            yield batch.filter(pa.array(score >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
