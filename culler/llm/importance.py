"""Target-distribution importance resampling over hashed n-grams, counted by batch concatenation.

The n-grams (1 to 3 consecutive words) of a text fall into ``BUCKETS`` by the CRC-32 of their bytes, words joined by one
space. Two bucket histograms, of the raw documents and of the target's texts, give each bucket a gain, the log of the
smoothed ratio; a document's weight is the sum of its n-grams' gains. Adding Gumbel noise drawn from the id and taking
the highest scores samples without replacement in proportion to exp(weight / 1000).

Counting joins a batch's texts with a sentinel byte that no word holds. One regex pass finds all words and
sentinels in a row, ``searchsorted`` on the sentinels' places gives each word's document, n-grams whose first and last
word differ in document are masked, and one ``bincount`` counts the rest. The CRC-32 of a run of words follows from
those of its words: appending n bytes is a linear map of the 32 bits, kept as lookup tables by length.

Scale: both passes over the texts are maps; a task sends at most ``BUCKETS`` numbers to the histogram, whose size is fixed,
so the driver holds two arrays of ``BUCKETS`` numbers. Ranks come from range partitions (``ranked``), no single task. Texts
are joined up to ``BATCH_BYTES``; a longer text is a batch of its own.

Defined cases: a null or empty text has no n-grams and weight 0; a null id draws its noise as an empty string; repeated
rows keep a row and a rank each; ties go to the smaller id, null last; an empty table gives an empty result, an
empty target only smoothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from culler.llm.common import prepare, written
from culler.operators.ranks import ranked

BUCKETS = 10_000
ORDERS = 3
SEED = 42
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Share drawn, in hundredths.
PERCENT = 5
BATCH_BYTES = 1 << 22

_SENTINEL = b"\x00"
#: A word or a sentinel, in bytes: digits, small letters and all that isn't ASCII.
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
_POLYNOMIAL = np.uint32(0xEDB88320)  # Fixed value: CRC-32, reflected.
#: Appending up to so many bytes has its own table; more are appended in steps of it.
_STEP = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ _POLYNOMIAL, table >> 1).astype(np.uint32)
    return table


_CRC = _byte_table()


def _append_tables() -> np.ndarray:
    """[n, k, b]: what byte b at place k of a CRC turns into when n bytes follow."""
    one = np.array([[np.uint32(b) << np.uint32(8 * k) for b in range(256)] for k in range(4)], dtype=np.uint32)
    out = [one]
    for _ in range(_STEP):
        x = out[-1]
        out.append(_CRC[x & 0xFF] ^ (x >> np.uint32(8)))
    return np.array(out, dtype=np.uint32)


_APPEND = _append_tables().ravel()
_SPACE = np.uint32(zlib.crc32(b" "))


def _appended(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of CRC(A + B) that A gives, from CRC(A) and the length of B."""
    crc, n = crc.copy(), n.copy()
    while len(far := np.flatnonzero(n > _STEP)):
        crc[far] = _appended(crc[far], np.full(len(far), _STEP, dtype=np.int64))
        n[far] -= _STEP
    at = n * 1024
    out = _APPEND[at + (crc & 0xFF)]
    for k in (1, 2, 3):
        out ^= _APPEND[at + 256 * k + ((crc >> np.uint32(8 * k)) & 0xFF)]
    return out


def word_crcs(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of every word; ``flat``: the words' bytes in a row. All words advance one byte at a time."""
    order = np.argsort(-np.minimum(sizes, _STEP + 1), kind="stable")
    starts, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    state = np.full(len(sizes), 0xFFFFFFFF, dtype=np.uint32)
    alive = len(sizes) - np.searchsorted(np.minimum(lengths, _STEP)[::-1], np.arange(_STEP), side="right")
    for k, m in enumerate(alive):
        if not m:
            break
        x = state[:m]
        state[:m] = _CRC[(x ^ flat[starts[:m] + k]) & 0xFF] ^ (x >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _STEP):  # rare: the rest of a long word in one call
        state[i] = zlib.crc32(flat[starts[i] + _STEP : starts[i] + lengths[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def batch_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of a batch: (document, bucket), and the number of words of each document."""
    # a text's own NUL bytes part words like a space
    tokens = _TOKEN.findall(_SENTINEL.join([(t or b"").replace(_SENTINEL, b" ") for t in texts]).lower())
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    is_end = flat[starts] == 0 if len(tokens) else np.zeros(0, dtype=bool)
    ends = np.flatnonzero(is_end)
    places = np.flatnonzero(~is_end)
    document = np.searchsorted(ends, places)  # sentinels before the word
    n_words = np.bincount(document, minlength=len(texts))
    crc = word_crcs(flat, sizes)[places]
    sizes = sizes[places]
    spaced = _appended(np.full(len(crc), _SPACE, dtype=np.uint32), sizes) ^ crc  # CRC of a space and the word
    documents, buckets = [document], [crc % BUCKETS]
    run = crc
    for n in range(2, ORDERS + 1):
        run = _appended(run[:-1], sizes[n - 1 :] + 1) ^ spaced[n - 1 :] if len(run) else run
        inside = document[: len(run)] == document[n - 1 : n - 1 + len(run)]
        documents.append(document[: len(run)][inside])
        buckets.append(run[inside] % BUCKETS)
    return np.concatenate(documents), np.concatenate(buckets).astype(np.int64), n_words


def slices(texts: list[bytes | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of at most ``limit`` bytes together, or one text."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > first and total + n > limit:
            yield first, texts[first:i]
            first, total = i, 0
        total += n
    if texts:
        yield first, texts[first:]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, texts in slices(batch.column(0).to_pylist()):
            total += np.bincount(batch_features(texts)[1], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])


def histogram(docs: DataFrame) -> np.ndarray:
    """Number of n-grams of all texts in each bucket; ``BUCKETS`` numbers reach the driver."""
    parts = docs.select(docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(_histogram, "bucket long, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: floor(1000 ln(p_target / p_raw)), add-one smoothed, in doubles."""
    s_all, t_all = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0), batch.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for first, texts in slices(batch.column(1).to_pylist()):
                document, bucket, n_words = batch_features(texts)
                rows = slice(first, first + len(texts))
                words[rows] = n_words
                features[rows] = np.bincount(document, minlength=len(texts))
                # gains are whole numbers and sums far below 2**53, so doubles are exact
                weight[rows] = np.bincount(document, weights=gain[bucket], minlength=len(texts)).astype(np.int64)
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], dtype=np.int64).reshape(n)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (words, features, weight, score))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row; ``rank`` is null for rows that aren't drawn."""
    prepare(docs.sparkSession)
    gain = gains(histogram(docs), histogram(target))
    rows = written(weigh(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "importance")
    long_enough = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * long_enough.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = ranked(long_enough, [], order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(short).drop("row")
