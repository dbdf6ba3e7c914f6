"""Language-model scores by stupid backoff, computed relationally.

Every row's n-grams (runs of 1 to ``order`` words, 3 by default) are joined to count tables that are partitioned by
the n-gram's hash, and the logarithms are summed per document. For the longest history h that a word has, and then
for its shorter ones:

    log S(w | h) = log(c(h w) / c(h))       if c(h w) > 0
                 = log(0.4) + log S(w | h') else, h' being h without its first word
    log S(w)     = log(c(w) / N)            if c(w) > 0
                 = log(0.4) - log(N)        else

c counts over all rows, N is the number of all words. With ``leave_out`` (the default) the row's own
n-grams are taken from c(h w), c(h) and c(w), so that a row doesn't vouch for itself; the first word has no h, the
second one a word, and so on.
Words are compared in their own case.

Rows of (document, n-gram) would be several times the text on disk, so they travel packed: documents are dealt
to batches by hash, a batch's distinct n-grams become one row per hash partition (gaps between
sorted 64-bit hashes, with counts, compressed), and the partition answers each such row with the totals.
1. documents by batch, texts compressed -> n-gram rows by partition (the exploded side, pre-aggregated per batch);
2. partition: count table from all its rows, joined back to each of them -> totals by batch;
3. documents and totals meet by batch -> scores.

Scale: rows are dealt to batches by id and text, so only wholly equal rows share one for certain. A frequent n-gram is one entry per batch, whatever its count, so no partition is hot; a batch holds about
``BATCH_DOCS`` documents (the larger, the more of its n-grams are sent only once), a partition the n-grams of about ``DOCS_PER_PARTITION``, and the number of both follows from
the row count. A batch visits only the partitions that its n-grams fall into. Batches depend on the rows' values alone, so a retried task deals them the same.

Defined cases: a null or wordless text scores null with 0 words; null and equal ids and repeated rows keep a row
each (each counts in full for the others); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from culler.llm.common import n_words, prepare
from culler.llm.words import ngrams, word_hashes

BACKOFF = 0.4
BATCH_DOCS = 6000
#: Bytes of rows that a task deals to batches, and compresses, at a time.
PACK_BYTES = 32 << 20
#: Texts of a batch that are in work at once.
SLICE_DOCS = 100
#: Hash partitions of the count tables: one for every so many documents.
DOCS_PER_PARTITION = 2000
ORDER = 3
#: Keeps the orders' hashes apart: order k's are shifted by k - 1 times this odd number.
_ORDER_SALT = 0x9E3779B97F4A7C15
_DOCS = "batch int, ids binary, known binary, sizes binary, texts binary"
_KEYS = "batch int, part int, grams binary, counts binary"
_TOTALS = "batch int, part int, totals binary"


def _packed(x: np.ndarray) -> bytes:
    """The numbers' bytes, all first bytes first (small numbers leave long runs), compressed behind their length."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, dtype: type) -> np.ndarray:
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _packed_grams(ascending: np.ndarray) -> bytes:
    return _packed(np.diff(ascending, prepend=np.uint64(0)))


def _unpacked_grams(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw, np.uint64), dtype=np.uint64)


def _packed_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of batch, doc_id and text (as bytes), packed: one row for each batch that they fall into."""
    held, size = [], 0
    for rows in batches:
        held.append(rows)
        size += rows.nbytes
        if size >= PACK_BYTES:
            yield _packed_rows(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield _packed_rows(pa.Table.from_batches(held))


def _packed_rows(rows: pa.Table) -> pa.RecordBatch:
    rows = rows.sort_by("batch").combine_chunks()
    batch, doc_id = rows["batch"].to_numpy(), rows["doc_id"]
    ids, known = doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy()
    text = pa.concat_arrays(rows["text"].cast(pa.large_binary()).fill_null(b"").chunks or [pa.array([], pa.large_binary())])
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, dtype=np.int64)
    data, zstd = memoryview(text.buffers()[2] or b""), pa.Codec("zstd", compression_level=3)
    starts = np.flatnonzero(np.r_[len(batch) > 0, batch[1:] != batch[:-1]])
    runs = list(zip(starts.tolist(), np.r_[starts[1:], len(batch)].tolist()))
    columns = [[x[a:b].tobytes() for a, b in runs] for x in (ids, known, np.diff(ends))]
    texts = [zstd.compress(data[ends[a] : ends[b]], asbytes=True) for a, b in runs]
    return pa.RecordBatch.from_arrays([pa.array(batch[starts], pa.int32()), *(pa.array(c, pa.binary()) for c in (*columns, texts))],
                                      names=["batch", "ids", "known", "sizes", "texts"])


def _docs_of(packed: pd.DataFrame) -> pd.DataFrame:
    """The rows again: batch, doc_id, text."""
    texts = []
    for raw, sizes in zip(packed["texts"], packed["sizes"]):
        ends = np.cumsum(np.frombuffer(sizes, dtype=np.int64)).tolist()
        whole = pa.decompress(raw, ends[-1], codec="zstd", asbytes=True) if ends[-1] else b""
        texts += [whole[a:b] for a, b in zip([0, *ends], ends)]
    ids = np.frombuffer(b"".join(packed["ids"]), dtype=np.int64)
    unknown = ~np.frombuffer(b"".join(packed["known"]), dtype=bool)
    return pd.DataFrame({"batch": packed["batch"].iloc[0], "doc_id": pd.arrays.IntegerArray(ids.copy(), unknown), "text": texts})


def _batch_grams(flat: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: (hashes in a row, number per text)."""
    return [(h ^ np.uint64((k - 1) * _ORDER_SALT % 2**64), n) for k in range(1, order + 1) for h, n in [ngrams(flat, sizes, k)]]


def _hashed(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and the number of words of each; the words themselves are held slice by slice."""
    parts = [word_hashes(texts[i : i + SLICE_DOCS], lower=False) for i in range(0, len(texts), SLICE_DOCS)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else word_hashes([], lower=False)


def _slices(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ends = np.r_[0, np.cumsum(sizes)]
    return ((flat[ends[i] : ends[min(i + SLICE_DOCS, len(sizes))]], sizes[i : i + SLICE_DOCS]) for i in range(0, len(sizes), SLICE_DOCS))


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, the sums of their counts, and where each given one stands."""
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64), place


def _batch_table(flat: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's distinct n-grams, ascending, and their counts."""
    grams = np.concatenate([g for part in _slices(flat, sizes) for g, _ in _batch_grams(*part, order)] or [flat])
    grams.sort()
    starts = np.flatnonzero(np.r_[len(grams) > 0, grams[1:] != grams[:-1]])
    return grams[starts], np.diff(starts, append=len(grams))


def _part(grams: np.ndarray, parts: int) -> np.ndarray:
    """Partition by the top bits, so that sorted hashes are sorted by partition as well."""
    return ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _runs(distinct: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(partition, first, end) of the sorted n-grams, for the partitions that hold any."""
    part = _part(distinct, parts)
    starts = np.flatnonzero(np.r_[len(part) > 0, part[1:] != part[:-1]])
    return zip(part[starts].tolist(), starts.tolist(), np.r_[starts[1:], len(part)].tolist())


def _grams_of(pdf: pd.DataFrame, parts: int, order: int) -> pd.DataFrame:
    distinct, counts = _batch_table(*_hashed(pdf["text"].tolist()), order)
    rows = [(int(pdf["batch"].iloc[0]), p, _packed_grams(distinct[a:b]), _packed(counts[a:b])) for p, a, b in _runs(distinct, parts)]
    return pd.DataFrame(rows, columns=["batch", "part", "grams", "counts"])


def _totals_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The partition's count table, joined back to the rows that it came from."""
    grams = [_unpacked_grams(g) for g in pdf["grams"]]
    _, table, place = _merged(grams, [_unpacked(c, np.int64) for c in pdf["counts"]])
    answers = np.split(table[place], np.cumsum([len(g) for g in grams])[:-1])
    return pd.DataFrame({"batch": pdf["batch"], "part": pdf["part"], "totals": [_packed(a) for a in answers]})


def _scores_of(docs: pd.DataFrame, totals: pd.DataFrame, words: int, parts: int, leave_out: bool, order: int) -> pd.DataFrame:
    hashed = _hashed(docs["text"].tolist())
    distinct, _ = _batch_table(*hashed, order)
    # the totals come back per partition in the order of the batch's sorted distinct n-grams
    answers = dict(zip(totals["part"], totals["totals"]))
    total = np.concatenate([np.zeros(0, dtype=np.int64), *(_unpacked(answers[p], np.int64) for p, _, _ in _runs(distinct, parts))])
    scored = [_slice_scores(*part, distinct, total, words, leave_out, order) for part in _slices(*hashed)]
    return pd.concat([docs[["doc_id"]].astype("Int64").reset_index(drop=True), pd.concat(scored, ignore_index=True)], axis=1)


def _slice_scores(flat: np.ndarray, sizes: np.ndarray, distinct: np.ndarray, total: np.ndarray, words: int, leave_out: bool, order: int) -> pd.DataFrame:
    grams = _batch_grams(flat, sizes, order)
    n1 = grams[0][1]
    out = pd.DataFrame({"n_words": n1, **{_seen(k): np.zeros(len(n1), dtype=np.int64) for k in range(2, order + 1)}})
    mine, place = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
    of_doc = [np.repeat(np.arange(len(n)), n) for _, n in grams]
    count = total[np.searchsorted(distinct, mine)][place]
    if leave_out:
        _, at, own = np.unique(np.concatenate(of_doc) * np.int64(len(mine)) + place, return_inverse=True, return_counts=True)
        count = count - own[at]
    count = np.split(count, np.cumsum([len(g) for g, _ in grams])[:-1])
    first = np.cumsum(n1) - n1  # a text's first word
    score = np.where(count[0] > 0, np.log(np.maximum(count[0], 1)), math.log(BACKOFF)) - math.log(words)
    for k in range(2, order + 1):
        c, n, doc, shorter = count[k - 1], grams[k - 1][1], of_doc[k - 1], grams[k - 2][1]
        i = np.arange(len(c)) - (np.cumsum(n) - n)[doc]  # the text's i-th run of k words ends at its word i + k - 1
        word, history = first[doc] + i + k - 1, (np.cumsum(shorter) - shorter)[doc] + i
        seen = c > 0
        score[word[~seen]] += math.log(BACKOFF)
        score[word[seen]] = np.log(c[seen]) - np.log(count[k - 2][history[seen]])
        out[_seen(k)] = np.bincount(doc[seen], minlength=len(n))
    sums = np.bincount(of_doc[0], weights=score, minlength=len(n1))
    out["log_score"] = np.where(n1 > 0, sums, np.nan)
    return out


def _seen(k: int) -> str:
    return {2: "n_bigrams_seen", 3: "n_trigrams_seen"}.get(k, f"n_{k}grams_seen")


def score_documents(docs: DataFrame, leave_out: bool = True, batch_docs: int = BATCH_DOCS, docs_per_partition: int = DOCS_PER_PARTITION,
                    order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_bigrams_seen, n_trigrams_seen (one such column per order from 2), log_score (rounded to 4
    digits, null without words), one row per row."""
    prepare(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0))).first()
    words = max(1, words)
    batches, parts = max(1, -(-n // batch_docs)), max(1, -(-n // docs_per_partition))
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    dealt = rows.select(batch.alias("batch"), "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_packed_docs, _DOCS)
    grams = dealt.groupBy("batch").applyInPandas(lambda pdf: _grams_of(_docs_of(pdf), parts, order), _KEYS)
    totals = grams.groupBy("part").applyInPandas(_totals_of, _TOTALS)
    scored = dealt.groupBy("batch").cogroup(totals.groupBy("batch")).applyInPandas(
        lambda d, t: _scores_of(_docs_of(d), t, words, parts, leave_out, order),
        f"doc_id long, n_words long, {''.join(f'{_seen(k)} long, ' for k in range(2, order + 1))}log_score double")
    return scored.withColumn("log_score", F.when(~F.isnan("log_score"), F.round("log_score", 4)))
