"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from culler.llm import importance
from culler.llm.queries import QUERIES
from culler.session import read_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, target):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    raw = Counter(bucket(f) for _, t in docs for f in features(t)[0])
    want = Counter(bucket(f) for t in target for f in features(t)[0])
    s_all, t_all = sum(raw.values()), sum(want.values())
    rows = []
    for i, text in docs:
        fs, n = features(text)
        weight = sum(math.floor(1000 * math.log((want[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {}
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        place.setdefault(r, []).append(k)
    return sorted(((*r[:4], place[r].pop() if place.get(r) else None) for r in rows), key=str)


def texts():
    rng = random.Random(5)
    words = ["the", "The", "Über", "über", "ñ", "x1", "a-b", "it's", "z" * 70, "q" * 200, "日本語", "ÀÉ", "n\x00m", "é"]
    words += [f"w{i}" for i in range(300)]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "\x00\x00"), (403, "one"), (404, "ONE two"), (405, "k" * 100_000), (406, "and so on " * 40_000)]
    rows += [(None, rows[7][1]), (None, rows[7][1]), (9, rows[9][1]), (9, "w1 " * 30), (407, "İ ſ K Å" * 30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], "doc_id long, text string, rank int, row string, bucket int")


@pytest.mark.parametrize("batch_bytes", [1, 1 << 22])
def test_features_of_a_batch(batch_bytes, monkeypatch):
    all_texts = [t for _, t in texts()]
    for first, part in importance.slices([None if t is None else t.encode() for t in all_texts], batch_bytes):
        document, buckets, n_words = importance.batch_features(part)
        for k, t in enumerate(all_texts[first : first + len(part)]):
            fs, n = features(t)
            assert n_words[k] == n and Counter(buckets[document == k].tolist()) == Counter(map(bucket, fs))


def test_resample_with_odd_rows(spark):
    rows, target = texts(), ["the über ñ w3 w4", None, "", "w5 w6 " * 9]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = importance.resample(frame(spark, rows), goal).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, target)
    assert importance.resample(frame(spark, rows).filter("false"), goal).count() == 0
    assert importance.resample(frame(spark, rows[:30]), goal.filter("false")).count() == 30


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    target = [r.text for r in read_table(spark, sf, "benchmark").collect()]
    assert sorted(map(tuple, QUERIES["op12_importance"](spark, sf).collect()), key=str) == brute(docs, target)
