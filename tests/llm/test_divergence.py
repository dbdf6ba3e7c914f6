"""The divergence audit against plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from culler.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    in_docs, count = Counter(), defaultdict(Counter)
    for lang, source, words in docs:
        in_docs.update((lang, w) for w in set(words))
        count[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [w for (l, w), n in in_docs.items() if l == lang and n >= least]
        groups = sorted(s for l, s in count if l == lang)
        price = {}
        for s in groups + [None]:
            c = {w: sum(count[lang, x][w] for x in (groups if s is None else [s])) for w in kept}
            total = sum(c.values())
            price[s] = {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in groups:
            pair = [(-sum(f(price[s][w], price[o][w]) for w in kept), o.encode(), o) for o in groups if o != s]
            term = [(-f(price[s][w], price[None][w]), w.encode(), w) for w in kept if count[lang, s][w] and price[s][w] > price[None][w]]
            out += [(lang, s, "pair", item, -v, k) for k, (v, _, item) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", item, -v, k) for k, (v, _, item) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(11)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["über", "Über", "日本", "NO", "no", "x1y"]
    rows = []
    for _ in range(600):
        source = rng.choice(["a", "a", "a", "b", "c", None, "é", "Z"])
        lang = rng.choice(["en", "en", "de", None])
        rows.append((lang, source, " ".join(rng.choice(words[: rng.choice([8, 40, 156])]) for _ in range(rng.randrange(0, 60)))))
    rows += [("en", "mute", None), ("en", "mute", ""), ("xx", "one", "few words"), ("xx", "two", None), ("yy", "alone", "no " * 9)]
    rows += [("en", "b", "wa wb " * 30_000), ("en", "a", "k" * 100_000)] + [("de", "c", "same text here")] * 12
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(lang, s, t, 1, "clash", 2) for lang, s, t in rows], "lang string, source string, text string, g int, term string, n int")


@pytest.mark.parametrize("block_terms, group_block, widest", [(4096, 64, 3000), (7, 2, 12)])
def test_audit(spark, block_terms, group_block, widest, monkeypatch):
    monkeypatch.setattr(divergence, "WIDEST", widest)
    out = divergence.audit(frame(spark, corpus()), block_terms=block_terms, group_block=group_block)
    assert dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect())) == brute(corpus())


def test_partial_counts_that_flush_often(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "FLUSH_ENTRIES", 5)
    rows = [(lang or "", s or "", (t or "").encode()) for lang, s, t in corpus()[:80]]
    batch = pa.RecordBatch.from_pylist([dict(zip("abc", r)) for r in rows], pa.schema([("a", pa.string()), ("b", pa.string()), ("c", pa.binary())]))
    n, docs = Counter(), Counter()
    for part in divergence._count(iter([batch])):
        for r in part.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want = Counter((lang, s, w) for lang, s, t in rows for w in TERM.findall(t.decode().translate(LOWER)))
    assert n == want
    assert docs == Counter((lang, s, w) for lang, s, t in rows for w in set(TERM.findall(t.decode().translate(LOWER))))


def test_empty(spark):
    assert divergence.audit(frame(spark, corpus()).filter("false")).count() == 0


def test_large_counts_are_exact():
    big = np.array([10**13, 3, 0])
    total, kept = np.array([10**14 + 7] * 3), np.array([1000] * 3)
    assert divergence.prices(big, total, kept).tolist() == [1 + 10**9 * (int(c) + 2) // (10**14 + 7 + 2000) for c in big]
