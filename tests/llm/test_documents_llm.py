"""MinHash, quality scores, backoff scores and the pipeline against plain loops."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from culler.llm import backoff_lm, bbit_minhash, components, qda
from culler.llm.common import written
from culler.session import read_table

from .test_vectors_llm import components_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def corpus():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    word = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    rows, at = [], 0
    passage = word(60)
    for _ in range(150):
        rows.append(word(int(rng.integers(1, 200))))
    for _ in range(60):  # a shared passage in otherwise different texts
        rows.append(word(80) + passage + word(80))
    base = word(160)
    for k in range(120):  # a group of copies at all distances around the threshold
        copy = list(base)
        for _ in range(int(rng.integers(0, 9))):
            copy[int(rng.integers(0, len(copy)))] = "changed"
        rows.append(copy)
    for k in range(40):
        copy = list(rows[k])
        copy[len(copy) // 2 :] = copy[len(copy) // 2 + 1 :]
        rows.append(copy)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    at = len(rows)
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one two"), (at + 4, "ONE\ttwo"), (at + 5, "Éa"), (at + 6, "éa"),
             (at + 7, rows[200][1].upper().replace("É", "é")), (at + 8, "x " * 30_000), (at + 9, "x " * 20_000), (None, rows[3][1]), (5, rows[5][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, "clash") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, sum int, doc string")


@pytest.mark.parametrize("block", [512, 16])
def test_minhash(spark, block):
    rows = corpus()
    out = bbit_minhash.near_duplicates(frame(spark, rows), block=block).collect()
    named = [(i, shingles(t)) for i, t in rows if i is not None]
    pairs = [(a, b) for k, (a, x) in enumerate(named) for b, y in named[:k] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    comp = components_of({i for i, _ in named}, pairs)
    want = sorted((str(i), len(shingles(t)), str(comp.get(i)), i is None or comp[i] == i) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in out) == want


def test_minhash_keeps_one(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = bbit_minhash.keep_one(df)
    assert out.columns == df.columns
    kept = {r.doc_id for r in bbit_minhash.near_duplicates(df).collect() if r.kept}
    assert Counter(r.doc_id for r in out.collect()) == Counter(kept)
    assert bbit_minhash.keep_one(df.filter("false")).count() == 0


def test_minhash_keeps_texts_of_ids_that_repeat(spark):
    words = lambda tag, n=120: [f"{tag}{i}" for i in range(n)]
    x, y, z = words("x"), words("y"), words("z")
    near = lambda t: " ".join(t[:60] + ["changed"] + t[61:])
    x, y, z, x1, y1, z1 = " ".join(x), " ".join(y), " ".join(z), near(x), near(y), near(z)
    texts = lambda rows: sorted((str(r.doc_id), str(r.text)) for r in bbit_minhash.keep_one(frame(spark, rows)).collect())
    assert texts([(5, x), (5, y), (7, x), (9, y)]) == sorted([("5", x), ("5", y)])
    rows = [(5, x), (5, y), (5, y), (7, x1), (9, y1), (3, z), (5, z1), (8, x), (4, None), (4, ""), (4, ""), (None, x)]
    out = bbit_minhash.near_duplicates(frame(spark, rows)).collect()
    want = [5, 5, 5, 5, 5, 3, 3, 5, 4, 4, 4, None]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == sorted((str(i), len(shingles(t)), str(c)) for (i, t), c in zip(rows, want))
    assert texts(rows) == sorted([("5", x), ("5", y), ("3", z), ("4", "None"), ("4", ""), ("None", x)])
    assert texts([(5, x), (5, x1), (6, x1)]) in ([("5", x)], [("5", x1)])  # one row of a component, though both have its id


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85, 0.95):
        error = []
        for _ in range(40):
            both = rng.integers(0, 2**63, 400, dtype=np.uint64)
            n = round(400 * (1 - share) / (1 + share))
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n, dtype=np.uint64)])) for _ in range(2))
            j = 400 / (400 + 2 * n)
            x, y = bbit_minhash.packed(bbit_minhash.minima([a, b])).view(np.uint64)
            z = x ^ y
            z |= z >> np.uint64(1)
            z |= z >> np.uint64(2)
            different = int(np.bitwise_count(z & np.uint64(0x1111111111111111)).sum())
            error.append(bbit_minhash.similarity(different) - j)
            assert j < 0.85 or different <= bbit_minhash.most_different()
        assert abs(np.mean(error)) < 0.03


def test_quality_on_held_out_rows(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    stats = qda.document_statistics(docs)
    out = {r.doc_id: r for r in qda.score_statistics(stats, qda.fit_labelled(stats, labels)).collect()}
    assert len(out) == docs.count()
    right = total = 0
    for r in labels.collect():
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if out[r.doc_id].held_out:
            right += out[r.doc_id].predicted == r.quality
            total += 1
    assert total > 50 and right / total >= 0.97


def test_quality_equals_a_plain_version(spark):
    """Scores, the settings chosen and the rows that choose them, against numpy over the same statistics."""
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    stats = qda.document_statistics(docs)
    model = qda.fit_labelled(stats, labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()), qda.text_statistics(r.text)) for r in docs.collect()]
    x = np.array([r[2] for r in rows])
    train = np.array([r[0] in quality and r[1] % 4 != 2 for r in rows])
    fold = np.array([r[1] // 4 % qda.FOLDS for r in rows])
    y = np.array([quality.get(r[0], -1) for r in rows])

    def odds(chosen, shrinkage, temperature):
        parts, density = [x[chosen & (y == c)] for c in (0, 1)], []
        within = [np.cov(p.T, bias=True) for p in parts]
        pooled = (len(parts[0]) * within[0] + len(parts[1]) * within[1]) / chosen.sum()
        for p, s in zip(parts, within):
            s = (1 - shrinkage) * s + shrinkage * (np.diag(np.diag(pooled)) + qda.RIDGE * np.eye(len(s)))
            z = x - p.mean(axis=0)
            density.append(-0.5 * np.einsum("ij,ij->i", z @ np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
        return np.clip((density[1] - density[0]) / temperature + math.log((len(parts[1]) + 1) / (len(parts[0]) + 1)), -500, 500)

    def loss(shrinkage, temperature):
        total = 0.0
        for k in range(qda.FOLDS):
            o = odds(train & (fold != k), shrinkage, temperature)
            total += sum(math.log1p(math.exp(-o[i] if y[i] else o[i])) for i in np.flatnonzero(train & (fold == k)))
        return round(total / train.sum(), 9)

    best = min((loss(a, t), i, a, t) for i, (a, t) in enumerate((a, t) for a in qda.SHRINKAGES for t in qda.TEMPERATURES))
    assert model.temperature == best[3]
    want = dict(zip([r[0] for r in rows], 1 / (1 + np.exp(-odds(train, *best[2:])))))
    got = {r.doc_id: r for r in qda.score_statistics(stats, model).collect()}
    assert all(abs(got[i].score - want[i]) < 1e-6 and got[i].predicted == (want[i] >= 0.7) for i in want)
    flipped = labels.withColumn("quality", F.when(qda.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = qda.fit_labelled(stats, flipped)  # held-out labels decide nothing
    assert other.temperature == model.temperature and np.array_equal(other.whiten, model.whiten)


def test_quality_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(["plain words stand here and there, as they do."] * 30 + ["junk$$$ ### ||| !!! !!!"] * 30 + [None, "", "a" * 200_000])] + [(None, "x"), (3, "y")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)] + [(3, None, 0), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    stats = qda.document_statistics(df)
    model = qda.fit_labelled(stats, labels)
    out = qda.score_statistics(stats, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    kept = qda.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in out)
    flat = qda.fit_labelled(stats, labels.filter("quality = 1"))
    assert len({r.score for r in qda.score_statistics(stats, flat).collect()}) == 1
    nothing = qda.document_statistics(df.filter("false"))
    assert qda.score_statistics(nothing, qda.fit_labelled(nothing, labels.filter("false"))).count() == 0


def backoff_by_loop(rows, own_out, order):
    """The recursion, written out: (id, words, runs seen per order from 2, score)."""
    words = [WORD.findall(t or "") for _, t in rows]
    runs = lambda ws: Counter(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    every, out = Counter(), []
    for ws in words:
        every.update(runs(ws))
    n = sum(map(len, words))
    for (i, _), ws in zip(rows, words):
        own, seen = runs(ws) if own_out else Counter(), [0] * (order - 1)
        c = lambda g: every[g] - own[g]

        def log_s(g):
            if len(g) == 1:
                return math.log(c(g) / n) if c(g) > 0 else math.log(0.4 / n)
            return math.log(c(g) / c(g[:-1])) if c(g) > 0 else math.log(0.4) + log_s(g[1:])

        x = sum(log_s(tuple(ws[max(0, k - order + 1) : k + 1])) for k in range(len(ws)))
        for k in range(2, order + 1):
            seen[k - 2] = sum(c(tuple(ws[j : j + k])) > 0 for j in range(len(ws) - k + 1))
        out.append((str(i), len(ws), *seen, round(x, 4) if ws else None))
    return sorted(out, key=str)


def test_backoff_slices(monkeypatch):
    """Two batches in slices of seven texts, scored in this process, against the loop."""
    monkeypatch.setattr(backoff_lm, "SLICE_DOCS", 7)
    rows = corpus()[130:300]
    docs = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], dtype="Int64"), "text": [t for _, t in rows], "batch": [k % 2 for k in range(len(rows))]})
    grams = pd.concat([backoff_lm._grams_of(b, 5, 3) for _, b in docs.groupby("batch")])
    totals = pd.concat([backoff_lm._totals_of(p) for _, p in grams.groupby("part")])
    words = sum(len(WORD.findall(t or "")) for _, t in rows)
    out = pd.concat([backoff_lm._scores_of(b, totals[totals["batch"] == k], words, 5, True, 3) for k, b in docs.groupby("batch")])
    got = sorted(((str(i), n, b, t) for i, n, b, t in zip(out["doc_id"], out["n_words"], out["n_bigrams_seen"], out["n_trigrams_seen"])), key=str)
    want = backoff_by_loop(rows, True, 3)
    assert got == [w[:4] for w in want]
    scores = sorted(x for x in out["log_score"] if x == x)
    assert scores == pytest.approx(sorted(w[4] for w in want if w[4] is not None), abs=1e-3)


@pytest.mark.parametrize("own_out, order", [(True, 3), (False, 3), (True, 2), (True, 1), (True, 4)])
def test_backoff(spark, own_out, order):
    rows = corpus()
    out = backoff_lm.score_documents(frame(spark, rows), leave_out=own_out, batch_docs=50, docs_per_partition=90, order=order).collect()
    names = ["n_words", *[backoff_lm._seen(k) for k in range(2, order + 1)], "log_score"]
    got = sorted(((str(r.doc_id), *[r[x] for x in names]) for r in out), key=str)
    want = backoff_by_loop(rows, own_out, order)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    for g, w in zip(got, want):
        assert (g[-1] is None and w[-1] is None) or g[-1] == pytest.approx(w[-1], abs=2e-3)
    assert backoff_lm.score_documents(frame(spark, rows[:0])).count() == 0


def test_backoff_packs_texts():
    """What is dealt to batches is compressed, and comes back whole: nulls, empty texts, other bytes, unknown ids."""
    rows = [(k % 3, None if k % 7 == 0 else k, t) for k, t in enumerate([None, "", "é \n", "x\x00y", "word " * 2000, *(t for _, t in corpus()[:200])])]
    table = pa.table({"batch": pa.array([b for b, _, _ in rows], pa.int32()), "doc_id": pa.array([i for _, i, _ in rows], pa.int64()),
                      "text": pa.array([None if t is None else t.encode() for _, _, t in rows], pa.binary())})
    packed = [p.to_pandas() for p in backoff_lm._packed_docs(iter(table.to_batches(max_chunksize=30)))]
    assert [len(p) for p in packed] == [3]
    assert packed[0]["texts"].str.len().sum() < 0.6 * sum(len(t or "") for _, _, t in rows)
    for b, part in pd.concat(packed).groupby("batch"):
        back = backoff_lm._docs_of(part)
        assert [(b, None if i is pd.NA else i, t) for i, t in zip(back["doc_id"], back["text"])] == [(x, i, (t or "").encode()) for x, i, t in rows if x == b]
    assert sum(len(p) for p in backoff_lm._packed_docs(iter(table.slice(0, 0).to_batches()))) == 0


def test_backoff_deals_texts_once(spark):
    """The texts are shuffled packed, and one shuffle serves both the counting and the scoring."""
    out = backoff_lm.score_documents(frame(spark, corpus()[:50]))
    plan = out._jdf.queryExecution().executedPlan()
    assert out.count() == 50 and plan.toString().count("MapInArrow") >= 1
    out.collect()
    assert "ReusedExchange" in plan.toString()


def test_component_rounds_write_few_files(spark, monkeypatch):
    """A small graph's rounds write a file each, however many shuffle partitions there are."""
    tables = []
    monkeypatch.setattr(components, "written", lambda df, tag: tables.append(written(df, tag)) or tables[-1])
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("23", "false")):
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 < 19] + [(7, 7), (3, None), (1, 0), (30, 5)], "a long, b long")
        out = components.connected_components(edges, 100)
        assert {(r.id, r.component) for r in out.collect()} == {(i, 0 if i < 40 else 40) for i in range(60)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(tables) > 3 and max(len(t.inputFiles()) for t in tables) == 1


def test_pipeline(spark):
    docs, seen = read_table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "test-stage")
        seen[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality classifier":
            bad = read_table(spark, SF, "labels").filter("quality = 0").join(docs, "doc_id").count()
            good = read_table(spark, SF, "labels").filter("quality = 1").join(before, "doc_id").count() - read_table(spark, SF, "labels").filter("quality = 1").join(docs, "doc_id").count()
            assert bad <= 1 and good <= 1
        if name == "MinHash near-dedup":
            sets = [shingles(r.text) for r in docs.collect()]
            assert not [1 for k, x in enumerate(sets) for y in sets[:k] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
        if name == "secret scans":
            assert docs.count() == before.count() and docs.filter("n_chars <> char_length(text)").count() == 0
    run = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted(map(str, df.collect()))
    assert run.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert key(run) == key(docs)


def test_pipeline_removes_near_copies_from_080(spark):
    """Copies of a text of distinct words with some words in the middle replaced: similarities 0.96 to 0.74."""
    base, rows, kept = [f"w{i}" for i in range(204)], [(0, " ".join(f"w{i}" for i in range(204)))], [0]
    for i, n in enumerate((1, 14, 16, 18, 22, 26), 1):
        rows.append((i, " ".join(base[:90] + [f"c{i}x{j}" for j in range(n)] + base[90 + n :])))
        x, y = shingles(rows[0][1]), shingles(rows[i][1])
        if 100 * len(x & y) < 80 * len(x | y):
            kept.append(i)
    out = [sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, frame(spark, [rows[0], r]), SF).collect()) for r in rows[1:]]
    assert out == [[0, i] if i in kept else [0] for i in range(1, len(rows))]
    assert 0 < len(kept) - 1 < len(rows) - 1


def test_pipeline_on_no_rows(spark):
    docs = read_table(spark, SF, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
    assert docs.count() == 0


def test_small_minhash_blocks_share_a_group():
    """A group of many small blocks answers for each of them as a group of its own would."""
    import numpy as np
    import pandas as pd

    from culler.llm import bbit_minhash as M

    sig = np.arange(8, dtype=np.int64)
    tile = pd.DataFrame({"rep": [1, 2, 2], "label": [1, 2, 2], "stray": [False, True, True], "sig": [sig] * 3, "left": [True, True, False]})
    many = pd.concat([tile.assign(t1=t, t2=0, rep=tile["rep"] + 10 * t, label=tile["label"] + 10 * t) for t in range(5)], ignore_index=True).sample(frac=1, random_state=1)
    out = M._stray_partners(many, 0)
    assert sorted((r.t1, r.doc, list(r.partners)) for r in out.itertuples()) == sorted(
        x for t in range(5) for x in ((t, 10 * t + 1, []), (t, 10 * t + 2, [10 * t + 1])))
    words = np.arange(50, dtype=np.uint64).tobytes()
    rows = out.assign(shingles=[words] * len(out))
    assert sorted(map(tuple, M._confirmed(rows, 85).values.tolist())) == [(10 * t + 2, 10 * t + 1) for t in range(5)]
