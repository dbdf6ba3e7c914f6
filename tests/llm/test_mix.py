"""Mixing and interleaving against plain loops."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from culler.llm import interleave, mix, queries

DOCS = "doc_id long, text string, source string, size int, target string, shard int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], DOCS)


def rows_of(n):
    rng = np.random.default_rng(3)
    sources = ["b", "a", None, "ü", "hot"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), sources[min(4, int(rng.integers(0, 9)))]) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", None), (None, "x y", "a"), (n + 2, "long " * 5000, "b"), (5, "again", "a"), (5, "again", "a")]
    return rows


def level_by_loop(sizes, weights, share, cap):
    """Targets by handing the excess round until nobody is above the cap."""
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        target = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target | {s: cap * sizes[s] for s in capped}
        capped |= over


def test_mix(spark):
    rows = rows_of(400)
    df = docs_frame(spark, rows)
    out = mix.mix(df, block_words=64).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    want = level_by_loop(sizes, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken, by_shard = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        n = sum(p.n_words for p in r.pieces)
        assert n <= 2 * r.size
        taken[r.source] += n
        seen = Counter()
        for p in r.pieces:
            assert 0 <= p.first_word and p.first_word + p.n_words <= r.size
            by_shard[p.shard] += p.n_words
            for w in range(p.first_word, p.first_word + p.n_words):
                seen[(p["pass"], w)] += 1
        assert not seen or max(seen.values()) == 1  # pieces are disjoint
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    assert max(by_shard.values()) - min(by_shard.values()) <= 64 * (len(sizes) + 1)
    again = mix.mix(df.repartition(7), block_words=64).collect()
    key = lambda r: (r.doc_id or -1, r.size, sum(p.n_words for p in r.pieces))
    assert sorted(map(key, out)) == sorted(map(key, again))


def plain_pieces(rows, block_words, n_shards, seed=mix.SEED, whole=False):
    """doc_id -> (shard, pass, block, first word, words) of each piece by walking each source's stream block by block."""
    key = lambda i: int(hashlib.md5(f"{seed}/{'-' if i is None else i}".encode()).hexdigest()[:15], 16)
    streams = defaultdict(list)
    for i, t, s in rows:
        streams["z" if s is None else "s" + s].append((key(i), i, len((t or "").split())))
    sizes = {k: sum(n for *_, n in v) for k, v in streams.items()}
    order = sorted(sizes)
    level = level_by_loop(sizes, {k: (3.0, 1.0, 2.0)[i % 3] for i, k in enumerate(order)}, 1.5, 2)
    stream = {k: int(level[k] + 0.5) for k in order}
    blocks = [-(-stream[k] // block_words) for k in order]
    tree = mix.splitting_tree(np.array(blocks), n_shards, seed)
    out = defaultdict(list)
    for at, k in enumerate(order):
        step, offset = mix.permutation(blocks[at], np.random.default_rng([seed, at]))
        by_place = sorted(range(blocks[at]), key=lambda b: (step * b + offset) % blocks[at])
        shard = dict(zip(by_place, np.repeat(np.arange(n_shards), tree[:, at]).tolist()))
        assert len(shard) == blocks[at] == tree[:, at].sum()
        position = 0
        for turn in range(3):
            for _, i, n in sorted(streams[k], key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
                if whole:
                    m = position + n // 2
                    if m < stream[k]:
                        out[i].append(shard[m // block_words])
                else:
                    for b in range(position // block_words, (position + n) // block_words + 1):
                        low, high = max(position, b * block_words), min(position + n, (b + 1) * block_words, stream[k])
                        if low < high:
                            out[i].append((shard[b], turn, b, low - position, high - low))
                position += n
    return out


def test_pieces_follow_the_tree_and_the_permuted_blocks(spark):
    rows = [r for r in rows_of(250) if r[0] not in (5, None)]
    got = {r.doc_id: [tuple(p)[:5] for p in r.pieces] for r in mix.mix(docs_frame(spark, rows), block_words=64, n_shards=5).collect()}
    want = plain_pieces(rows, 64, 5)
    assert {i: sorted(p) for i, p in got.items() if p} == {i: sorted(p) for i, p in want.items()}


def test_query_equals_its_sql_and_its_pieces(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op1_mix(spark, sf).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = db.execute(queries.MIX_SQL).fetchall()
        rows = db.execute("SELECT doc_id, text, source FROM documents").fetchall()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in out) == sorted((*w[:3], round(w[3], 3), w[4]) for w in want)
    pieces = plain_pieces(rows, mix.BLOCK_WORDS, mix.SHARDS)
    assert all(r.pieces == ",".join(":".join(map(str, p)) for p in pieces.get(r.doc_id, [])) for r in out)


def test_the_draw_decides_the_result(spark, monkeypatch):
    rows = [r for r in rows_of(250) if r[0] not in (5, None)]
    df = docs_frame(spark, rows)
    one = Counter((p.shard, r.doc_id, p.block) for r in mix.mix(df, block_words=64).collect() for p in r.pieces)
    order = [r.doc_id for r in mix.mix_whole(df, block_words=64).collect()]
    quotas = mix.shard_quotas
    monkeypatch.setattr(mix, "shard_quotas", lambda targets, n, words, seed: quotas(targets, n, words, seed + 1))
    two = Counter((p.shard, r.doc_id, p.block) for r in mix.mix(df, block_words=64).collect() for p in r.pieces)
    other = [r.doc_id for r in mix.mix_whole(df, block_words=64).collect()]
    assert one != two and sum(one.values()) == sum(two.values())
    assert order != other and Counter(order) == Counter(other)


def test_blocks_grow_with_the_mix():
    rows = pd.DataFrame({"skey": ["sa", "sb", "sc"], "source_size": [10**13, 10**12, 0], "target": [2e13, 1.5e12, 0.0]})
    table = mix.quota_table(rows, 8, mix.BLOCK_WORDS, 1)
    assert table["blocks"].sum() <= mix.MAX_BLOCKS + 3 and (table["blocks"] * table["block_words"] >= table["stream"]).all()
    assert [c[-1] for c in table["cuts"]] == table["blocks"].tolist()


def test_splitting_tree_keeps_quotas():
    quotas = np.array([7, 0, 100, 33])
    tree = mix.splitting_tree(quotas, 6, 1)
    assert (tree.sum(axis=0) == quotas).all() and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 2
    # on average each shard gets each source's share
    mean = np.mean([mix.splitting_tree(quotas, 4, s) for s in range(400)], axis=0)
    assert np.allclose(mean, quotas / 4, atol=0.7)


def test_mixed_shards_hold_the_words(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i % 17)), "ab"[i % 2]) for i in range(60)]
    df = docs_frame(spark, rows)
    pieces = mix.mix(df, block_words=16, n_shards=3).select("doc_id", F.explode("pieces").alias("p")).collect()
    got = Counter(w for r in mix.mixed_shards(df, block_words=16, n_shards=3).collect() for w in r.text.split())
    want = Counter(f"d{r.doc_id}w{j}" for r in pieces for j in range(r.p.first_word, r.p.first_word + r.p.n_words))
    assert got == want


def test_mix_whole(spark):
    rows = rows_of(300)[:300]
    df = docs_frame(spark, rows)
    out = mix.mix_whole(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert max(got.values()) <= 2 and set(got) <= {(i, t) for i, t, _ in rows}
    target = {r.source: (r.target, r.source_size) for r in mix.mix(df).collect()}
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len((r.text or "").split())
    for s, (t, size) in target.items():
        assert abs(words[s] - t) <= 60
    empty = df.filter("false")
    assert mix.mix(empty).count() == 0 and mix.mix_whole(empty).count() == 0


def test_mix_whole_stands_in_shard_order(spark):
    rows = [r for r in rows_of(250) if r[0] not in (5, None)]
    out = [r.doc_id for r in mix.mix_whole(docs_frame(spark, rows), block_words=64, n_shards=5).collect()]
    want = plain_pieces(rows, 64, 5, whole=True)
    assert Counter(out) == Counter({i: len(s) for i, s in want.items()})
    left, at = {i: sorted(s) for i, s in want.items()}, 0
    for i in out:  # the rows stand shard by shard: a document's copies come in order of their shards
        shard = left[i].pop(0)
        assert shard >= at
        at = shard
    nulls = mix.mix_whole(docs_frame(spark, [(None, "a b", "s"), (None, "c", None), (1, "d e f", "s"), (1, "d", "s")]))
    assert Counter(r.doc_id for r in nulls.collect())[None] == 2


def test_interleave(spark):
    rows = rows_of(500)
    df = docs_frame(spark, rows)
    out = interleave.interleave(df, bits=3).collect()
    assert len(out) == len(rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    per = defaultdict(Counter)
    for r in out:
        per[r.source][r.shard] += 1
    for c in per.values():  # every shard holds its share of every source
        assert max(c[s] for s in range(8)) - min(c[s] for s in range(8)) <= 2
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == texts
    key = lambda r: (r.doc_id or -1, r.shard, r.slot)
    other = interleave.interleave(df.repartition(5), bits=6).collect()
    assert sorted(map(key, out)) == sorted(map(key, other))  # buckets don't change the order
    assert interleave.interleave(df.filter("false")).count() == 0


def test_interleave_many_sources_of_one_row(spark):
    """All rows share the fraction 1/2: the order key decides, and the shards stay even."""
    df = docs_frame(spark, [(i, "w " * (i % 7), f"s{i}") for i in range(600)])
    out = interleave.interleave(df.repartition(3)).collect()
    assert {r.fraction for r in out} == {0.5}
    assert sorted(r.position for r in out) == list(range(600))
    assert set(Counter(r.shard for r in out).values()) == {75}
    again = interleave.interleave(df.repartition(7), bits=4).collect()
    assert sorted((r.doc_id, r.position) for r in out) == sorted((r.doc_id, r.position) for r in again)
