"""Subword encoding against the library, and decoding against it."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import types as T

from culler.llm import piece_bpe
from culler.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def bpe():
    return piece_bpe.PieceBpe(open(tokenizer_path(), "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def hard_texts() -> list[str]:
    rnd = random.Random(4)
    parts = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "漢", "字", "😀", "\t", "aa", "aaa", "in", "<0x0A>", "<s>", "\r\n", " ", " " * 17, "\0"]
    out = ["", " ", "  ", " a", "a  b ", "▁x", "\n", " \n \n", "a" * 700, "ab" * 400, " " * 300, "x" * 900]
    out += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 50))) for _ in range(800)]
    out += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABC012 ") for _ in range(rnd.randint(1, 80))) for _ in range(800)]
    return out


def test_ids_equal_the_library(bpe, library):
    texts = hard_texts()
    flat, sizes = bpe.encode(texts)
    ends = np.cumsum(sizes)
    for text, end, n, want in zip(texts, ends, sizes, library.encode(texts)):
        assert flat[end - n : end].tolist() == want, text[:60]


def test_one_merge_per_round_gives_the_same(bpe):
    words = ["▁" + w for t in hard_texts()[12:300] for w in t.replace("\n", " ").split()]
    a, an, _ = bpe._rounds(words, single=True)
    b, bn, again = bpe._rounds(words, single=False)
    redo = set(again.tolist())
    keep = ~np.isin(an, list(redo))
    assert np.array_equal(a[keep], b) and np.array_equal(an[keep], bn)


def test_decode_equals_the_library(bpe, library):
    rnd = random.Random(5)
    for _ in range(1500):
        ids = [rnd.randint(0, 31999) if rnd.random() < 0.5 else rnd.randint(0, 260) for _ in range(rnd.randint(0, 30))]
        assert bpe.decode(np.array(ids, dtype=np.int64)) == library.decode(ids), ids


def test_documents(spark, library):
    rows = [(1, "Hello  world"), (2, None), (2, ""), (None, "Hello  world"), (1, "Hello  world"), (7, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    out = piece_bpe.encode_documents(df, tokenizer_path(), with_ids=True).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids)
    assert sorted(r.n_tokens for r in out)[:2] == [2, 2]
    long_ = next(r for r in out if r.doc_id == 7)
    assert long_.ids == library.encode("word " * 30_000, add_bos=True, add_eos=True)
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert piece_bpe.encode_documents(empty, tokenizer_path()).count() == 0
