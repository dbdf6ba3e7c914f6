"""Licence scans against plain searches."""

import random
import re

import pytest

from culler.llm import licence_scan
from culler.llm.licence_scan import BASE, LicenceIndex, SuffixAutomaton, words_of
from culler.llm.licence_texts import TEMPLATES
from culler.llm.queries import QUERIES
from culler.session import read_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base_of(text):
    w = words(text)
    places = sorted((i, label) for phrase, label in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_automaton_knows_every_factor_and_its_places():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 9))] for _ in range(rng.randrange(1, 5))]
        a = SuffixAutomaton(texts)
        factors = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for length in range(1, 6):
            for code in range(3**length):
                f = tuple(code // 3**k % 3 for k in range(length))
                state = 0
                for x in f:
                    state = a.step[state].get(x) if state is not None else None
                assert (state is not None) == (f in factors)
                if state is not None:
                    assert a.places[state] == [(k, i + length - 1) for k, t in enumerate(texts) for i in range(len(t)) if tuple(t[i : i + length]) == f]


def test_matching_statistics():
    rng = random.Random(4)
    index = LicenceIndex({"x": ["a b c a b d", "b c c a"], "y": ["d d a b c a"]}, [("a b", "p"), ("c", "q"), ("b c a", "r")])
    templates = [t.split() for t in ["a b c a b d", "b c c a", "d d a b c a", "a b", "c", "b c a"]]
    has = lambda f: any(t[i : i + len(f)] == f for t in templates for i in range(len(t)))
    for _ in range(300):
        text = [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]
        base, long = [], []
        index.match([index.ids[w.encode()] for w in text], 0, base, long)
        want = [(i, k) for i in range(len(text)) for k, p in enumerate((["a", "b"], ["c"], ["b", "c", "a"])) if text[i : i + len(p)] == p]
        assert sorted(base) == sorted(want)
        longest = [max(n for n in range(i + 2) if n == 0 or has(text[i - n + 1 : i + 1])) for i in range(len(text))]
        ends = [i for i in range(len(text)) if i + 1 == len(text) or longest[i + 1] != longest[i] + 1]
        assert {(i, longest[i]) for i in ends if longest[i] >= licence_scan.LEAST_MATCH} <= {(last, n) for last, n, _ in long}
        assert all(longest[last] == n and last in ends for last, n, _ in long)


def test_every_template_is_a_whole_span():
    index = LicenceIndex()
    for label, texts in TEMPLATES.items():
        for t in texts:
            w = words_of("some words before " + t + " and after")
            found = index.scan(w)
            assert found["score"] == 1.0 and {s[2] for s in found["spans"]} == {label}
            assert (3, 2 + len(words_of(t)), label, 1.0) in found["spans"]


def test_notices_with_other_words_between():
    index = LicenceIndex()
    mit = TEMPLATES["mit"][2].replace("free of charge", "free of any charge").replace("publish, distribute", "publish, show, distribute")
    assert [s[2] for s in index.scan(words_of(mit))["spans"]] == ["mit"]
    half = " ".join(TEMPLATES["mit"][2].split()[:20])
    found = index.scan(words_of(half))
    assert not found["spans"] and 0.2 < found["score"] < 0.8
    assert index.scan(words_of("the software is not here and the conditions are of any kind"))["spans"] == []
    shuffled = TEMPLATES["apache"][2].split()
    random.Random(1).shuffle(shuffled)
    assert index.scan(words_of(" ".join(shuffled)))["spans"] == []


ODD = [(1, None), (2, ""), (3, "MIT License"), (4, "mit-license MIT\x00LICENSE, Apache\nlicense general public licensing"), (5, "MİT License mıt license"),
       (6, "GNU General Public License general public license " * 3), (7, "mit license " * 20_000), (8, "k" * 100_000), (None, "the mit license"),
       (None, "the mit license"), (3, "Apache License"), (9, TEMPLATES["gpl"][1] + " " + TEMPLATES["bsd"][2]), (10, "general public mit license")]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in ODD], "doc_id long, text string, base string, score int")
    out = licence_scan.scan_licences(rows).collect()
    got = sorted((str(r.doc_id), r.n_words, [(b.first_word, b.label) for b in r.base]) for r in out)
    want = []
    for i, t in ODD:
        w = words(t)
        want.append((str(i), len(w), sorted((k, label) for p, label in BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())))
    assert got == sorted(want)
    assert {s.label for r in out if r.doc_id == 9 for s in r.spans} == {"gpl", "bsd"}
    assert all(0 <= r.score <= 1 for r in out) and {r.score for r in out if r.doc_id in (1, 2, 8)} == {0.0}
    assert licence_scan.scan_licences(rows.filter("false")).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    out = QUERIES["op11_licences"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(docs[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert (r.score > 0) >= (r.n_base > 0) and (r.n_base > 0 or r.labels == "" and r.score < 0.8)
