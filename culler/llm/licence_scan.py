"""Licence scans by a generalised suffix automaton of licence tokens.

All templates (licence notices and passages, and the base phrases) feed one suffix automaton over words: its states
are the factors of the templates. Streaming a text's words through it gives the matching statistics, at each
word the length of the longest factor that ends there. Two things follow:

* **Base places.** A base phrase ends at a word if it is a suffix of the matched factor. Each state lists the phrases that
  end its longest factor (its own and its suffix link's), and those no longer than the match count.
* **Covered spans.** Maximal matches (those that the next word doesn't extend) of ``LEAST_MATCH`` words or more, or that
  hold a base phrase, stand at known places of the templates. Matches of a template are chained while text and
  template both go on, with at most ``GAP`` words between; a chain covers the template words that its matches hold. A
  chain that covers ``COVERED`` of its template is a span and gives the template's label, unless another label's
  span over the same words covers more of its own.

The score is the largest covered share of any template by one chain (0 without a match, 1 for a whole notice).

Scale: a map over texts, nothing is shuffled and nothing but the templates is shared. A word outside the templates'
vocabulary resets the automaton, so only runs of template words are stepped through. Whole texts are streamed, words of
one text at a time; a chain looks back over a bounded number of words, so a text of repeated licences takes linear time.

Defined cases: a null or empty text has no words, no labels and score 0; null and equal ids and repeated rows keep a row
each; an empty table gives an empty result; further columns are ignored. Of equally good chains the one that starts first is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from culler.llm.common import prepare
from culler.llm.licence_texts import TEMPLATES

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
LEAST_MATCH = 4
GAP = 12
COVERED = 0.8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | str | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return _WORD.findall(raw.lower())


class SuffixAutomaton:
    """Generalised suffix automaton of word lists: state 0 is the empty factor."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: (text, last word's place) of the prefixes that a state holds; ``places`` adds those of longer factors
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, text in enumerate(texts):
            last = 0
            for i, word in enumerate(text):
                last = self._extend(last, word)
                self.ends[last].append((k, i))
        self.places: list[list[tuple[int, int]]] = [list(e) for e in self.ends]
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.places[self.link[v]] += self.places[v]
        self.places = [sorted(set(p)) for p in self.places]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of p's factors followed by ``word``, taken out of the longer state q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:  # the prefix is a factor of an earlier text
            return self._split(last, self.step[last][word], word)
        made = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = made
            p = self.link[p]
        self.link[made] = 0 if p < 0 else self._split(p, self.step[p][word], word)
        return made


class LicenceIndex:
    """The automaton of a set of templates with what each state says."""

    def __init__(self, templates: Mapping[str, Sequence[str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE):
        phrases = [words_of(p) for p, _ in base]
        named = [(label, words_of(t)) for label, texts in templates.items() for t in texts]
        self.labels = [label for label, _ in named]
        self.sizes = [len(w) for _, w in named]
        self.base_labels = [label for _, label in base]
        self.base_sizes = [len(p) for p in phrases]
        #: shorter runs of template words hold neither a base phrase nor a long match
        self.least = min([LEAST_MATCH, *self.base_sizes])
        self.ids: dict[bytes, int] = {}
        for w in [*(w for _, w in named), *phrases]:
            for word in w:
                self.ids.setdefault(word, len(self.ids))
        coded = [[self.ids[x] for x in w] for w in [*(w for _, w in named), *phrases]]
        self.automaton = a = SuffixAutomaton(coded)
        n = len(named)
        #: (length, phrase) of the base phrases that end a state's longest factor
        self.phrases: list[tuple[tuple[int, int], ...]] = [tuple(sorted({(len(phrases[k - n]), k - n) for k, i in p if k >= n and i == len(phrases[k - n]) - 1}))
                                                           for p in a.places]
        self.phrases = [tuple(x for x in p if x[0] <= a.length[v]) for v, p in enumerate(self.phrases)]
        for v in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            self.phrases[v] = tuple(sorted({*self.phrases[a.link[v]], *self.phrases[v]}))
        #: places of a state's factors in the templates that have a label
        self.places = [[x for x in p if x[0] < n] for p in a.places]

    def match(self, ids: list[int], first: int, base: list[tuple[int, int]], long: list[tuple[int, int, int]]) -> None:
        """Streams a run of template words that starts at word ``first``; adds (start, phrase) to ``base`` and
        (last word, length, state) of the long maximal matches to ``long``."""
        step, link, length, phrases = self.automaton.step, self.automaton.link, self.automaton.length, self.phrases
        state = n = 0
        holds = -1  # where the last base phrase started
        for i, word in enumerate(ids, first):
            nxt = step[state].get(word)
            if nxt is None:
                if n >= LEAST_MATCH or (n and holds >= i - n):
                    long.append((i - 1, n, state))
                while state and nxt is None:
                    state = link[state]
                    nxt = step[state].get(word)
                n = length[state] + 1 if nxt is not None else 0
                state = nxt or 0
            else:
                state, n = nxt, n + 1
            for size, k in phrases[state]:
                if size <= n:
                    base.append((i - size + 1, k))
                    holds = max(holds, i - size + 1)
        last = first + len(ids)
        if n >= LEAST_MATCH or (n and holds >= last - n):
            long.append((last - 1, n, state))

    def chains(self, long: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, covered template words) of the best chain to each template of each
        stretch of text: chains of a template that overlap in the text give one, the one that covers most."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for last, n, state in long:
            for k, end in self.places[state]:
                by_template.setdefault(k, []).append((last, n, end))
        out = []
        for k, matches in by_template.items():
            matches.sort()
            reach = self.sizes[k] + GAP
            best: list[tuple[int, int]] = []  # (covered, first word) of the best chain that ends with the match
            spans: list[tuple[int, int, int]] = []
            back = 0
            for i, (last, n, end) in enumerate(matches):
                start, begin = last - n + 1, end - n + 1
                covered, first = n, start
                while matches[back][0] < start - reach:
                    back += 1
                for j in range(back, i):
                    at, _, to = matches[j]
                    if at < last and to < end and start - at - 1 <= GAP and begin - to - 1 <= GAP:
                        # overlapping matches count the words that are new in both
                        new = min(n, last - at, end - to)
                        if best[j][0] + new > covered:
                            covered, first = best[j][0] + new, best[j][1]
                best.append((covered, first))
                spans.append((first, last, covered))
            # the best chain of each stretch; chains apply in text order, so a sweep tells stretches apart
            kept: list[tuple[int, int, int]] = []
            for first, last, covered in sorted(spans):
                if kept and first <= kept[-1][1]:
                    old = kept[-1]
                    kept[-1] = (first, last, covered) if covered > old[2] else old
                else:
                    kept.append((first, last, covered))
            out += [(k, *span) for span in kept]
        return out

    def scan(self, words: list[bytes]) -> dict:
        """n_words, base [(start, phrase)], spans [(label, first word, last word, covered share)], score."""
        coded = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words)) if words else np.zeros(0, dtype=np.int64)
        known = np.r_[False, coded >= 0, False]
        edges = np.flatnonzero(known[1:] != known[:-1])
        base: list[tuple[int, int]] = []
        long: list[tuple[int, int, int]] = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.least:
                self.match(coded[a:b].tolist(), a, base, long)
        chains = self.chains(long)
        spans = best_of_overlapping({(first, last, self.labels[k], covered / self.sizes[k]) for k, first, last, covered in chains if covered >= COVERED * self.sizes[k]})
        score = max((covered / self.sizes[k] for k, _, _, covered in chains), default=0.0)
        return {"n_words": len(words), "base": base, "spans": spans, "score": min(1.0, score)}


def best_of_overlapping(spans: set[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The spans that no overlapping span of another label covers better, by start: one notice resembles others."""
    out, stretch, until = [], [], -1
    for span in [*sorted(spans), None]:
        if span is None or span[0] > until:
            out += [s for s in stretch if not any(t[2] != s[2] and t[3] > s[3] and t[0] <= s[1] and s[0] <= t[1] for t in stretch)]
            stretch = []
        if span is not None:
            stretch.append(span)
            until = max(until, span[1])
    return out


_SCHEMA = ("doc_id long, n_words long, base array<struct<label string, first_word long, last_word long>>, "
           "spans array<struct<label string, first_word long, last_word long, covered double>>, score double")
_BASE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))


def scan_licences(docs: DataFrame, index: LicenceIndex | None = None) -> DataFrame:
    """doc_id, n_words, base (places of the base phrases by start), spans (covered template spans by start; words
    from 0, last one included), score."""
    prepare(docs.sparkSession)
    index = index or LicenceIndex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(words_of(t.as_py())) for t in batch.column(1)]
            base = [[{"label": index.base_labels[k], "first_word": i, "last_word": i + index.base_sizes[k] - 1} for i, k in sorted(f["base"])] for f in found]
            spans = [[{"label": label, "first_word": a, "last_word": b, "covered": c} for a, b, label, c in f["spans"]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f["n_words"] for f in found], pa.int64()), pa.array(base, _BASE), pa.array(spans, _SPANS),
                 pa.array([f["score"] for f in found], pa.float64())], names=["doc_id", "n_words", "base", "spans", "score"])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, _SCHEMA)
