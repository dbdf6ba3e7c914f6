"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text with its spaces escaped falls apart into words (space marks, then other characters; line feeds alone):
no piece of the vocabulary crosses such a border, so no merge does. The symbols of many
distinct words stand in flat numpy arrays. In every round each word finds its smallest pair rank (one
segmented minimum), merges all places of that rank that don't overlap, from the left, at the same time, and
the arrays are compacted; words without a pair in the vocabulary leave. This goes on until none is left.

Exactness. The reference order is one merge at a time, best score first, then leftmost. Merging several places of
a word at once gives the same result if no pair that arises ranks as high as the one just merged.
That is checked in each round: a word where it fails is encoded again with one merge per round, which is the
reference order itself. Pieces that share a score (runs of spaces) always take one merge per round.

Scale: a map over the documents without a shuffle. Each worker keeps a bounded table of encoded words; when it is
full, it starts anew, which costs time only. The model (half a megabyte, fixed) is read once on
the driver and sent inside the task.

Defined cases: a null text is an empty one, encoded as the begin and end ids alone; null or equal ids and
repeated rows keep a row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from culler.llm.common import prepare

MARK = "▁"
NORMAL, CONTROL, USER_DEFINED, BYTE = 1, 3, 4, 6
NONE = np.int32(2**31 - 1)
#: Encoded words that a worker keeps, and characters that it takes at a time.
CACHE_WORDS = 300_000
CHUNK_CHARS = 2_000_000
_WORDS = re.compile(r"\n| *[^ \n]+| +")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[i : i + n]
        i += n


def _per_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("culler_per_byte", _per_byte)


class PieceBpe:
    """The tables of a BPE model with byte fallback, identity normalisation and a leading dummy space."""

    def __init__(self, model: bytes):
        pieces, spec = [], {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 3:
                spec = dict(_fields(value))
        if spec.get(2) or spec.get(3, 1) != 1 or spec.get(4, 1) != 0 or spec.get(5, 1) != 1:
            raise ValueError("only identity normalisation with a dummy prefix, escaped and kept spaces is supported")
        kinds = np.array([k for _, _, k in pieces])
        if (kinds == USER_DEFINED).any() or (kinds == BYTE).sum() != 256:
            raise ValueError("a model with byte fallback and without user-defined pieces is needed")
        normal = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) for p in normal):
            raise ValueError("a piece crosses a word border")
        self.n = len(pieces)
        self.bos, self.eos = ([i for i, (p, _, k) in enumerate(pieces) if k == CONTROL and p == s][0] for s in ("<s>", "</s>"))
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        # a character without a piece is the symbol n + its code point: it may merge, else it ends as bytes
        self.of_char = np.arange(0x110000, dtype=np.int32) + np.int32(self.n)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        symbol = lambda s: normal.get(s, int(self.of_char[ord(s)]) if len(s) == 1 else None)
        scores = sorted({pieces[i][1] for p, i in normal.items() if len(p) > 1}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs = [(symbol(p[:k]), symbol(p[k:]), rank_of[pieces[i][1]], i) for p, i in normal.items() for k in range(1, len(p))]
        pairs = [x for x in pairs if x[0] is not None and x[1] is not None]
        keys = np.array([(a << 21) | b for a, b, _, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(np.array([r for _, _, r, _ in pairs], dtype=np.int32)[order], NONE)
        self.merged = np.append(np.array([i for _, _, _, i in pairs], dtype=np.int32)[order], np.int32(0))
        shared = np.bincount([rank_of[pieces[i][1]] for p, i in normal.items() if len(p) > 1], minlength=len(scores)) > 1
        self.shared = np.append(shared, False)  # the last: no pair
        surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k not in (NORMAL,) else p.replace(MARK, " ").encode()
                   for p, _, k in pieces]
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_n = np.array([len(s) for s in surface], dtype=np.int64)
        self.surface_at = np.cumsum(self.surface_n) - self.surface_n
        self.silent = kinds == CONTROL
        self.marked = np.array([p.startswith(MARK) for p, _, _ in pieces])
        self._start_cache()

    def _start_cache(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into the pair table, of its last row if there is no such pair."""
        key = (left.astype(np.int64) << 21) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def _rounds(self, words: list[str], single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, their words in ascending order, words to encode again one merge at a time)."""
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        pair = np.full(len(sym), len(self.keys) - 1, dtype=np.int64)
        same = np.flatnonzero(word[1:] == word[:-1])
        pair[same] = self._lookup(sym[same], sym[same + 1])
        done_sym, done_word, again = [], [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = self.ranks[pair]
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            open_ = np.repeat(best != NONE, sizes)
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                sym, word, pair, rank = sym[open_], word[open_], pair[open_], rank[open_]
                if not len(sym):
                    break
                keep = best != NONE
                best, sizes = best[keep], sizes[keep]
            of = np.repeat(np.arange(len(best)), sizes)
            place = np.flatnonzero(rank == best[of])
            # leftmost of overlapping places: every second one in a run of neighbours; in some words only the first
            run = np.r_[True, np.diff(place) != 1]
            place = place[(np.arange(len(place)) - np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))) % 2 == 0]
            owner = of[place]
            head = np.r_[True, owner[1:] != owner[:-1]]
            place = place[head | ~(single | self.shared[best[owner]])]
            owner = of[place]
            several = np.bincount(owner, minlength=len(best)) > 1
            sym[place] = self.merged[pair[place]]
            keep = np.ones(len(sym), dtype=bool)
            keep[place + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[place]
            sym, word, pair, of = sym[keep], word[keep], pair[keep], of[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            right = touched[touched + 1 < len(sym)]
            pair[touched] = len(self.keys) - 1
            right = right[word[right] == word[right + 1]]
            pair[right] = self._lookup(sym[right], sym[right + 1])
            early = right[(self.ranks[pair[right]] <= best[of[right]]) & several[of[right]]]
            if len(early):
                bad = np.unique(word[early])
                again.append(bad)
                keep = ~np.isin(word, bad)
                sym, word, pair = sym[keep], word[keep], pair[keep]
        empty = np.zeros(0, dtype=np.int32)
        sym, word = np.concatenate([empty, *done_sym]), np.concatenate([empty, *done_word])
        order = np.argsort(word, kind="stable")
        return sym[order], word[order], np.concatenate([empty, *again])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words in a row, and their number per word."""
        sym, word, again = self._rounds(words, single=False)
        if len(again):
            redo, its, _ = self._rounds([words[i] for i in again], single=True)
            sym, word = np.concatenate([sym, redo]), np.concatenate([word, again[its]])
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        point = sym - self.n
        count = np.where(point < 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)).astype(np.int64)
        ids, word = np.repeat(sym, count), np.repeat(word, count)
        if (point >= 0).any():
            raw = "".join(map(chr, point[point >= 0])).encode()
            ids[ids >= self.n] = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
        return ids, np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, without begin and end, and the number of ids of each."""
        if len(self.index) > CACHE_WORDS:
            self._start_cache()
        parts = [_WORDS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = list({w: None for p in parts for w in p if w not in self.index})
        if new:
            ids, sizes = self._encode_words([w.replace(" ", MARK) for w in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, ids])
        get = self.index.__getitem__
        numbers = np.fromiter((get(w) for p in parts for w in p), dtype=np.int64, count=sum(map(len, parts)))
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[numbers] - (ends - sizes), sizes)]
        upto = np.r_[0, ends][np.cumsum([len(p) for p in parts])] if parts else np.zeros(0, dtype=np.int64)
        return ids, np.diff(np.r_[0, upto])

    def decode(self, ids: np.ndarray) -> str:
        """The text of one sequence of ids; control ids are silent, the dummy space goes."""
        ids = ids[~self.silent[ids]]
        sizes = self.surface_n[ids]
        ends = np.cumsum(sizes)
        raw = self.surface[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.surface_at[ids] - (ends - sizes), sizes)].tobytes()
        if len(ids) and self.marked[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "culler_per_byte")


def text_chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with about ``chars`` characters, one text at least."""
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model's bytes, read by the driver (about half a megabyte)."""
    return Path(path).read_bytes()


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (begin and end included) and
    decoded. The digests are of the ids as little-endian unsigned 32-bit integers and of decode(ids) in UTF-8."""
    prepare(docs.sparkSession)
    model = read_model(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe(model)
        for batch in batches:
            doc_ids, all_texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(all_texts):
                flat, sizes = bpe.encode(all_texts[a:b])
                ends = np.cumsum(sizes)
                rows = [np.concatenate([[bpe.bos], flat[e - n : e], [bpe.eos]]).astype(np.int32) for e, n in zip(ends, sizes)]
                texts = [bpe.decode(r) for r in rows]
                out = [doc_ids.slice(a, b - a), pa.array(sizes + 2, pa.int64()),
                       pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
                       pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out += [pa.array(rows, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = ENCODED + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)
