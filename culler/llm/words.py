"""Words as 64-bit hashes, for operators that count or compare runs of words."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

#: Hashes of words kept per worker.
CACHE_WORDS = 500_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # Fixed values: a 64-bit finaliser's multipliers.
_S = np.uint64(33)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; starts anew when it holds CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def word_hashes(texts: list[str | bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and the number of words of each. Words are what lies between
    ASCII white space; ``lower`` turns A-Z to lower case first. Bytes are a text's UTF-8."""
    words = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = [(b.lower() if lower else b).split() for b in words]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(sizes.sum()))
    return flat, sizes


def ngrams(flat: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside each text, in a row, and the number of each text's runs."""
    count = np.maximum(sizes - (n - 1), 0)
    if not len(flat):
        return flat[:0], count
    h = flat.copy() if n == 1 else mixed(flat[: max(0, len(flat) - n + 1)])
    for k in range(1, n):
        h = mixed(h + flat[k : len(flat) - n + 1 + k])
    starts = np.cumsum(sizes) - sizes
    within = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
    return h[within], count
