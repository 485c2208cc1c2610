"""Sets of word-shingle hashes of whole texts, in numpy: no Python object for a word.

A-Z are lower-cased and words are split at ASCII white space. A word's hash is a polynomial of its bytes modulo 2**64, mixed
with its length; a shingle's hash is a sum of its words' hashes, each times the weight of its place, mixed again."""

from __future__ import annotations

import numpy as np

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_WHITE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; a word that goes on beyond them is hashed whole.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words each of whose output bits depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and the offsets of the texts."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    white = _WHITE[raw]
    powers = _powers(64)
    hashes, begins = [], []
    a = 0
    while a < len(raw):
        b = min(len(raw), a + CHUNK)
        while not white[b - 1]:  # to the end of the word; the last byte is white
            more = np.flatnonzero(white[b : b + CHUNK])
            b += int(more[0]) + 1 if len(more) else len(white[b : b + CHUNK])
        w = white[a:b]
        starts = np.flatnonzero(~w & np.concatenate([[True], w[:-1]]))
        if len(starts):
            sizes = np.flatnonzero(w[1:] & ~w[:-1]) + 1 - starts
            if sizes.max() > len(powers):
                powers = _powers(int(sizes.max()))
            own = np.flatnonzero(~w)
            ends = np.cumsum(sizes)
            place = np.arange(len(own)) - np.repeat(ends - sizes, sizes)
            terms = (_LOWER[raw[a:b][own]].astype(np.uint64) + np.uint64(1)) * powers[place]
            hashes.append(mixed(np.add.reduceat(terms, ends - sizes) + mixed(sizes.astype(np.uint64))))
            begins.append(starts + a)
        a = b
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.concatenate([[0], np.searchsorted(begin, stops)])


def shingle_sets(texts: list[bytes], width: int, seed: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending, as signed longs. A text of fewer words than a shingle is one shingle."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    weights = mixed(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(seed << 8)) | np.uint64(1)
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(min(width, len(words))):  # a window that leaves its text isn't used, or is the one shingle of a short text
        total[: len(words) - k] += words[k:] * weights[k]
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        own = words[at[i] : at[i + 1]]
        total[at[i]] = (own * weights[: len(own)]).sum(dtype=np.uint64)
    total = mixed(total + np.uint64(seed)).view(np.int64)
    return [np.unique(total[a : a + max(1, m - width + 1)]) if m else total[:0] for a, m in zip(at.tolist(), n.tolist())]
