"""Words and shingles of whole texts as 64-bit hashes, computed for many texts at once in numpy.

A word is a run of letters and digits in lower case. ASCII punctuation, the Latin-1 signs and the general
and CJK punctuation blocks separate words, every other non-ASCII character belongs to a word.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _CLASS[_c] = 1 if _c >= 0x80 or chr(_c).isalnum() else 0
_CLASS[[0xC2, 0xE2, 0xE3]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, n.bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of all words; no word crosses a document border."""
    kind = _CLASS[data]
    lead = np.flatnonzero(kind == 2)
    if len(lead):
        kind = np.minimum(kind, 1)
        after = data[np.minimum(lead + 1, len(data) - 1)]
        first = data[lead]
        latin = lead[(first == 0xC2)]
        block = lead[((first == 0xE2) & (after == 0x80)) | ((first == 0xE3) & (after == 0x80))]
        for where, width in ((latin, 2), (block, 3)):
            for k in range(width):
                kind[np.minimum(where + k, len(data) - 1)] = 0
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins = kind.copy()
    begins[1:] &= kind[:-1] ^ 1
    begins[inner] = kind[inner]
    ends = kind.copy()
    ends[:-1] &= kind[1:] ^ 1
    ends[inner - 1] = kind[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case: by table while all characters are below U+0100, else by Python, text by text."""
    if not len(data):
        return data, offsets
    if data.max() < 0xC4:
        low = _LOWER[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        latin = latin[(data[latin] <= 0x9E) & (data[latin] != 0x97)]
        low[latin] += 0x20
        return low, offsets
    raw = data.tobytes()
    texts = [raw[a:b].decode().lower().encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that follow each other without overlap: a polynomial of the bytes, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    value = up[:len(data)] * (data.astype(np.uint64) + np.uint64(1))
    both = np.empty(2 * len(starts), np.int64)
    both[0::2], both[1::2] = starts, ends
    # A span that touches the next one leaves an empty sum between them; reduceat gives that a value, which is not used.
    if both[-1] == len(data):
        both = both[:-1]
    sums = np.add.reduceat(value, both)[0::2]
    return mix(sums * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets of the documents in that list)."""
    data, offsets = lowered(data, offsets)
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the offsets of the documents in that list.

    A document of fewer words, but one at least, has one shingle of all its words.
    """
    counts = np.diff(offsets)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    length = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(length)])
    at = _expand(offsets[:-1], length)
    rolled = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    factor = 1
    for k in range(width):
        factor = factor * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        rolled += padded[at + k] * np.uint64(factor)
    short = np.flatnonzero((counts < width) & (counts > 0))
    for d in short:  # fewer words than a shingle: at most width - 1 of them
        total = np.uint64(0)
        factor = 1
        for w in words[offsets[d]:offsets[d + 1]]:
            factor = factor * 0xD6E8FEB86659FD93 & (1 << 64) - 1
            total = np.uint64((int(total) + int(w) * factor) & (1 << 64) - 1)
        rolled[out_offsets[d]] = total
    return mix(rolled), out_offsets


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def multiset(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct hashes of each document, ordered by document and hash."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    if not len(h):
        return d, h, np.zeros(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))
