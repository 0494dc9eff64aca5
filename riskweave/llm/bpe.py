"""Token ids of whole texts with a public tokenizer file, by way of a word cache.

The vocabulary used here drops white space and never merges across it, nor between ASCII letters and ASCII signs, so the ids of a
text are those of its pieces in order. Texts are cut into pieces in numpy; a Python worker encodes a piece once and finds it again
by a 64-bit hash and its length. The table holds at most ``CACHE_WORDS`` pieces and starts anew beyond that. Pieces missing from
it are encoded together. An apostrophe and ``|`` never border a piece, as contractions and special tokens contain them.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from riskweave.llm.common import ranges
from riskweave.llm.words import span_hashes

CACHE_WORDS = 1 << 21
_SLOTS = 1 << 22
_TOGETHER = 200
_SEPARATOR = "\x00"
#: 0 white space, 1 letters and what always stays with its neighbours, 2 ASCII signs that border letters.
_KIND = np.ones(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _c in range(33, 127):
    if not chr(_c).isalnum() and chr(_c) not in "'|":
        _KIND[_c] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_ENCODERS: dict[int, WordEncoder] = {}


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pieces of all documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, letter = _KIND[data], _IS_LETTER[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    border[0] = border[-1] = True
    black = kind > 0
    border[1:-1] |= black[1:] != black[:-1]
    sign = kind == 2
    border[1:-1] |= (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    at = np.flatnonzero(border)
    starts, ends = at[:-1], at[1:]
    real = black[starts]
    return starts[real], ends[real]


class WordEncoder:
    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.separator = self._whole([_SEPARATOR])[0]
        if len(self.separator) != 1:
            raise ValueError("the tokenizer must give the separator one id")
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        self.words, self.used = 0, 0
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in order, offsets of the documents in them)."""
        starts, ends = pieces(data, offsets)
        if b"<|" not in data.tobytes():  # special tokens are matched before letters are lowered
            data = _LOWER[data]
        keys = span_hashes(data, starts, ends)
        places = self._find(keys)
        if (places < 0).any():
            if self.words + int((places < 0).sum()) > CACHE_WORDS:
                self._clear()
                places[:] = -1
            self._learn(data, starts, ends, keys, places)
            places = self._find(keys)
        lengths = self.lengths[places].astype(np.int64)
        ids = self.flat[ranges(self.starts[places], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[np.searchsorted(starts, offsets)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not in the table: linear probing, all keys a step at a time."""
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        slot = (keys >> np.uint64(42)).astype(np.int64)
        while len(todo):
            place = self.places[slot]
            hit = (place >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = place[hit]
            on = (place >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _store(self, keys: np.ndarray, places: np.ndarray) -> None:
        slot = (keys >> np.uint64(42)).astype(np.int64)
        while len(keys):
            free = self.places[slot] < 0
            _, first = np.unique(slot, return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.places[slot[first]] = keys[first], places[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, places, slot = keys[left], places[left], (slot[left] + 1) & (_SLOTS - 1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, places: np.ndarray) -> None:
        missing = np.flatnonzero(places < 0)
        new, first = np.unique(keys[missing], return_index=True)
        raw = data.tobytes()
        texts = [raw[starts[i]:ends[i]].decode() for i in missing[first]]
        found: list[list[int]] = [[]] * len(texts)
        plain = [i for i, t in enumerate(texts) if _SEPARATOR not in t]
        groups = [plain[i:i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        joined = self._whole([f" {_SEPARATOR} ".join(texts[i] for i in g) for g in groups])
        for group, ids in zip(groups, joined, strict=True):
            ids = np.array(ids, np.int32)
            parts = np.split(ids, np.flatnonzero(ids == self.separator[0]))
            if len(parts) != len(group):
                raise ValueError("the tokenizer lost a word border")
            for k, (i, part) in enumerate(zip(group, parts, strict=True)):
                found[i] = part[1:] if k else part
        for i in set(range(len(texts))) - set(plain):
            found[i] = self._whole([texts[i]])[0]
        sizes = np.array([len(f) for f in found], np.int64)
        ids = np.concatenate(found).astype(np.int32) if len(found) else np.zeros(0, np.int32)
        while self.words + len(new) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used:self.used + len(ids)] = ids
        own = slice(self.words, self.words + len(new))
        self.starts[own], self.lengths[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self._store(new, np.arange(self.words, self.words + len(new), dtype=np.int32))
        self.words, self.used = self.words + len(new), self.used + len(ids)


def tokenizer_json(path: str) -> str:
    """Read on the driver: executors get the text of the file and need no path."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def share(spark: SparkSession, path: str):
    """Broadcast of the tokenizer's text (a file of fixed size, about 2 MB)."""
    return spark.sparkContext.broadcast(tokenizer_json(path))


def encoder(shared) -> WordEncoder:
    """The worker's encoder, kept between tasks."""
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(shared.value)
    return _ENCODERS[key]


def forget() -> None:
    """Let go of the worker's encoder: workers are kept between stages, and a stage without tokens needs its memory."""
    _ENCODERS.clear()
