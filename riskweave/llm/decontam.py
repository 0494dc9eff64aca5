"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item of n words has n - 4 shingles of five words, weighted by how often they occur in it. A document is compared with
an item through its windows of as many shingles. Windows of s shingles and an item of t have similarity 0.8 only if they share
4/9 (s + t) shingles, so only windows with that many places whose shingle occurs in the benchmark at all get a fingerprint; that
leaves out no similar window and nearly all of an ordinary text. Multi-index Hamming blocks then find all items of the window's
size within ``RADIUS`` of its 64 bits: fingerprints that differ in at most 23 bits differ in at most two bits of one of eight blocks of
eight, and every item is listed under all such values of each block. The pairs found are verified by exact weighted Jaccard similarity of
the shingle multisets. A pair of similarity 0.8 differs in 9.7 bits on average with a deviation of 2.9, so the radius lies more than
four deviations beyond.

The benchmark is read in blocks of bounded size; each is broadcast and meets all documents, so documents are never shuffled and
a passage that many documents share costs each of them the same.

Null and empty texts match nothing. An item of fewer than five words is one shingle of all its words and must occur exactly. A
document shorter than an item is one window. Of several windows the most similar, then first, is returned for each document
row and item. Repeated rows repeat their results. Equal items each match. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import ranges, text_slices
from riskweave.llm.words import mix, multiset, shingle_hashes, word_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Most bits that differ, and the blocks of the fingerprint with the bits changed in each: BLOCKS * (FLIPS + 1) > RADIUS.
RADIUS, BLOCKS, FLIPS = 23, 8, 2
_BITS = 64 // BLOCKS
#: Most benchmark bytes in one broadcast block.
BLOCK_BYTES = 2 << 20
_SLICE = 1 << 18
#: Windows looked up at once, and most shingles of windows that are verified at once; one window at least.
_WINDOWS, _VERIFIED = 1 << 13, 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, similarity double, hamming int, start_word long, n_words long"


def fingerprints(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of every window of ``sizes`` hashes from ``starts``: bit b is set where more than half of the hashes set it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + sizes, -1)
    inside = np.cumsum(covered[:-1]) > 0
    rank = np.concatenate([[0], np.cumsum(inside)])
    bits = np.unpackbits(hashes[inside].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    ones = sums[rank[starts] + sizes] - sums[rank[starts]]
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """One block of benchmark items with its lookup tables."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        rows = [(i, t.encode()) for i, t in rows]
        data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
        words, word_offsets = word_hashes(data, offsets)
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.words = np.diff(word_offsets)
        hashes, at = shingle_hashes(words, word_offsets, WIDTH)
        self.sizes = np.diff(at)
        item, h, count = multiset(hashes, at)
        long = self.words[item] >= WIDTH
        self.short = {n: (h[self.words[item] == n], item[self.words[item] == n]) for n in set(self.words[item[~long]].tolist())}
        item, h, count = item[long], h[long], count[long]
        self.shingles = np.unique(h)
        entry = np.argsort(_entry(h, item))
        self.entries, self.entry_count = _entry(h, item)[entry], count[entry]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.shingles >> np.uint64(44)] = True
        self.prints = np.zeros(len(rows), np.uint64)
        usable = np.flatnonzero(self.words >= WIDTH)
        self.prints[usable] = fingerprints(hashes, at[usable], self.sizes[usable])
        self.classes, kind = np.unique(self.sizes[usable], return_inverse=True)  # item sizes: windows meet items of their size
        self.tables = [self._table(usable, kind, b) for b in range(BLOCKS)]

    def _table(self, usable: np.ndarray, kind: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets by size class and block value, items) with every item under all values that differ in few enough bits."""
        value = _block(self.prints[usable], block)
        flips = [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(_BITS), n)]
        near = ((kind << _BITS)[:, None] + (value[:, None] ^ np.array(flips, np.int64)[None, :])).ravel()
        order = np.argsort(near, kind="stable")
        return np.searchsorted(near[order], np.arange((len(self.classes) << _BITS) + 1)), np.repeat(usable, len(flips))[order]

    def near(self, prints: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item of its size class) within the radius, by the block tables."""
        windows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block, (offsets, listed) in enumerate(self.tables):
            value = (kind << _BITS) + _block(prints, block)
            count = offsets[value + 1] - offsets[value]
            window = np.repeat(np.arange(len(prints)), count)
            item = listed[ranges(offsets[value], count)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            windows.append(window[close])
            items.append(item[close])
        pairs = np.unique(np.concatenate(windows) * max(1, len(self.ids)) + np.concatenate(items))
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def occurs(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each shingle occurs in an item."""
        found = self.maybe[hashes >> np.uint64(44)]
        at = np.flatnonzero(found)
        if len(at):
            place = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
            found[at] = self.shingles[place] == hashes[at]
        return found

    def overlap(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Size of the multiset intersection of window i and item i."""
        if not len(starts) or not len(self.entries):
            return np.zeros(len(starts), np.int64)
        pair = np.repeat(np.arange(len(starts)), sizes)
        key = _entry(hashes[ranges(starts, sizes)], items[pair])
        at = np.minimum(np.searchsorted(self.entries, key), len(self.entries) - 1)
        found = self.entries[at] == key
        both, count = np.unique(pair[found] * len(self.entries) + at[found], return_counts=True)
        return np.bincount(both // len(self.entries), np.minimum(count, self.entry_count[both % len(self.entries)]), len(starts)).astype(np.int64)


def _entry(hashes: np.ndarray, items: np.ndarray) -> np.ndarray:
    return mix(hashes + (items.astype(np.uint64) + np.uint64(1)) * _ODD)


def _block(prints: np.ndarray, block: int) -> np.ndarray:
    return (prints >> np.uint64(_BITS * block)).astype(np.int64) & ((1 << _BITS) - 1)


def likely_windows(hashes: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, shingles, size class) of all windows with enough places whose shingle occurs in the benchmark."""
    inside = items.occurs(hashes)
    total = np.concatenate([[0], np.cumsum(inside)])
    sizes, hits = np.diff(offsets), total[offsets[1:]] - total[offsets[:-1]]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for kind, full in enumerate(items.classes.tolist()):
        size = np.minimum(full, sizes)  # a document shorter than the item is one window
        need = np.ceil(SIMILARITY * (size + full) / (1 + SIMILARITY) - 1e-6).astype(np.int64)
        docs = np.flatnonzero((hits >= need) & (size > 0))
        if not len(docs):
            continue
        count = sizes[docs] - size[docs] + 1
        start, width = ranges(offsets[docs], count), np.repeat(size[docs], count)
        good = total[start + width] - total[start] >= np.repeat(need[docs], count)
        found.append((start[good], width[good], np.full(int(good.sum()), kind)))
    start, size, kind = (np.concatenate(c) for c in zip(*found, strict=True))
    return start, size, kind


def similar_windows(hashes: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(start, shingles, item, similarity, hamming) of all windows within the radius of an item and with similarity 0.8 or more."""
    start, size, kind = likely_windows(hashes, offsets, items)
    out = []
    for k in range(0, max(len(start), 1), _WINDOWS):
        own, width = start[k:k + _WINDOWS], size[k:k + _WINDOWS]
        prints = fingerprints(hashes, own, width)
        window, item = items.near(prints, kind[k:k + _WINDOWS])
        cuts = np.flatnonzero(np.diff(np.cumsum(width[window]) // _VERIFIED)) + 1
        parts = zip(np.split(window, cuts), np.split(item, cuts), strict=True)
        common = np.concatenate([items.overlap(hashes, own[w], width[w], i) for w, i in parts])
        similarity = common / np.maximum(width[window] + items.sizes[item] - common, 1)
        good = similarity >= SIMILARITY
        window, item = window[good], item[good]
        out.append((own[window], width[window], item, similarity[good], np.bitwise_count(prints[window] ^ items.prints[item]).astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def match_batch(data: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Best window of each (document, item): document, item, similarity, hamming, start word, words."""
    words, word_offsets = word_hashes(data, offsets)
    hashes, at = shingle_hashes(words, word_offsets, WIDTH)
    start, size, item, similarity, hamming = similar_windows(hashes, at, items)
    doc = np.searchsorted(at, start, side="right") - 1
    found = [(doc, item, similarity, hamming, start - at[doc], np.minimum(size + WIDTH - 1, np.diff(word_offsets)[doc]))]
    for n, (h, short_item) in items.short.items():
        rolled, roll_at = shingle_hashes(words, word_offsets, n)
        for one, which in zip(h, short_item, strict=True):
            place = np.flatnonzero(rolled == one)
            doc = np.searchsorted(roll_at, place, side="right") - 1
            whole = np.diff(word_offsets)[doc] >= n
            place, doc = place[whole], doc[whole]
            found.append((doc, np.full(len(doc), which), np.ones(len(doc)), np.zeros(len(doc), np.int64), place - roll_at[doc], np.full(len(doc), n)))
    doc, item, similarity, hamming, first, n_words = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((first, -similarity, item, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])
    best = order[new]
    return doc[best], items.ids[item[best]], similarity[best], hamming[best], first[best], n_words[best]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start_word, n_words of every document row and item with similarity 0.8 or more."""
    spark = docs.sparkSession
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    result = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in rows]))
        part = low.mapInArrow(_matcher(shared), SCHEMA)
        result = part if result is None else result.unionByName(part)
    return result


def _matcher(shared):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text", _SLICE):
                doc, item, similarity, hamming, start, n_words = match_batch(data, offsets, shared.value)
                ids = batch.column(0).slice(first, end - first).take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(item, pa.int64()), pa.array(similarity, pa.float64()), pa.array(hamming, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(n_words, pa.int64()),
                ], ["doc_id", "item_id", "similarity", "hamming", "start_word", "n_words"])

    return match
