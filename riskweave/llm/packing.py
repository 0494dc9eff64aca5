"""Packing token documents into sequences of fixed capacity: dominance reduction, then best fit.

Only lengths decide a packing, so the driver sees the histogram of piece lengths (at most ``capacity`` numbers) and solves it by
counts. Reduction after Martello and Toth: taking a longest piece j, a set {j} or {j, k} is fixed for good when it dominates
every other set that could share a sequence with j:

* nothing else fits: {j};
* k fills the sequence exactly, or the two shortest pieces don't fit together with j: {j, k} with k the longest that fits;
* at most two more pieces fit with j and no fitting pair is longer than that k: {j, k}.

What remains is packed best fit by decreasing length. The result is a list of patterns with copies; a piece finds its sequence
from its length and its number among pieces of that length, which is counted on the cluster.

A document is its ids and one end id; null text is empty. Longer documents are cut into full pieces and a rest. Repeated rows
are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import bpe
from riskweave.llm.common import gapless, text_slices
from riskweave.session import pin

END_ID = 0
CAPACITY = 2048
_SLICE = 1 << 18


@dataclass
class Pattern:
    """``copies`` sequences that hold the same (length, times) items; ``room`` is what is left in each."""

    copies: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text."""
    shared = bpe.share(docs.sparkSession, tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(shared).encode
        for batch in batches:
            for first, end, data, at in text_slices(batch, "text", _SLICE):
                ids, offsets = encode(data, at)
                ids = ids.astype("<u4")
                rows: list[list] = [[], [], [], [], []]
                for i, doc_id in enumerate(batch.column(0).slice(first, end - first).to_pylist()):
                    own = np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start:start + capacity]
                        for column, value in zip(rows, (doc_id, k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Counts by length with the neighbour questions the reduction asks."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n

    def longest(self, limit: int) -> int:
        at = np.flatnonzero(self.count[:limit + 1])
        return int(at[-1]) if len(at) else 0

    def shortest_sums(self, how_many: int) -> list[int]:
        """Sums of the 1, 2, ... shortest pieces left; missing ones weigh more than any sequence."""
        found: list[int] = []
        for length in np.flatnonzero(self.count):
            found += [int(length)] * int(min(self.count[length], how_many - len(found)))
            if len(found) == how_many:
                break
        found += [len(self.count)] * (how_many - len(found))
        return [int(s) for s in np.cumsum(found)]

    def best_pair(self, limit: int) -> int:
        """Largest sum of two pieces left within ``limit``; 0 if no two fit."""
        best = 0
        at = np.flatnonzero(self.count[:limit + 1])
        for a in at:
            b = self.longest(min(int(a), limit - int(a)))
            if b == a and self.count[a] < 2:
                b = self.longest(int(a) - 1)
            if b:
                best = max(best, int(a) + b)
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """(patterns fixed for good, counts of the pieces that remain)."""
    left, fixed = _Lengths(counts, capacity), []
    for j in sorted(counts, reverse=True):
        while left.count[j]:
            room = capacity - j
            left.count[j] -= 1  # one piece j is set; questions are about the others
            k = left.longest(room)
            one, two, three = left.shortest_sums(3)
            alone = one > room
            pair = not alone and (k == room or two > room or (three > room and left.best_pair(room) <= k))
            left.count[j] += 1
            if alone:
                times = int(left.count[j])
                fixed.append(Pattern(times, room, [(j, 1)]))
                left.count[j] = 0
            elif pair and k == j:
                times = int(left.count[j]) // 2
                fixed.append(Pattern(times, room - k, [(j, 2)]))
                left.count[j] -= 2 * times
            elif pair:
                times = int(min(left.count[j], left.count[k]))
                fixed.append(Pattern(times, room - k, [(j, 1), (k, 1)]))
                left.count[j] -= times
                left.count[k] -= times
            else:
                break
    return fixed, {int(n): int(left.count[n]) for n in np.flatnonzero(left.count)}


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by decreasing length, many equal sequences at a time."""
    by_room: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, bool)

    def put(pattern: Pattern) -> None:
        by_room[pattern.room].append(pattern)
        open_rooms[pattern.room] = True

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            rooms = np.flatnonzero(open_rooms[length:])
            if len(rooms):
                room = int(rooms[0]) + length
                pattern = by_room[room].pop()
                open_rooms[room] = bool(by_room[room])
            else:
                room, pattern = capacity, Pattern(left, capacity)
            each = min(room // length, left)
            bins = min(pattern.copies, left // each)
            if bins < pattern.copies and room < capacity:
                put(Pattern(pattern.copies - bins, room, pattern.items))
            put(Pattern(bins, room - each * length, [*pattern.items, (length, each)]))
            left -= bins * each
    return [p for group in by_room for p in group]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def runs(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first number, sequence of the first, times per sequence, offset), by length and number.

    Splitting a group of equal sequences happens once per length, so their number is bounded by the capacity, not the input.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for length, times in p.items:
            rows.append((length, taken.get(length, 0), sequence, times, offset))
            taken[length] = taken.get(length, 0) + p.copies * times
            offset += length * times
        sequence += p.copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (columns doc_id, piece, length, ids_crc32, ...)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    table = spark.sparkContext.broadcast(runs(solve(counts, capacity)))
    numbered = gapless(pieces, "length", ["doc_id", "piece", "ids_crc32"], counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = (t[:, 0] << 46) + t[:, 1]
        for batch in batches:
            length, slot = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "slot"))
            at = np.searchsorted(keys, (length.astype(np.int64) << 46) + slot, side="right") - 1
            number = slot - t[at, 1]
            sequence = t[at, 2] + number // t[at, 3]
            offset = t[at, 4] + number % t[at, 3] * length
            names = [n for n in batch.schema.names if n != "slot"]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.select(*pieces.columns, "slot").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pin(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
