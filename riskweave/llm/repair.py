"""Token ids in grammar-compressed shard files: Re-Pair.

Documents are range-partitioned and sorted by doc_id; a task tokenizes its whole texts and cuts them into shards of about
``SHARD_IDS`` ids. In a shard, frequent id pairs are replaced by nonterminals again and again until no pair occurs
``MIN_COUNT`` times or a round gains less than ``LEAST_GAIN``; a round replaces many pairs at once, the more frequent first where they overlap. Pairs never cross
documents, so a document is decoded alone from its part of the sequence and the rules.

File format: Parquet in the shared folder, one row per shard: part, shard, n_ids, doc_ids, sequence offsets of the documents,
base (first nonterminal), rules (left, right), expansion lengths of the rules, sequence. Arrays are little-endian bytes, the
32-bit ones as byte planes, which compress well.

Null text is empty: the document is the end id alone. A null doc_id sorts first; repeated rows are documents of their own. An
empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import bpe
from riskweave.llm.common import ranges, text_slices
from riskweave.session import scratch_path

END_ID = 2
SHARD_IDS = 1 << 20
MIN_COUNT = 24
#: A shard is done when a round takes less than this share of its sequence away.
LEAST_GAIN = 0.01
_NO_RANK = np.iinfo(np.int64).max
_SLICE = 2 << 20
SHARD_SCHEMA = "part int, shard int, n_ids long, doc_ids binary, doc_valid binary, offsets binary, base long, rules binary, rule_lengths binary, sequence binary"


def planes(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _short(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def compress(ids: np.ndarray, offsets: np.ndarray, min_count: int = MIN_COUNT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules, expansion lengths, sequence, offsets of the documents in the sequence)."""
    x, offsets = ids.astype(np.int64), offsets.astype(np.int64)
    base = int(x.max()) + 1 if len(x) else 0
    rules, lengths, top = [], [], base
    while len(x) > 1:
        keys = (x[:-1] << 32) | x[1:]
        border = offsets[1:-1]
        keys[border[(border > 0) & (border < len(x))] - 1] = -1
        ordered = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(starts, len(ordered)))
        often = starts[(counts >= min_count) & (ordered[starts] >= 0)]
        if not len(often):
            break
        pairs, seen = ordered[often], counts[np.searchsorted(starts, often)]
        rank_of = np.empty(len(pairs), np.int64)
        order = np.lexsort((pairs, -seen))
        rank_of[order] = np.arange(len(pairs))
        # Most places hold no frequent pair: a small table of hashed pairs rules them out before the search.
        maybe = np.zeros(1 << 18, bool)
        maybe[_short(pairs)] = True
        place = np.flatnonzero(maybe[_short(keys)])
        found = np.minimum(np.searchsorted(pairs, keys[place]), len(pairs) - 1)
        same = pairs[found] == keys[place]
        place, found = place[same], found[same]
        rank = np.full(len(keys), _NO_RANK)
        rank[place] = rank_of[found]
        before = np.concatenate([[_NO_RANK], rank[:-1]])
        after = np.concatenate([rank[1:], [_NO_RANK]])
        # A pair is taken where it beats both neighbours, and every second one of a run of equal pairs: none overlap.
        position = np.arange(len(rank))
        place = position - np.maximum.accumulate(np.where(rank != before, position, 0))
        chosen = np.flatnonzero((rank != _NO_RANK) & (place % 2 == 0) & ((place > 0) | (rank < before)) & (rank <= after))
        used, symbol = np.unique(order[rank[chosen]], return_inverse=True)
        left, right = pairs[used] >> 32, pairs[used] & 0xFFFFFFFF
        known = np.concatenate([np.zeros(0, np.int64), *lengths])
        size = [np.where(s < base, 1, known[np.maximum(s - base, 0)] if len(known) else 1) for s in (left, right)]
        rules.append(np.stack([left, right], axis=1))
        lengths.append(size[0] + size[1])
        x[chosen] = top + symbol
        top += len(used)
        keep = np.ones(len(x), bool)
        keep[chosen + 1] = False
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        x = x[keep]
        if len(chosen) < len(x) * LEAST_GAIN:
            break
    return base, np.concatenate([np.zeros((0, 2), np.int64), *rules]), np.concatenate([np.zeros(0, np.int64), *lengths]), x, offsets


def expand(base: int, rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """The ids a piece of the sequence stands for. Rule expansions are laid out once, in rule order."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.zeros(int(starts[-1]), np.int64)
    for r, (left, right) in enumerate(rules.tolist()):
        at = starts[r]
        for s in (left, right):
            if s < base:
                flat[at] = s
                at += 1
            else:
                n = lengths[s - base]
                flat[at:at + n] = flat[starts[s - base]:starts[s - base] + n]
                at += n
    plain = sequence < base
    rule = np.maximum(sequence - base, 0)
    size = np.where(plain, 1, lengths[rule] if len(lengths) else 1)
    table = np.concatenate([flat, sequence[plain]])
    origin = np.where(plain, len(flat) + np.cumsum(plain) - 1, starts[rule])
    return table[ranges(origin, size)]


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, min_count: int = MIN_COUNT) -> None:
    shared = bpe.share(docs.sparkSession, tokenizer_path)

    def row(part: int, shard: int, doc_ids: list, parts: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        base, rules, lengths, sequence, at = compress(ids, offsets, min_count)
        known = np.array([d is not None for d in doc_ids])
        numbers = np.array([d or 0 for d in doc_ids], "<i8")
        values = [part, shard, len(ids), numbers.tobytes(), known.tobytes(), at.astype("<i8").tobytes(), base, planes(rules.ravel()), planes(lengths), planes(sequence)]
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 3]
        names = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, shard = bpe.encoder(shared).encode, TaskContext.get().partitionId(), 0
        doc_ids, parts, sizes, held = [], [], [], 0
        for batch in batches:
            for first, end, data, at in text_slices(batch, "text", _SLICE):
                ids, offsets = tokens(data, at)
                doc_ids += batch.column(0).slice(first, end - first).to_pylist()
                parts.append(np.insert(ids, offsets[1:], end_id))
                sizes.append(np.diff(offsets) + 1)
                held += len(parts[-1])
                if held >= shard_ids:
                    yield row(part, shard, doc_ids, parts, sizes)
                    doc_ids, parts, sizes, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield row(part, shard, doc_ids, parts, sizes)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def decode_shard(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the shard, offsets of its documents in them)."""
    lengths = unplanes(row["rule_lengths"])
    sequence, at = unplanes(row["sequence"]), np.frombuffer(row["offsets"], "<i8")
    ids = expand(row["base"], unplanes(row["rules"]).reshape(-1, 2), lengths, sequence)
    size = np.where(sequence < row["base"], 1, lengths[np.maximum(sequence - row["base"], 0)] if len(lengths) else 1)
    return ids, np.concatenate([[0], np.cumsum(size)])[at]


def decode_document(row: dict, number: int) -> np.ndarray:
    """Ids of one document of a shard; only its part of the sequence is expanded."""
    at = np.frombuffer(row["offsets"], "<i8")
    own = unplanes(row["sequence"])[at[number]:at[number + 1]]
    return expand(row["base"], unplanes(row["rules"]).reshape(-1, 2), unplanes(row["rule_lengths"]), own)


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, offsets = decode_shard(row)
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                valid = np.frombuffer(row["doc_valid"], bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=~valid), pa.array(offsets[:-1], pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([row["part"]] * len(crc), pa.int32()), pa.array([row["shard"]] * len(crc), pa.int32()),
                ], ["doc_id", "inside", "n_tokens", "ids_crc32", "part", "shard"])

    sizes = shards.select("part", "shard", "n_ids")
    # Running starts: over the parts (as many as range partitions), then over the shards of a part.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "part_base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.withColumn("shard_base", F.coalesce(inside, F.lit(0))).join(parts, "part")
    docs = shards.mapInArrow(decode, "doc_id long, inside long, n_tokens long, ids_crc32 long, part int, shard int")
    return docs.join(bases, ["part", "shard"]).select(
        "doc_id", (F.col("part_base") + F.col("shard_base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def repair_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents and read them back."""
    path = scratch_path(docs.sparkSession, "repair-shards")
    write_shards(docs, tokenizer_path, path)
    return read_shards(docs.sparkSession, path)
