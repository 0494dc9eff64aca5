"""Alignment of two tokenizers over the same bytes, and how often their tokens overlap in the whole corpus.

Side A is a byte-level BPE file, side B a SentencePiece model that puts a space before the text; A is given that space too. Both
sides of a document cover the same bytes, so a link, a pair of tokens whose byte ranges overlap, starts where one of the two
starts inside the other: ``merge_asof`` finds the covering B token of each A start and the covering A token of each B start, over
a whole batch of documents that lie one after the other, and the union of both directions holds every link once. Positions where tokens of both sides end cut
a document into groups.

Counts of the corpus go through chunks, a slice of documents each: a chunk lists its different links once with their number, so a
link that all documents share is one row a chunk and no task gets all its places. Counts come back to the chunks the same way, and
a chunk's documents look them up there. The table of highest counts has one row per B id, at most the size of that vocabulary.

Texts that are null or empty, or whose A or B tokens don't spell the space and the text, have no tokens. Rows are independent: ties,
repeated rows and null ids give rows of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from riskweave.llm import bytebpe
from riskweave.llm.bytebpe import list_array
from riskweave.llm.common import ranges, text_slices
from riskweave.session import pin

#: Text bytes of a chunk; a longer document is a chunk of its own.
CHUNK = 1 << 20
#: A link is (A id << 32) + B id.
B_BITS = 32
_SPACE = "▁"
_BUILT: dict[int, PieceModel] = {}


def apart_at_spaces(model: bytes) -> bool:
    """Whether a model encodes each word with the spaces before it as if it were alone.

    So do merges that never join a space to what is before it, over texts that are taken as they are but for the first space.
    """
    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    norm, kinds = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    as_is = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    merges = spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
    return as_is and merges and not spec.denormalizer_spec.precompiled_charsmap and all(
        p.type not in (kinds.USER_DEFINED, kinds.UNUSED) and _SPACE not in p.piece.lstrip(_SPACE) for p in spec.pieces)


class PieceModel(bytebpe.KnownPieces):
    """A SentencePiece model with the bytes its pieces stand for; it is asked once for a word that is met again and again."""

    def __init__(self, model: bytes) -> None:
        self.model, self.table = sentencepiece.SentencePieceProcessor(model_proto=model), bytebpe.PieceTable()
        space = self.model.piece_to_id(_SPACE)
        self.space = space if space != self.model.unk_id() and apart_at_spaces(model) else None  # none: whole texts only
        spelled = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            spelled.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(_SPACE, " ").encode())
        sizes = np.array([len(b) for b in spelled], np.int64)
        self.flat, self.offsets = np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of the texts in them)."""
        found = self.model.encode(texts, num_threads=1)
        ends = np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(found), np.int64, int(ends[-1])), ends

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of words with the spaces before them; the model adds the first space, but to an empty text none."""
        found = self.model.encode([p[1:].decode() for p in pieces], num_threads=1)
        return [ids if len(p) > 1 else [self.space] for p, ids in zip(pieces, found, strict=True)]

    def encode_batch(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``; ``data`` between the offsets are the same texts with a space before each that is not empty."""
        if self.space is None or not len(data):
            return self.encode(texts)
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ids, ends = self.piece_ids(data.tobytes(), data, starts, np.diff(np.append(starts, len(data))))
        return ids, ends[np.searchsorted(starts, offsets)]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        starts = self.offsets[ids]
        return self.flat[ranges(starts, self.offsets[ids + 1] - starts)]


def _pieces(shared) -> PieceModel:
    key = hash(shared.value)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = PieceModel(shared.value)
    return _BUILT[key]


def token_frame(ids: np.ndarray, offsets: np.ndarray, spelled: np.ndarray) -> pd.DataFrame:
    """doc, id, start and end of all tokens; documents lie one after the other, so starts ascend over all of them."""
    ends = np.cumsum(spelled[ids + 1] - spelled[ids])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return pd.DataFrame({"doc": np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), "id": ids, "start": starts, "end": ends})


def spells(ids: np.ndarray, ends: np.ndarray, side, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the tokens of each document spell its bytes."""
    sizes = np.concatenate([[0], np.cumsum(side.offsets[ids + 1] - side.offsets[ids])])[ends]
    same = np.diff(sizes) == np.diff(offsets)
    if same.all():
        got, want, length = side.spell(ids), data, np.diff(offsets)
    else:
        length = np.diff(offsets)[same]
        got = side.spell(ids)[ranges(sizes[:-1][same], length)]
        want = data[ranges(offsets[:-1][same], length)]
    wrong = np.flatnonzero(got != want)
    if len(wrong):
        same[np.flatnonzero(same)[np.searchsorted(np.cumsum(length), wrong, side="right")]] = False
    return same


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty."""
    filled = np.diff(offsets) > 0
    grown = offsets + np.concatenate([[0], np.cumsum(filled)])
    return np.insert(data, offsets[:-1][filled], 32), grown


def only(ids: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the documents that are kept, the others left without."""
    counts = np.diff(ends) * kept
    return ids[ranges(ends[:-1], counts)], np.concatenate([[0], np.cumsum(counts)])


def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """doc, a, b: the ids of every pair of tokens whose ranges overlap.

    Both sides of a document begin at the same byte of the batch, so the last start on the other side is one of the same document.
    """
    a_side, b_side = a[["doc", "start", "id"]].rename(columns={"id": "a"}), b[["doc", "start", "id"]].rename(columns={"id": "b"})
    covering_b = pd.merge_asof(a_side, b_side[["start", "b"]], on="start")
    covering_a = pd.merge_asof(b_side, a_side[["start", "a"]].assign(at=a_side["start"]), on="start")
    later = covering_a[covering_a["at"] < covering_a["start"]]  # equal starts are in the other direction already
    return pd.concat([covering_b[["doc", "a", "b"]], later[["doc", "a", "b"]]])


def group_sizes(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, A tokens, B tokens) of each group: both sides end together at its end."""
    a_ends, b_ends = a["end"].to_numpy(), b["end"].to_numpy()  # ascending, and the last ones are the same byte
    marked = np.zeros((int(a_ends[-1]) if len(a_ends) else 0) + 1, bool)
    marked[b_ends] = True
    last_a = np.flatnonzero(marked[a_ends])
    ends = a_ends[last_a]
    marked[:] = False
    marked[ends] = True
    last_b = np.flatnonzero(marked[b_ends])
    return a["doc"].to_numpy()[last_a], np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("chunk", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
    ("group_a", pa.list_(pa.int32())), ("group_b", pa.list_(pa.int32())), ("links", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
    ("chunk_links", pa.list_(pa.int64())), ("chunk_times", pa.list_(pa.int64())), ("alignment", pa.string()),
])
_DDL = (
    "doc_id long, chunk long, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>, links array<long>, "
    "times array<int>, chunk_links array<long>, chunk_times array<long>, alignment string"
)


class _Spelling:
    """Decimal ids with the sign that follows them, ready to be joined."""

    def __init__(self, n: int) -> None:
        self.by_sign = {s: np.array([f"{i}{s}" for i in range(n)], object) for s in ",|;"}

    def texts(self, a: pd.DataFrame, b: pd.DataFrame, in_a: np.ndarray, in_b: np.ndarray, docs: np.ndarray, n: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document, from the groups of all."""
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        a, b = a["id"].to_numpy(), b["id"].to_numpy()
        out = np.empty(len(a) + len(b), object)
        at_a, at_b = np.arange(len(a)) + np.repeat(before_b, in_a), np.arange(len(b)) + np.repeat(before_a + in_a, in_b)
        out[at_a], out[at_b] = self.by_sign[","][a], self.by_sign[","][b]
        last_a, last_b = before_a + in_a - 1, before_b + in_b - 1
        out[at_a[last_a]], out[at_b[last_b]] = self.by_sign["|"][a[last_a]], self.by_sign[";"][b[last_b]]
        ends = np.concatenate([[0], np.cumsum(in_a + in_b)])[np.searchsorted(docs, np.arange(n + 1))].tolist()
        return ["".join(out[x:y])[:-1] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def align_chunk(texts: list[str], data: np.ndarray, offsets: np.ndarray, byte_bpe: bytebpe.ByteBpe, pieces: PieceModel, spelling: _Spelling) -> list[pa.Array]:
    """Columns of ``SCHEMA`` from ``a_ids`` on for the texts of one chunk, given as strings and as bytes between offsets."""
    n = len(texts)
    data, offsets = with_space(data, offsets)
    a_ids, a_ends = byte_bpe.encode_batch(data, offsets, special=False)
    b_ids, b_ends = pieces.encode_batch(texts, data, offsets)
    a_ids, b_ids = a_ids.astype(np.int64), b_ids.astype(np.int64)
    kept = spells(a_ids, a_ends, byte_bpe, data, offsets) & spells(b_ids, b_ends, pieces, data, offsets)
    (a_ids, a_ends), (b_ids, b_ends) = only(a_ids, a_ends, kept), only(b_ids, b_ends, kept)
    a, b = token_frame(a_ids, a_ends, byte_bpe.offsets), token_frame(b_ids, b_ends, pieces.offsets)
    docs, in_a, in_b = group_sizes(a, b)
    group_ends = np.searchsorted(docs, np.arange(n + 1))
    linked = links(a, b)
    keys = (linked["a"].to_numpy(np.int64) << B_BITS) + linked["b"].to_numpy(np.int64)
    here, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    width = max(len(here), 1)
    cells, cell_times = np.unique(linked["doc"].to_numpy(np.int64) * width + place, return_counts=True)
    cell_ends = np.searchsorted(cells // width, np.arange(n + 1))
    chunk_ends = np.array([0, *[len(here)] * n])  # all in the first row
    int32, int64 = pa.int32(), pa.int64()
    return [
        list_array(a_ids, a_ends, int32), list_array(b_ids, b_ends, int32), list_array(in_a, group_ends, int32), list_array(in_b, group_ends, int32),
        list_array(here[cells % width] if len(here) else here, cell_ends, int64), list_array(cell_times, cell_ends, int32),
        list_array(here, chunk_ends, int64), list_array(times, chunk_ends, int64),
        pa.array(spelling.texts(a, b, in_a, in_b, docs, n), pa.string()),
    ]


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per document: ids of both sides, tokens of each group, different links with their times, the alignment as text.

    The first row of a chunk lists the chunk's links as well. Chunks are named by partition and number, so store the result before
    reading it twice.
    """
    spark = docs.sparkSession
    shared_a = bytebpe.share(spark, byte_path)
    with open(piece_path, "rb") as file:
        shared_b = spark.sparkContext.broadcast(file.read())  # a model file of fixed size, 0.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_bpe, pieces = bytebpe.tables(shared_a), _pieces(shared_b)
        spelling = _Spelling(max(len(byte_bpe.offsets), len(pieces.offsets)))
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text", CHUNK):
                texts = [t or "" for t in batch.column(1).slice(first, end - first).to_pylist()]
                columns = align_chunk(texts, data, offsets, byte_bpe, pieces, spelling)
                named = [batch.column(0).slice(first, end - first), pa.array(np.full(len(texts), chunk), pa.int64())]
                yield pa.RecordBatch.from_arrays([*named, *columns], schema=SCHEMA)
                chunk += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DDL)


def link_counts(aligned: DataFrame) -> DataFrame:
    """link, count over the corpus, and best: whether no link of the same B id has a higher count."""
    b_id = F.col("link").bitwiseAND(F.lit((1 << B_BITS) - 1))
    counts = _chunk_rows(aligned).groupBy("link").agg(F.sum("n").alias("count"))
    stored = pin(counts.withColumn("b_id", b_id), "link-counts")
    highest = stored.groupBy("b_id").agg(F.max("count").alias("highest"))
    return stored.join(F.broadcast(highest), "b_id").select("link", "count", (F.col("count") == F.col("highest")).alias("best"))


def _chunk_rows(aligned: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.col("chunk_links").alias("link"), F.col("chunk_times").alias("n"))
    return aligned.select(F.col("chunk").alias("of_chunk"), F.explode(pairs).alias("p")).select("of_chunk", "p.link", "p.n")


def with_corpus_counts(aligned: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to stored rows of ``align_documents`` (chunk, links, times, chunk_links, chunk_times); drops these."""
    table = _chunk_rows(aligned).join(link_counts(aligned), "link").select("of_chunk", "link", "count", "best")
    kept = [c for c in aligned.columns if c not in ("chunk", "links", "times", "chunk_links", "chunk_times")]
    documents = aligned.select("chunk", "links", "times", *kept)

    def look_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows, found = rows.combine_chunks(), found.combine_chunks()
        order = np.argsort(np.asarray(found["link"]))
        known, count, best = (np.asarray(found[c])[order] for c in ("link", "count", "best"))
        lengths = np.asarray(rows["links"].combine_chunks().value_lengths() if rows.num_rows else [], np.int64)
        at = np.searchsorted(known, np.asarray(rows["links"].combine_chunks().flatten()))
        times = np.asarray(rows["times"].combine_chunks().flatten()).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])

        def sums(values: np.ndarray) -> pa.Array:
            running = np.concatenate([[0], np.cumsum(values)])
            return pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64())

        out = rows.select(kept)
        return out.append_column("n_best", sums(times * best[at])).append_column("count_sum", sums(times * count[at]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in kept)
    return documents.groupBy("chunk").cogroup(table.groupBy("of_chunk")).applyInArrow(look_up, schema + ", n_best long, count_sum long")


def alignment_digest(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Counts and the digest of the groups for every document, with the corpus-wide counts of its links."""
    aligned = align_documents(docs, byte_path, piece_path).select(
        "doc_id", "chunk", F.size("a_ids").cast("long").alias("n_a"), F.size("b_ids").cast("long").alias("n_b"),
        F.size("group_a").cast("long").alias("n_groups"), F.aggregate("times", F.lit(0).cast("long"), lambda x, t: x + t).alias("n_links"),
        F.when(F.col("alignment") == "", "").otherwise(F.sha2("alignment", 256)).alias("groups_sha256"),
        "links", "times", "chunk_links", "chunk_times")
    return with_corpus_counts(pin(aligned, "aligned")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
