"""Byte-level BPE ids of whole texts by backtracking over longest matches, and texts back from ids by an offset table.

Greedy longest matches are not what merging in rank order gives, but every prefix of a correct encoding is the correct encoding of
those bytes, and a sequence is correct when each pair of neighbours is: merging the bytes of both must not join across the border
between them. So the encoder walks through a piece taking the longest token that matches (one pass of an Aho-Corasick automaton
over the piece lists them) and is compatible with the token before it, falls back to the next shorter token with the same start,
and steps back where none is left. A position that failed once is closed for good, which keeps the walk linear.

Two tokens are compatible if undoing their merges, the later merge first, never meets a pair across the border that would have
been merged earlier. Answers are kept in a table of pairs. Texts are cut into pieces in numpy, many texts at once; a piece met before
is found in a table by its hash and checked byte by byte. Both tables are bounded and start anew when full.

Pieces are those of the tokenizer's own expression. Its library and ours may know different versions of Unicode, so a text with a
character that Python's tables don't know is cut by the library itself. Special tokens are matched first unless their strings are to
be read as plain text. A null text is empty and has no ids; rows are independent, so ties and repeated rows are too.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm.common import ranges, text_slices
from riskweave.llm.words import span_hashes

#: Most entries of a worker's tables of pairs and pieces; longer pieces than ``KEPT_BYTES`` are encoded each time.
PAIRS, PIECES, KEPT_BYTES = 1 << 20, 1 << 20, 64
#: Text bytes encoded, and ids decoded, at a time.
SLICE, DECODE_IDS = 1 << 20, 1 << 18
#: Fixed by the tokenizer's format: how its ByteLevel step cuts a text, and the code points that stand for bytes.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_BUILT: dict[tuple, TokenBytes] = {}
#: Kinds of characters, and the letters of contractions.
OTHER, LETTER, NUMBER, WHITE, UNKNOWN = range(5)
_SHORT, _LONG = [ord(c) for c in "stmd"], [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


def character_kinds() -> np.ndarray:
    """The kind of every code point."""
    everything = "".join(map(chr, range(sys.maxunicode + 1)))
    kinds = np.zeros(len(everything), np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for run in regex.finditer(pattern, everything):
            kinds[run.start():run.end()] = kind
    kinds[np.fromiter((unicodedata.category(c) == "Cn" for c in everything), bool)] = UNKNOWN
    return kinds


def piece_starts(points: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character; ``starts`` are the first characters of the texts.

    Runs of one kind are pieces. A run of white space gives its last character to the run after it: a space joins that run, any
    other stays a piece of its own. A sign ``'`` that begins a piece takes the letters of a contraction with it.
    """
    n = len(points)
    begins = np.ones(n + 1, bool)
    begins[1:n] = kinds[1:] != kinds[:-1]
    ends_text = np.zeros(n + 1, bool)
    ends_text[starts[starts <= n]] = True
    ends_text[n] = True
    begins |= ends_text
    last_white = np.flatnonzero((kinds == WHITE) & begins[1:] & ~ends_text[1:])
    begins[last_white] = True
    begins[last_white[points[last_white] == 32] + 1] = False
    quotes = np.flatnonzero((points == 39) & begins[:n])
    quotes = quotes[~ends_text[quotes + 1]]
    one = quotes[np.isin(points[quotes + 1], _SHORT)]
    two = quotes[quotes + 2 < n]
    two = two[~ends_text[two + 2]]
    two = two[np.logical_or.reduce([(points[two + 1] == a) & (points[two + 2] == b) for a, b in _LONG])]
    for at, width in ((one, 1), (two, 2)):
        begins[at + 1] = False
        begins[at + 1 + width] = True
    return begins[:n]


class PieceTable:
    """Ids of pieces by the hash of their bytes. The bytes are kept and compared, so equal hashes do no harm."""

    def __init__(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self._offsets()

    def _offsets(self) -> None:
        self.at, self.first = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.counts) - self.counts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[where] == keys, self.places[where], -1)

    def add(self, keys: np.ndarray, pieces: list[bytes], ids: list[list[int]]) -> None:
        """New keys in ascending order with their pieces."""
        at = np.searchsorted(self.keys, keys)
        self.places = np.insert(self.places, at, np.arange(len(self.sizes), len(self.sizes) + len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.sizes = np.concatenate([self.sizes, np.array([len(p) for p in pieces], np.int64)])
        self.counts = np.concatenate([self.counts, np.array([len(i) for i in ids], np.int64)])
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(pieces), np.uint8)])
        self.ids = np.concatenate([self.ids, np.array([i for own in ids for i in own], np.int32)])
        self._offsets()

    def holds(self, places: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the pieces at these places are those of the data."""
        same = self.sizes[places] == sizes
        checked = np.flatnonzero(same)
        sizes = sizes[checked]
        wrong = self.data[ranges(self.at[places[checked]], sizes)] != data[ranges(starts[checked], sizes)]
        if wrong.any():
            same[checked[np.searchsorted(np.cumsum(sizes), np.flatnonzero(wrong), side="right")]] = False
        return same


class KnownPieces:
    """Ids of pieces of texts: ``encode_pieces`` is asked for those that ``table`` does not hold."""

    table: PieceTable

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def piece_ids(self, raw: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, offsets of the pieces in them); ``raw`` and ``data`` are the same bytes."""
        places, extra = self._places(raw, data, starts, sizes)
        counts = np.concatenate([self.table.counts, [len(e) for e in extra]]).astype(np.int64)
        flat = np.concatenate([self.table.ids, *extra]) if extra else self.table.ids
        first = np.concatenate([self.table.first, len(self.table.ids) + np.cumsum(counts[len(self.table.counts):]) - counts[len(self.table.counts):]])
        lengths = counts[places]
        return flat[ranges(first[places], lengths)], np.concatenate([[0], np.cumsum(lengths)])

    def _places(self, raw: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Place of every piece in the table; pieces the table does not keep are placed after it, their ids in the list."""
        keys, first, again = np.unique(span_hashes(data, starts, starts + sizes), return_index=True, return_inverse=True)
        places = self.table.find(keys)
        new = np.flatnonzero((places < 0) & (sizes[first] <= KEPT_BYTES))
        if len(new) + len(self.table.keys) > PIECES:
            self.table = PieceTable()
            places[:] = -1
            new = np.flatnonzero(sizes[first] <= KEPT_BYTES)[:PIECES]
        if len(new):
            pieces = [raw[a:a + n] for a, n in zip(starts[first[new]].tolist(), sizes[first[new]].tolist(), strict=True)]
            places[new] = np.arange(len(self.table.sizes), len(self.table.sizes) + len(new))
            self.table.add(keys[new], pieces, self.encode_pieces(pieces))
        every = places[again]
        kept = np.flatnonzero(every >= 0)
        every[kept[~self.table.holds(every[kept], data, starts[kept], sizes[kept])]] = -1
        direct = np.flatnonzero(every < 0)
        every[direct] = len(self.table.sizes) + np.arange(len(direct))
        return every, [np.array(ids, np.int32) for ids in self.encode_pieces([raw[starts[i]:starts[i] + sizes[i]] for i in direct])]


class TokenBytes:
    """Bytes of all tokens of a tokenizer file (the text of its JSON) in a row, with an offset table."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        vocab, self.special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(_BYTE_OF[c] for c in token)
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        sizes = np.array([len(b) for b in self.token_bytes], np.int64)
        self.flat, self.offsets = np.frombuffer(b"".join(self.token_bytes), np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens one after the other."""
        starts = self.offsets[ids]
        return self.flat[ranges(starts, self.offsets[ids + 1] - starts)]


class ByteBpe(KnownPieces, TokenBytes):
    """Tables for encoding with one tokenizer file."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(tokenizer_json)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or spec["normalizer"]:
            raise ValueError("expects a byte-level BPE tokenizer without normalizer and prefix space")
        super().__init__(tokenizer_json)
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("expects special tokens that match literally")
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._merges(model["vocab"], model["merges"])
        self._matches(model["vocab"].values())
        self.pattern = regex.compile(PIECE)
        self.cutter = Tokenizer.from_str(tokenizer_json).pre_tokenizer
        self.pairs: dict[int, bool] = {}
        self.kinds, self.table = character_kinds(), PieceTable()

    def _merges(self, vocab: dict[str, int], merges: list) -> None:
        """Rank and parts of every token; single bytes have rank -1 and are their own parts."""
        n = len(self.token_bytes)
        self.rank, self.left, self.right, self.joined = [-1] * n, list(range(n)), list(range(n)), {}
        for rank, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[a + b]
            if self.rank[whole] >= 0 or len(self.token_bytes[whole]) < 2:
                raise ValueError("two merges give the same token")
            self.rank[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
            self.joined[vocab[a] * n + vocab[b]] = rank
            if max(self.rank[vocab[a]], self.rank[vocab[b]]) >= rank:
                raise ValueError("a merge comes before those of its parts")

    def _matches(self, ids) -> None:
        """Automaton of all tokens, and for each token the longest other one it starts with."""
        self.size = [len(b) for b in self.token_bytes]
        self.automaton, by_bytes = ahocorasick.Automaton(), {}
        for i in ids:
            if self.size[i] > 1 and self.rank[i] < 0:
                continue  # no merge leads to it
            by_bytes[self.token_bytes[i]] = i
            self.automaton.add_word(self.token_bytes[i].decode("latin-1"), i)
        if sum(len(b) == 1 for b in by_bytes) != 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.token_bytes)
        for token, i in by_bytes.items():
            self.shorter[i] = next((by_bytes[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in by_bytes), -1)

    def compatible(self, a: int, b: int) -> bool:
        """True if merging the bytes of both in rank order ends in these two tokens."""
        key = a * len(self.size) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        """Undo merges on both sides of the border, the latest first.

        A pair across the border is met while both its tokens exist, which ends with the earlier of the merges that use them up;
        it is joined if its own merge comes before that one. On equal ranks the left one is merged first.
        """
        rank, joined, width = self.rank, self.joined, len(self.rank)
        used_a = used_b = len(joined)  # rank of the merge that takes in the token at the border, later than all at first
        while True:
            own = joined.get(a * width + b)
            if own is not None and own < used_a and own <= used_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b] or rank[b] < 0:
                used_a, a = rank[a], self.right[a]
            else:
                used_b, b = rank[b], self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        size, shorter, pairs, width = self.size, self.shorter, self.pairs, len(self.size)
        n = len(piece)
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):  # ends ascend: the last match of a start is its longest
            longest[end + 1 - size[i]] = i
        tokens: list[int] = []
        closed: set[int] = set()
        before, at, token = -1, 0, longest[0] if n else -1
        while at < n:
            end = at + size[token]
            if end not in closed:
                fits = before < 0 or pairs.get(before * width + token)
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    tokens.append(token)
                    if end < n:
                        before, token = token, longest[end]
                    at = end
                    continue
            token = shorter[token]
            if token < 0:  # nothing fits here: the token before ends here no more
                closed.add(at)
                token = tokens.pop()
                at -= size[token]
                before = tokens[-1] if tokens else -1
        return tokens

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.encode_piece(p) for p in pieces]

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        """Ids of one text, piece by piece; with ``special`` false the strings of special tokens are plain text."""
        known = (self.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)] != UNKNOWN).all()
        parts, at = [], 0
        found = self.special_pattern.finditer(text) if special else []
        for start, end, own in [*((m.start(), m.end(), [self.special[m.group()]]) for m in found), (len(text), len(text), [])]:
            plain = text[at:start]
            pieces = self.pattern.findall(plain) if known else [plain[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(plain)]
            parts += [i for p in pieces for i in self.encode_piece(p.encode())] + own
            at = end
        return np.array(parts, np.int32)

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of the texts in them); the texts are the bytes between the offsets."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        if (special and any(s.encode() in raw for s in self.special)) or (kinds == UNKNOWN).any():
            texts = [self.encode(raw[a:b].decode(), special) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate([np.zeros(0, np.int32), *texts]), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of the characters
        starts = at[piece_starts(points, kinds, np.searchsorted(at, offsets))]
        sizes = np.diff(np.append(starts, len(data)))
        ids, ends = self.piece_ids(raw, data, starts, sizes)
        return ids, ends[np.searchsorted(starts, offsets)]


def share(spark: SparkSession, path: str):
    """Broadcast of the tokenizer's text (a file of fixed size, about 2 MB); executors need no path."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def tables(shared, kind: type[TokenBytes] = ByteBpe) -> ByteBpe | TokenBytes:
    """The worker's tables, kept between tasks; decoding needs no more than the bytes of the tokens."""
    key = (kind.__name__, hash(shared.value))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = kind(shared.value)
    return _BUILT[key]


def list_array(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: the values between the offsets, row by row."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(flat, kind))


def encode_texts(docs: DataFrame, tokenizer_path: str, special: bool = True) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; null texts are empty, an empty table gives an empty result."""
    shared = share(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(shared)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text", SLICE):
                ids, ends = bpe.encode_batch(data, offsets, special)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), list_array(ids, ends, pa.int32())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of each row's ids, special tokens too. Bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    shared = share(encoded.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tables(shared, TokenBytes)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            ends = np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))
            first = 0
            while first < len(batch):
                stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + DECODE_IDS, side="right")))
                part = column.slice(first, stop - first)
                texts = []
                for i in range(len(part)):
                    own = np.zeros(0, np.int64) if not part[i].is_valid else np.asarray(part[i].values).astype(np.int64)
                    texts.append(tokens.spell(own).tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, stop - first).columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])
                first = stop

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"
    return encoded.mapInArrow(run, schema)


def id_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def round_trip_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again."""
    both = decode_ids(encode_texts(docs, tokenizer_path), tokenizer_path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(id_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
