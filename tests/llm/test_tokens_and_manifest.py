"""Alignment, byte BPE and Merkle manifest against plain versions: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import bisect
import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import align, bytebpe, merkle
from riskweave.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, rank long, chunk long, "
    "link long, ids array<int>, decoded string, path string"
)
TEXTS = [
    None, "", " ", "a", "same text here", "same text here", "two  spaces\nand\n\nlines\t", "İstanbul ﬁn Straße 漢字 🙂", "<|endoftext|> and <s>a</s><0x41>",
    "▁ literal mark", "x" * 3000, "word " * 700, "it's we'll 123,456.78", "nul \x00 byte", "͸ unassigned", "tab nbsp 　wide", "é combined", "﻿bom",
]


def frame(spark, texts, sources=3):
    rows = []
    for i, text in enumerate(texts):
        source = None if i % 7 == 3 else f"s{i % sources}"
        rows.append((None if i == 4 else i, text, "en" if i % 3 else None, source, len(text) if text else None, "t", "d", 1, 2, 3, [1], "z", "p"))
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij é") for _ in range(rng.randint(1, 8))) for _ in range(n)) + "\n"


@pytest.fixture(scope="module")
def byte_bpe():
    with open(BYTE_TOKENIZER, encoding="utf-8") as file:
        return bytebpe.ByteBpe(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*TEXTS, *(prose(i) for i in range(12))]
    all_rows = frame(spark, texts)
    return all_rows.union(all_rows.where("doc_id in (5, 20)")).cache()


def test_every_token_encodes_to_itself(byte_bpe):
    assert [i for i in range(len(byte_bpe.token_bytes)) if i not in byte_bpe.special.values() and byte_bpe.encode_piece(byte_bpe.token_bytes[i]) != [i]] == []


def test_backtracking_equals_the_library(byte_bpe, library):
    rng = random.Random(7)
    alphabets = ["ab", "abc dehist'", "éß漢字ñ 🙂\n\t ", "aeiourstln", " \n\r\t\x0b　\x1c\x85͸", "0123456789 .,!?<|endoftext|>", "!?.,;:-_*#=+"]
    for _ in range(4000):
        alphabet = rng.choice(alphabets)
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        text += "<|endoftext|>" + text[:4] if rng.random() < 0.1 else ""
        want = library.encode(text, add_special_tokens=False).ids
        got = byte_bpe.encode(text)
        assert got.tolist() == want, text
        assert byte_bpe.spell(got.astype(np.int64)).tobytes().decode() == library.decode(want, skip_special_tokens=False) == text
    for text in ("x" * 20000, "aaab" * 4000, " " * 9000 + "a", "ab" * 7000 + "é"):
        assert byte_bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def encoded(byte_bpe, texts, special=True):
    raw = [t.encode() for t in texts]
    ids, ends = byte_bpe.encode_batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), special)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_pieces_equal_the_library_for_all_of_unicode(byte_bpe, library):
    known = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    assert len(known) > 200_000
    for first in range(0, len(known), 5000):
        texts = ["".join(f"a{c}1{c}!{c} {c}\n" for c in known[k:k + 100]) for k in range(first, min(first + 5000, len(known)), 100)]
        points = np.array([ord(c) for t in texts for c in t], np.uint32)
        starts = bytebpe.piece_starts(points, byte_bpe.kinds[points], np.cumsum([0, *map(len, texts)]))
        place = np.concatenate([np.arange(len(t)) for t in texts])
        want = [a for t in texts for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(t)]
        assert place[np.flatnonzero(starts)].tolist() == want


def test_batches_equal_the_library(byte_bpe, library):
    rng = random.Random(9)
    alphabets = ["ab", "abc dehist'", "éß漢字ñ 🙂\n\t ", " \n\r\t\x0b　\x1c\x85a'", "'''strevldm a", "a b'\n", "0123456789 .,!?"]
    for k in range(60):
        texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 50))) for a in rng.choices(alphabets, k=50)] + ["'", "it's", "x'", " 're", "'ll"]
        if k % 20 == 1:
            texts[3] += "<|endoftext|>'s"
        if k % 20 == 2:
            texts[3] += "͸ a"  # no character yet: the library cuts this one
        assert encoded(byte_bpe, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    plain = [i for p in ("a", "<|", "endoftext", "|>", "b") for i in library.encode(p, add_special_tokens=False).ids]
    assert encoded(byte_bpe, ["a<|endoftext|>b"], special=False) == [plain]
    assert encoded(byte_bpe, []) == [] and encoded(byte_bpe, ["", ""]) == [[], []]


def test_equal_hashes_and_full_tables_do_no_harm(monkeypatch, library):
    monkeypatch.setattr(bytebpe, "span_hashes", lambda data, starts, ends: (data[starts] % 3).astype(np.uint64))
    monkeypatch.setattr(bytebpe, "PAIRS", 50)
    with open(BYTE_TOKENIZER, encoding="utf-8") as file:
        small = bytebpe.ByteBpe(file.read())
    texts = [prose(i) for i in range(20)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(small, texts) == want and len(small.pairs) <= 50 and len(small.table.keys) <= 3
    monkeypatch.undo()
    monkeypatch.setattr(bytebpe, "PIECES", 40)
    small.table = bytebpe.PieceTable()
    assert [encoded(small, [t])[0] for t in texts] == want and len(small.table.keys) <= 40


def test_round_trip_over_rows(spark, docs, library, monkeypatch):
    rows = docs.select("doc_id", "text").collect()

    def digests(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    got = bytebpe.round_trip_digest(docs, BYTE_TOKENIZER).collect()
    assert Counter(tuple(r) for r in got) == Counter((r["doc_id"], *digests(r["text"])) for r in rows)
    assert bytebpe.round_trip_digest(docs.limit(0), BYTE_TOKENIZER).count() == 0
    broken = spark.createDataFrame([(1, [161, 95]), (2, None), (3, [])], "doc_id long, ids array<int>")  # half a character
    assert {r["doc_id"]: r["decoded"] for r in bytebpe.decode_ids(broken, BYTE_TOKENIZER).collect()} == {1: library.decode([161, 95]), 2: "", 3: ""}


def plain_alignment(rows, library_json, piece_path, byte_bpe):
    a_side, b_side = Tokenizer.from_file(library_json), sentencepiece.SentencePieceProcessor(model_file=piece_path)
    a_side.encode_special_tokens = True
    counts, per_row = Counter(), []

    def spans(spelled):
        at, out = 0, []
        for piece in spelled:
            out.append((at, at + len(piece)))
            at += len(piece)
        return out

    for row in rows:
        text = row["text"] or ""
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        spelled_a = [byte_bpe.token_bytes[i] for i in a]
        spelled_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            per_row.append((row["doc_id"], 0, 0, 0, [], ""))
            continue
        at_a, at_b = spans(spelled_a), spans(spelled_b)
        found = [(x, y) for x, (s, e) in zip(a, at_a, strict=True) for y, (t, u) in zip(b, at_b, strict=True) if s < u and t < e]
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups = [([], []) for _ in ends]
        for side, (ids, at) in enumerate(((a, at_a), (b, at_b))):
            for i, (_, e) in zip(ids, at, strict=True):
                groups[bisect.bisect_left(ends, e)][side].append(str(i))
        counts.update(found)
        per_row.append((row["doc_id"], len(a), len(b), len(ends), found, ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return Counter(
        (doc_id, n_a, n_b, n_groups, len(found), sum(counts[p] == highest[p[1]] for p in found), sum(counts[p] for p in found),
         hashlib.sha256(text.encode()).hexdigest() if text else "")
        for doc_id, n_a, n_b, n_groups, found, text in per_row)


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_alignment_equals_all_pairs(spark, docs, byte_bpe, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    rows = docs.select("doc_id", "text").collect()
    want = plain_alignment(rows, BYTE_TOKENIZER, PIECE_TOKENIZER, byte_bpe)
    got = align.alignment_digest(docs.repartition(3), BYTE_TOKENIZER, PIECE_TOKENIZER).collect()
    assert Counter(tuple(r) for r in got) == want
    assert sum(n for row, n in want.items() if row[1] == 0) >= 3  # null, empty and a text the piece model respells


def test_alignment_keeps_ids_and_group_sizes(spark, docs):
    for r in align.align_documents(docs, BYTE_TOKENIZER, PIECE_TOKENIZER).collect():
        assert sum(r["group_a"]) == len(r["a_ids"]) and sum(r["group_b"]) == len(r["b_ids"])
        assert [len(g.split("|")[0].split(",")) for g in r["alignment"].split(";") if g] == r["group_a"]


def test_alignment_of_nothing(spark, docs):
    assert align.alignment_digest(docs.limit(0), BYTE_TOKENIZER, PIECE_TOKENIZER).count() == 0
    only = align.alignment_digest(docs.where("text is null or text = ''"), BYTE_TOKENIZER, PIECE_TOKENIZER).collect()
    assert {tuple(r)[1:] for r in only} == {(0, 0, 0, 0, 0, 0, "")}


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(r, text):
        return digest(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def tree(nodes):
        paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(k, min(k + 3, len(nodes))) for k in range(0, len(nodes), 3)]
            for run in runs:
                for k in run:
                    for i in under[k]:
                        paths[i].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
            nodes, under = [digest(*(nodes[k] for k in run)) for run in runs], [[i for k in run for i in under[k]] for run in runs]
        return nodes[0], paths

    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = (own, *tree([leaf(r, r["text"]) for r in own]))
    root, upper = tree([trees[s][1] for s in sources])
    out = Counter()
    for s, above in zip(sources, upper, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            text, path = r["text"], path + above
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in path:
                folded = digest(left, folded, right)
            out[r["doc_id"], leaf(r, r["text"]), subroot, root, digest(*(a + b for a, b in path)), folded, folded == root] += 1
    return out


def check_manifest(docs):
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = merkle.verified_manifest(docs).collect()
    assert Counter(tuple(r) for r in got) == plain_manifest(rows)
    return got


def test_manifest_equals_a_plain_tree(spark, docs):
    got = check_manifest(docs)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 27, 28, 90])
def test_manifest_of_one_source_at_every_border(spark, monkeypatch, size):
    monkeypatch.setattr(merkle, "DIGITS", 2)  # blocks of nine: several rounds
    monkeypatch.setattr(merkle, "BLOCK", 9)
    check_manifest(frame(spark, [f"line {i}\n" for i in range(size)], sources=1).withColumn("source", F.lit("only")))


def test_manifest_with_a_large_source_and_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    many = frame(spark, [f"row {i % 50}\n" for i in range(160)], sources=1)
    source = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("é"), F.col("doc_id"))).when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise("hot")
    check_manifest(many.withColumn("source", source).repartition(5))


def test_manifest_of_nothing(spark, docs):
    assert merkle.verified_manifest(docs.limit(0)).count() == 0


def test_words_are_encoded_alone_as_in_their_text():
    pieces = align._pieces(type("Shared", (), {"value": open(PIECE_TOKENIZER, "rb").read()})())
    texts = [
        "the cat and the cat and the cat", "", " ", "   ", "a  b   c ", " lead", "tab\tand\n\nline  \n end", "é e\u0301 Ａ 漢字 \U0001F600 x",
        "a▁b ▁ c", "<s> </s> <unk> <0x41>", "x" * 200 + " y", "12 345 6,789.0", "the  cat\u00a0and\u3000the cat", "z\0 z",
    ]
    data = np.frombuffer("".join(f" {t}" if t else "" for t in texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 if t else 0 for t in texts])])
    asked = []
    plain = pieces.encode_pieces
    pieces.encode_pieces = lambda new: asked.extend(new) or plain(new)
    try:
        for _ in range(2):  # the second time all but the long word come from the table
            ids, ends = pieces.encode_batch(texts, data, offsets)
            want, want_ends = pieces.encode(texts)
            assert ids.tolist() == want.tolist() and ends.tolist() == want_ends.tolist()
    finally:
        del pieces.encode_pieces
    assert asked.count(b" cat") == 1 and asked.count(b" " + b"x" * 200) == 2
    pieces.space, space = None, pieces.space  # a model that is not known to part at spaces gets whole texts
    assert pieces.encode_batch(texts, data, offsets)[0].tolist() == want.tolist()
    pieces.space = space
