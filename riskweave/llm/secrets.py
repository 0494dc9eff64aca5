"""Secret scan: an Aho-Corasick pass over keywords, anchored expressions only at the hits, checksums inside the tokens.

Kinds in order: assign, access, hex, then the kinds the checksum adds: github and npm tokens, whose last six characters are the
base-62 CRC-32 of the thirty before. Spans are in code points, end exclusive. Matches of a kind are leftmost and don't overlap;
a match that fails its length is dropped but still covers its text, as in a plain left-to-right search. Long hexadecimal runs
have no keyword; they are found by one expression over the text.

Null text is empty. Whole texts are read, a document at a time in its own task. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
#: Keyword in lower case and the kind it announces.
KEYWORDS = (
    *((w, "assign") for w in ("password", "passwd", "secret", "token", "apikey", "api_key")), ("akia", "access"),
    *((f"gh{c}_", "github") for c in "pousr"), ("npm_", "npm"),
)
ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        for word, kind in KEYWORDS:
            made.add_word(word, (len(word), kind))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def ascii_lower(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def checksum(payload: str) -> str:
    """CRC-32 in base 62, six digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    return checksum(match[0][4:34]) == match[0][34:]


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans by start, then kind as listed."""
    hits = sorted((end - size + 1, kind) for end, (size, kind) in _automaton().iter(ascii_lower(text)))
    past, found = dict.fromkeys(KINDS, 0), []
    for start, kind in hits:
        if start < past[kind]:
            continue
        match = ANCHORED[kind].match(text, start)
        if match:
            past[kind] = match.end()
            if _valid(kind, match):
                found.append((start, match.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its spans as an array of (kind, start, end)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[(k, s, e) for s, e, k in find_secrets(t if isinstance(t, str) else "")] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": spans})

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scan, schema)


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of base spans and the list of all spans."""

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
