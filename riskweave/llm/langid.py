"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a gated recurrent unit whose gates use piecewise linear activations, so that a step is a table lookup, a small
product and clips over thousands of segments at once. Both states give the label probabilities of every byte position;
a document's probabilities are their mean over all positions of its whole text. The network is trained in numpy by
backpropagation through time on the driver, on a bounded sample of labelled rows: ``SAMPLE_DOCS`` documents of each language by hash
order (of different rows: repeated ones count once), ``SAMPLE_SEGMENTS`` segments of each. Labels name few languages. Rows with crc32(doc_id) mod 5 = 0 and null languages are never learned from.

Texts are read in segments of at most ``STEPS`` bytes; the state starts anew in each, so a long text is many rows of the batch.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all if nothing could be learned. Equal
probabilities take the first language in order. A null doc_id counts as held out. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import bpe
from riskweave.llm.common import text_slices
from riskweave.session import pin

HIDDEN, STEPS = 8, 64
SAMPLE_DOCS, SAMPLE_SEGMENTS, SAMPLE_BITS = 400, 6, (8, 18)
EPOCHS, BATCH, RATE = 5, 128, 0.02
UNKNOWN = "und"
_SLICE, _ROWS = 1 << 18, 2048


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("\\p{L}")), F.lit(False))


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


@dataclass
class Direction:
    """``table`` holds the input part of all gates by byte (update, reset, candidate), ``state`` the recurrent part."""

    table: np.ndarray
    state: np.ndarray


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.state, self.backward.table, self.backward.state, self.out, self.bias]


def _start(languages: list[str], seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)

    def direction() -> Direction:
        return Direction(rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32), rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32))

    return Network(languages, direction(), direction(), rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))


def _run(x: np.ndarray, d: Direction, order) -> tuple[np.ndarray, list]:
    """States at every step of segments ``x`` (steps, rows) and what the way back needs."""
    h, kept = np.zeros((x.shape[1], HIDDEN), np.float32), [None] * len(x)
    states = np.zeros((*x.shape, HIDDEN), np.float32)
    for t in order:
        a, u = d.table[x[t]], h @ d.state
        z, r = _gate(a[:, :HIDDEN] + u[:, :HIDDEN]), _gate(a[:, HIDDEN:2 * HIDDEN] + u[:, HIDDEN:2 * HIDDEN])
        c = np.clip(a[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:], -1, 1)
        kept[t] = (h, z, r, u[:, 2 * HIDDEN:], c)
        h = c + z * (h - c)
        states[t] = h
    return states, kept


def _back(x: np.ndarray, d: Direction, order, kept: list, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``table`` and ``state`` by backpropagation through time; ``upstream`` is the gradient of every state."""
    table, state = np.zeros_like(d.table), np.zeros_like(d.state)
    g = np.zeros(upstream.shape[1:], np.float32)
    for t in reversed(order):
        h, z, r, u, c = kept[t]
        g = g + upstream[t]
        dc = g * (1 - z) * (np.abs(c) < 1)
        dz = g * (h - c) * 0.25 * ((z > 0) & (z < 1))
        dr = dc * u * 0.25 * ((r > 0) & (r < 1))
        gates = np.concatenate([dz, dr, dc], axis=1)
        np.add.at(table, x[t], gates)
        inner = np.concatenate([dz, dr, dc * r], axis=1)
        state += h.T @ inner
        g = g * z + inner @ d.state.T
    return table, state


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    ahead = range(len(x))
    behind = range(len(x) - 1, -1, -1)
    hf, kept_f = _run(x, net.forward, ahead)
    hb, kept_b = _run(x, net.backward, behind)
    both = np.concatenate([hf, hb], axis=2)
    logits = both @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    n = x.size
    loss = -float(np.log(p[:, np.arange(len(y)), y] + 1e-9).mean())
    p[:, np.arange(len(y)), y] -= 1
    p /= n
    flat = both.reshape(-1, 2 * HIDDEN)
    up = p @ net.out.T
    forward = _back(x, net.forward, ahead, kept_f, up[:, :, :HIDDEN])
    backward = _back(x, net.backward, behind, kept_b, up[:, :, HIDDEN:])
    return loss, [*forward, *backward, flat.T @ p.reshape(n, -1), p.sum(axis=(0, 1))]


def train(segments: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam over shuffled batches; segments shorter than ``STEPS`` are repeated up to it."""
    languages = sorted(set(labels))
    net = _start(languages, seed)
    rng = np.random.default_rng(seed)
    x = np.stack([np.frombuffer((s * (STEPS // max(1, len(s)) + 1))[:STEPS], np.uint8) for s in segments]).T
    y = np.array([languages.index(v) for v in labels])
    weights = net.weights()
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    # Languages weigh the same in training: each batch draws them evenly.
    by_language = [np.flatnonzero(y == k) for k in range(len(languages))]
    for _ in range(epochs * max(1, len(y) // BATCH)):
        pick = np.concatenate([rng.choice(rows, max(1, BATCH // len(languages))) for rows in by_language])
        _, gradients = _gradients(net, x[:, pick], y[pick])
        step += 1
        for w, g, m, v in zip(weights, gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def _sweep(x: np.ndarray, d: Direction, order, live: np.ndarray) -> np.ndarray:
    """States only, in place where possible. Rows end after ``live`` steps; before that their state is empty."""
    rows, shortest = x.shape[1], int(live.min())
    h = np.zeros((rows, HIDDEN), np.float32)
    states = np.empty((*x.shape, HIDDEN), np.float32)
    a, u = np.empty((rows, 3 * HIDDEN), np.float32), np.empty((rows, 3 * HIDDEN), np.float32)
    gates, c, s = np.empty((rows, 2 * HIDDEN), np.float32), np.empty((rows, HIDDEN), np.float32), np.empty((rows, HIDDEN), np.float32)
    table, state = d.table.copy(), d.state.copy()
    table[:, :2 * HIDDEN] = 0.25 * table[:, :2 * HIDDEN] + 0.5
    state[:, :2 * HIDDEN] *= 0.25
    for t in order:
        np.take(table, x[t], axis=0, out=a, mode="clip")
        np.matmul(h, state, out=u)
        np.add(a[:, :2 * HIDDEN], u[:, :2 * HIDDEN], out=gates)
        np.clip(gates, 0, 1, out=gates)
        np.multiply(gates[:, HIDDEN:], u[:, 2 * HIDDEN:], out=c)
        c += a[:, 2 * HIDDEN:]
        np.clip(c, -1, 1, out=c)
        np.subtract(h, c, out=s)
        s *= gates[:, :HIDDEN]
        np.add(c, s, out=h)
        if t >= shortest:
            h[live <= t] = 0
        states[t] = h
    return states


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities over all byte positions of each document; zeros for empty ones."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // STEPS)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[owner] + number * sizes[owner] // np.maximum(pieces[owner], 1)
    live = offsets[owner] + (number + 1) * sizes[owner] // np.maximum(pieces[owner], 1) - start
    total = np.zeros((len(sizes), len(net.languages)))
    padded = np.concatenate([data, np.zeros(STEPS, np.uint8)])
    for i in range(0, len(owner), _ROWS):
        s, n = start[i:i + _ROWS], live[i:i + _ROWS]
        x = np.ascontiguousarray(padded[s[:, None] + np.arange(STEPS)].T)
        logits = _sweep(x, net.forward, range(STEPS), n) @ net.out[:HIDDEN]
        logits += _sweep(x, net.backward, range(STEPS - 1, -1, -1), n) @ net.out[HIDDEN:]
        logits += net.bias
        p = np.exp(logits, out=logits)
        p /= p.sum(axis=2, keepdims=True)
        p *= (np.arange(STEPS)[:, None] < n)[:, :, None]
        np.add.at(total, owner[i:i + _ROWS], p.sum(axis=0))
    return total / np.maximum(sizes, 1)[:, None]


def _lowest(rows: DataFrame, shift: int) -> DataFrame:
    """Rows of the lowest buckets of ``_n`` that hold ``SAMPLE_DOCS`` rows of their language together."""
    bucket = F.shiftright("_n", shift)
    counts = rows.groupBy("lang", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("lang").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    last = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < SAMPLE_DOCS).groupBy("lang").agg(F.max("_bucket").alias("_last"))
    return rows.join(F.broadcast(last), "lang").where(bucket <= F.col("_last")).drop("_last")  # one row a language


def training_segments(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """The bounded sample: segments at evenly spaced places of the first documents of each language by hash order."""
    text_hash = F.xxhash64("text")
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "lang", text_hash.alias("_h")).distinct()
    usable = pin(usable.withColumn("_n", F.xxhash64("doc_id", "_h").bitwiseAND(F.lit((1 << 63) - 1))), "sample-hashes")
    # Two passes over counted buckets of the hash leave little more than the sample, so no task gets a language whole.
    for bits in SAMPLE_BITS:
        usable = _lowest(usable, 63 - bits)
    order = Window.partitionBy("lang").orderBy("_n", "doc_id", "_h")
    chosen = usable.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= SAMPLE_DOCS)
    chosen = F.broadcast(chosen.select("doc_id", "lang", "_h").distinct())  # at most SAMPLE_DOCS rows a language
    texts = docs.withColumn("_h", text_hash).join(chosen, ["doc_id", "lang", "_h"]).select("doc_id", "lang", "_h", "text")
    texts = texts.groupBy("doc_id", "lang", "_h").agg(F.min("text").alias("text"))  # repeated rows are one

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True):
                raw = text.encode()
                for k in range(min(SAMPLE_SEGMENTS, len(raw) // STEPS) or 1):
                    at = k * max(0, len(raw) - STEPS) // SAMPLE_SEGMENTS
                    rows.append((doc_id, k, lang, raw[at:at + STEPS]))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "lang", "segment"])

    rows = texts.mapInPandas(cut, "doc_id long, k int, lang string, segment binary").collect()  # SAMPLE_DOCS x SAMPLE_SEGMENTS per language
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["k"], bytes(r["segment"])))
    return [bytes(r["segment"]) for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame) -> Network | None:
    segments, labels = training_segments(docs)
    return train(segments, labels) if segments else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (own columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score", "_letters").withColumn("_letters", has_letter(F.col("text")))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    names = [c for c in docs.columns if c != "_letters"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        net = shared.value
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text", _SLICE):
                part = batch.slice(first, end - first)
                letters = np.asarray(part.column(part.schema.get_field_index("_letters")))
                if net is None:
                    best, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
                    languages = [UNKNOWN]
                else:
                    p = document_probabilities(net, data, offsets)
                    best, languages = p.argmax(axis=1), [*net.languages, UNKNOWN]
                    score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                    best = np.where(letters, best, len(languages) - 1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(np.array(languages, object)[best], pa.string()), pa.array(score, pa.float64())],
                    [*names, "lang_pred", "score"])

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(label, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return predict(docs.select("doc_id", "text"), fit(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")
