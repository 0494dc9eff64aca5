"""Near-duplicate detection by BagMinHash signatures over weighted five-word shingles.

The weight of a shingle is its count in the document. Weights are cut into dyadic intervals [0,1), [1,2), [2,4), ...; each interval
of a shingle has a Poisson process in time whose rate is its width. A point falls, by further random bits, on one unit of its
interval, the leaf of a binary splitting, and counts where that unit lies below the weight; it goes to one of the signature's
places. A place keeps the earliest point it gets. The points below a weight w are a Poisson process of rate w and are shared by
all documents that have the shingle, so two places agree with probability sum(min) / sum(max): the weighted Jaccard similarity.
Points are drawn only up to the time by which all places of a document are filled, far fewer than shingles x places.

Bands of places are hashed. Documents with the same shingle multiset are one class from the start. In each band bucket members
are tested exactly against the bucket's smallest document, a few bands at a time, unless the two are linked already. A passage that many unlike documents share also fills buckets,
so documents of buckets with several components go on to buckets of a prefix filter: their shingles in order of frequency, rarest
first, up to the first that takes the weight before it beyond a fifth of the document's. Two documents of similarity 0.8 differ in at
most a fifth of either's weight, so their rarest common shingle is in both prefixes, and what follows it bounds their overlap. As long
as such a bucket holds several components, members outside its largest component are tested against those of the others that the bound
admits: a few central members first, more in each round. Pairs inside a component need no test, so nothing is lost. Bits flipped by
each shingle bound the difference of two documents from below, so most pairs a little under the threshold need no test of their texts.

Defined results: null is the empty text; documents without a word are one class per equal text; fewer than five words make one
shingle. One row per document row; the kept document of a class is its smallest doc_id (repeated rows of it are all kept). A document
without an id is kept; it is in the class of its text like any other, and a class without any id is named by a number from 2^62 on. Ids are expected to name one text; of several texts under one id, any one stands for it in tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import bpe
from riskweave.llm.common import prune_to_ids, text_slices
from riskweave.llm.words import mix, shingle_hashes, word_hashes
from riskweave.session import pin

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Bands whose buckets are tested together. The first joins most of a large group, whose pairs in later bands need no test then.
BAND_ROUNDS = ((0, 1), (1, 4), (4, BANDS))
#: Members of a bucket outside its largest component that are tested in the first round; each round takes 8 times as many.
FIRST_TESTED = 8
_SLICE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPARE = 3.0
#: Bits of a shingle's hash; the other bits of a word hold its document's number in a slice.
_HASH_BITS = 47
#: Words of 64 bits that a document's shingles flip.
FLIP_WORDS = 16
#: Rows of numbers, and of texts, that a stored partition holds at most on average.
NUMBER_ROWS, TEXT_ROWS = 1 << 16, 1 << 12
#: Nodes of texts without an id begin here; ids are expected to be smaller.
NO_ID = 1 << 62


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, places: int) -> np.ndarray:
    """(n_docs, places) identities of the earliest points. All documents must have a shingle."""
    total = np.bincount(doc, weights, n_docs)
    limit = places / np.maximum(total, 1) * (np.log(places) + _SPARE)
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64), 0) + 1
    element = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    seed = mix(hashes[element] + (level.astype(np.uint64) + np.uint64(1)) * _ODD)
    below = np.where(level > 0, weights[element] - (1 << np.maximum(level - 1, 0)), 1)  # units of the interval that count
    bits = np.maximum(level - 1, 0).astype(np.uint64)
    out = np.zeros((n_docs, places), np.uint64)
    todo = np.ones(n_docs, bool)
    while todo.any():
        chosen = todo[doc[element]]
        slot, time, point = _points(seed[chosen], bits[chosen], below[chosen], doc[element][chosen], limit, places)
        earliest = np.full(n_docs * places, np.inf)
        np.minimum.at(earliest, slot, time)
        won = time == earliest[slot]
        out.ravel()[slot[won]] = point[won]
        todo &= np.isinf(earliest.reshape(n_docs, places)).any(axis=1)
        limit = np.where(todo, 2 * limit, limit)
    return out


def _points(seed, bits, below, doc, limit, places):
    """All points up to their document's limit: (document and place, time, identity)."""
    time = np.zeros(len(seed))
    number, slots, times, points = 0, [], [], []
    rate = (np.uint64(1) << bits).astype(np.float64)
    while len(seed):
        width = max(1, min(64, 20_000 // len(seed)))
        steps = (np.arange(number, number + width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        u = mix(seed[:, None] + steps[None, :])
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        v = mix(u ^ _ODD)
        unit = ((v >> np.uint64(32)) & ((np.uint64(1) << bits) - np.uint64(1))[:, None]).astype(np.int64)
        good = (at <= limit[doc][:, None]) & (unit < below[:, None])
        row, column = np.nonzero(good)
        slots.append(doc[row] * places + ((v[row, column] & np.uint64(0xFFFFFFFF)) % np.uint64(places)).astype(np.int64))
        times.append(at[row, column])
        points.append(u[row, column])
        on = at[:, -1] <= limit[doc]
        seed, bits, below, doc, rate, time = seed[on], bits[on], below[on], doc[on], rate[on], at[on, -1]
        number += width
    return np.concatenate(slots), np.concatenate(times), np.concatenate(points)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) keys; the band's number is part of its key."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.repeat((np.arange(bands, dtype=np.uint64) + np.uint64(1))[None, :] * _ODD, len(signature), axis=0)
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def _bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), by document and shingle. Document and hash share a word, so that one plain sort will do."""
    words, word_offsets = word_hashes(data, offsets)
    hashes, at = shingle_hashes(words, word_offsets, WIDTH)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    packed = np.sort((doc << np.uint64(_HASH_BITS)) | (hashes >> np.uint64(64 - _HASH_BITS)))
    if not len(packed):
        return np.zeros(0, np.int64), packed, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    own = packed[first]
    return (own >> np.uint64(_HASH_BITS)).astype(np.int64), own & np.uint64((1 << _HASH_BITS) - 1), np.diff(np.append(first, len(packed)))


def nodes(docs: DataFrame) -> DataFrame:
    """node, doc_id and text of every row. A node is the doc_id; a text without one gets a number of its own beyond all ids."""
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, own).alias("node"), doc_id.alias("doc_id"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """node, doc_id, weight (number of shingles), two digests of the shingle multiset and the band keys of every document row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text", _SLICE):
                n = end - first
                doc, h, count = _bags(data, offsets)
                weight = np.bincount(doc, count, n).astype(np.int64)
                digests = []
                for salt in (1, 2):  # sums of mixed (shingle, count): equal multisets have equal sums
                    value = mix(h + mix(count.astype(np.uint64) + np.uint64(salt * int(_ODD) & (1 << 64) - 1)))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
                    cut = np.searchsorted(doc, np.arange(n + 1))
                    digests.append((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64))
                raw = np.asarray(batch.column(3).slice(first, n))
                digests[0] = np.where(weight > 0, digests[0], raw)
                full = np.flatnonzero(weight)
                place = np.cumsum(weight > 0) - 1
                keys = band_keys(signatures(place[doc], h, count, len(full), BANDS * ROWS)) if len(full) else np.zeros((0, BANDS), np.int64)
                sizes = np.where(weight > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(weight, pa.int64()),
                    pa.array(digests[0], pa.int64()), pa.array(digests[1], pa.int64()), bands,
                ], ["node", "doc_id", "weight", "d1", "d2", "bands"])

    raw = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    low = nodes(docs).withColumn("raw", raw)
    return low.mapInArrow(sketch, "node long, doc_id long, weight long, d1 long, d2 long, bands array<long>")


def similarities(pairs: DataFrame) -> DataFrame:
    """Exact weighted Jaccard similarity of pairs (a, b, text_a, text_b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # The slices of the two texts end at the nearer of their borders.
                _, end_a, data_a, off_a = next(text_slices(batch.slice(at), "text_a", _SLICE))
                _, end_b, data_b, off_b = next(text_slices(batch.slice(at), "text_b", _SLICE))
                n = min(end_a, end_b)
                keys, counts, totals, owners = [], [], [], []
                for data, off in ((data_a, off_a[:n + 1]), (data_b, off_b[:n + 1])):
                    doc, h, count = _bags(data[:off[-1]], off)
                    keys.append(mix(h + (doc.astype(np.uint64) + np.uint64(1)) * _ODD))
                    counts.append(count)
                    totals.append(np.bincount(doc, count, n))
                    owners.append(doc)
                _, ia, ib = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
                common = np.bincount(owners[0][ia], np.minimum(counts[0][ia], counts[1][ib]), n)
                value = common / np.maximum(totals[0] + totals[1] - common, 1)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value, pa.float64())], ["a", "b", "similarity"])
                at += n

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, similarity double")


def _few(df: DataFrame, rows: int, each: int = NUMBER_ROWS) -> DataFrame:
    """``df``, of about so many rows, in no more partitions than hold ``each`` of them, but one for each core at least.

    Every stored step waits for its tasks, most of them far shorter than it takes to start them and write their files.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored pairs (a, b) with similarity 0.8 or more. Only texts of documents that are in a pair are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    texts = prune_to_ids(nodes(docs).select("node", "text"), ids, "node")
    texts = texts.dropDuplicates(["node"])
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    compared = similarities(pairs.join(left, "a").join(right, "b"))
    return pin(_few(compared.where(F.col("similarity") >= SIMILARITY), pairs.count(), TEXT_ROWS), "links")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over links (a, b). Labels spread and jump, stored after each round."""
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
    rows = 2 * links.count()
    labels = pin(_few(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), rows), "labels")
    while True:
        near = ends.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("comp", "near").alias("new"), "comp")
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        step = pin(_few(spread.join(jump, "new").select("node", F.least("new", "far").alias("new"), "comp"), rows), "labels")
        changed = step.where("new < comp").limit(1).count()
        labels = step.select("node", F.col("new").alias("comp"))
        if not changed:
            return labels


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """Components after more links (a, b): only distinct pairs of older components are linked, not their nodes."""
    of = {c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")) for c in ("a", "b")}
    pairs = found.join(of["a"], "a", "left").join(of["b"], "b", "left")
    pairs = pairs.select(F.coalesce("comp_a", "a").alias("x"), F.coalesce("comp_b", "b").alias("y")).where("x != y")
    rows = found.count()
    top = components(pin(_few(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), rows), "links"))
    both = comps.withColumnRenamed("comp", "low").join(top.withColumnRenamed("node", "low"), "low", "full")
    both = both.select(F.coalesce("node", "low").alias("node"), F.coalesce("comp", "low").alias("comp"))
    return pin(_few(both, comps.count() + 2 * rows), "labels")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components; a node without links is a component of its own."""
    for c in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")), c, "left")
    return pairs.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, kept."""
    rows = pin(sketches(docs), "sketches")
    bag = ["d1", "d2", "weight"]
    n_rows = rows.count()
    same = rows.groupBy(*bag).agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    same = pin(_few(same, BANDS * n_rows), "bags")
    banded = same.where(F.size("bands") > 0).select("rep", "weight", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("key").agg(F.min(F.struct("rep", "weight")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = pin(_few(banded.join(hubs.select("key", "hub"), "key"), BANDS * n_rows), "members")
    comparable = F.least("weight", "weight_a") >= SIMILARITY * F.greatest("weight", "weight_a")
    pairs = members.select("band", F.col("hub.rep").alias("a"), F.col("hub.weight").alias("weight_a"), F.col("rep").alias("b"), "weight")
    pairs = pairs.where((F.col("a") != F.col("b")) & comparable)
    comps, tested = None, None
    for first, end in BAND_ROUNDS:
        fresh = pairs.where(F.col("band").between(first, end - 1)).select("a", "b").distinct()
        fresh = fresh if comps is None else _apart(fresh, comps).join(tested, ["a", "b"], "left_anti")
        fresh = pin(_few(fresh, (end - first) * n_rows), "tested")
        found = verify(fresh, docs)
        tested = fresh if tested is None else tested.union(fresh)
        if comps is None:
            comps = components(found)
        elif found.limit(1).count():
            comps = _merged(comps, found)
    finer, flips = _prefix_members(members.select("key", "rep", "weight"), comps, docs)
    done, open_, most = None, True, FIRST_TESTED  # done: (key, rep) tested against their whole bucket
    while open_:
        more, done, open_ = _open_pairs(finer, flips, comps, done, most)
        most *= 8
        if more is None:
            break
        fresh = pin(more.join(tested, ["a", "b"], "left_anti"), "tested")
        found = verify(fresh, docs)
        tested = tested.union(fresh)
        if found.limit(1).count():
            comps = _merged(comps, found)
    classes = same.select(*bag, "rep", "copies").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.withColumn("class_id", F.coalesce("comp", "rep"))
    sizes = classes.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    classes = pin(_few(classes.join(sizes, "class_id").select(*bag, "class_id", "class_size"), n_rows), "classes")
    out = rows.select("doc_id", *bag).join(classes, bag)
    return out.select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def shingles(docs: DataFrame) -> DataFrame:
    """rep, weight (number of shingles), key (shingle) and n (its count) of documents (rep, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text", _SLICE):
                doc, h, count = _bags(data, offsets)
                weight = np.bincount(doc, count, end - first).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first).take(pa.array(doc)), pa.array(weight[doc]), pa.array(h.view(np.int64)), pa.array(count.astype(np.int64)),
                ], ["rep", "weight", "key", "n"])

    return docs.select("rep", "text").mapInArrow(split, "rep long, weight long, key long, n long")


def flip_words(doc: np.ndarray, hashes: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, FLIP_WORDS) words in which each shingle of a document flips a bit, a repeated one another bit each time.

    What two documents have in common flips the same bits of both, so at least as many shingles differ as bits do.
    """
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    place = mix(np.repeat(hashes, count) + mix(nth.astype(np.uint64) + _ODD)) % np.uint64(64 * FLIP_WORDS)
    slot, times = np.unique(np.repeat(doc, count) * (64 * FLIP_WORDS) + place.astype(np.int64), return_counts=True)
    odd = slot[times % 2 == 1]
    out = np.zeros(n_docs * FLIP_WORDS, np.uint64)
    np.bitwise_or.at(out, odd // 64, np.uint64(1) << (odd % 64).astype(np.uint64))
    return out.reshape(n_docs, FLIP_WORDS).view(np.int64)


def flipped(docs: DataFrame) -> DataFrame:
    """rep and flips (its flip words) of documents (rep, text)."""

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, "text", _SLICE):
                n = end - first
                bits = flip_words(*_bags(data, offsets), n)
                places = pa.array(np.arange(n + 1) * FLIP_WORDS, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.ListArray.from_arrays(places, pa.array(bits.ravel()))], ["rep", "flips"])

    return docs.select("rep", "text").mapInArrow(flip, "rep long, flips array<long>")


def _prefix_members(members: DataFrame, comps: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, rep, weight, weight before the key) of the prefix filter's buckets, and the flip words of their documents.

    Those are the documents of band buckets that hold several components.
    """
    placed = _placed(members, comps)
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    held = placed.join(several.select("key"), "key").select(F.col("rep").alias("node")).distinct()
    held = pin(_few(held, members.count()), "held")
    texts = prune_to_ids(nodes(docs).select("node", "text"), held, "node")
    texts = texts.join(held, "node", "left_semi").dropDuplicates(["node"])
    texts = pin(_few(texts.select(F.col("node").alias("rep"), "text"), held.count(), TEXT_ROWS), "held-texts")
    bags = pin(shingles(texts), "shingles")
    ranked = bags.join(bags.groupBy("key").agg(F.count(F.lit(1)).alias("docs")), "key")
    before = F.sum("n").over(Window.partitionBy("rep").orderBy("docs", "key")) - F.col("n")
    ranked = ranked.withColumn("before", before).where((F.col("before") <= (1 - SIMILARITY) * F.col("weight") + 1e-6) & (F.col("docs") > 1))
    return pin(_few(ranked.select("key", "rep", "weight", "before"), bags.count()), "prefixes"), pin(flipped(texts), "flips")


def _open_pairs(members: DataFrame, flips: DataFrame, comps: DataFrame, done: DataFrame | None, at_once: int) -> tuple[DataFrame | None, DataFrame | None, bool]:
    """Pairs still to test: in buckets of several components, members outside the largest against all other components.

    Returns (pairs or None, members tested so far, whether some bucket has more such members than fit in this round). Components
    only merge, so once every member outside is tested, no pair across components is left.
    """
    placed = _placed(members, comps)
    by_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    held = placed.join(mixed.select("key", F.col("top.comp").alias("main")), "key")
    held = pin(_few(held.join(flips, "rep"), members.count()), "open")
    outside = held.where("comp != main")
    if done is not None:
        outside = outside.join(done, ["key", "rep"], "left_anti")
    few = outside.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("before", "rep"))).where(F.col("_n") <= at_once + 1)
    few = pin(_few(few.select("key", F.col("rep").alias("x"), F.col("comp").alias("comp_x"), F.col("weight").alias("weight_x"), F.col("before").alias("before_x"), F.col("flips").alias("flips_x"), "_n"), held.count()), "outside")
    most = few.agg(F.max("_n")).first()[0]
    if most is None:
        return None, done, False
    few = few.where(F.col("_n") <= at_once).drop("_n")
    if most > at_once:
        now = few.select("key", F.col("x").alias("rep"))
        done = now if done is None else done.union(now)
    # Without a common shingle before the key, the overlap is at most what is left; a similar pair passes at its rarest one.
    left = F.least(F.col("weight") - F.col("before"), F.col("weight_x") - F.col("before_x"))
    near = left >= SIMILARITY / (1 + SIMILARITY) * (F.col("weight") + F.col("weight_x")) - 1e-6
    # Similar documents differ in at most this share of their weights, and in no fewer shingles than flipped bits.
    differ = sum(F.bit_count(F.col("flips")[i].bitwiseXOR(F.col("flips_x")[i])) for i in range(FLIP_WORDS))
    near = near & (differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("weight") + F.col("weight_x")) + 1e-6)
    pairs = few.join(held, "key").where((F.col("comp") != F.col("comp_x")) & near)
    return pairs.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct(), done, most > at_once
