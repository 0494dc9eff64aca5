"""Merkle manifest of a dataset: a hash tree per source, a tree over the sources, and a proof for every row.

Rows get their rank within the source from a stored whole-table order, so a source of any size is spread over its segments. Nodes
are rolled up in blocks of ``FANOUT ** DIGITS`` neighbours: the digits of a rank are columns, and one grouping after the other drops
the lowest digit and nests the children as structs. All groupings of a block use the same partitioning, so a round costs one
shuffle, and no row ever holds more than a block. The tops of the blocks are the nodes of the next round, until every source has
one; the sources' roots are rolled up the same way. Going down again, each stored block takes the path of its top (one row a block)
and explodes into its children with their proofs; inside a block that needs no join.

A run of up to ``FANOUT`` neighbours becomes the hash of their digests, also if it has one node, while its level has several nodes.
A lone leaf is the root of its source. Sources are ordered bytewise, null first. Rows of one source and doc_id are ordered by
their leaf, a null doc_id first; equal rows have equal leaves, so their order changes no hash. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import pin, segment_count

FANOUT, DIGITS = 3, 6
BLOCK = FANOUT ** DIGITS
#: The columns a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_POSITION = (1 << 33) - 1


def field_text(value: Column) -> Column:
    """``-`` for null, else the bytes of the value, a colon, the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def tampered_text(text: Column, doc_id: Column) -> Column:
    """The text without line ends, for rows whose crc32 of the decimal doc_id is even."""
    even = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def dataset_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source as a key that is never null and sorts null first), leaf and the leaf of the tampered row."""
    fields = {f: docs[f] for f in FIELDS}
    changed = fields | {"text": tampered_text(docs["text"], docs["doc_id"])}
    tree = F.when(docs["source"].isNull(), "").otherwise(F.concat(F.lit("s"), docs["source"]))
    return docs.select(
        "doc_id", tree.alias("tree"), leaf(list(fields.values())).alias("digest"), leaf(list(changed.values())).alias("tampered"))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``rank``, the number of a row within its tree from 0; no task holds more than a segment of the whole order.

    Of the trees of a segment only the first can have begun in an earlier one, so what earlier segments add is one row a segment.
    """
    sort = [F.col(tree).asc(), *[F.col(o).asc_nulls_first() for o in order]]
    placed = rows.repartitionByRange(segment_count(rows), *sort).sortWithinPartitions(*sort)
    stored = pin(placed.withColumn("_at", F.monotonically_increasing_id()), "merkle-order").withColumn("_segment", F.shiftright("_at", 33))
    sizes = stored.groupBy("_segment", tree).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(tree).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").select("_segment", tree, "_before")
    inside = F.row_number().over(Window.partitionBy("_segment", tree).orderBy("_at")).cast("long") - 1
    return (
        stored.withColumn("_inside", inside).join(F.broadcast(carried), ["_segment", tree], "left")  # at most one row a segment
        .withColumn("rank", F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_at", "_segment", "_inside", "_before")
    )


def _levels(nodes: Column) -> Column:
    """Levels above so many nodes: the least power of ``FANOUT`` that reaches them."""
    found = F.lit(DIGITS)
    for k in range(DIGITS - 1, -1, -1):
        found = F.when(nodes <= FANOUT ** k, k).otherwise(found)
    return found


def roll_up(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per block of neighbours in a tree: tree, rank (of the block), digest (of its top) and the nested ``node``.

    ``nodes`` has tree, rank, digest and the payload columns. Levels of a block: all ``DIGITS`` unless the tree ends in it.
    """
    digits = [F.pmod(F.floor(F.col("rank") / FANOUT ** k), F.lit(FANOUT)).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    block = F.floor(F.col("rank") / BLOCK).cast("long").alias("block")
    rows = nodes.select("tree", block, *digits, F.struct("digest", *payload).alias("node")).repartition("tree", "block")
    size = F.count(F.lit(1)).over(Window.partitionBy("tree", "block"))
    alone = (F.col("block") == 0) & (size < BLOCK)
    rows = rows.withColumn("levels", F.when(alone, _levels(size)).otherwise(DIGITS))
    for k in range(DIGITS):
        keys = ["tree", "block", "levels", *[f"d{j}" for j in range(DIGITS - 1, k, -1)]]
        run = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), F.col("node"))))
        rows = rows.groupBy(*keys).agg(run.alias("run"))
        below = F.transform("run", lambda c: c["node"])
        joined = F.sha2(F.array_join(F.transform("run", lambda c: c["node"]["digest"]), ""), 256)
        digest = F.when(F.col("levels") > k, joined).otherwise(F.col("run")[0]["node"]["digest"])
        rows = rows.select(*keys, F.struct(digest.alias("digest"), (F.col("levels") > k).alias("hashed"), below.alias("below")).alias("node"))
    return rows.select("tree", F.col("block").alias("rank"), F.col("node.digest").alias("digest"), "node")


def unroll(blocks: DataFrame, above: list[str], payload: list[str]) -> DataFrame:
    """All nodes a block was rolled up from, with ``path`` extended: the siblings left and right of the node, lowest level first.

    ``blocks`` has tree, rank, node, path and the columns ``above``, which every node inherits.
    """
    rows = blocks
    for _ in range(DIGITS):
        run = F.col("node.below")
        rows = rows.select("tree", *above, "path", F.col("node.hashed").alias("hashed"), run.alias("run"), F.posexplode(run).alias("digit", "child"), F.col("rank"))
        digests = F.transform("run", lambda c: c["digest"])
        left = F.array_join(F.slice(digests, F.lit(1), F.col("digit")), "")
        right = F.array_join(F.slice(digests, F.col("digit") + 2, F.lit(FANOUT)), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        path = F.when(F.col("hashed"), F.concat(step, "path")).otherwise(F.col("path"))
        rows = rows.select(
            "tree", *above, (F.col("rank") * FANOUT + F.col("digit")).alias("rank"), path.alias("path"), F.col("child").alias("node"))
    return rows.select("tree", "rank", *above, "path", *[F.col(f"node.{c}").alias(c) for c in ["digest", *payload]])


def _rounds(most: int) -> int:
    """Rounds of blocks until the largest tree of so many nodes has one."""
    rounds = 1
    while BLOCK ** rounds < most:
        rounds += 1
    return rounds


def climb(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Stored tables of blocks, one a round; the last has one row per tree."""
    top = nodes.agg(F.max("rank")).first()[0]
    stored: list[DataFrame] = []
    for _ in range(_rounds(int(top) + 1 if top is not None else 1)):
        stored.append(pin(roll_up(nodes, payload if not stored else []), "merkle-blocks"))
        nodes = stored[-1].select("tree", "rank", "digest")
    return stored


def descend(stored: list[DataFrame], tops: DataFrame, above: list[str], payload: list[str]) -> DataFrame:
    """From the tops of the trees (tree, path and ``above``) to their lowest nodes."""
    found = tops.withColumn("rank", F.lit(0).cast("long"))
    for k in range(len(stored) - 1, -1, -1):
        paths = found.select("tree", "rank", "path", *above)
        found = unroll(stored[k].select("tree", "rank", "node").join(paths, ["tree", "rank"]), above, payload if k == 0 else [])
    return found


def _no_path() -> Column:
    return F.expr("cast(array() as array<struct<left: string, right: string>>)")


def manifest(leaves: DataFrame) -> DataFrame:
    """The rows of ``leaves`` (tree, doc_id, digest, tampered) with subroot, root and path."""
    payload = ["doc_id", "tampered"]
    stored = climb(ranked(leaves, "tree", ["doc_id", "digest"]), payload)
    subroots = stored[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("source_tree"), "digest")
    upper = climb(ranked(subroots, "tree", ["source_tree"]), ["source_tree"])
    root = upper[-1].select("tree", F.col("digest").alias("root"), _no_path().alias("path"))
    sources = descend(upper, root, ["root"], ["source_tree"])
    tops = sources.select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return descend(stored, tops, ["subroot", "root"], payload)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row, and the root its tampered form folds to."""
    rows = manifest(dataset_leaves(docs))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("tampered"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
