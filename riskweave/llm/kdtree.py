"""Sharding by a K-d tree over document metadata.

The tree starts with all documents and cuts each node at the weighted median of its widest dimension, where the weight of a
document is its size in bytes, until every leaf is one shard of the target size. Medians are found on the cluster: each pass
aggregates a node into a fixed number of buckets and the next pass looks only into the bucket that holds the median, so the
driver sees a bounded histogram and never a document. All nodes of a level share their passes.

Rows are ordered by (dimension, text hash, doc_id), so equal texts stay together. A group of copies above ``heavy`` of a shard
is placed first, whole, on the emptiest shard, which it may overfill by its size; only a group larger than a shard is cut, like
single documents. Smaller groups are never cut.

Defined results: a null text weighs one byte, null metadata counts as 0 and lowest, null ids sort first; repeated rows go to
the same shard; with fewer texts than shards some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import gapless, small_frame, utf8_bytes
from riskweave.session import pin

FANOUT = 512  # buckets per node at least; the nodes of a level share ``LEVEL_BUCKETS``
LEVEL_BUCKETS = 16_384
#: Copies above this share of a shard are placed as a group of their own.
HEAVY = 0.002


@dataclass
class _Node:
    """One node: shards [first, first + n) and, while it is cut, the search state of its median."""

    first: int
    n: int
    whole: float  # a group of copies up to this size is never cut
    dim: int = 0
    level: int = 0  # component searched: 0 dimension, 1 text hash, 2 doc_id
    low: int = 0
    high: int = 0
    before: int = 0
    target: int = 0
    value: int = 0
    group: int = 0
    cut: tuple[int, int, int] | None = None


def text_rank(column: Column) -> Column:
    """A number that orders strings by their first seven bytes; null is 0."""
    head = F.rpad(F.hex(F.encode(F.substring(F.coalesce(column.cast("string"), F.lit("")), 1, 7), "UTF-8")), 14, "0")
    return F.coalesce(F.conv(F.substring(head, 1, 14), 16, 10).cast("long"), F.lit(0))


def document_dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata that copies of a text share: bytes, and bytes per character. A label such as ``lang`` may differ between copies."""
    size, chars = utf8_bytes(F.col("text")), F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return {
        "bytes": size,
        "density": F.when(chars > 0, F.floor(size * 1_000_000 / chars)).otherwise(F.lit(0)).cast("long"),
    }


def _ids(frame: DataFrame) -> Column:
    return F.coalesce(frame["doc_id"].cast("long"), F.lit(-1))


def _x() -> Column:
    return F.expr("CASE _level WHEN 0 THEN _value WHEN 1 THEN _group ELSE _id END")


def _node_frame(spark, nodes: list[_Node]) -> DataFrame:
    rows = [
        (i, n.dim, n.level, n.low, n.high, n.value, n.group) for i, n in enumerate(nodes)
    ]
    schema = "_node int, _dim int, _level int, _low long, _high long, _v long, _g long"
    return F.broadcast(small_frame(spark, rows, schema))  # one row per node: fewer than there are shards


def _pick(dims: int) -> Column:
    return F.element_at("_dims", F.col("_dim") + 1) if dims else F.lit(0)


def _find_cuts(rows: DataFrame, nodes: list[_Node], dims: int) -> None:
    """Set ``cut`` of every node: rows up to it, in tuple order, go left."""
    spark = rows.sparkSession
    searching = [i for i, n in enumerate(nodes) if n.cut is None]
    while searching:
        fanout = max(FANOUT, LEVEL_BUCKETS // len(searching))
        frame = _node_frame(spark, nodes)
        seen = rows.join(frame, "_node").withColumn("_value", _pick(dims)).where(
            (F.col("_level") == 0) | ((F.col("_value") == F.col("_v")) & ((F.col("_level") == 1) | (F.col("_group") == F.col("_g"))))
        ).withColumn("_x", _x()).where(F.col("_x").between(F.col("_low"), F.col("_high")) & F.col("_node").isin(searching))
        width = F.col("_high").cast("double") - F.col("_low").cast("double") + 1
        bucket = F.least(F.floor((F.col("_x") - F.col("_low")).cast("double") / width * fanout), F.lit(fanout - 1))
        found: dict[int, list] = {i: [] for i in searching}
        counted = seen.groupBy("_node", bucket.alias("_bucket")).agg(
            F.sum("_size").alias("size"), F.min("_x").alias("low"), F.max("_x").alias("high"))
        for r in counted.collect():  # at most ``fanout`` rows per node
            found[r["_node"]].append((r["_bucket"], r["size"], r["low"], r["high"]))
        for i in searching:
            _narrow(nodes[i], sorted(found[i]))
        searching = [i for i, n in enumerate(nodes) if n.cut is None]


def _narrow(node: _Node, buckets: list) -> None:
    if not buckets:
        node.cut = (0, 0, -1)
        return
    for k, (_, size, low, high) in enumerate(buckets):
        last = k == len(buckets) - 1
        if node.before + size < node.target and not last:
            node.before += size
            continue
        if low < high:
            node.low, node.high = low, high
        elif node.level == 0:
            node.value, node.level, node.low, node.high = low, 1, 0, (1 << 63) - 1
        elif node.level == 1 and size > node.whole:
            node.group, node.level, node.low, node.high = low, 2, -1, (1 << 62)
        else:  # one group of copies or one document: it goes to the side where it leaves the smaller gap
            left = node.before + size - node.target <= node.target - node.before
            edge = low if left else low - 1
            node.cut = (node.value, edge, (1 << 62)) if node.level == 1 else (node.value, node.group, edge)
        return


def kdtree_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """Give every document a shard: doc_id, size, text_crc32, shard, slot. Either ``shards`` or ``target_bytes`` is given."""
    spark = docs.sparkSession
    dimensions = document_dimensions(docs) if dimensions is None else dimensions
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pin(docs.select(
        "doc_id", (utf8_bytes(F.col("text")) + 1).alias("_size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.expr("xxhash64(coalesce(text, '')) & 9223372036854775807").alias("_group"),
        _ids(docs).alias("_id"), F.array(*dimensions.values()).alias("_dims") if dimensions else F.array(F.lit(0)).alias("_dims"),
    ), "kd-rows")
    total, count = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = shards or max(1, -(-total // max(1, target_bytes)))
    room = [total / shards] * shards
    heavy_rows = (
        rows.groupBy("_group").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & (F.col("size") > HEAVY * total / shards)).collect()  # at most shards / HEAVY groups
    )
    placed = []
    for r in sorted(heavy_rows, key=lambda r: (-r["size"], r["_group"])):
        best = max(range(shards), key=lambda s: room[s])
        if r["size"] <= total / shards:
            room[best] -= r["size"]
            placed.append((r["_group"], best))
    heavy = F.broadcast(small_frame(spark, placed, "_group long, _shard int"))
    fixed = rows.join(heavy, "_group")
    free = rows.join(heavy, "_group", "left_anti").withColumn("_node", F.lit(0))
    spans = free.agg(*[f(F.col("_dims")[d]) for d in range(max(1, len(dimensions))) for f in (F.min, F.max)]).first()
    widths = [max(1, (spans[2 * d + 1] or 0) - (spans[2 * d] or 0)) for d in range(max(1, len(dimensions)))]
    nodes = [_Node(0, shards, HEAVY * total / shards)]
    while any(n.n > 1 for n in nodes):
        nodes, free = _split_level(free, nodes, room, widths, len(dimensions))
    leaf = small_frame(spark, [(i, n.first) for i, n in enumerate(nodes)], "_node int, _shard int")
    sharded = free.join(F.broadcast(leaf), "_node").select("doc_id", "_size", "text_crc32", "_shard")
    sharded = sharded.unionByName(fixed.select("doc_id", "_size", "text_crc32", "_shard"))
    out = gapless(sharded, "_shard", ["doc_id", "text_crc32", "_size"], dict.fromkeys(range(shards), count // shards + 1))
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.col("_shard").alias("shard"), "slot")


def _split_level(free: DataFrame, nodes: list[_Node], room: list[float], widths: list[int], dims: int) -> tuple[list[_Node], DataFrame]:
    spark = free.sparkSession
    stats = {r["_node"]: r for r in free.groupBy("_node").agg(
        *[f(F.col("_dims")[d]).alias(f"{name}{d}") for d in range(len(widths)) for name, f in (("low", F.min), ("high", F.max))]
    ).collect()}
    for i, node in enumerate(nodes):
        r = stats.get(i)
        if node.n == 1 or r is None:
            node.cut = (0, 0, -1)
            continue
        node.dim = max(range(len(widths)), key=lambda d: ((r[f"high{d}"] - r[f"low{d}"]) / widths[d], -d))
        node.low, node.high = r[f"low{node.dim}"], r[f"high{node.dim}"]
        node.target = round(sum(room[node.first:node.first + node.n // 2]))
    _find_cuts(free, [n for n in nodes], dims)
    children, cuts = [], []
    for i, node in enumerate(nodes):
        if node.n == 1:
            cuts.append((i, 0, 0, 0, 0, len(children), len(children)))
            children.append(_Node(node.first, 1, node.whole))
        else:
            half = node.n // 2
            cuts.append((i, node.dim, *node.cut, len(children), len(children) + 1))
            children += [_Node(node.first, half, node.whole), _Node(node.first + half, node.n - half, node.whole)]
    table = F.broadcast(small_frame(spark, cuts, "_node int, _dim int, _v long, _g long, _d long, _left int, _right int"))
    value = _pick(dims)
    left = (value < F.col("_v")) | ((value == F.col("_v")) & (
        (F.col("_group") < F.col("_g")) | ((F.col("_group") == F.col("_g")) & (F.col("_id") <= F.col("_d")))))
    moved = free.join(table, "_node").withColumn("_child", F.when(left, F.col("_left")).otherwise(F.col("_right")))
    return children, moved.withColumn("_node", F.col("_child")).select(*free.columns)
