"""Isotonic calibration: the non-decreasing step function of the score that fits the labels best.

Pooling adjacent violators gives the slopes of the lower convex hull of the points (rows so far, positives so far) in score order.
Hulls combine: the hull of a table is the hull of its segments' hulls. So every ordered segment keeps only its own hull vertices,
which a second, much smaller round turns into the vertices of the whole. Steps of a hull over whole numbers that add up to n rows
are at most about 3 n^(2/3), which bounds what the last task holds: some ten million vertices for 10^11 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.ordered import Running, running
from riskweave.session import HOT_GROUP_ROWS, int_conf, pin, segment_count

_VERTEX = "upto double, n long, pos long"


def _hull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vertices of the lower hull of one ordered segment; a point on or above the line of its neighbours goes."""
    hull: list[tuple[float, int, int]] = []
    for batch in batches:
        for upto, n, pos in zip(batch["upto"].tolist(), batch["n"].tolist(), batch["pos"].tolist(), strict=True):
            while len(hull) > 1:
                (_, n0, p0), (_, n1, p1) = hull[-2:]
                if (p1 - p0) * (n - n1) < (pos - p1) * (n1 - n0):
                    break
                hull.pop()
            hull.append((upto, n, pos))
    yield pd.DataFrame(hull, columns=["upto", "n", "pos"])


def isotonic_blocks(df: DataFrame, score: str, label: str) -> DataFrame:
    """above (exclusive, null below all), upto (inclusive), n, pos and value of every block, in any order.

    Scores and labels that are null are left out; without any row there is no block.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    cells = known.groupBy(F.col(score).cast("double").alias("upto")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("boolean").cast("long")).alias("_pos"))
    points = running(cells, [], ["upto"], {"n": Running("sum", F.col("_n")), "pos": Running("sum", F.col("_pos"))}).select("upto", "n", "pos")
    # The origin is the first vertex of the whole; it sorts before all scores.
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("upto"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"))
    vertices, limit = pin(points.unionByName(origin), "points"), int_conf(df.sparkSession, HOT_GROUP_ROWS)
    parts, size = segment_count(vertices), vertices.count()
    while size > 1:
        placed = vertices.repartitionByRange(parts, "n").sortWithinPartitions("n")
        vertices = pin(placed.mapInPandas(_hull, _VERTEX), "vertices")
        if parts == 1:
            break
        left = vertices.count()
        parts = 1 if left <= limit or left > 0.9 * size else max(1, min(parts - 1, left // limit + 1))
        size = left
    before = Window.orderBy("n")  # hull vertices only
    steps = vertices.select(
        F.lag("upto").over(before).alias("above"), "upto", (F.col("n") - F.lag("n").over(before)).alias("n"),
        (F.col("pos") - F.lag("pos").over(before)).alias("pos")).where("n IS NOT NULL")
    return steps.withColumn("value", F.col("pos") / F.col("n"))


def isotonic_calibrate(df: DataFrame, blocks: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """The value of the block each score lies in; scores above all blocks take the last value, null and NaN scores null."""
    kept = df.columns
    rows = df.withColumns({"_at": F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double")), "_value": F.lit(None).cast("double"), "_kind": F.lit(1)})
    ends = blocks.select(F.col("upto").alias("_at"), F.col("value").alias("_value"), F.lit(0).alias("_kind"))
    # From the highest score down, the last block end at or above a score is that of its block.
    walked = running(
        rows.where("_at IS NOT NULL").unionByName(ends, allowMissingColumns=True), [], [F.col("_at").desc(), F.col("_kind").asc()],
        {"_found": Running("last", F.col("_value"))}).where("_kind = 1")
    top = F.broadcast(blocks.agg(F.max("value").alias("_top")))
    found = walked.crossJoin(top).select(*kept, F.coalesce("_found", "_top").alias(name))
    return found.unionByName(rows.where("_at IS NULL").select(*kept, F.lit(None).cast("double").alias(name)))
