"""Running aggregates, ranks, curves and exact quantiles that stay correct and balanced under skew.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task. ``running`` counts rows per
key first (one column, combined on the map side) and treats the two cases differently:

* keys with at most ``spark.riskweave.hotGroupRows`` rows use the plain window: one shuffle;
* rows of larger keys, and whole-table orders, are range-partitioned on (keys, order) so that one key
  is spread over many segments. Running values are computed inside each segment and the totals of
  earlier segments are added from a small table of at most (segments + hot keys) rows.

The number of hot keys is at most rows / hotGroupRows, which is what makes broadcasting them safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import HOT_GROUP_ROWS, int_conf, pin, segment_count

_IDX_MASK = (1 << 33) - 1


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``how`` is count, sum, min, max, last (skips nulls) or lag."""

    how: str
    expr: Column | None = None
    current: bool = True

    def __post_init__(self) -> None:
        if self.how not in {"count", "sum", "min", "max", "last", "lag"}:
            raise ValueError(f"unknown running aggregate {self.how!r}")


@dataclass(frozen=True)
class HotGroups:
    """Keys with more rows than one task should hold; ``frame`` is None when there are none."""

    keys: tuple[str, ...]
    rows: int
    frame: DataFrame | None


def _sort(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o).asc() if isinstance(o, str) else o for o in order]


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_h_{k}"])
    return cond


def find_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> HotGroups:
    """Count rows per key (narrow, map-side combined) and keep the keys above the limit."""
    limit = limit or int_conf(df.sparkSession, HOT_GROUP_ROWS)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot_rows = counts.agg(F.sum("_n").alias("rows")).first()["rows"]
    if not hot_rows:
        return HotGroups(tuple(keys), 0, None)
    frame = counts.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    return HotGroups(tuple(keys), int(hot_rows), frame)


def split_hot(df: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None)."""
    if hot.frame is None:
        return df, None
    small = F.broadcast(hot.frame)
    cond = _null_safe(df, hot.frame, hot.keys)
    return df.join(small, cond, "left_anti"), df.join(small, cond, "left_semi")


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: HotGroups | None = None) -> DataFrame:
    """Join rows with a table of one row per key.

    Rows of keys above ``hotGroupRows`` meet their table rows by broadcast. There are at most rows / hotGroupRows such keys.
    """
    hot = hot or find_hot(rows, [key])
    if hot.frame is None:
        return rows.join(table, key, how)
    cold, heavy = split_hot(rows, hot)
    few = table.join(F.broadcast(hot.frame), table[key] == hot.frame[f"_h_{key}"], "left_semi")
    return cold.join(table, key, how).unionByName(heavy.join(F.broadcast(few), key, how))


def _windowed(aggs: Mapping[str, Running], window) -> list[Column]:
    out = []
    frames = {
        True: window.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        False: window.rowsBetween(Window.unboundedPreceding, -1),
    }
    for name, agg in aggs.items():
        frame = frames[agg.current]
        if agg.how == "count":
            number = F.row_number().over(window).cast("long")
            col = number if agg.current else number - 1
        elif agg.how == "lag":
            col = F.lag(agg.expr, 1).over(window)
        elif agg.how == "last":
            col = F.last(agg.expr, ignorenulls=True).over(frame)
        else:
            col = getattr(F, agg.how)(agg.expr).over(frame)
        out.append(col.alias(name))
    return out


def _plain(df: DataFrame, keys, order, aggs) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*_sort(order))
    return df.select("*", *_windowed(aggs, window))


def _segments(df: DataFrame, keys, order, rows: int | None) -> DataFrame:
    """Range-partition on (keys, order); ``_pos`` encodes segment and position inside it."""
    sort = [F.col(k).asc() for k in keys] + _sort(order)
    n = segment_count(df, rows)
    placed = (
        df.repartitionByRange(n, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return pin(placed, "segments").withColumn("_seg", F.shiftright("_pos", 33))


def ordered_segments(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The table in a whole order, stored: ``_seg`` numbers its segments, ``_pos`` orders the rows."""
    return _segments(df, [], order, None)


def _segmented(df: DataFrame, keys, order, aggs, rows: int | None) -> DataFrame:
    columns = df.columns
    inputs = {f"_in_{name}": agg.expr for name, agg in aggs.items() if agg.expr is not None}
    pinned = _segments(df.select("*", *[e.alias(n) for n, e in inputs.items()]), keys, order, rows)
    local = {
        name: Running(agg.how, F.col(f"_in_{name}") if agg.expr is not None else None, agg.current)
        for name, agg in aggs.items()
    }

    totals = []
    for name, agg in local.items():
        if agg.how == "count":
            total = F.count(F.lit(1))
        elif agg.how == "lag":
            total = F.max_by(agg.expr, F.col("_pos"))
        elif agg.how == "last":
            total = F.max_by(agg.expr, F.when(agg.expr.isNotNull(), F.col("_pos")))
        else:
            total = getattr(F, agg.how)(agg.expr)
        totals.append(total.alias(f"_t_{name}"))
    pieces = pinned.groupBy("_seg", *keys).agg(*totals)
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for name, agg in local.items():
        total = F.col(f"_t_{name}")
        if agg.how in ("count", "sum"):
            carry = F.sum(total).over(before)
        elif agg.how in ("min", "max"):
            carry = getattr(F, agg.how)(total).over(before)
        elif agg.how == "lag":
            carry = F.lag(total, 1).over(Window.partitionBy(*keys).orderBy("_seg"))
        else:
            carry = F.last(total, ignorenulls=True).over(before)
        carries.append(carry.alias(f"_c_{name}"))
    carry = pieces.select(
        F.col("_seg").alias("_h__seg"), *[F.col(k).alias(f"_h_{k}") for k in keys], *carries
    )

    if not keys and all(a.how == "count" for a in local.values()):
        index = F.col("_pos").bitwiseAND(F.lit(_IDX_MASK))
        inside = pinned.select(
            "*", *[(index + (1 if a.current else 0)).alias(f"_l_{n}") for n, a in local.items()]
        ).withColumn("_first", F.lit(False))
    else:
        window = Window.partitionBy("_seg", *keys).orderBy("_pos")
        inside = pinned.select(
            "*",
            *_windowed({f"_l_{n}": a for n, a in local.items()}, window),
            (F.row_number().over(window) == 1).alias("_first"),
        )
    joined = inside.join(F.broadcast(carry), _null_safe(inside, carry, ["_seg", *keys]), "left")
    out = []
    for name, agg in local.items():
        here, prior = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if agg.how == "count":
            col = here + F.coalesce(prior, F.lit(0))
        elif agg.how == "sum":
            col = F.when(here.isNull(), prior).when(prior.isNull(), here).otherwise(here + prior)
        elif agg.how == "min":
            col = F.least(here, prior)
        elif agg.how == "max":
            col = F.greatest(here, prior)
        elif agg.how == "lag":
            col = F.when(F.col("_first"), prior).otherwise(here)
        else:
            col = F.coalesce(here, prior)
        out.append(col.alias(name))
    return joined.select(*columns, *out)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    aggs: Mapping[str, Running],
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` (a total order) within ``keys``.

    With no keys the whole table is one ordered group and always uses segments. ``hot`` may be passed
    when the caller has already counted the keys on a cheaper frame.
    """
    if not keys:
        return _segmented(df, [], order, aggs, None)
    hot = hot or find_hot(df, keys)
    cold, heavy = split_hot(df, hot)
    result = _plain(cold, keys, order, aggs)
    if heavy is None:
        return result
    return result.unionByName(_segmented(heavy, keys, order, aggs, hot.rows))


def running_low(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, total: str, low: str, hot: HotGroups | None = None
) -> DataFrame:
    """Adds the running sum of a column and the least that sum has been so far.

    Segments carry both at once: the sum of all rows before, and the least prefix sum so far, which for each earlier segment is
    its own least prefix on top of the sum before it.
    """
    keys = list(keys)
    if not keys:
        return _segmented_low(df, [], order, value, total, low, None)
    hot = hot or find_hot(df, keys)
    cold, heavy = split_hot(df, hot)
    window = Window.partitionBy(*keys).orderBy(*_sort(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = cold.withColumn(total, F.sum(value).over(window)).withColumn(low, F.min(total).over(window))
    if heavy is None:
        return result
    return result.unionByName(_segmented_low(heavy, keys, order, value, total, low, hot.rows))


def _segmented_low(df: DataFrame, keys, order, value: str, total: str, low: str, rows: int | None) -> DataFrame:
    window = Window.partitionBy("_seg", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = _segments(df, keys, order, rows).withColumn("_sum", F.sum(value).over(window)).withColumn("_low", F.min("_sum").over(window))
    pieces = inside.groupBy("_seg", *keys).agg(F.sum(value).alias("_all"), F.min("_sum").alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.withColumn("_c_sum", F.sum("_all").over(before)).withColumn(
        "_c_low", F.min(F.coalesce("_c_sum", F.lit(0)) + F.col("_least")).over(before))
    carry = carry.select(F.col("_seg").alias("_h__seg"), *[F.col(k).alias(f"_h_{k}") for k in keys], "_c_sum", "_c_low")
    joined = inside.join(F.broadcast(carry), _null_safe(inside, carry, ["_seg", *keys]), "left")
    base = F.coalesce("_c_sum", F.lit(0))
    kind = inside.schema["_sum"].dataType
    return joined.select(
        *df.columns, (base + F.col("_sum")).cast(kind).alias(total), F.least(F.col("_c_low"), base + F.col("_low")).cast(kind).alias(low))


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Exact 1-based position in a whole-table order."""
    return running(df, [], order, {name: Running("count")})


def group_rank(df: DataFrame, keys: Sequence[str], order, name: str = "rank") -> DataFrame:
    """Exact 1-based position within a group."""
    return running(df, keys, order, {name: Running("count")})


def first_occurrence(
    df: DataFrame, group: Sequence[str], order: Sequence[str], row_id: Sequence[str], name: str,
    within: HotGroups | None = None,
) -> DataFrame:
    """Flag the earliest row of each group. Hot groups use an aggregate and a join on the row id.

    ``within`` are counted groups of a prefix of the group columns: when none of those is hot, no
    finer group can be, and nothing is counted again.
    """
    none_hot = within is not None and within.frame is None
    hot = HotGroups(tuple(group), 0, None) if none_hot else find_hot(df, group)
    cold, heavy = split_hot(df, hot)
    window = Window.partitionBy(*group).orderBy(*_sort(order))
    result = cold.withColumn(name, F.row_number().over(window) == 1)
    if heavy is None:
        return result
    earliest = (
        heavy.groupBy(*group)
        .agg(F.min_by(F.struct(*row_id), F.struct(*order)).alias("_e"))
        .select("_e.*")
        .withColumn(name, F.lit(True))
    )
    flagged = heavy.join(earliest, list(row_id), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return result.unionByName(flagged.select(*result.columns))


def score_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """One row per distinct score (per ``by`` group), highest first, with cumulative tp and fp.

    Columns: by..., score, pos, neg, tp, fp. Null scores are dropped, as they cannot be ordered.
    """
    one = weight if weight is not None else F.lit(1)
    cells = (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(
            F.sum(F.when(F.col(label), one).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(label), 0).otherwise(one)).alias("neg"),
        )
    )
    return running(
        cells,
        list(by),
        [F.col("score").desc()],
        {"tp": Running("sum", F.col("pos")), "fp": Running("sum", F.col("neg"))},
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    discrete: bool = False,
) -> DataFrame:
    """Exact quantiles per group as one column per entry of ``probabilities``.

    Values are counted first, so memory is bounded by the segment and not by the group. ``discrete``
    picks the nearest-rank value; otherwise the two neighbours are interpolated linearly.
    """
    by = list(by)
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cum = running(cells, by, ["_v"], {"_cum": Running("sum", F.col("_n"))})
    totals = (
        df.where(F.col(value).isNotNull())
        .groupBy(*[F.col(b).alias(f"_h_{b}") for b in by])
        .agg(F.count(F.lit(1)).alias("_total"))
    )
    if by:
        ranked = cum.join(totals, _null_safe(cum, totals, by))
    else:
        ranked = cum.crossJoin(F.broadcast(totals))
    aggs, total = [], F.col("_total")
    for name, p in probabilities.items():
        if discrete:
            need = F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * total))
            aggs.append(F.min(F.when(F.col("_cum") >= need, F.col("_v"))).alias(name))
        else:
            position = F.lit(float(p)) * (total - 1)
            aggs.append(F.min(F.when(F.col("_cum") > F.floor(position), F.col("_v"))).alias(f"_lo_{name}"))
            aggs.append(F.min(F.when(F.col("_cum") > F.ceil(position), F.col("_v"))).alias(f"_hi_{name}"))
            aggs.append(F.max(position - F.floor(position)).alias(f"_fr_{name}"))
    picked = ranked.groupBy(*by).agg(*aggs)
    if discrete:
        return picked
    return picked.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
            for n in probabilities
        ],
    )
