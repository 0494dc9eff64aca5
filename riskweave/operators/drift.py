"""Drift over time and evaluation under late labels: Page-Hinkley, adaptive windows, prequential reports with a label embargo."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.metrics import ratio
from riskweave.operators.ordered import HotGroups, Running, find_hot, running, running_low

#: Sums of whole millionths (billionths for squares): a key gives the same numbers whether it is cut into segments or not.
MONEY, WHOLE = "decimal(28,6)", "decimal(28,0)"


def _whole(value: Column, unit: float) -> Column:
    return F.floor(value * F.lit(unit) + F.lit(0.5)).cast(WHOLE)


def page_hinkley(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, delta: float, threshold: float, hot: HotGroups | None = None
) -> DataFrame:
    """Adds mean_so_far, drift_statistic and drift to every row: has the mean of the key risen?

    Every row adds its value, less the mean of the rows up to it, less ``delta``; the statistic is how far this sum lies above its
    least value so far, and drift says it exceeds ``threshold``. To look for a fall, pass the negated value. The sum is not started
    anew after drift, so ``first_drift`` gives the alarm to act on. Rows with a null value add nothing.
    """
    keys = list(keys)
    hot = hot or (find_hot(df, keys) if keys else None)
    known = F.col(value).try_cast(MONEY)
    walked = running(df.withColumn("_x", known), keys, order, {
        "_sum": Running("sum", F.col("_x")), "_count": Running("sum", F.col("_x").isNotNull().cast("long"))}, hot=hot)
    mean = F.col("_sum").cast("double") / F.when(F.col("_count") > 0, F.col("_count"))
    step = _whole(F.col("_x").cast("double") - mean - F.lit(float(delta)), 1e6)
    stepped = walked.withColumns({"mean_so_far": mean, "_step": F.coalesce(step, F.lit(0).cast(WHOLE))})
    low = running_low(stepped, keys, order, "_step", "_total", "_low", hot=hot)
    # The sum starts at 0, which counts as its least value until it falls below.
    statistic = (F.col("_total") - F.least(F.col("_low"), F.lit(0))).cast("double") / F.lit(1e6)
    return low.withColumns({"drift_statistic": statistic, "drift": statistic > F.lit(float(threshold))}).select(
        *df.columns, "mean_so_far", "drift_statistic", "drift")


def first_drift(tested: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: rows, highest statistic, and the order columns of its first drift (null if there is none)."""
    at = F.min(F.when(F.col("drift"), F.struct(*order)))
    return tested.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.max("drift_statistic").alias("highest_statistic"), at.alias("_at")
    ).select(*keys, "rows", "highest_statistic", *[F.col(f"_at.{o}").alias(f"first_{o}") for o in order])


def rate_series(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, flag: Column) -> DataFrame:
    """keys, period, rows and rate: the share of flagged rows of each key in each period; rows without a time or flag are left out."""
    period = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    shaped = df.select(*keys, period.alias("period"), flag.cast("boolean").alias("_flag")).where("period IS NOT NULL AND _flag IS NOT NULL")
    return shaped.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("rows"), (F.count_if("_flag") / F.count(F.lit(1))).alias("rate"))


Window = list[tuple[float, int]]


def adwin_step(window: Window, value: float, delta: float, most: int) -> tuple[Window, bool]:
    """The adaptive window after one more value between 0 and 1, and whether older values were dropped.

    The window is an exponential histogram, oldest bucket first: (sum, count) with counts that are powers of two, at most
    ``most`` of each; when there are more, the two oldest become one of twice the count. As long as some cut between buckets
    leaves two parts whose means differ by more than chance allows (a bound by Hoeffding with confidence ``delta`` over the
    window's length), the oldest bucket goes. A window of n values has at most ``most`` * log2(n) buckets.
    """
    window, size = [*window, (value, 1)], 1
    while True:
        same = [i for i, (_, n) in enumerate(window) if n == size]
        if len(same) <= most:
            break
        i = same[0]
        window[i:i + 2] = [(window[i][0] + window[i + 1][0], 2 * size)]
        size *= 2
    dropped = False
    while _can_be_cut(window, delta):
        window, dropped = window[1:], True
    return window, dropped


def _can_be_cut(window: Window, delta: float) -> bool:
    total, n = sum(s for s, _ in window), sum(c for _, c in window)
    head, ahead = 0.0, 0
    chance = math.log(4 * n / delta) / 2
    for s, c in window[:-1]:
        head, ahead = head + s, ahead + c
        if abs(head / ahead - (total - head) / (n - ahead)) >= math.sqrt(chance * (1 / ahead + 1 / (n - ahead))):
            return True
    return False


def adwin_fold(series: pd.DataFrame, value: str, window: Window, delta: float, most: int) -> tuple[pd.DataFrame, Window]:
    """An ordered piece of one key's series with window_size, window_mean and drift, and the window after it. Null values add nothing."""
    out = []
    for x in series[value].tolist():
        dropped = False
        if x is not None and not math.isnan(x):
            window, dropped = adwin_step(window, float(x), delta, most)
        n = sum(c for _, c in window)
        out.append((n, sum(s for s, _ in window) / n if n else None, dropped))
    marks = pd.DataFrame(out, columns=["window_size", "window_mean", "drift"], index=series.index)
    return pd.concat([series, marks], axis=1), window


def adwin_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("window_size", T.LongType()), T.StructField("window_mean", T.DoubleType()), T.StructField("drift", T.BooleanType())])


def adwin(series: DataFrame, keys: Sequence[str], order: str, value: str, delta: float = 0.002, most: int = 5) -> DataFrame:
    """Adds window_size, window_mean and drift to every row of a series of rates, key by key in order.

    The window of a value depends on every value before it, so a key's series is folded by one task. Fold rates of periods
    (``rate_series``), not events: a series is then as long as time is, whatever the number of rows.
    """
    keys = list(keys)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        return adwin_fold(part.sort_values(order, kind="stable"), value, [], delta, most)[0]

    return series.groupBy(*keys).applyInPandas(fold, adwin_schema(series.schema))


def labels_known(
    df: DataFrame, ts: str, label: str, row_id: str, embargo_seconds: int, keys: Sequence[str] = (), hot: HotGroups | None = None
) -> DataFrame:
    """Row id with the labels, and the positive ones, that were known when the row was scored.

    A label becomes known ``embargo_seconds`` after its row, and is known to rows of that instant on. Rows with a null label give
    none; a row without a time knows nothing and its label is never known. One pass over the rows and their labels' arrivals in
    order of time, cut into segments where a key is large.
    """
    keys = list(keys)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    base = df.select(F.col(row_id).alias("_row"), micros.alias("_us"), F.col(label).cast("boolean").alias("_label"), *keys)
    timed = base.where("_us IS NOT NULL")
    asks = timed.select("_row", "_us", *keys, F.lit(0).cast("long").alias("_one"), F.lit(0).cast("long").alias("_hit"), F.lit(1).alias("_kind"))
    arrivals = timed.where("_label IS NOT NULL").select(
        "_row", (F.col("_us") + embargo_seconds * 1_000_000).alias("_us"), *keys, F.lit(1).cast("long").alias("_one"),
        F.col("_label").cast("long").alias("_hit"), F.lit(0).alias("_kind"))
    walked = running(asks.unionByName(arrivals), keys, ["_us", "_kind", "_row"], {
        "_known": Running("sum", F.col("_one")), "_positive": Running("sum", F.col("_hit"))}, hot=hot).where("_kind = 1")
    zero = F.lit(0).cast("long")
    return base.select("_row").join(walked.select("_row", "_known", "_positive"), "_row", "left").select(
        F.col("_row").alias(row_id), F.coalesce("_known", zero).alias("labels_known"), F.coalesce("_positive", zero).alias("positives_known"))


def prequential_report(
    df: DataFrame, ts: str, label: str, score: str, generation_seconds: int, embargo_seconds: int, threshold: float
) -> DataFrame:
    """One row per generation that has labelled rows: what a model trained at its start could learn from, and how the scores did in it.

    Generations are equal spans of time. ``train_rows`` and ``train_positives`` are labels known at the start of the generation, the
    embargo over. The generation itself is the held-out set: its confusion counts at the threshold, precision, recall, Brier score,
    and the Brier score of always giving the positive rate known at the start. Rows without time or label are left out, a null
    score counts as 0. The tables after the first aggregate have one row per generation.
    """
    span = generation_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(
        micros.alias("us"), F.col(label).cast("boolean").alias("label"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score")
    ).where("us IS NOT NULL AND label IS NOT NULL")
    flagged, hit = F.col("score") >= F.lit(float(threshold)), F.col("label")
    miss = F.col("score") - hit.cast("double")
    held = rows.groupBy(F.floor(F.col("us") / span).cast("long").alias("generation")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("positives"), F.count_if(hit & flagged).alias("true_positives"),
        F.count_if(~hit & flagged).alias("false_positives"),
        F.sum(_whole(miss * miss, 1e9)).alias("_brier"))
    # A label that arrives within a generation is first used by the next one.
    arrived = rows.groupBy(F.ceil((F.col("us") + embargo_seconds * 1_000_000) / span).cast("long").alias("generation")).agg(
        F.count(F.lit(1)).alias("_new"), F.count_if(hit).alias("_new_positives"))
    both = held.unionByName(arrived, allowMissingColumns=True).groupBy("generation").agg(
        *[F.max(c).alias(c) for c in ("rows", "positives", "true_positives", "false_positives", "_brier", "_new", "_new_positives")])
    known = running(both, [], ["generation"], {"train_rows": Running("sum", F.col("_new")), "train_positives": Running("sum", F.col("_new_positives"))})
    zero = F.lit(0).cast("long")
    out = known.where("rows IS NOT NULL").withColumns({"train_rows": F.coalesce("train_rows", zero), "train_positives": F.coalesce("train_positives", zero)})
    rate = F.when(F.col("train_rows") > 0, F.col("train_positives") / F.col("train_rows"))
    negatives = F.col("rows") - F.col("positives")
    caught = F.col("true_positives")
    return out.select(
        "generation", "train_rows", "train_positives", "rows", "positives", "true_positives", "false_positives",
        ratio(caught, caught + F.col("false_positives")).alias("precision"), ratio(caught, F.col("positives")).alias("recall"),
        (F.col("_brier").cast("double") / F.lit(1e9) / F.col("rows")).alias("brier"),
        ((F.col("positives") * (1 - rate) * (1 - rate) + negatives * rate * rate) / F.col("rows")).alias("brier_of_known_rate"))
