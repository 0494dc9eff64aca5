"""Detection metrics. Curves and ranks come from ``ordered``; everything else is one aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.domains import WILSON_Z
from riskweave.operators.ordered import Running, global_rank, group_rank, ordered_segments, running, score_curve
from riskweave.session import pin


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den as double, ``empty`` when the denominator is zero or null."""
    return F.when(F.coalesce(den, F.lit(0)) == 0, F.lit(empty).cast("double")).otherwise(
        num.cast("double") / den.cast("double")
    )


def rounded(col: Column, digits: int) -> Column:
    """Half-up rounding after snapping to five more digits.

    Sums of doubles differ in their last bits between partitionings; without the snap a value on a
    rounding tie would flip with them.
    """
    return F.round(F.round(col, digits + 5), digits)


def n_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_if(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))


def join_groups(frames: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Join one-row-per-group frames; without ``by`` they are single rows."""
    if not by:
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({k: f"_h_{k}" for k in by})
        cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in by])
        return a.join(b, cond).drop(*[f"_h_{k}" for k in by])

    return reduce(join, frames)


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": ratio(fp, fp + tn),
    }


def confusion_metrics(df: DataFrame, label: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """M1: confusion counts and the rates derived from them; zero on empty denominators."""
    y, p = F.col(label), F.col(flag)
    counts = df.groupBy(*by).agg(
        n_if(y & p).alias("tp"), n_if(~y & p).alias("fp"), n_if(y & ~p).alias("fn"), n_if(~y & ~p).alias("tn")
    )
    derived = rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select("*", *[F.round(c, 6).alias(n) for n, c in derived.items()])


def _two_classes(value: Column) -> Column:
    return F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), value)


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M2: step sum over distinct scores; null when only one class is present."""
    return curve_average_precision(score_curve(df, score, label, by), by)


def curve_average_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    step = F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return curve.groupBy(*by).agg(F.round(_two_classes(step / F.sum("pos")), 6).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M3: tie-aware area under the ROC curve; null when only one class is present."""
    return curve_roc_auc(score_curve(df, score, label, by), by)


def curve_roc_auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    above = F.col("tp") - F.col("pos")
    wins = F.sum(F.col("neg").cast("double") * (above + F.col("pos") / F.lit(2.0)))
    area = wins / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))
    return curve.groupBy(*by).agg(F.round(_two_classes(area), 6).alias("roc_auc"))


def curve_areas(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M2 and M3 from one curve."""
    curve = score_curve(df, score, label, by)
    return join_groups([curve_average_precision(curve, by), curve_roc_auc(curve, by)], by)


def threshold_f1_precision(
    df: DataFrame, score: str, label: str, floor: float = 0.90, break_ties_by_recall: bool = True
) -> DataFrame:
    """M4: threshold with the best F1 among those of precision >= floor, else the best of all.

    Ties go to the higher recall and then the higher threshold, or straight to the higher threshold.
    An empty input gives 0.5.
    """
    curve = score_curve(df, score, label)
    totals = curve.agg(F.sum("pos").alias("positives"))
    tp, fp, positives = F.col("tp"), F.col("fp"), F.col("positives")
    recall = F.when(positives == 0, F.lit(1.0)).otherwise(tp / positives)
    rows = curve.crossJoin(F.broadcast(totals)).select(
        (ratio(tp, tp + fp) >= floor).alias("preferred"),
        ratio(2 * tp, tp + fp + positives).alias("f1"),
        recall.alias("recall"),
        ratio(tp, tp + fp).alias("precision"),
        F.col("score").alias("threshold"),
    )
    keys = ["preferred", "f1", "recall", "threshold"] if break_ties_by_recall else ["preferred", "f1", "threshold"]
    best = rows.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(*keys)).alias("b"))
    return best.select(
        F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"),
        *[F.round(f"b.{c}", 6).alias(c) for c in ("precision", "recall", "f1")],
    )


def threshold_under_fpr(df: DataFrame, score: str, label: str, cap: float, tiebreak: str) -> DataFrame:
    """M5: best-F1 row prefix whose false-positive rate is within the cap (all prefixes if none is).

    Equal scores are split in ``tiebreak`` order; the earliest prefix wins ties.
    """
    y = F.col(label).cast("boolean")
    narrow = df.select(F.col(score).alias("threshold"), F.col(tiebreak).alias("_tie"), y.cast("int").alias("y"))
    walked = running(
        narrow, [], [F.col("threshold").desc(), F.col("_tie").asc()],
        {"rank": Running("count"), "tp": Running("sum", F.col("y"))},
    )
    totals = narrow.agg(
        F.greatest(F.lit(1), F.sum("y")).alias("P"), F.greatest(F.lit(1), F.count_if(F.col("y") == 0)).alias("N")
    )
    tp, fp = F.col("tp"), F.col("rank") - F.col("tp")
    rows = walked.crossJoin(F.broadcast(totals)).select(
        "threshold", "rank",
        ratio(tp, F.col("rank")).alias("precision"),
        ratio(tp, F.col("P")).alias("recall"),
        ratio(2 * tp, F.col("rank") + F.col("P")).alias("f1"),
        ratio(fp, F.col("N")).alias("false_positive_rate"),
    )
    key = F.struct((F.col("false_positive_rate") <= cap).alias("ok"), F.col("f1"), (-F.col("rank")).alias("early"))
    best = rows.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1", "false_positive_rate"), key).alias("b"))
    return best.select(
        "b.threshold", *[F.round(f"b.{c}", 6).alias(c) for c in ("precision", "recall", "f1", "false_positive_rate")]
    )


def threshold_for_budget(df: DataFrame, score: str, budget: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """M6: the budget-th largest score; infinity for no budget and 0 when every row fits.

    ``budget`` may be an expression over ``_rows``, the number of rows of the group.
    """
    by = list(by)
    rows = df.groupBy(*by).agg(F.count(score).alias("_rows"))
    cells = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count(score).alias("_n")).where(F.col("_s").isNotNull())
    walked = running(cells, by, [F.col("_s").desc()], {"_cum": Running("sum", F.col("_n"))})
    want = budget if isinstance(budget, Column) else F.lit(int(budget))
    joined = join_groups([walked, rows], by) if by else walked.crossJoin(F.broadcast(rows))
    picked = joined.groupBy(*by).agg(
        F.max(F.when(F.col("_cum") >= want, F.col("_s"))).alias("_t"), F.max(want).alias("_b"), F.max("_rows").alias("_rows")
    )
    return picked.select(
        *by,
        F.when(F.coalesce("_b", F.lit(0)) <= 0, F.lit(float("inf")))
        .when(F.col("_b") >= F.col("_rows"), F.lit(0.0))
        .otherwise(F.col("_t"))
        .alias("threshold"),
    )


def value_weighted_recall(df: DataFrame, label: str, flag: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """M7: flagged share of the positive value."""
    y, v = F.col(label), F.col(value)
    return df.groupBy(*by).agg(
        F.round(ratio(sum_if(y & F.col(flag), v), sum_if(y, v)), 6).alias("value_weighted_recall")
    )


def brier_scores(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M8: Brier score, the score of always predicting the base rate, and the skill over it."""
    y = F.col(label).cast("int").cast("double")
    base = df.groupBy(*by).agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("b"), F.avg(y).alias("p"))
    null = F.col("p") * (1 - F.col("p"))
    return base.select(
        *by,
        F.round("b", 8).alias("brier_score"),
        F.round(null, 8).alias("null_brier_score"),
        F.round(F.when(null == 0, F.lit(0.0)).otherwise(1 - F.col("b") / null), 6).alias("brier_skill_score"),
    )


def equal_count_bin(index: Column, rows: Column, bins: int) -> Column:
    """Bin of a 0-based position when rows are dealt into ``bins`` runs, larger runs first."""
    q, r = F.floor(rows / bins), rows % bins
    edge = r * (q + 1)
    return F.when(index < edge, F.floor(index / (q + 1))).otherwise(
        r + F.floor((index - edge) / F.greatest(q, F.lit(1)))
    ).cast("long")


def calibration_bins(
    df: DataFrame, score: str, label: str, tiebreak: str, bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Rows, mean score and observed rate of equal-count score bins."""
    by = list(by)
    narrow = df.select(*by, F.col(score).alias("_s"), F.col(tiebreak).alias("_tie"), F.col(label).cast("int").alias("_y"))
    order = ["_s", "_tie"]
    ranked = group_rank(narrow, by, order, "_rank") if by else global_rank(narrow, order, "_rank")
    rows = narrow.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    joined = join_groups([ranked, rows], by) if by else ranked.crossJoin(F.broadcast(rows))
    return (
        joined.groupBy(*by, equal_count_bin(F.col("_rank") - 1, F.col("_rows"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("_s").alias("mean_score"), F.avg("_y").alias("observed_rate"))
    )


def expected_calibration_error(
    df: DataFrame, score: str, label: str, tiebreak: str, bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """M9: row-weighted gap between mean score and observed rate over equal-count bins."""
    cells = calibration_bins(df, score, label, tiebreak, bins, by)
    gap = F.sum(F.col("rows") * F.abs(F.col("mean_score") - F.col("observed_rate"))) / F.sum("rows")
    return cells.groupBy(*by).agg(F.round(gap, 8).alias("expected_calibration_error"))


def wilson_interval(successes: Column, total: Column) -> tuple[Column, Column]:
    """95 % Wilson bounds, clamped to [0, 1]; null when there are no trials."""
    n, z2 = total.cast("double"), F.lit(WILSON_Z * WILSON_Z)
    p = successes / n
    centre = p + z2 / (2 * n)
    margin = F.lit(WILSON_Z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    low = F.round(F.greatest(F.lit(0.0), (centre - margin) / scale), 6)
    high = F.round(F.least(F.lit(1.0), (centre + margin) / scale), 6)
    return F.when(total > 0, low), F.when(total > 0, high)


#: Cells of a segment that are drawn and summed at once.
_DRAWN = 1 << 12


def cell_draws(scores: np.ndarray, counts: np.ndarray, repeats: int, seed: int) -> np.ndarray:
    """(cells, 2, repeats) Poisson counts with the cells' positives and negatives as means, by score and seed alone."""
    out = np.empty((len(scores), 2, repeats))
    for i, (key, mean) in enumerate(zip((scores + 0.0).view(np.uint64).tolist(), counts, strict=True)):
        out[i] = np.random.Generator(np.random.Philox(key=[seed, key])).poisson(mean[:, None], (2, repeats))
    return out


def _drawn(cells: pd.DataFrame, repeats: int, seed: int) -> Iterator[np.ndarray]:
    cells = cells.sort_values("_pos")
    for k in range(0, len(cells), _DRAWN):
        part = cells.iloc[k:k + _DRAWN]
        yield cell_draws(part["score"].to_numpy(np.float64), part[["pos", "neg"]].to_numpy(np.float64), repeats, seed)


def bootstrap_pr_auc(df: DataFrame, score: str, label: str, row_id: str | None = None, repeats: int = 200, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of the average precision.

    A row weighs Poisson(1) in a replicate, the distributed form of resampling each class with replacement; rows of one score and
    class are drawn together, as the sum of n such weights is Poisson(n). So the table of distinct scores is sorted once, and every
    segment of it handles all replicates as arrays: first its totals, then, with the totals of the segments before, its part of
    each replicate's step sum. ``row_id`` is not needed and kept for callers that name it.
    """
    scored = df.where(F.col(score).isNotNull())
    hit = F.col(label).cast("boolean")
    cells = scored.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(hit).alias("pos"), (F.count(F.lit(1)) - F.count_if(hit)).alias("neg"))
    cells = ordered_segments(cells, [F.col("score").desc()])

    def totals(cells: pd.DataFrame) -> pd.DataFrame:
        both = sum(d.sum(axis=0) for d in _drawn(cells, repeats, seed))
        return pd.DataFrame({"_seg": cells["_seg"].iloc[0], "replicate": np.arange(repeats), "tp": both[0], "fp": both[1]})

    sums = pin(cells.groupBy("_seg").applyInPandas(totals, "_seg long, replicate int, tp double, fp double"), "bootstrap-totals")
    before = Window.partitionBy("replicate").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    carries = sums.select(
        F.col("_seg").alias("_of"), "replicate", F.coalesce(F.sum("tp").over(before), zero).alias("tp"), F.coalesce(F.sum("fp").over(before), zero).alias("fp"))

    def steps(cells: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        carry = carry.sort_values("replicate")
        seen, part = carry[["tp", "fp"]].to_numpy().T, np.zeros(repeats)
        for draws in _drawn(cells, repeats, seed):
            running = seen + np.cumsum(draws, axis=0)
            part += (draws[:, 0] * running[:, 0] / np.maximum(running.sum(axis=1), 1)).sum(axis=0)
            seen = running[-1]
        return pd.DataFrame({"replicate": np.arange(repeats), "part": part})

    parts = cells.groupBy("_seg").cogroup(carries.groupBy("_of")).applyInPandas(steps, "replicate int, part double")
    classes = sums.groupBy("replicate").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    estimates = parts.groupBy("replicate").agg(F.sum("part").alias("part")).join(classes, "replicate").select(
        F.when((F.col("tp") > 0) & (F.col("fp") > 0), F.round(F.col("part") / F.col("tp"), 6)).alias("pr_auc"))
    # One value per replicate: the sort below holds at most ``repeats`` numbers.
    return estimates.agg(
        F.round(F.percentile("pr_auc", F.lit(0.025)), 6).alias("pr_auc_low"),
        F.round(F.percentile("pr_auc", F.lit(0.975)), 6).alias("pr_auc_high"),
        F.count("pr_auc").alias("replicates"),
    )


def top_fraction_capture(
    df: DataFrame, score: str, label: str, tiebreak: str, fractions: Sequence[float] = (0.001, 0.005, 0.01)
) -> DataFrame:
    """Positives found in the top-scored fraction of rows."""
    y = F.col(label).cast("int")
    narrow = df.select(F.col(score).alias("_s"), F.col(tiebreak).alias("_tie"), y.alias("_y"))
    ranked = global_rank(narrow, [F.col("_s").desc(), F.col("_tie").asc()], "_rank")
    totals = narrow.agg(F.count(F.lit(1)).alias("_rows"), F.greatest(F.lit(1), F.sum("_y")).alias("_pos"))
    options = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    cuts = totals.select("*", options.alias("fraction")).withColumn(
        "review_count", F.greatest(F.lit(1), F.ceil(F.col("_rows") * F.col("fraction"))).cast("long")
    )
    # One small row of cut points joins every row; captured counts come from one aggregation.
    wide = cuts.agg(*[
        F.max(F.when(F.col("fraction") == f, F.col("review_count"))).alias(f"_cut{i}") for i, f in enumerate(fractions)
    ])
    caught = ranked.crossJoin(F.broadcast(wide)).agg(*[
        F.sum(F.when(F.col("_rank") <= F.col(f"_cut{i}"), F.col("_y")).otherwise(0)).alias(f"_got{i}")
        for i in range(len(fractions))
    ])
    got = None
    for i, f in enumerate(fractions):
        got = (F.when if got is None else got.when)(F.col("fraction") == f, F.col(f"_got{i}"))
    return cuts.crossJoin(F.broadcast(caught)).select(
        "fraction", "review_count", got.alias("fraud_captured"), F.round(got / F.col("_pos"), 6).alias("recall")
    )


def full_metrics(
    df: DataFrame, score: str, label: str, flag: str, value: str, tiebreak: str, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion rates, both areas, Brier, calibration and value recall per group."""
    frames = [
        confusion_metrics(df, label, flag, by),
        curve_areas(df, score, label, by),
        brier_scores(df, score, label, by),
        expected_calibration_error(df, score, label, tiebreak, 10, by),
        value_weighted_recall(df, label, flag, value, by),
    ]
    return join_groups(frames, by)


def temporal_slices(df: DataFrame, time_order: Sequence[str], name: str = "slice") -> DataFrame:
    """Tag rows of the earlier and the later half of the time order."""
    ranked = global_rank(df, list(time_order), "_rank")
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    return ranked.crossJoin(F.broadcast(rows)).select(
        *df.columns,
        F.when(F.col("_rank") <= F.floor(F.col("_rows") / 2), F.lit("early_test")).otherwise(F.lit("late_test")).alias(name),
    )


def metrics_by_family(df: DataFrame, dim: str = "attack_family") -> DataFrame:
    """Events, detections, recall, mean score and value recall of each attack family."""
    flag = F.col("predicted_fraud")
    return (
        df.where(F.col("label_fraud") & F.col(dim).isNotNull()).groupBy(dim)
        .agg(
            F.count(F.lit(1)).alias("events"), n_if(flag).alias("detected"),
            F.round(F.avg(flag.cast("int")), 6).alias("recall"),
            F.round(F.avg("risk_score"), 6).alias("mean_risk_score"),
            F.round(ratio(sum_if(flag, F.col("value_at_risk_inr")), F.sum("value_at_risk_inr")), 6).alias("value_weighted_recall"),
        )
    )


def metrics_by_vector(df: DataFrame, dim: str, split: str, order: Sequence[str]) -> DataFrame:
    """Per attack vector, with the split of its first row."""
    return (
        df.where(F.col("label_fraud") & F.col(dim).isNotNull()).groupBy(dim)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.round(F.avg(F.col("predicted_fraud").cast("int")), 6).alias("recall"),
            F.round(F.avg("risk_score"), 6).alias("mean_risk_score"),
            F.min_by(split, F.struct(*order)).alias("split"),
        )
    )


def metrics_by_phase(df: DataFrame, dim: str = "lifecycle_phase") -> DataFrame:
    """Precision, recall and false-positive rate of each lifecycle phase."""
    out = confusion_metrics(df.where(F.col(dim).isNotNull()), "label_fraud", "predicted_fraud", [dim])
    events = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select(dim, events.alias("events"), "precision", "recall", "false_positive_rate")


def metrics_by_legitimate_profile(df: DataFrame, profile: str = "legitimate_control") -> DataFrame:
    """False positives of each legitimate profile; rows without one are ORDINARY."""
    flag = F.col("predicted_fraud")
    return (
        df.where(~F.col("label_fraud")).groupBy(F.coalesce(F.col(profile), F.lit("ORDINARY")).alias("profile"))
        .agg(
            F.count(F.lit(1)).alias("events"), n_if(flag).alias("false_positives"),
            F.round(F.avg(flag.cast("int")), 6).alias("false_positive_rate"),
        )
    )


def hard_vs_ordinary_fpr(df: DataFrame, role: str = "case_role", flag: str = "predicted_fraud") -> DataFrame:
    """Flag rates of legitimate controls and of ordinary legitimate rows."""
    hard, plain = F.col(role) == "legitimate_control", F.col(role) == "ordinary_legitimate"
    return df.agg(
        F.round(ratio(n_if(hard & F.col(flag)), n_if(hard)), 6).alias("hard_false_positive_rate"),
        F.round(ratio(n_if(plain & F.col(flag)), n_if(plain)), 6).alias("ordinary_false_positive_rate"),
        n_if(hard).alias("hard_control_event_count"),
    )


def chain_outcomes(df: DataFrame, alert: str = "alert", by: Sequence[str] = ()) -> DataFrame:
    """One row per chain: attack, caught, family, first alert and first contributing stage."""
    seq, fraud = F.col("sequence"), F.col("fraud_contributing")
    valued = fraud & (F.coalesce(F.col("value_at_risk_inr"), F.lit(0.0)) > 0)
    key = F.coalesce(F.col("chain_id").cast("string"), F.concat(F.lit("solo_"), F.col("event_id").cast("string")))
    chains = df.groupBy(*by, key.alias("chain_key")).agg(
        F.bool_or("is_attack").alias("is_attack"),
        F.bool_or(alert).alias("caught"),
        F.min_by("attack_family", F.when(F.col("attack_family").isNotNull(), seq)).alias("attack_family"),
        F.min(F.when(F.col(alert), seq)).alias("first_alert"),
        F.coalesce(F.min(F.when(valued, seq)), F.min(F.when(fraud, seq))).alias("first_malicious"),
    )
    in_time = F.col("first_malicious").isNull() | (F.col("first_alert") <= F.col("first_malicious"))
    return chains.withColumn("prevented", F.col("is_attack") & F.col("caught") & in_time)


def chain_summary(df: DataFrame, alert: str = "alert", by: Sequence[str] = ()) -> DataFrame:
    """Chain-level detection report with row metrics and legitimate alert rates."""
    attack, caught = F.col("is_attack"), F.col("caught")
    got, every = n_if(attack & caught), n_if(attack)
    legit = n_if(~attack & caught)
    chains = chain_outcomes(df, alert, by).groupBy(*by).agg(
        F.round(ratio(got, every), 4).alias("chain_recall"),
        got.alias("chains_caught"), every.alias("chains_total"),
        F.round(ratio(n_if(F.col("prevented")), got), 4).alias("prevented_share"),
        F.round(F.avg(F.when(attack & caught, F.col("first_alert"))), 3).alias("mean_caught_at_stage"),
        F.round(ratio(got, got + legit), 4).alias("chain_precision"),
        legit.alias("legit_chains_alerted"),
    )
    y, a = F.col("label") == 1, F.col(alert)
    control, ambient = F.col("source") == "control", F.col("source") == "ambient"
    rows = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_test"), n_if(y).alias("fraud_rows"), n_if(a).alias("alerts"),
        F.round(ratio(n_if(y & a), n_if(y)), 4).alias("row_recall"),
        F.round(ratio(n_if(y & a), n_if(a)), 4).alias("row_precision"),
        F.round(ratio(n_if(control & a), n_if(control)), 5).alias("hard_false_positive_rate"),
        F.round(ratio(n_if(ambient & a), n_if(ambient)), 5).alias("ambient_friction_rate"),
    )
    return join_groups([chains, rows], by)


def chain_recall_by_family(df: DataFrame, alert: str = "alert", by: Sequence[str] = ()) -> DataFrame:
    """Share of caught chains per attack family."""
    return (
        chain_outcomes(df, alert, by)
        .where(F.col("is_attack") & F.col("attack_family").isNotNull())
        .groupBy(*by, "attack_family")
        .agg(F.round(F.avg(F.col("caught").cast("int")), 4).alias("chain_recall"), F.count(F.lit(1)).alias("chains"))
    )


def fold_aggregate(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over folds, nulls skipped, as rows."""
    long = folds.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    ).select("m.*")
    return (
        long.where(F.col("value").isNotNull()).groupBy("metric")
        .agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))
    )


def split_summary(df: DataFrame, split: str, label: str, time: str) -> DataFrame:
    """Rows, positives, prevalence and time range of each split."""
    y = F.col(label).cast("int")
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(y).alias("frauds"), F.round(F.avg(y), 8).alias("fraud_prevalence"),
        F.round(F.min(time), 3).alias("time_min_seconds"), F.round(F.max(time), 3).alias("time_max_seconds"),
    )


def kpi_rollup(values: Mapping[str, tuple[str, DataFrame, str, str | None]]) -> DataFrame:
    """Metric rows (section, metric, value, target) from one-row metric frames.

    ``values`` maps the metric name to (section, frame, column of the frame, target text).
    """
    rows = [
        frame.select(
            F.lit(section).alias("section"), F.lit(name).alias("metric"),
            F.col(column).cast("double").alias("value"), F.lit(target).cast("string").alias("target"),
        )
        for name, (section, frame, column, target) in values.items()
    ]
    return reduce(DataFrame.unionByName, rows)
