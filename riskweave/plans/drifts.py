"""Registered queries of calibration, drift and prequential evaluation, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import calibration as k
from riskweave.operators import drift as x
from riskweave.plans.graphs import recursive
from riskweave.plans.registry import Tables, query
from riskweave.plans.views import with_views

#: Production parameters of the queries.
DELTA, ALARM = 0.005, 50.0
GENERATION, EMBARGO = 2 * 86_400, 86_400
THRESHOLD = 0.5

# Block values by the min-max formula: for each score the largest, over all beginnings at or below it, of the least mean up to any end at or above it.
_ISOTONIC = {
    "cells": "SELECT risk_score AS s, count(*) AS n, sum(CAST(label_fraud AS INT)) AS p, row_number() OVER (ORDER BY risk_score) AS i FROM predictions GROUP BY 1",
    "sums": "SELECT s, i, sum(n) OVER (ORDER BY i) AS n, sum(p) OVER (ORDER BY i) AS p FROM cells",
    "starts": "SELECT i + 1 AS a, n, p FROM sums UNION ALL SELECT 1, 0, 0",
    "means": "SELECT a, i AS b, (e.p - b.p) / CAST(e.n - b.n AS DOUBLE) AS m FROM starts b JOIN sums e ON e.i >= a",
    "least": "SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM means",
    "fitted": "SELECT i, max(m) AS value FROM least GROUP BY i",
}


@query("X8_isotonic_calibration", with_views(
    "SELECT event_id, round(value, 9) AS calibrated FROM predictions JOIN sums ON s = risk_score JOIN fitted USING (i)", "predictions", **_ISOTONIC))
def _(t: Tables):
    """Calibrated probability of every prediction by isotonic regression."""
    rows = t("predictions").select("event_id", "risk_score", "label_fraud")
    out = k.isotonic_calibrate(rows, k.isotonic_blocks(rows, "risk_score", "label_fraud"), "risk_score")
    return out.select("event_id", F.round("calibrated", 9).alias("calibrated"))


@query("X8_isotonic_blocks", with_views(
    "SELECT round(value, 9) AS value, max(s) AS upto, sum(cells.n) AS n, sum(cells.p) AS pos FROM fitted JOIN cells USING (i) GROUP BY 1".replace("sum(cells.n)", "CAST(sum(cells.n) AS BIGINT)").replace(
        "sum(cells.p)", "CAST(sum(cells.p) AS BIGINT)"), "predictions", **_ISOTONIC))
def _(t: Tables):
    """Blocks of the calibration: highest score, rows, positives, value."""
    return k.isotonic_blocks(t("predictions"), "risk_score", "label_fraud").select(F.round("value", 9).alias("value"), "upto", "n", "pos")


_DRIFT = {
    "seen": "SELECT event_id, payment_rail, event_ts, CAST(amount_inr AS DECIMAL(28, 6)) AS x, "
            "CAST(sum(CAST(amount_inr AS DECIMAL(28, 6))) OVER w AS DOUBLE) / count(amount_inr) OVER w AS mean_so_far "
            "FROM pay_events WINDOW w AS (PARTITION BY payment_rail ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING)",
    "stepped": f"SELECT *, sum(coalesce(CAST(floor((CAST(x AS DOUBLE) - mean_so_far - CAST({DELTA} AS DOUBLE)) * 1e6 + 5e-1) AS DECIMAL(28, 0)), 0)) OVER "
               "(PARTITION BY payment_rail ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM seen",
    "tested": "SELECT *, CAST(total - least(0, min(total) OVER (PARTITION BY payment_rail ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING)) AS DOUBLE) / 1e6 AS drift_statistic FROM stepped",
}


@query("X9_page_hinkley", with_views(
    f"SELECT event_id, round(mean_so_far, 6) AS mean_so_far, drift_statistic, drift_statistic > {ALARM} AS drift FROM tested", "pay_events", **_DRIFT))
def _(t: Tables):
    """Page-Hinkley statistic of the amounts of each rail in order of time."""
    rows = t("pay_events").select("event_id", "payment_rail", "event_ts", "amount_inr")
    out = x.page_hinkley(rows, ["payment_rail"], ["event_ts", "event_id"], "amount_inr", DELTA, ALARM)
    return out.select("event_id", F.round("mean_so_far", 6).alias("mean_so_far"), "drift_statistic", "drift")


@query("X9_first_drift", with_views(
    f"SELECT payment_rail, count(*) AS rows, max(drift_statistic) AS highest_statistic, arg_min(event_ts, (event_ts, event_id)) FILTER (drift_statistic > {ALARM}) AS first_event_ts, "
    f"arg_min(event_id, (event_ts, event_id)) FILTER (drift_statistic > {ALARM}) AS first_event_id FROM tested GROUP BY 1", "pay_events", **_DRIFT))
def _(t: Tables):
    """First alarm of each rail."""
    rows = t("pay_events").select("event_id", "payment_rail", "event_ts", "amount_inr")
    return x.first_drift(x.page_hinkley(rows, ["payment_rail"], ["event_ts", "event_id"], "amount_inr", DELTA, ALARM), ["payment_rail"], ["event_ts", "event_id"])


@query("X10_labels_known", with_views(
    f"SELECT a.event_id, count(b.event_id) AS labels_known, count(b.event_id) FILTER (b.label_fraud) AS positives_known FROM predictions a LEFT JOIN predictions b "
    f"ON b.payment_rail = a.payment_rail AND epoch_us(b.event_ts) + {EMBARGO * 1_000_000} <= epoch_us(a.event_ts) GROUP BY 1", "predictions"))
def _(t: Tables):
    """Labels of the rail that were known when each event was scored, a day after their event."""
    return x.labels_known(t("predictions"), "event_ts", "label_fraud", "event_id", EMBARGO, ["payment_rail"])


@query("X10_prequential_report", with_views(
    "SELECT h.generation, t.train_rows, t.train_positives, h.rows, h.positives, h.true_positives, h.false_positives, "
    "round(CASE WHEN true_positives + false_positives = 0 THEN 0 ELSE true_positives / (true_positives + false_positives) END, 9) AS precision, "
    "round(CASE WHEN positives = 0 THEN 0 ELSE true_positives / positives END, 9) AS recall, round(brier, 9) AS brier, "
    "round(CASE WHEN train_rows > 0 THEN (positives * (1 - train_positives / train_rows) ^ 2 + (rows - positives) * (train_positives / train_rows) ^ 2) / rows END, 9) AS brier_of_known_rate "
    "FROM held h JOIN trained t USING (generation)", "predictions",
    timed=f"SELECT *, epoch_us(event_ts) // {GENERATION * 1_000_000} AS generation FROM predictions",
    held="SELECT generation, count(*) AS rows, count(*) FILTER (label_fraud) AS positives, "
         f"count(*) FILTER (label_fraud AND risk_score >= {THRESHOLD}) AS true_positives, count(*) FILTER (NOT label_fraud AND risk_score >= {THRESHOLD}) AS false_positives, "
         "CAST(sum(CAST(floor((risk_score - CAST(label_fraud AS INT)) * (risk_score - CAST(label_fraud AS INT)) * 1e9 + 5e-1) AS DECIMAL(28, 0))) AS DOUBLE) / 1e9 / count(*) AS brier FROM timed GROUP BY 1",
    trained="SELECT h.generation, count(p.event_id) AS train_rows, count(p.event_id) FILTER (p.label_fraud) AS train_positives FROM held h "
            f"LEFT JOIN predictions p ON epoch_us(p.event_ts) + {EMBARGO * 1_000_000} <= h.generation * {GENERATION * 1_000_000} GROUP BY 1"))
def _(t: Tables):
    """Two-day generations, each held out from the labels known at its start."""
    out = x.prequential_report(t("predictions"), "event_ts", "label_fraud", "risk_score", GENERATION, EMBARGO, THRESHOLD)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "brier", "brier_of_known_rate")})


# Share of first payments to a beneficiary, by rail and half day: it falls as accounts settle on their payees.
_FIRST_USE = (
    "SELECT event_id, payment_rail, event_ts, row_number() OVER (PARTITION BY sender_account_id, beneficiary_id ORDER BY event_ts, event_id) = 1 AS first_use FROM pay_events")
HALF_DAY, CONFIDENCE, UNMERGED = 43_200, 0.05, 1_000


@query("X11_adwin", recursive(with_views(
    "SELECT payment_rail, period, rate, i - start + 1 AS window_size, (SELECT round(avg(rate), 9) FROM series s WHERE s.payment_rail = w.payment_rail AND s.i BETWEEN w.start AND w.i) AS window_mean, "
    "start > previous AS drift FROM windows w JOIN series USING (payment_rail, i)",
    "pay_events", first_use=_FIRST_USE,
    series=f"SELECT payment_rail, epoch_us(event_ts) // {HALF_DAY * 1_000_000} AS period, avg(CAST(first_use AS INT)) AS rate, row_number() OVER (PARTITION BY payment_rail ORDER BY period) AS i FROM first_use GROUP BY payment_rail, period",
    parts="SELECT a.payment_rail, a.i AS s, c.i AS c, b.i AS e, (c.p - a.p + a.rate) / (c.i - a.i + 1) AS m0, (b.p - c.p) / (b.i - c.i) AS m1 FROM (SELECT *, sum(rate) OVER (PARTITION BY payment_rail ORDER BY i) AS p FROM series) a "
          "JOIN (SELECT *, sum(rate) OVER (PARTITION BY payment_rail ORDER BY i) AS p FROM series) c ON c.payment_rail = a.payment_rail AND c.i >= a.i "
          "JOIN (SELECT *, sum(rate) OVER (PARTITION BY payment_rail ORDER BY i) AS p FROM series) b ON b.payment_rail = a.payment_rail AND b.i > c.i",
    bad=f"SELECT DISTINCT payment_rail, s, e FROM parts WHERE abs(m0 - m1) >= sqrt(ln(4 * (e - s + 1) / {CONFIDENCE}) / 2 * (1 / CAST(c - s + 1 AS DOUBLE) + 1 / CAST(e - c AS DOUBLE)))",
    fine="SELECT a.payment_rail, a.i AS s, b.i AS e FROM series a JOIN series b ON b.payment_rail = a.payment_rail AND b.i >= a.i WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.payment_rail = a.payment_rail AND bad.s = a.i AND bad.e = b.i)",
    windows="SELECT DISTINCT payment_rail, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS start, CAST(1 AS BIGINT) AS previous FROM series UNION ALL "
            "SELECT w.payment_rail, w.i + 1, min(f.s), any_value(w.start) FROM windows w JOIN fine f ON f.payment_rail = w.payment_rail AND f.e = w.i + 1 AND f.s >= w.start GROUP BY w.payment_rail, w.i")))
def _(t: Tables):
    """Adaptive windows over the share of first payments; without merged buckets, so that every cut is looked at."""
    rows = t.spark.sql(_FIRST_USE.replace("FROM pay_events", "FROM {pay_events}"), pay_events=t("pay_events"))
    series = x.rate_series(rows, ["payment_rail"], "event_ts", HALF_DAY, F.col("first_use"))
    return x.adwin(series, ["payment_rail"], "period", "rate", CONFIDENCE, UNMERGED).select(
        "payment_rail", "period", "rate", "window_size", F.round("window_mean", 9).alias("window_mean"), "drift")
