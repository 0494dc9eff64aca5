"""Registered queries: detection metrics (M) and splits (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import metrics as m
from riskweave.operators import splits as s
from riskweave.plans.registry import Tables, query
from riskweave.plans.views import with_views

_CONF = """
count(*) FILTER (WHERE label_fraud AND predicted_fraud) AS tp, count(*) FILTER (WHERE NOT label_fraud AND predicted_fraud) AS fp,
count(*) FILTER (WHERE label_fraud AND NOT predicted_fraud) AS fn, count(*) FILTER (WHERE NOT label_fraud AND NOT predicted_fraud) AS tn
"""
_RATES = """
round(CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
round(CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1,
round(CASE WHEN fp + tn = 0 THEN 0e0 ELSE fp / CAST(fp + tn AS DOUBLE) END, 6) AS false_positive_rate
"""
_CURVE = """
SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp
FROM (SELECT risk_score AS score, count(*) FILTER (WHERE label_fraud) AS pos, count(*) FILTER (WHERE NOT label_fraud) AS neg
      FROM predictions GROUP BY 1) c
"""
_TRAIN_ROWS = """
SELECT event_id, event_ts, CASE WHEN event_id % 10 = 0 THEN NULL ELSE case_id END AS chain_id, sequence, attack_family, label_fraud AS is_attack,
       label_fraud AND lifecycle_phase <> 'pre_transaction' AS fraud_contributing, value_at_risk_inr,
       CASE WHEN label_fraud AND lifecycle_phase <> 'pre_transaction' THEN 1 ELSE 0 END AS label, risk_score,
       CASE WHEN label_fraud THEN 'attack' WHEN event_id % 10 = 0 THEN 'ambient' ELSE 'control' END AS source,
       risk_score >= 5e-1 AS alert, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS fold
FROM predictions
"""


def train_rows(t: Tables):
    return t.spark.sql(_TRAIN_ROWS.replace("predictions", "{predictions}"), predictions=t("predictions"))


@query("M1_confusion_metrics", with_views(f"SELECT *, {_RATES} FROM (SELECT {_CONF} FROM predictions) q", "predictions"))
def _(t: Tables):
    return m.confusion_metrics(t("predictions"), "label_fraud", "predicted_fraud")


@query("X2_score_curve", with_views("SELECT score, pos, neg, tp, fp FROM curve", "predictions", curve=_CURVE))
def _(t: Tables):
    return m.score_curve(t("predictions"), "risk_score", "label_fraud")


@query(
    "M2_average_precision",
    with_views("SELECT round(sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / sum(pos), 6) AS pr_auc FROM curve", "predictions", curve=_CURVE),
)
def _(t: Tables):
    return m.average_precision(t("predictions"), "risk_score", "label_fraud")


@query(
    "M3_roc_auc",
    with_views(
        "SELECT round(sum(r) / CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM predictions WHERE NOT label_fraud), 6) AS roc_auc FROM "
        "(SELECT (SELECT count(*) FROM predictions n WHERE NOT n.label_fraud AND n.risk_score < p.risk_score) + "
        "(SELECT count(*) FROM predictions n WHERE NOT n.label_fraud AND n.risk_score = p.risk_score) / CAST(2 AS DOUBLE) AS r "
        "FROM predictions p WHERE p.label_fraud) q",
        "predictions",
    ),
)
def _(t: Tables):
    return m.roc_auc(t("predictions"), "risk_score", "label_fraud")


def _m4(order: str) -> str:
    return with_views(
        "SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ("
        "SELECT score AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(p AS DOUBLE) AS recall, "
        "2 * tp / CAST(tp + fp + p AS DOUBLE) AS f1 FROM curve, (SELECT sum(pos) AS p FROM curve) s) q "
        f"ORDER BY precision >= 9e-1 DESC, {order} LIMIT 1",
        "predictions", curve=_CURVE,
    )


@query("M4_threshold_f1_precision", _m4("f1 DESC, recall DESC, threshold DESC"))
def _(t: Tables):
    return m.threshold_f1_precision(t("predictions"), "risk_score", "label_fraud")


@query("M4_threshold_f1_baseline", _m4("f1 DESC, threshold DESC"))
def _(t: Tables):
    return m.threshold_f1_precision(t("predictions"), "risk_score", "label_fraud", break_ties_by_recall=False)


@query(
    "M5_threshold_under_fpr",
    with_views(
        "SELECT threshold, round(tp / CAST(rn AS DOUBLE), 6) AS precision, round(tp / CAST(p AS DOUBLE), 6) AS recall, "
        "round(2 * tp / CAST(rn + p AS DOUBLE), 6) AS f1, round((rn - tp) / CAST(n AS DOUBLE), 6) AS false_positive_rate FROM ("
        "SELECT risk_score AS threshold, row_number() OVER w AS rn, count(*) FILTER (WHERE label_fraud) OVER w AS tp FROM predictions "
        "WINDOW w AS (ORDER BY risk_score DESC, event_id ROWS UNBOUNDED PRECEDING)) r, "
        "(SELECT count(*) FILTER (WHERE label_fraud) AS p, count(*) FILTER (WHERE NOT label_fraud) AS n FROM predictions) s "
        "ORDER BY (rn - tp) / CAST(n AS DOUBLE) <= 2e-2 DESC, 2 * tp / CAST(rn + p AS DOUBLE) DESC, rn LIMIT 1",
        "predictions",
    ),
)
def _(t: Tables):
    return m.threshold_under_fpr(t("predictions"), "risk_score", "label_fraud", 0.02, "event_id")


@query(
    "M6_threshold_for_budget",
    with_views("SELECT min(risk_score) AS threshold FROM (SELECT risk_score FROM predictions ORDER BY risk_score DESC LIMIT 500) q", "predictions"),
)
def _(t: Tables):
    return m.threshold_for_budget(t("predictions"), "risk_score", 500)


@query(
    "M6_threshold_for_budget_by_rail",
    with_views(
        "SELECT payment_rail, min(risk_score) AS threshold FROM (SELECT payment_rail, risk_score, "
        "row_number() OVER (PARTITION BY payment_rail ORDER BY risk_score DESC) AS rn, count(*) OVER (PARTITION BY payment_rail) AS n "
        "FROM predictions) q WHERE rn <= greatest(1, CAST(round(n * 1e-2) AS BIGINT)) GROUP BY 1", "predictions"),
)
def _(t: Tables):
    budget = F.greatest(F.lit(1), F.round(F.col("_rows") * 0.01).cast("long"))
    return m.threshold_for_budget(t("predictions"), "risk_score", budget, ["payment_rail"])


_VWR = (
    "round(sum(CASE WHEN label_fraud AND predicted_fraud THEN value_at_risk_inr ELSE 0e0 END) / "
    "sum(CASE WHEN label_fraud THEN value_at_risk_inr ELSE 0e0 END), 6) AS value_weighted_recall"
)


@query("M7_value_weighted_recall", with_views(f"SELECT {_VWR} FROM predictions", "predictions"))
def _(t: Tables):
    return m.value_weighted_recall(t("predictions"), "label_fraud", "predicted_fraud", "value_at_risk_inr")


_BRIER = (
    "round(b, 8) AS brier_score, round(p * (1 - p), 8) AS null_brier_score, round(1 - b / (p * (1 - p)), 6) AS brier_skill_score"
)
_BRIER_BASE = "avg(power(risk_score - CAST(CAST(label_fraud AS INT) AS DOUBLE), 2)) AS b, avg(CAST(CAST(label_fraud AS INT) AS DOUBLE)) AS p"


@query("M8_brier_scores", with_views(f"SELECT {_BRIER} FROM (SELECT {_BRIER_BASE} FROM predictions) q", "predictions"))
def _(t: Tables):
    return m.brier_scores(t("predictions"), "risk_score", "label_fraud")


@query(
    "M9_expected_calibration_error",
    with_views(
        "SELECT round(sum(n * abs(c - o)) / sum(n), 8) AS expected_calibration_error FROM ("
        "SELECT b, count(*) AS n, avg(risk_score) AS c, avg(CAST(CAST(label_fraud AS INT) AS DOUBLE)) AS o FROM ("
        "SELECT risk_score, label_fraud, ntile(10) OVER (ORDER BY risk_score, event_id) AS b FROM predictions) r GROUP BY b) q", "predictions"),
)
def _(t: Tables):
    return m.expected_calibration_error(t("predictions"), "risk_score", "label_fraud", "event_id")


@query(
    "M10_wilson_interval",
    with_views(
        "SELECT lifecycle_phase, k, n, round(greatest(0e0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, "
        "round(least(1e0, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM ("
        "SELECT lifecycle_phase, CAST(count(*) FILTER (WHERE predicted_fraud) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, "
        "CAST('1.959963984540054' AS DOUBLE) AS z FROM predictions GROUP BY 1) q", "predictions"),
)
def _(t: Tables):
    counts = t("predictions").groupBy("lifecycle_phase").agg(
        m.n_if(F.col("predicted_fraud")).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n")
    )
    low, high = m.wilson_interval(F.col("k"), F.col("n"))
    return counts.select("*", low.alias("low"), high.alias("high"))


@query("M11_bootstrap_pr_auc")
def _(t: Tables):
    return m.bootstrap_pr_auc(t("predictions"), "risk_score", "label_fraud", "event_id")


@query(
    "M12_top_fraction_capture",
    with_views(
        "SELECT f AS fraction, greatest(1, CAST(ceil(n * f) AS BIGINT)) AS review_count, "
        "count(*) FILTER (WHERE label_fraud AND rn <= greatest(1, CAST(ceil(n * f) AS BIGINT))) AS fraud_captured, "
        "round(count(*) FILTER (WHERE label_fraud AND rn <= greatest(1, CAST(ceil(n * f) AS BIGINT))) / CAST(p AS DOUBLE), 6) AS recall FROM ("
        "SELECT label_fraud, row_number() OVER (ORDER BY risk_score DESC, event_id) AS rn, count(*) OVER () AS n, "
        "count(*) FILTER (WHERE label_fraud) OVER () AS p FROM predictions) r, (SELECT unnest([1e-3, 5e-3, 1e-2]) AS f) fr GROUP BY f, n, p",
        "predictions"),
)
def _(t: Tables):
    return m.top_fraction_capture(t("predictions"), "risk_score", "label_fraud", "event_id")


_SLICED = (
    "SELECT p.*, CASE WHEN row_number() OVER (ORDER BY event_ts, event_id) <= (SELECT count(*) FROM predictions) // 2 "
    "THEN 'early_test' ELSE 'late_test' END AS slice FROM predictions p"
)


@query(
    "M13_temporal_slices",
    with_views(
        f"SELECT c.slice, tp, fp, fn, tn, {_RATES}, pr_auc, roc_auc, {_BRIER}, expected_calibration_error, value_weighted_recall "
        f"FROM (SELECT slice, {_CONF}, {_BRIER_BASE}, {_VWR} FROM sliced GROUP BY slice) c "
        "JOIN (SELECT slice, round(sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / sum(pos), 6) AS pr_auc, "
        "round(sum(neg * (tp - pos + pos / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS roc_auc FROM ("
        "SELECT slice, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM ("
        "SELECT slice, risk_score, count(*) FILTER (WHERE label_fraud) AS pos, count(*) FILTER (WHERE NOT label_fraud) AS neg FROM sliced GROUP BY 1, 2) g "
        "WINDOW w AS (PARTITION BY slice ORDER BY risk_score DESC)) h GROUP BY slice) a ON a.slice = c.slice "
        "JOIN (SELECT slice, round(sum(n * abs(cf - o)) / sum(n), 8) AS expected_calibration_error FROM (SELECT slice, b, count(*) AS n, "
        "avg(risk_score) AS cf, avg(CAST(CAST(label_fraud AS INT) AS DOUBLE)) AS o FROM (SELECT slice, risk_score, label_fraud, "
        "ntile(10) OVER (PARTITION BY slice ORDER BY risk_score, event_id) AS b FROM sliced) r GROUP BY 1, 2) q GROUP BY 1) e ON e.slice = c.slice",
        "predictions", sliced=_SLICED),
)
def _(t: Tables):
    sliced = m.temporal_slices(t("predictions"), ["event_ts", "event_id"])
    return m.full_metrics(sliced, "risk_score", "label_fraud", "predicted_fraud", "value_at_risk_inr", "event_id", ["slice"])


_FAMILY = (
    "count(*) AS events, count(*) FILTER (WHERE predicted_fraud) AS detected, round(avg(CAST(CAST(predicted_fraud AS INT) AS DOUBLE)), 6) AS recall, "
    "round(avg(risk_score), 6) AS mean_risk_score, round(sum(CASE WHEN predicted_fraud THEN value_at_risk_inr ELSE 0e0 END) / sum(value_at_risk_inr), 6) AS value_weighted_recall"
)


@query("M14_metrics_by_family", with_views(f"SELECT attack_family, {_FAMILY} FROM predictions WHERE label_fraud GROUP BY 1", "predictions"))
def _(t: Tables):
    return m.metrics_by_family(t("predictions"))


@query(
    "M14_metrics_by_vector",
    with_views(
        "SELECT vector, count(*) AS events, round(avg(CAST(CAST(predicted_fraud AS INT) AS DOUBLE)), 6) AS recall, round(avg(risk_score), 6) AS mean_risk_score, "
        "arg_min(split, event_id) AS split FROM (SELECT *, concat(attack_family, '-', payment_rail) AS vector, "
        "CASE WHEN event_id % 5 < 3 THEN 'test_known' ELSE 'test_novel' END AS split FROM predictions) p WHERE label_fraud GROUP BY 1", "predictions"),
)
def _(t: Tables):
    tagged = t("predictions").withColumns({
        "vector": F.concat_ws("-", "attack_family", "payment_rail"),
        "split": F.when(F.col("event_id") % 5 < 3, "test_known").otherwise("test_novel"),
    })
    return m.metrics_by_vector(tagged, "vector", "split", ["event_id"])


@query(
    "M14_metrics_by_phase",
    with_views(
        "SELECT lifecycle_phase, events, round(CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision, "
        "round(CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall, round(fp / CAST(greatest(1, fp + tn) AS DOUBLE), 6) AS false_positive_rate "
        f"FROM (SELECT lifecycle_phase, count(*) AS events, {_CONF} FROM predictions GROUP BY 1) q", "predictions"),
)
def _(t: Tables):
    return m.metrics_by_phase(t("predictions"))


@query(
    "M14_metrics_by_legitimate_profile",
    with_views(
        "SELECT coalesce(CASE WHEN event_id % 4 = 0 THEN payment_rail END, 'ORDINARY') AS profile, count(*) AS events, "
        "count(*) FILTER (WHERE predicted_fraud) AS false_positives, round(avg(CAST(CAST(predicted_fraud AS INT) AS DOUBLE)), 6) AS false_positive_rate "
        "FROM predictions WHERE NOT label_fraud GROUP BY 1", "predictions"),
)
def _(t: Tables):
    control = F.when(F.col("event_id") % 4 == 0, F.col("payment_rail"))
    return m.metrics_by_legitimate_profile(t("predictions").withColumn("legitimate_control", control))


_ROLE = "CASE WHEN label_fraud THEN 'attack' WHEN event_id % 4 = 0 THEN 'legitimate_control' ELSE 'ordinary_legitimate' END"


@query(
    "M15_hard_vs_ordinary_fpr",
    with_views(
        "SELECT round(avg(CASE WHEN r = 'legitimate_control' THEN CAST(CAST(predicted_fraud AS INT) AS DOUBLE) END), 6) AS hard_false_positive_rate, "
        "round(avg(CASE WHEN r = 'ordinary_legitimate' THEN CAST(CAST(predicted_fraud AS INT) AS DOUBLE) END), 6) AS ordinary_false_positive_rate, "
        f"count(*) FILTER (WHERE r = 'legitimate_control') AS hard_control_event_count FROM (SELECT *, {_ROLE} AS r FROM predictions) p", "predictions"),
)
def _(t: Tables):
    return m.hard_vs_ordinary_fpr(t("predictions").withColumn("case_role", F.expr(_ROLE)))


_CHAINS = (
    "SELECT {by} coalesce(chain_id, concat('solo_', CAST(event_id AS VARCHAR))) AS ck, bool_or(is_attack) AS atk, bool_or(alert) AS caught, "
    "min(CASE WHEN alert THEN sequence END) AS fa, coalesce(min(CASE WHEN fraud_contributing AND value_at_risk_inr > 0 THEN sequence END), "
    "min(CASE WHEN fraud_contributing THEN sequence END)) AS fm, arg_min(attack_family, sequence) FILTER (WHERE attack_family IS NOT NULL) AS fam "
    "FROM rows GROUP BY ALL"
)
_CHAIN_REPORT = (
    "round(caught_n / CAST(total AS DOUBLE), 4) AS chain_recall, caught_n AS chains_caught, total AS chains_total, "
    "round(prevented / CAST(caught_n AS DOUBLE), 4) AS prevented_share, round(stage, 3) AS mean_caught_at_stage, "
    "round(caught_n / CAST(caught_n + legit AS DOUBLE), 4) AS chain_precision, legit AS legit_chains_alerted"
)
_CHAIN_COUNTS = (
    "count(*) FILTER (WHERE atk AND caught) AS caught_n, count(*) FILTER (WHERE atk) AS total, count(*) FILTER (WHERE NOT atk AND caught) AS legit, "
    "count(*) FILTER (WHERE atk AND caught AND (fm IS NULL OR fa <= fm)) AS prevented, avg(CASE WHEN atk AND caught THEN fa END) AS stage"
)
_CHAIN_ROWS = (
    "count(*) AS rows_test, count(*) FILTER (WHERE label = 1) AS fraud_rows, count(*) FILTER (WHERE alert) AS alerts, "
    "round(avg(CASE WHEN label = 1 THEN CAST(CAST(alert AS INT) AS DOUBLE) END), 4) AS row_recall, round(avg(CASE WHEN alert THEN CAST(label AS DOUBLE) END), 4) AS row_precision, "
    "round(avg(CASE WHEN source = 'control' THEN CAST(CAST(alert AS INT) AS DOUBLE) END), 5) AS hard_false_positive_rate, "
    "round(avg(CASE WHEN source = 'ambient' THEN CAST(CAST(alert AS INT) AS DOUBLE) END), 5) AS ambient_friction_rate"
)


@query(
    "M16_chain_summary",
    with_views(
        f"SELECT {_CHAIN_REPORT}, r.* FROM (SELECT {_CHAIN_COUNTS} FROM chains) c, (SELECT {_CHAIN_ROWS} FROM rows) r",
        "predictions", rows=_TRAIN_ROWS, chains=_CHAINS.format(by="")),
)
def _(t: Tables):
    return m.chain_summary(train_rows(t))


@query(
    "M16_chain_recall_by_family",
    with_views(
        "SELECT fam AS attack_family, round(avg(CAST(CAST(caught AS INT) AS DOUBLE)), 4) AS chain_recall, count(*) AS chains FROM chains "
        "WHERE atk AND fam IS NOT NULL GROUP BY 1", "predictions", rows=_TRAIN_ROWS, chains=_CHAINS.format(by="")),
)
def _(t: Tables):
    return m.chain_recall_by_family(train_rows(t))


@query(
    "M17_fold_aggregate",
    with_views(
        f"SELECT metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM (UNPIVOT (SELECT c.fold, {_CHAIN_REPORT}, row_recall, row_precision "
        f"FROM (SELECT fold, {_CHAIN_COUNTS} FROM chains GROUP BY 1) c JOIN (SELECT fold, {_CHAIN_ROWS} FROM rows GROUP BY 1) r ON c.fold = r.fold) "
        "ON chain_recall, prevented_share, chain_precision, row_recall, row_precision, mean_caught_at_stage INTO NAME metric VALUE value) u GROUP BY 1",
        "predictions", rows=_TRAIN_ROWS, chains=_CHAINS.format(by="fold,")),
)
def _(t: Tables):
    folds = m.chain_summary(train_rows(t), by=["fold"])
    names = ["chain_recall", "prevented_share", "chain_precision", "row_recall", "row_precision", "mean_caught_at_stage"]
    return m.fold_aggregate(folds, names)


_SPLIT_SQL = (
    "SELECT c.*, CASE WHEN rn <= floor(n * (CAST(1 AS DOUBLE) - 2e-1 - 2e-1)) THEN 'train' WHEN rn <= floor(n * (CAST(1 AS DOUBLE) - 2e-1)) "
    "THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY time_s, row_id) AS rn, count(*) OVER () AS n FROM card_tx) c"
)


@query("L1_chronological_split", with_views("SELECT row_id, time_s, class, split FROM s", "card_tx", s=_SPLIT_SQL))
def _(t: Tables):
    return s.chronological_split(t("card_tx").select("row_id", "time_s", "class"), "time_s", "row_id", label="class")


@query(
    "M19_split_summary",
    with_views(
        "SELECT split, count(*) AS rows, CAST(sum(class) AS BIGINT) AS frauds, round(avg(CAST(class AS DOUBLE)), 8) AS fraud_prevalence, "
        "round(min(time_s), 3) AS time_min_seconds, round(max(time_s), 3) AS time_max_seconds FROM s GROUP BY 1", "card_tx", s=_SPLIT_SQL),
)
def _(t: Tables):
    tagged = s.chronological_split(t("card_tx").select("row_id", "time_s", "class"), "time_s", "row_id")
    return m.split_summary(tagged, "split", "class", "time_s")


@query(
    "L2_sealed_split",
    "SELECT p_partkey, p_brand, CASE WHEN h.b IS NOT NULL THEN 'test_novel' WHEN (rn - 5e-1) / n <= 6e-1 THEN 'train' "
    "WHEN (rn - 5e-1) / n <= 8e-1 THEN 'validation' ELSE 'test_known' END AS split FROM ("
    "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) p "
    "LEFT JOIN (SELECT DISTINCT p_brand AS b FROM part WHERE p_brand LIKE '%3') h ON h.b = p.p_brand",
)
def _(t: Tables):
    part = t("part").select("p_partkey", "p_brand")
    return s.sealed_split(part, "p_brand", ["p_partkey"], part.where(F.col("p_brand").endswith("3")).select("p_brand"))


@query(
    "L2_ordinary_split",
    with_views(
        "SELECT event_id, CASE WHEN f <= 6e-1 THEN 'train' WHEN f <= 78e-2 THEN 'validation' WHEN f <= 92e-2 THEN 'test_known' ELSE 'test_novel' END AS split "
        "FROM (SELECT event_id, (row_number() OVER (ORDER BY event_ts, event_id) - 5e-1) / count(*) OVER () AS f FROM pay_events WHERE NOT label_fraud) q", "pay_events"),
)
def _(t: Tables):
    ordinary = t("pay_events").where(~F.col("label_fraud")).select("event_id", "event_ts")
    return s.ordinary_split(ordinary, ["event_ts", "event_id"]).select("event_id", "split")


@query("L3_stratified_group_kfold")
def _(t: Tables):
    return s.group_folds(t("case_events"), "case_id", "attack_family", s.fold_count(0.3))


@query(
    "L4_replay_buffer",
    with_views(
        "SELECT event_id, attack_family, sequence FROM (SELECT *, row_number() OVER (PARTITION BY attack_family ORDER BY src, event_id) AS r FROM ("
        "SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY src, event_id) AS d FROM ("
        "SELECT 0 AS src, * FROM rows WHERE label = 1 AND alert UNION ALL SELECT 1 AS src, * FROM rows WHERE label = 1) u) v "
        "WHERE d = 1 AND attack_family IS NOT NULL) w WHERE r <= 500", "predictions", rows=_TRAIN_ROWS),
)
def _(t: Tables):
    rows = train_rows(t)
    old = rows.where((F.col("label") == 1) & F.col("alert"))
    return s.replay_buffer(old, rows, "event_id", cap=500).select("event_id", "attack_family", "sequence")


@query(
    "L5_assemble_training",
    with_views(
        "SELECT event_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY src) AS d FROM ("
        "SELECT 0 AS src, event_id, 'baseline' AS origin FROM pay_events WHERE event_type IN ('click', 'purchase') UNION ALL "
        "SELECT 1, event_id, 'log' FROM pay_events WHERE lifecycle_phase <> 'pre_transaction' UNION ALL SELECT 2, event_id, 'replay' FROM pay_events WHERE label_fraud) u) v WHERE d = 1", "pay_events"),
)
def _(t: Tables):
    sources = {
        "baseline": F.col("event_type").isin("click", "purchase"), "log": F.col("lifecycle_phase") != "pre_transaction",
        "replay": F.col("label_fraud"),
    }
    parts = [t("pay_events").where(cond).select("event_id", F.lit(name).alias("origin")) for name, cond in sources.items()]
    return s.assemble_training(*parts)


@query(
    "L6_class_weights",
    with_views(
        "SELECT row_id, n / CAST(2 * CASE WHEN class = 1 THEN p ELSE n - p END AS DOUBLE) AS balanced, "
        "CASE WHEN class = 1 THEN (n - p) / CAST(p AS DOUBLE) ELSE 1e0 END AS inverse_prevalence "
        "FROM card_tx, (SELECT count(*) AS n, CAST(sum(class) AS BIGINT) AS p FROM card_tx) c", "card_tx"),
)
def _(t: Tables):
    rows = t("card_tx").select("row_id", "class")
    first = s.class_weights(rows, "class").withColumnRenamed("weight", "balanced")
    both = s.class_weights(first, "class", "inverse_prevalence").withColumnRenamed("weight", "inverse_prevalence")
    return both.drop("class")


@query("L7_sample_to_prevalence")
def _(t: Tables):
    return s.sample_to_prevalence(t("card_tx").select("row_id", "class"), "class", "row_id", 0.05)


@query("L3_fold_balance", with_views(
    "SELECT stratum, CAST(f AS INT) AS fold, n // 3 + CASE WHEN f < n % 3 THEN 1 ELSE 0 END AS groups FROM (SELECT stratum, count(*) AS n FROM ("
    "SELECT case_id, coalesce(max(attack_family), 'none') AS stratum FROM case_events GROUP BY 1) g GROUP BY 1) s, (SELECT unnest([0, 1, 2]) AS f) x", "case_events"))
def _(t: Tables):
    folds = s.group_folds(t("case_events"), "case_id", "attack_family", s.fold_count(0.3))
    return folds.groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("groups"))


@query("L7_sample_counts", with_views(
    "SELECT p AS positives, least(n - p, CAST(floor(p / 5e-2) AS BIGINT) - p) AS negatives FROM (SELECT count(*) AS n, count(*) FILTER (WHERE class = 1) AS p FROM card_tx) c", "card_tx"))
def _(t: Tables):
    kept = s.sample_to_prevalence(t("card_tx").select("row_id", "class"), "class", "row_id", 0.05)
    return kept.agg(F.count_if(F.col("class") == 1).alias("positives"), F.count_if(F.col("class") == 0).alias("negatives"))
