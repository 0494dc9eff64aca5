"""Registered queries: sources (S), models (T) and streams (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators import history as h
from riskweave.operators import metrics as m
from riskweave.operators import models as md
from riskweave.operators import splits as s
from riskweave.plans.cases import _SCORED, _STATE, _GUARD
from riskweave.plans.features import _DISTINCT, _HOUR
from riskweave.plans.metrics import _CHAIN_COUNTS, _CHAIN_REPORT, _CHAIN_ROWS, _CHAINS, _SPLIT_SQL, _TRAIN_ROWS, train_rows
from riskweave.plans.registry import Tables, query
from riskweave.plans.views import with_views
from riskweave.session import pin, scratch_path
from riskweave.sources import logs, readers, writers
from riskweave.streaming import stateful as st

# ---------------------------------------------------------------- sources and sinks


@query("S1_load_transactions", "SELECT o_orderkey, TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice, TRY_CAST(o_orderpriority AS DOUBLE) AS o_orderpriority, o_orderstatus FROM orders")
def _(t: Tables):
    rows = readers.load_transactions(t.spark, f"{t.sf_dir}/orders.parquet", ["o_totalprice", "o_orderpriority"])
    return rows.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


@query("S1_load_transactions_csv", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice, CAST(NULL AS DOUBLE) AS o_orderpriority FROM orders")
def _(t: Tables):
    path = writers.write_dataset(t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), scratch_path(t.spark, "orders") + ".csv")
    return readers.load_transactions(t.spark, path, ["o_totalprice", "o_orderpriority"])


@query("S2_load_events", with_views(
    "SELECT CAST(event_id AS VARCHAR) AS event_id, event_ts, amount_inr, label_fraud, attack_family FROM pay_events", "pay_events"))
def _(t: Tables):
    names = [f.name for f in readers.EVENT_SCHEMA.fields]
    rows = t("pay_events").select(*[F.col(n) if n in t("pay_events").columns else F.lit(None).cast("string").alias(n) for n in names])
    path = writers.write_dataset(rows, scratch_path(t.spark, "events") + ".csv")
    scores = t("predictions").select(*[F.col(f.name) if f.name in t("predictions").columns else F.lit(None).cast("string").alias(f.name) for f in readers.PREDICTION_SCHEMA.fields])
    scores_path = writers.write_dataset(scores, scratch_path(t.spark, "predictions") + ".csv")
    events, _ = readers.load_events(t.spark, path, scores_path)
    return events.select("event_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "amount_inr", "label_fraud", "attack_family")


@query("S5_log_round", with_views(
    "SELECT c.event_id, c.case_id AS chain_id, sequence, CASE WHEN is_attack AND fraud_contributing THEN 1 ELSE 0 END AS label, CASE WHEN a.case_id IS NOT NULL THEN 'attack' ELSE 'control' END AS source "
    "FROM case_events c JOIN truth t ON t.event_id = c.event_id LEFT JOIN (SELECT DISTINCT case_id FROM truth WHERE is_attack) a ON a.case_id = c.case_id", "case_events", "truth"))
def _(t: Tables):
    events = t("case_events").select("event_id", "case_id", F.col("case_id").alias("chain_id"), "sequence", "event_type")
    truth = t("truth").drop("case_id")
    attacked = t("truth").where("is_attack").select("case_id").distinct()
    out = logs.log_round(
        events.join(attacked, "case_id", "left_semi").drop("case_id"), truth, events.join(attacked, "case_id", "left_anti").drop("case_id"), truth,
    )
    return out.select("event_id", "chain_id", "sequence", "label", "source")


@query("S3_S4_training_log", with_views("SELECT event_id, case_id, CAST(sequence AS INT) AS sequence, attack_family FROM predictions", "predictions"))
def _(t: Tables):
    rows = t("predictions").select("event_id", "case_id", "sequence", "attack_family")
    path = scratch_path(t.spark, "log")
    logs.append_log(rows.where(F.col("event_id") % 2 == 0), path)
    logs.append_log(rows.where(F.col("event_id") % 2 == 1), path)
    return logs.load_log(t.spark, path, "event_id BIGINT, case_id STRING, sequence INT, attack_family STRING")


@query("S6_S7_report_and_dataset", with_views("SELECT event_id, risk_score, predicted_fraud FROM predictions", "predictions"))
def _(t: Tables):
    rows = t("predictions").select("event_id", "risk_score", "predicted_fraud")
    report = m.confusion_metrics(t("predictions"), "label_fraud", "predicted_fraud")
    paths = writers.write_report(scratch_path(t.spark, "report"), report, report, rows)
    return t.spark.read.schema(rows.schema).option("header", True).csv(paths["predictions"])


@query("S8_dataset_fingerprint")
def _(t: Tables):
    return readers.dataset_fingerprint(t("lineitem"))


@query("S8_fingerprint_contract", "SELECT count(*) AS rows, true AS same_in_any_order, true AS sees_a_repeated_row, true AS sees_a_changed_value FROM lineitem")
def _(t: Tables):
    """What the fingerprint promises: the number of rows, no matter their order, and any copy or change shows."""
    rows = t("lineitem")
    one = rows.orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(1)
    dealt = rows.repartition(7, "l_partkey").sortWithinPartitions("l_shipdate")
    changed = rows.withColumn("l_quantity", F.when(F.col("l_orderkey") == F.lit(one.first()["l_orderkey"]), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    first, *others = [readers.dataset_fingerprint(r) for r in (rows, dealt, rows.unionByName(one), changed)]
    marks = [c for c in first.columns if c != "rows"]
    for k, other in enumerate(others):
        first = first.crossJoin(F.broadcast(other.select(F.struct(*marks).alias(f"_{k}"))))  # one row each
    own = F.struct(*marks)
    return first.select("rows", (own == F.col("_0")).alias("same_in_any_order"), (own != F.col("_1")).alias("sees_a_repeated_row"), (own != F.col("_2")).alias("sees_a_changed_value"))


# ---------------------------------------------------------------- models

_NUMERIC = ("v1", "v2", "v3", "amount_log", "hour_sin", "hour_cos")


def card_splits(t: Tables):
    from riskweave.functions import scalar as p

    hour_sin, hour_cos = p.cyclic_hour(p.hour_of_elapsed(F.col("time_s")))
    card = t("card_tx").withColumns({
        "amount_log": p.log1p_clipped(F.col("amount")), "hour_sin": hour_sin, "hour_cos": hour_cos,
        "band": F.when(F.col("v2") < 5, "low").otherwise("high"),
    })
    return pin(s.chronological_split(card, "time_s", "row_id", label="class"), "card")


def _fit(kind: str, train):
    build = {"logistic": md.logistic_stages, "boosted": md.boosted_stages}[kind]
    return md.fit_model(kind, train, "class", _NUMERIC, ("band",), build)


def _part(rows, name: str):
    return rows.where(F.col("split") == name)


@query("T1_logistic_pipeline")
def _(t: Tables):
    rows = card_splits(t)
    return _fit("logistic", _part(rows, "train")).score(_part(rows, "test"), ["row_id", "class"])


@query("T2_boosted_pipeline")
def _(t: Tables):
    rows = card_splits(t)
    return _fit("boosted", _part(rows, "train")).score(_part(rows, "test"), ["row_id", "class"])


def _selected_and_scored(t: Tables):
    """(scored test rows, the frozen choice) of the two candidates."""
    rows = card_splits(t)
    train = _part(rows, "train")
    candidates = {"logistic": _fit("logistic", train), "boosted": _fit("boosted", train)}
    chosen = md.select_by_validation(candidates, _part(rows, "validation"), "class", "row_id", fpr_cap=0.02, calibrate=True)
    return md.score_events(_part(rows, "test"), chosen, ["row_id", "class"]), chosen


@query("T4_T5_T9_select_calibrate_and_score")
def _(t: Tables):
    return _selected_and_scored(t)[0]


# What SQL can say about scores of a trained model: which rows, in which range, and that flag and action follow from score and threshold.
_ACTION = (
    "CASE WHEN risk_score < 45e-2 * {t} THEN 'allow' WHEN risk_score < {t} THEN 'monitor' WHEN risk_score < least(82e-2, {t} + 14e-2) THEN 'step_up' "
    "WHEN risk_score < 95e-2 THEN 'hold' ELSE 'block' END")


@query("T9_score_contract", with_views(
    "SELECT row_id, class, true AS score_in_range, true AS flag_follows, true AS action_follows FROM s WHERE split = 'test'", "card_tx", s=_SPLIT_SQL))
def _(t: Tables):
    scored, chosen = _selected_and_scored(t)
    cut = F.lit(chosen.threshold)
    action = F.expr(_ACTION.format(t=f"CAST({chosen.threshold!r} AS DOUBLE)"))
    return scored.select(
        "row_id", "class", F.col("risk_score").between(0, 1).alias("score_in_range"), (F.col("predicted_fraud") == (F.col("risk_score") >= cut)).alias("flag_follows"),
        (F.col("mitigation_action") == action).alias("action_follows"))


def chain_rows(t: Tables):
    """Chain features with the truth columns of the training log."""
    truth = t("truth").drop("case_id", "intervention_point", "offset_seconds")
    events = t("evidence_events").withColumn("chain_id", F.when(F.col("event_id") % 10 != 0, F.col("case_id")))
    return logs.flatten_events(events, truth, group_key=F.coalesce(F.col("chain_id"), F.concat(F.lit("solo_"), F.col("event_id").cast("string"))))


def chain_features(rows):
    return h.chain_feature_frame(rows, "event_ts", keep=[*[c for c in md.CHAIN_META if c != "event_id"], "group_key"])


@query("T3_fraud_detector")
def _(t: Tables):
    rows = pin(chain_features(chain_rows(t)), "chains")
    model = md.fraud_detector(rows)
    path = scratch_path(t.spark, "detector")
    model.save(path)
    again = md.ScoringModel.load(t.spark, path, d.CHAIN_NUMERIC_FEATURES, d.CHAIN_CATEGORICAL_FEATURES)
    return again.score(rows, ["event_id", "label"])


@query("T3_score_contract", with_views(
    "SELECT event_id, CAST(is_attack AND fraud_contributing AS INT) AS label, true AS score_in_range, true AS same_when_loaded FROM truth", "truth"))
def _(t: Tables):
    rows = pin(chain_features(chain_rows(t)), "chains")
    model, path = md.fraud_detector(rows), scratch_path(t.spark, "detector")
    model.save(path)
    again = md.ScoringModel.load(t.spark, path, d.CHAIN_NUMERIC_FEATURES, d.CHAIN_CATEGORICAL_FEATURES)
    both = model.score(rows, ["event_id", "label"]).join(
        again.score(rows, ["event_id"]).select("event_id", F.col("risk_score").alias("loaded")), "event_id")
    return both.select(
        "event_id", F.col("label").cast("int").alias("label"), F.col("risk_score").between(0, 1).alias("score_in_range"),
        (F.col("risk_score") == F.col("loaded")).alias("same_when_loaded"))


@query("T6_cross_validate")
def _(t: Tables):
    rows = chain_features(chain_rows(t))
    return m.fold_aggregate(md.cross_validate(rows, md.fraud_detector), md.FOLD_METRICS)


_OLD = _TRAIN_ROWS.replace("risk_score >= 5e-1 AS alert", "risk_score >= 62e-2 AS alert")


@query("T7_promotion_gate", with_views(
    "SELECT c.fold, c.chain_recall, c.hard_false_positive_rate, c.chain_precision, c.prevented_share, c.chain_recall - i.chain_recall >= -1e-2 - 1e-9 AND i.hard_false_positive_rate - c.hard_false_positive_rate >= -2e-3 - 1e-9 "
    "AND greatest(c.chain_recall - i.chain_recall, i.hard_false_positive_rate - c.hard_false_positive_rate, c.chain_precision - i.chain_precision, c.prevented_share - i.prevented_share) >= 1e-3 - 1e-9 AS promoted FROM newer c JOIN older i ON i.fold = c.fold",
    "predictions", rows=_TRAIN_ROWS, chains=_CHAINS.format(by="fold,"),
    older=f"SELECT c.fold, {_CHAIN_REPORT}, hard_false_positive_rate FROM (SELECT fold, {_CHAIN_COUNTS} FROM chains GROUP BY 1) c JOIN (SELECT fold, {_CHAIN_ROWS} FROM rows GROUP BY 1) r ON c.fold = r.fold",
    rows2=_OLD, chains2=_CHAINS.format(by="fold,").replace("FROM rows", "FROM rows2"),
    newer=f"SELECT c.fold, {_CHAIN_REPORT}, hard_false_positive_rate FROM (SELECT fold, {_CHAIN_COUNTS} FROM chains2 GROUP BY 1) c JOIN (SELECT fold, {_CHAIN_ROWS} FROM rows2 GROUP BY 1) r ON c.fold = r.fold"))
def _(t: Tables):
    rows = train_rows(t)
    challenger = m.chain_summary(rows.withColumn("alert", F.col("risk_score") >= 0.62), by=["fold"])
    gate = md.promotion_gate(challenger, m.chain_summary(rows, by=["fold"]), "fold")
    return gate.select("fold", "chain_recall", "hard_false_positive_rate", "chain_precision", "prevented_share", "promoted")


@query("T8_retrain_generation")
def _(t: Tables):
    root = scratch_path(t.spark, "champion")
    rows = pin(chain_rows(t), "chain-rows")
    md.retrain_generation(t.spark, [rows], root, 1, chain_features, md.fraud_detector)
    version = writers.current_version(t.spark, root)
    champion = md.ScoringModel.load(t.spark, f"{root}/{version}", d.CHAIN_NUMERIC_FEATURES, d.CHAIN_CATEGORICAL_FEATURES)
    scored = champion.score(chain_features(rows), ["event_id", "label"])
    return scored.withColumn("alert", F.col("risk_score") >= champion.threshold)


# ---------------------------------------------------------------- streams


def as_stream(t: Tables, rows):
    """Store rows that Spark derived from the tables and read them back as a stream of files."""
    path = scratch_path(t.spark, "stream")
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


#: All rows of a table come in one micro-batch, which touches every key.
_BUCKETS = 1 << 14


def run_stream(t: Tables, stream):
    return st.run_available(stream, scratch_path(t.spark, "stream-out"), scratch_path(t.spark, "stream-state"))


@query("ST1_stream_point_in_time_features", with_views(
    "SELECT a.event_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY sequence) - 1 AS DOUBLE) AS prior_event_count, round(CAST((epoch_us(event_ts) - epoch_us(lag(event_ts) OVER (PARTITION BY case_id ORDER BY sequence))) AS DOUBLE) / 1e6, 6) AS seconds_since_prev_event, "
    "CAST(events_last_hour AS DOUBLE) AS events_last_hour, round(value_sum_last_hour_inr, 2) AS value_sum_last_hour_inr, CAST(distinct_beneficiaries_prior AS DOUBLE) AS distinct_beneficiaries_prior, CAST(distinct_devices_prior AS DOUBLE) AS distinct_devices_prior "
    "FROM case_events a JOIN hr ON hr.event_id = a.event_id JOIN di ON di.event_id = a.event_id", "evidence_events", hr=_HOUR, di=_DISTINCT))
def _(t: Tables):
    fields = t("evidence_events").select("event_id", "beneficiary_id", "device_id")
    rows = t("case_events").select("event_id", "event_ts", "case_id", "sequence", "amount_inr").join(fields, "event_id")
    out = run_stream(t, st.stream_point_in_time_features(as_stream(t, rows), "case_id", "event_ts", "event_id", buckets=_BUCKETS))
    names = ["prior_event_count", "events_last_hour", "value_sum_last_hour_inr", "distinct_beneficiaries_prior", "distinct_devices_prior"]
    return out.select("event_id", *names, F.round("seconds_since_prev_event", 6).alias("seconds_since_prev_event"))


@query("ST2_stream_case_guard", with_views(
    "SELECT event_id, codes AS indicator_codes, CAST(gs AS INT) AS observable_risk_score, minact AS minimum_action, band AS risk_band FROM gd", "evidence_events", st=_STATE, sc=_SCORED, gd=_GUARD))
def _(t: Tables):
    out = run_stream(t, st.stream_case_guard(as_stream(t, t("evidence_events")), "case_id", "event_ts", "event_id", keep=[], buckets=_BUCKETS))
    return out.select("event_id", F.array_join("indicator_codes", "|").alias("indicator_codes"), F.col("observable_risk_score").cast("int").alias("observable_risk_score"), "minimum_action", "risk_band")


@query("ST3_stream_label_log", with_views("SELECT event_id, case_id, sequence FROM case_events", "case_events"))
def _(t: Tables):
    rows = t("case_events").select("event_id", "case_id", "sequence", F.col("event_ts").cast("timestamp").alias("event_ts"))
    path = scratch_path(t.spark, "label-log")
    doubled = rows.unionByName(rows)
    st.stream_label_log(as_stream(t, doubled), path, scratch_path(t.spark, "label-state"), "event_ts", "40 days").awaitTermination()
    return logs.load_log(t.spark, path, "event_id BIGINT, case_id STRING, sequence BIGINT").select("event_id", "case_id", "sequence")


@query("ST4_stream_rollups", with_views(
    "SELECT CAST(event_ts AS DATE) AS day, count(*) FILTER (WHERE NOT label_fraud) AS legitimate, count(*) FILTER (WHERE label_fraud) AS fraud FROM pay_events GROUP BY 1", "pay_events"))
def _(t: Tables):
    rows = t("pay_events").select("event_ts", "label_fraud", "amount_inr")
    out = st.run_latest(st.stream_rollups(as_stream(t, rows)), ["window_start"], scratch_path(t.spark, "stream-out"), scratch_path(t.spark, "stream-state"))
    return out.select(F.to_date("window_start").alias("day"), "legitimate", "fraud")
