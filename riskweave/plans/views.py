"""Views over the given tables in the shape of payment data, in SQL that Spark and DuckDB both run.

``{events}`` and ``{orders}`` stand for the tables. The window in ``case_events`` and in
``evidence_events`` is written as SQL for the oracle only; the Spark side numbers rows with
``riskweave.operators.ordered.group_rank``, which does not put a large case into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.operators.ordered import group_rank

PAY_EVENTS = """
SELECT event_id, event_ts, sender_account_id,
       k % 40 AS beneficiary_id, (sender_account_id + k) % 60 AS device_id,
       (sender_account_id % 5) * 10 + k % 4 AS ip_prefix,
       amount_inr, event_type,
       CASE k % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CARD' WHEN 2 THEN 'BANK_TRANSFER' ELSE 'WALLET' END AS payment_rail,
       CASE k % 5 WHEN 0 THEN 'WEB' WHEN 1 THEN 'POS' WHEN 2 THEN 'API' ELSE 'MOBILE_APP' END AS channel,
       CASE WHEN event_type IN ('signup', 'view') THEN 'pre_transaction'
            WHEN event_type = 'error' THEN 'post_transaction' ELSE 'transaction' END AS lifecycle_phase,
       k >= 93 AS label_fraud,
       CASE WHEN k >= 93 THEN CASE k % 3 WHEN 0 THEN 'FAM-A' WHEN 1 THEN 'FAM-B' ELSE 'FAM-C' END END AS attack_family,
       concat(CAST(sender_account_id AS STRING), '-', CAST(CAST(event_ts AS DATE) AS STRING)) AS case_id,
       CASE WHEN k < 10 THEN NULL ELSE k END AS beneficiary_age_days,
       k % 11 = 0 AS strong_authentication_passed, k
FROM (SELECT event_id, ts AS event_ts, user_id AS sender_account_id, value AS amount_inr, event_type,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

CASE_EVENTS = """
SELECT p.*, row_number() OVER (PARTITION BY case_id ORDER BY event_ts, event_id) AS sequence FROM {pay_events} p
"""

PREDICTIONS = """
SELECT event_id, event_ts, case_id, sequence, label_fraud, attack_family, lifecycle_phase, payment_rail, amount_inr,
       risk_score, risk_score >= CAST(0.5 AS DOUBLE) AS predicted_fraud,
       CASE WHEN label_fraud THEN amount_inr ELSE CAST(0 AS DOUBLE) END AS value_at_risk_inr
FROM (SELECT c.*, round(CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.65 AS DOUBLE)
                        + CASE WHEN label_fraud THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS risk_score
      FROM {case_events} c) s
"""

DECISIONS = """
SELECT event_id, case_id, sequence,
       CASE WHEN risk_score < CAST(0.225 AS DOUBLE) THEN 'allow' WHEN risk_score < CAST(0.5 AS DOUBLE) THEN 'monitor'
            WHEN risk_score < CAST(0.64 AS DOUBLE) THEN 'step_up' WHEN risk_score < CAST(0.95 AS DOUBLE) THEN 'hold' ELSE 'block' END AS action,
       event_id % 6 = 0 AS has_legitimate_context
FROM {predictions}
"""

TRUTH = """
SELECT event_id, case_id, label_fraud AS is_attack, attack_family, value_at_risk_inr,
       CASE lifecycle_phase WHEN 'pre_transaction' THEN 'PREVENT' WHEN 'transaction' THEN 'DECIDE' ELSE 'CONTAIN' END AS intervention_point,
       (sequence - 1) * 60 AS offset_seconds, label_fraud AND lifecycle_phase <> 'pre_transaction' AS fraud_contributing
FROM {predictions}
"""

CARD_TX = """
SELECT o_orderkey AS row_id, CAST(o_orderkey * 60 AS DOUBLE) AS time_s, o_totalprice AS amount,
       CASE WHEN o_custkey % 50 = 0 THEN 1 ELSE 0 END AS class,
       CAST((o_orderkey * 31) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS v1,
       CAST(o_custkey AS DOUBLE) / CAST(100 AS DOUBLE) AS v2,
       o_totalprice / CAST(1000 AS DOUBLE) + CAST(o_orderkey AS DOUBLE) / CAST(500 AS DOUBLE) AS v3
FROM {orders}
"""

# Case events with the attributes the evidence rules read. Nulls are frequent on purpose.
EVIDENCE_EVENTS = """
SELECT event_id, event_ts, case_id, sequence, k,
       CASE k % 16 WHEN 0 THEN 'SESSION_STARTED' WHEN 1 THEN 'AUTHENTICATION_CONTEXT_CHANGED' WHEN 2 THEN 'BENEFICIARY_ADDED'
            WHEN 3 THEN 'PAYMENT_INITIATED' WHEN 4 THEN 'PAYMENT_REPEATED' WHEN 5 THEN 'FUNDS_RECEIVED' WHEN 6 THEN 'FUNDS_DISPERSED'
            WHEN 7 THEN 'PAYOUT_REQUESTED' WHEN 8 THEN 'PAYOUT_SETTLED' WHEN 9 THEN 'DISPUTE_OPENED'
            WHEN 10 THEN 'DISPUTE_EVIDENCE_REVIEWED' WHEN 11 THEN 'DISPUTE_REFUND_ISSUED' WHEN 12 THEN 'IDENTITY_APPLICATION_SUBMITTED'
            WHEN 13 THEN 'ACCOUNT_OPENED' WHEN 14 THEN 'AGENTIC_PAYMENT_INITIATED' ELSE 'COMMUNICATION_RISK_CONTEXT' END AS event_type,
       CASE WHEN k % 16 IN (0, 1, 2, 12, 13, 15) THEN 'pre_transaction'
            WHEN k % 16 IN (5, 6, 8, 9, 10, 11) THEN 'post_transaction' ELSE 'transaction' END AS lifecycle_phase,
       CASE WHEN k % 16 IN (0, 1, 2, 12, 13, 15) THEN NULL ELSE amount_inr END AS amount_inr,
       CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 20 AS DOUBLE) END AS sender_baseline_amount_inr,
       CASE WHEN k % 4 = 0 THEN NULL ELSE k % 3 END AS payment_count,
       CASE WHEN k % 5 = 0 THEN 1 END AS authorized_payment_count,
       CASE WHEN k % 2 = 0 THEN NULL ELSE k % 7 = 0 END AS device_is_new,
       CASE WHEN k % 9 = 0 THEN true END AS network_is_new,
       CASE WHEN k % 10 = 0 THEN true WHEN k % 10 = 1 THEN false END AS device_shared_across_accounts,
       CASE WHEN k % 13 = 0 THEN k % 10 END AS urgency_level,
       CASE WHEN k % 8 = 1 THEN k % 4 END AS channel_switch_count,
       CASE WHEN k % 6 = 0 THEN k % 30 END AS beneficiary_age_days,
       CASE WHEN k % 7 = 2 THEN k % 6 END AS linked_attribute_count,
       CASE WHEN k % 11 = 3 THEN k % 5 END AS verification_retry_count,
       CASE WHEN k % 12 = 5 THEN CAST(k % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS profile_consistency_score,
       CASE WHEN k % 14 = 6 THEN k % 4 = 0 END AS behavior_automation_suspected,
       CASE WHEN k % 15 = 7 THEN k % 2 = 1 END AS evidence_conflict_present,
       CASE WHEN k % 17 = 8 THEN k % 9 END AS sender_count,
       CASE WHEN k % 18 = 9 THEN CAST(k % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS outflow_ratio,
       CASE WHEN k % 19 = 4 THEN k % 5 = 0 END AS accelerated_settlement,
       CASE WHEN k % 21 = 5 THEN k % 8 END AS linked_dispute_count,
       CASE WHEN k % 6 = 1 THEN k % 4 <> 0 WHEN k % 6 = 3 THEN true END AS agent_signature_valid,
       CASE WHEN k % 6 = 1 THEN true WHEN k % 6 = 3 THEN k % 5 <> 0 END AS consumer_consent_valid,
       CASE WHEN k % 6 = 1 THEN true WHEN k % 6 = 3 THEN true END AS intent_scope_match,
       CASE WHEN k % 6 = 1 THEN true END AS payment_container_match,
       CASE WHEN k % 6 = 3 THEN true END AS merchant_scope_match,
       CASE WHEN k % 23 = 6 THEN k * 10 END AS request_age_seconds,
       CASE WHEN k % 25 = 7 THEN k % 3 END AS nonce_reuse_count,
       CASE WHEN k % 10 < 3 THEN k % 11 = 0 END AS strong_authentication_passed,
       CASE WHEN k % 27 = 10 THEN true END AS dual_approval_complete,
       CASE WHEN k % 29 = 11 THEN k % 3 END AS independent_checks_passed,
       CASE WHEN k % 31 = 12 THEN k END AS supplier_relationship_days,
       concat('acct_', CAST(sender_account_id AS STRING)) AS sender_account_id,
       CASE WHEN k % 3 = 1 THEN concat('ben_', CAST(beneficiary_id AS STRING)) END AS beneficiary_id,
       CASE WHEN k % 2 = 1 THEN concat('dev_', CAST(device_id AS STRING)) END AS device_id
FROM {case_events}
"""

RAIL_PRIORS = """
SELECT 'UPI' AS rail, CAST(0.45 AS DOUBLE) AS share UNION ALL SELECT 'CARD', CAST(0.25 AS DOUBLE)
UNION ALL SELECT 'BANK_TRANSFER', CAST(0.18 AS DOUBLE) UNION ALL SELECT 'WALLET', CAST(0.12 AS DOUBLE)
"""

_TEXT = {
    "pay_events": PAY_EVENTS,
    "case_events": CASE_EVENTS,
    "predictions": PREDICTIONS,
    "decisions": DECISIONS,
    "truth": TRUTH,
    "card_tx": CARD_TX,
    "evidence_events": EVIDENCE_EVENTS,
    "rail_priors": RAIL_PRIORS,
}
_NEEDS = {
    "pay_events": ["events"],
    "case_events": ["pay_events"],
    "predictions": ["case_events"],
    "decisions": ["predictions"],
    "truth": ["predictions"],
    "card_tx": ["orders"],
    "evidence_events": ["case_events"],
    "rail_priors": [],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named view, or the table of that name."""
    if name not in _TEXT:
        return table(spark, sf_dir, name)
    if name == "case_events":
        return group_rank(view(spark, sf_dir, "pay_events"), ["case_id"], ["event_ts", "event_id"], "sequence")
    return spark.sql(_TEXT[name], **{n: view(spark, sf_dir, n) for n in _NEEDS[name]})


def with_views(sql: str, *names: str, **extra: str) -> str:
    """Prefix oracle SQL with the named views, their dependencies and further CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name in _TEXT and name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({_TEXT[n].format(**{x: x for x in _NEEDS[n]})})" for n in ordered]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
