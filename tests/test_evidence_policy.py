import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave import domains as d
from riskweave.functions import scalar
from riskweave.operators import evidence as e
from riskweave.operators import policy as g

TYPES = {
    "payment_count": "int", "authorized_payment_count": "int", "device_is_new": "boolean", "network_is_new": "boolean", "device_reused_across_profiles": "boolean",
    "urgency_level": "int", "channel_switch_count": "int", "beneficiary_age_days": "int", "amount_inr": "double", "sender_baseline_amount_inr": "double",
    "linked_attribute_count": "int", "verification_retry_count": "int", "liveness_confidence": "double", "behavior_automation_suspected": "boolean",
    "evidence_conflict_present": "boolean", "sender_count": "int", "outflow_ratio": "double", "destination_novelty_score": "double", "sales_velocity_multiplier": "double",
    "accelerated_settlement": "boolean", "linked_dispute_count": "int", "request_age_seconds": "int", "nonce_reuse_count": "int", "basket_value_multiplier": "double",
    "strong_authentication_passed": "boolean", "dual_approval_complete": "boolean", "supplier_relationship_days": "int", **{n: "boolean" for n in d.AGENT_TRUST_FACTORS},
}


def cases(spark, named):
    """named: case id -> list of (event_type, phase, attributes)."""
    fields = [("event_id", "string"), ("case_id", "string"), ("sequence", "int"), ("event_ts", "timestamp"), ("event_type", "string"), ("lifecycle_phase", "string"), *TYPES.items()]
    rows = []
    for case, events in named.items():
        for i, (kind, phase, attrs) in enumerate(events, 1):
            head = (f"{case}{i}", case, i, datetime(2026, 8, 1) + timedelta(minutes=i), kind, phase)
            rows.append(head + tuple(attrs.get(n) for n in TYPES))
    return spark.createDataFrame(rows, T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields)))


PAY, TX, PRE, POST = "PAYMENT_INITIATED", "transaction", "pre_transaction", "post_transaction"
BASE = ("SESSION_STARTED", PRE, {})
RULES = {
    "cross_phase_progression": [BASE, ("DISPUTE_OPENED", POST, {})],
    "cumulative_value_sequence": [(PAY, TX, {}), (PAY, TX, {})],
    "repeated_value_movement": [("SESSION_STARTED", PRE, {"payment_count": 2})],
    "agent_intent_count_mismatch": [("SESSION_STARTED", PRE, {"authorized_payment_count": 1}), ("SESSION_STARTED", PRE, {"payment_count": 2})],
    "downstream_value_release": [("PAYOUT_SETTLED", POST, {})],
    "sensitive_context_change": [("BENEFICIARY_ADDED", PRE, {})],
    "context_change_before_value": [(PAY, TX, {}), ("BENEFICIARY_ADDED", PRE, {})],
    "new_device": [("SESSION_STARTED", PRE, {"device_is_new": True})],
    "new_network": [("SESSION_STARTED", PRE, {"network_is_new": True})],
    "shared_infrastructure": [("SESSION_STARTED", PRE, {"device_reused_across_profiles": True})],
    "communication_pressure": [("SESSION_STARTED", PRE, {"urgency_level": 7})],
    "channel_switching": [("SESSION_STARTED", PRE, {"channel_switch_count": 2})],
    "new_beneficiary": [("SESSION_STARTED", PRE, {"beneficiary_age_days": 7})],
    "extreme_amount_deviation": [(PAY, TX, {"amount_inr": 300.0, "sender_baseline_amount_inr": 100.0})],
    "amount_deviation": [(PAY, TX, {"amount_inr": 150.0, "sender_baseline_amount_inr": 100.0})],
    "subtle_amount_deviation": [(PAY, TX, {"amount_inr": 115.0, "sender_baseline_amount_inr": 100.0})],
    "dense_identity_linkage": [("SESSION_STARTED", PRE, {"linked_attribute_count": 3})],
    "verification_retries": [("SESSION_STARTED", PRE, {"verification_retry_count": 3})],
    "identity_consistency_gap": [("SESSION_STARTED", PRE, {"liveness_confidence": 0.5})],
    "automation_signal": [("SESSION_STARTED", PRE, {"behavior_automation_suspected": True})],
    "evidence_conflict": [("SESSION_STARTED", PRE, {"evidence_conflict_present": True})],
    "fan_in_concentration": [("SESSION_STARTED", PRE, {"sender_count": 4})],
    "rapid_outflow": [("SESSION_STARTED", PRE, {"outflow_ratio": 0.5})],
    "novel_payout_destination": [("SESSION_STARTED", PRE, {"destination_novelty_score": 0.6})],
    "sales_velocity_shift": [("SESSION_STARTED", PRE, {"sales_velocity_multiplier": 2.0})],
    "accelerated_payout_after_change": [("PAYOUT_REQUESTED", TX, {"accelerated_settlement": True})],
    "linked_dispute_burst": [("SESSION_STARTED", PRE, {"linked_dispute_count": 5})],
    "dispute_evidence_sequence": [("DISPUTE_EVIDENCE_REVIEWED", POST, {}), ("DISPUTE_OPENED", POST, {})],
    "refund_after_dispute_sequence": [("DISPUTE_OPENED", POST, {}), ("DISPUTE_REFUND_ISSUED", POST, {})],
    "identity_to_payment_activation": [("IDENTITY_APPLICATION_SUBMITTED", PRE, {}), ("ACCOUNT_OPENED", PRE, {}), (PAY, TX, {})],
    **{f"{n}_failed": [("SESSION_STARTED", PRE, {n: False})] for n in d.AGENT_TRUST_FACTORS},
    "stale_agent_request": [("SESSION_STARTED", PRE, {"request_age_seconds": 301})],
    "agent_request_replay": [("SESSION_STARTED", PRE, {"nonce_reuse_count": 1})],
    "agent_intent_value_mismatch": [("SESSION_STARTED", PRE, {"basket_value_multiplier": 1.3})],
}


def test_every_rule_fires_on_its_case_and_not_on_a_plain_one(spark):
    rows = e.case_guard(cases(spark, {**RULES, "plain": [BASE]}), as_of=False).collect()
    found = {r["case_id"]: r["indicator_codes"] for r in rows}
    for code in RULES:
        assert code in found[code], code
    assert found["plain"] == []


def test_as_of_state_of_last_event_equals_final_state(spark):
    df = cases(spark, RULES)
    names = ["case_id", "indicator_codes", "raw_risk_score", "observable_risk_score", "minimum_action", "risk_band"]
    final = {tuple(map(str, r)) for r in e.case_guard(df, as_of=False).select(*names).collect()}
    last = df.groupBy("case_id").agg(F.max("sequence").alias("sequence"))
    asof = {tuple(map(str, r)) for r in e.case_guard(df).join(last, ["case_id", "sequence"]).select(*names).collect()}
    assert final == asof


def test_verification_discount_and_zero_counts(spark):
    named = {
        "v": [(PAY, TX, {"amount_inr": 300.0, "sender_baseline_amount_inr": 100.0, "strong_authentication_passed": True, "dual_approval_complete": True})],
        "z": [(PAY, TX, {"amount_inr": 90.0, "sender_baseline_amount_inr": 0.0, "payment_count": 0})],
        "t": [("SESSION_STARTED", PRE, {n: True for n in d.AGENT_TRUST_FACTORS})],
    }
    rows = {r["case_id"]: r for r in e.case_guard(cases(spark, named), as_of=False).collect()}
    assert (rows["v"]["verification_discount"], rows["v"]["observable_risk_score"], rows["v"]["minimum_action"]) == (6, 0, "allow")
    assert rows["z"]["indicator_codes"] == ["extreme_amount_deviation"]
    assert rows["t"]["verification_discount"] == 6


def test_latest_trust_value_decides(spark):
    full = {n: True for n in d.AGENT_TRUST_FACTORS}
    named = {"up": [("SESSION_STARTED", PRE, {**full, "intent_scope_match": False}), ("SESSION_STARTED", PRE, {"intent_scope_match": True})],
             "down": [("SESSION_STARTED", PRE, full), ("SESSION_STARTED", PRE, {"intent_scope_match": False})]}
    rows = {r["case_id"]: r for r in e.legitimate_context(e.case_state(cases(spark, named), as_of=False), ["case_id"]).collect()}
    assert rows["up"]["complete_agent_trust_chain"] and not rows["down"]["complete_agent_trust_chain"]


def test_unknown_tool_is_rejected(spark):
    with pytest.raises(ValueError, match="Unknown evidence tools"):
        e.evidence_packets(cases(spark, {"a": [BASE]}), ["timeline_summary", "nope"])


def fold_open(rows):
    state, out = None, []
    for action, context in rows:
        out.append(state)
        if context and action in d.RESOLVING_ACTIONS:
            state = None
        elif action in d.ALERT_ACTIONS:
            state = action
    return out


def fold_decisive(rows):
    held = None
    for i, (action, context) in enumerate(rows, 1):
        if action == "block":
            return i
        if action == "hold" and held is None:
            held = i
        elif held is not None and context and action in d.RESOLVING_ACTIONS:
            held = None
    return held


def random_decisions(n=300, seed=11):
    rng = random.Random(seed)
    return {f"c{i}": [(rng.choice(d.ACTIONS), rng.random() < 0.3) for _ in range(rng.randint(1, 9))] for i in range(n)}


def test_closed_forms_match_a_sequential_fold(spark, small_groups):
    spark.conf.set("spark.riskweave.hotGroupRows", "5")
    named = random_decisions()
    rows = [(c, i, a, ctx) for c, seq in named.items() for i, (a, ctx) in enumerate(seq, 1)]
    df = spark.createDataFrame(rows, "case_id string, sequence int, action string, has_legitimate_context boolean")
    opened = {(r["case_id"], r["sequence"]): r["unresolved_alert"] for r in g.unresolved_alert_state(df).collect()}
    decisive = {r["case_id"]: r["decisive_sequence"] for r in g.effective_decisive_turn(df).collect()}
    kept = {(r["case_id"], r["sequence"]) for r in g.stop_on_block(df).collect()}
    for case, seq in named.items():
        assert [opened[case, i] for i in range(1, len(seq) + 1)] == fold_open(seq)
        assert decisive.get(case) == fold_decisive(seq)
        first_block = next((i for i, (a, _) in enumerate(seq, 1) if a == "block"), len(seq))
        assert {i for c, i in kept if c == case} == set(range(1, first_block + 1))


def test_lane_matches_a_sequential_fold(spark):
    rng = random.Random(2)
    rows = []
    for c in range(200):
        for i in range(1, rng.randint(2, 8)):
            rows.append((f"c{c}", i, rng.choice(["SESSION_STARTED", PAY]), rng.choice(["allow", "monitor", "step_up", "hold"]), rng.random() < 0.5, rng.random() < 0.2, rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "case_id string, sequence int, event_type string, minimum_action string, verified boolean, above boolean, observable_risk_score int")
    got = {(r["case_id"], r["sequence"]): r["action"] for r in g.deterministic_lane(df.withColumn("indicator_codes", F.array().cast("array<string>")), "above").collect()}
    rank = {a: i for i, a in enumerate(d.ACTIONS)}
    state, current = None, None
    for case, seq, kind, floor, verified, above, _ in rows:
        if case != current:
            state, current = None, case
        low = floor
        if state in ("step_up", "hold") and kind == PAY:
            low = max((low, "hold"), key=rank.get)
        if verified and low == "allow" and state is None and not above:
            action = "allow"
        else:
            action = "monitor" if low == "allow" else low
            if above and rank[action] < rank["step_up"]:
                action = "step_up"
            if action in d.ALERT_ACTIONS:
                state = action
        assert got[case, seq] == action


def test_only_booleans_are_true(spark):
    """1, "yes" and "true" are neither verified markers nor signals."""
    loose = spark.createDataFrame([(1, 1, "yes", "true", True)], "event_id long, a int, b string, c string, d boolean")
    picked = loose.select(*[scalar.attr(loose, n, "boolean").alias(n) for n in "abcd"], scalar.attr(loose, "a", "double").alias("number")).first()
    assert tuple(picked) == (None, None, None, True, 1.0)
    assert loose.select(scalar.count_true(loose, ["a", "b", "c", "d"])).first()[0] == 1
