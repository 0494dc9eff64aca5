"""Registered queries: case evidence (E) and decision policy (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators import evidence as e
from riskweave.operators import policy as g
from riskweave.plans.registry import Tables, query
from riskweave.plans.views import with_views


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


_VM = f"event_type IN ({_quoted(d.VALUE_MOVING_TYPES)})"


def _any(cond: str) -> str:
    return f"max(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER w"


def _latest(name: str) -> str:
    return f"last_value({name} IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


# Oracle side of the evidence state: one column per fact, as of each event.
_STATE_COLUMNS = {
    "n": "count(*) OVER w",
    "nv": "count(*) FILTER (WHERE vm) OVER w",
    "elapsed": "(max(epoch_us(event_ts)) OVER w - min(epoch_us(event_ts)) OVER w) / 1e6",
    "val": "sum(CASE WHEN vm THEN coalesce(amount_inr, 0e0) ELSE 0e0 END) OVER w",
    "pays": "sum(CASE WHEN vm THEN coalesce(payment_count, 1) ELSE 0 END) OVER w",
    "maxc": "max(payment_count) OVER w",
    "maxa": "max(authorized_payment_count) OVER w",
    "ratio": "coalesce(max(CASE WHEN vm THEN coalesce(amount_inr, 0e0) / greatest(1e0, CASE WHEN coalesce(sender_baseline_amount_inr, amount_inr, 0e0) = 0 THEN 1e0 "
             "ELSE coalesce(sender_baseline_amount_inr, amount_inr) END) END) OVER w, 1e0)",
    "p0": "min(CASE WHEN lifecycle_phase = 'pre_transaction' THEN sequence END) OVER w",
    "p1": "min(CASE WHEN lifecycle_phase = 'transaction' THEN sequence END) OVER w",
    "p2": "min(CASE WHEN lifecycle_phase = 'post_transaction' THEN sequence END) OVER w",
    "chg": _any(f"event_type IN ({_quoted(d.CONTEXT_CHANGE_TYPES)})"),
    "nd": _any("device_is_new"), "nn": _any("network_is_new"), "sh": _any("device_shared_across_accounts"),
    "urg": _any("urgency_level >= 7"), "sw": _any("channel_switch_count >= 2"), "nb": _any("beneficiary_age_days <= 7"),
    "lnk": _any("linked_attribute_count >= 3"), "ret": _any("verification_retry_count >= 3"), "gap": _any("profile_consistency_score < 0.6"),
    "aut": _any("behavior_automation_suspected"), "cfl": _any("evidence_conflict_present"), "fan": _any("sender_count >= 4"),
    "out": _any("outflow_ratio >= 0.5"), "dis": _any("linked_dispute_count >= 5"),
    "op": _any("event_type = 'DISPUTE_OPENED'"), "rv": _any("event_type = 'DISPUTE_EVIDENCE_REVIEWED'"),
    "ap": _any("event_type = 'IDENTITY_APPLICATION_SUBMITTED'"), "ac": _any("event_type = 'ACCOUNT_OPENED'"),
    "pm": _any("event_type IN ('PAYMENT_INITIATED', 'AGENTIC_PAYMENT_INITIATED')"),
    "stale": _any("request_age_seconds > 300"), "rep": _any("nonce_reuse_count > 0"),
    **{f"f{i}": _any(f"{n} = false") for i, n in enumerate(d.AGENT_TRUST_FACTORS)},
    **{f"l{i}": _latest(n) for i, n in enumerate(d.AGENT_TRUST_FACTORS)},
    "m_dual_approval_complete": _any("dual_approval_complete"),
    "m_independent_checks_passed": _any("independent_checks_passed > 0"),
    "m_strong_authentication_passed": _any("strong_authentication_passed"),
    "m_supplier_relationship_days": _any("supplier_relationship_days >= 30"),
}
_MARKS = [c for c in _STATE_COLUMNS if c.startswith("m_")]
_STATE = (
    "SELECT *, " + ", ".join(f"{expr} AS {name}" for name, expr in _STATE_COLUMNS.items())
    + f" FROM (SELECT *, {_VM} AS vm FROM evidence_events) v WINDOW w AS (PARTITION BY case_id ORDER BY sequence)"
)
_RULES = [
    ("cross_phase_progression", 1, "(p0 IS NOT NULL)::INT + (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT >= 2"),
    ("cumulative_value_sequence", 2, "nv >= 2"),
    ("repeated_value_movement", 2, "event_type = 'PAYMENT_REPEATED' OR payment_count > 1"),
    ("agent_intent_count_mismatch", 4, "maxc > maxa"),
    ("downstream_value_release", 2, "event_type IN ('FUNDS_DISPERSED', 'PAYOUT_SETTLED', 'DISPUTE_REFUND_ISSUED')"),
    ("sensitive_context_change", 1, "chg = 1"),
    ("context_change_before_value", 2, "chg = 1 AND nv > 0"),
    ("new_device", 1, "nd = 1"), ("new_network", 1, "nn = 1"), ("shared_infrastructure", 2, "sh = 1"),
    ("communication_pressure", 2, "urg = 1"), ("channel_switching", 1, "sw = 1"), ("new_beneficiary", 2, "nb = 1"),
    ("extreme_amount_deviation", 3, "ratio >= 3"), ("amount_deviation", 2, "ratio >= 1.5 AND ratio < 3"),
    ("subtle_amount_deviation", 1, "ratio >= 1.15 AND ratio < 1.5"),
    ("dense_identity_linkage", 2, "lnk = 1"), ("verification_retries", 1, "ret = 1"), ("identity_consistency_gap", 2, "gap = 1"),
    ("automation_signal", 1, "aut = 1"), ("evidence_conflict", 2, "cfl = 1"), ("fan_in_concentration", 3, "fan = 1"), ("rapid_outflow", 2, "out = 1"),
    ("accelerated_payout_after_change", 2, "event_type = 'PAYOUT_REQUESTED' AND accelerated_settlement"),
    ("linked_dispute_burst", 2, "dis = 1"), ("dispute_evidence_sequence", 2, "op = 1 AND rv = 1"),
    ("refund_after_dispute_sequence", 3, "event_type = 'DISPUTE_REFUND_ISSUED' AND op = 1"),
    ("identity_to_payment_activation", 2, "ap = 1 AND ac = 1 AND pm = 1"),
    *[(f"{n}_failed", pts, f"f{i} = 1") for i, (n, pts) in enumerate(d.AGENT_TRUST_POINTS.items())],
    ("stale_agent_request", 1, "stale = 1"), ("agent_request_replay", 2, "rep = 1"),
]
_MARK_SUM = " + ".join(_MARKS)
_TRUST = "coalesce(l0 AND l1 AND l2 AND l3 AND l4, false)"
_SCORED = (
    "SELECT *, greatest(0, raw - disc) AS gs FROM (SELECT *, CASE WHEN ver THEN 4 + 2 * greatest(0, marks - 1) + CASE WHEN trust THEN 2 ELSE 0 END ELSE 0 END AS disc FROM ("
    f"SELECT *, {_MARK_SUM} AS marks, {_TRUST} AS trust, ({_MARK_SUM} > 0 OR {_TRUST}) AS ver, "
    + "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in _RULES) + ") AS codes, "
    + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in _RULES) + " AS raw FROM st) a) b"
)
_GUARD = (
    "SELECT *, CASE minact WHEN 'allow' THEN 'low' WHEN 'monitor' THEN 'medium' WHEN 'step_up' THEN CASE WHEN gs >= 5 THEN 'high' ELSE 'medium' END ELSE 'high' END AS band FROM ("
    "SELECT *, CASE WHEN ver AND gs < 3 THEN 'allow' WHEN lifecycle_phase = 'transaction' AND codes LIKE '%agent_intent_count_mismatch%' AND gs >= 4 THEN 'hold' "
    "WHEN lifecycle_phase = 'transaction' AND gs >= 6 THEN 'hold' WHEN lifecycle_phase = 'post_transaction' AND gs >= 8 THEN 'hold' WHEN gs >= 3 THEN 'step_up' "
    "WHEN gs >= 1 THEN 'monitor' ELSE 'allow' END AS minact FROM sc) c"
)
_ALL = {"st": _STATE, "sc": _SCORED, "gd": _GUARD}


def _ev(sql: str, *extra_views: str, **extra: str) -> str:
    return with_views(sql, "evidence_events", *extra_views, **_ALL, **extra)


_PHASE_TEXT = (
    "array_to_string(list_transform(list_sort(list_filter([CASE WHEN p0 IS NOT NULL THEN {'a': p0, 'b': 'pre_transaction'} END, "
    "CASE WHEN p1 IS NOT NULL THEN {'a': p1, 'b': 'transaction'} END, CASE WHEN p2 IS NOT NULL THEN {'a': p2, 'b': 'post_transaction'} END], "
    "lambda x: x IS NOT NULL)), lambda x: x.b), '|')"
)


@query("E1_timeline_summary", _ev(
    f"SELECT event_id, n AS event_count, nv AS value_event_count, {_PHASE_TEXT} AS lifecycle_phases_reached, CAST(round(elapsed) AS BIGINT) AS elapsed_seconds FROM st"))
def _(t: Tables):
    out = e.timeline_summary(e.case_state(t("evidence_events")), ["event_id"])
    return out.withColumn("lifecycle_phases_reached", F.array_join("lifecycle_phases_reached", "|"))


@query("E1_timeline_summary_final", _ev(
    f"SELECT case_id, n AS event_count, nv AS value_event_count, {_PHASE_TEXT} AS lifecycle_phases_reached, CAST(round(elapsed) AS BIGINT) AS elapsed_seconds "
    "FROM st QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY sequence DESC) = 1"))
def _(t: Tables):
    out = e.timeline_summary(e.case_state(t("evidence_events"), as_of=False), ["case_id"])
    return out.withColumn("lifecycle_phases_reached", F.array_join("lifecycle_phases_reached", "|"))


@query("E1_timeline_positions", _ev("SELECT case_id, sequence AS position, event_type, lifecycle_phase FROM evidence_events"))
def _(t: Tables):
    return e.timeline_positions(t("evidence_events"))


@query("E1_event_type_counts", _ev("SELECT case_id, event_type, count(*) AS events FROM evidence_events GROUP BY ALL"))
def _(t: Tables):
    return e.event_type_counts(t("evidence_events"))


@query("E2_velocity_profile", _ev(
    "SELECT event_id, CAST(round(elapsed) AS BIGINT) AS elapsed_seconds, nv AS value_event_count, CAST(pays AS BIGINT) AS declared_payment_count, round(val, 2) AS observed_value_inr, "
    "round(n / greatest(elapsed / 60, 1e0), 3) AS events_per_minute FROM st"))
def _(t: Tables):
    return e.velocity_profile(e.case_state(t("evidence_events")), ["event_id"])


@query("E3_payment_context", _ev(
    "SELECT case_id, event_id, amount_inr, b AS baseline_amount_inr, CAST(round(CAST(CAST(amount_inr / greatest(b, 1e0) AS VARCHAR) AS DECIMAL(36, 18)), 3) AS DOUBLE) AS amount_to_baseline_ratio, "
    "CAST(beneficiary_age_days AS DOUBLE) AS beneficiary_age_days, coalesce(payment_count, 1) AS payment_count FROM ("
    "SELECT *, coalesce(sender_baseline_amount_inr, CASE WHEN amount_inr = 0 THEN 1e0 ELSE amount_inr END) AS b FROM evidence_events WHERE amount_inr IS NOT NULL) q"))
def _(t: Tables):
    return e.payment_context(t("evidence_events"))


_MARK_TEXT = "concat_ws('|', " + ", ".join(f"CASE WHEN {m} = 1 THEN '{m[2:]}' END" for m in sorted(_MARKS)) + ")"


@query("E4_legitimate_context", _ev(
    "SELECT event_id, ver AS independent_verification_found, CASE WHEN trust AND marks > 0 THEN 'corroborated' WHEN ver THEN 'verified' ELSE 'unverified' END AS verification_strength, "
    f"{_MARK_TEXT} AS verified_markers, trust AS complete_agent_trust_chain FROM sc"))
def _(t: Tables):
    out = e.legitimate_context(e.case_state(t("evidence_events")), ["event_id"])
    return out.withColumn("verified_markers", F.array_join("verified_markers", "|"))


_ENT = (
    "SELECT case_id, event_id, sequence, 'sender_account' AS kind, sender_account_id AS value FROM evidence_events UNION ALL "
    "SELECT case_id, event_id, sequence, 'beneficiary', beneficiary_id FROM evidence_events WHERE beneficiary_id IS NOT NULL UNION ALL "
    "SELECT case_id, event_id, sequence, 'device', device_id FROM evidence_events WHERE device_id IS NOT NULL"
)
_EDGES = "CASE WHEN beneficiary_id IS NOT NULL AND device_id IS NOT NULL THEN 3 WHEN beneficiary_id IS NOT NULL OR device_id IS NOT NULL THEN 1 ELSE 0 END"
_EXPLICIT = "CASE WHEN linked_attribute_count IS NOT NULL OR device_shared_across_accounts IS NOT NULL THEN 1 ELSE 0 END"


@query("E5_entity_linkage", _ev(
    "SELECT t.case_id, edges AS relationship_edge_count, expl AS explicit_linkage_observations, coalesce(u, 0) AS unique_entity_count, coalesce(r, 0) AS repeated_entity_count FROM ("
    f"SELECT case_id, CAST(sum({_EDGES}) AS BIGINT) AS edges, CAST(sum({_EXPLICIT}) AS BIGINT) AS expl FROM evidence_events GROUP BY 1) t "
    "LEFT JOIN (SELECT case_id, count(DISTINCT value) AS u FROM ent GROUP BY 1) a ON a.case_id = t.case_id "
    "LEFT JOIN (SELECT case_id, count(*) AS r FROM (SELECT case_id, value FROM ent GROUP BY ALL HAVING count(*) > 1) z GROUP BY 1) b ON b.case_id = t.case_id", ent=_ENT))
def _(t: Tables):
    return e.entity_linkage(t("evidence_events"))


@query("E5_entity_linkage_as_of", _ev(
    "SELECT c.case_id, c.event_id, count(DISTINCT p.value) AS unique_entity_count, any_value(x.edges) AS relationship_edge_count, any_value(x.expl) AS explicit_linkage_observations "
    f"FROM evidence_events c JOIN ent p ON p.case_id = c.case_id AND p.sequence <= c.sequence JOIN (SELECT event_id, CAST(sum({_EDGES}) OVER w AS BIGINT) AS edges, "
    f"CAST(sum({_EXPLICIT}) OVER w AS BIGINT) AS expl FROM evidence_events WINDOW w AS (PARTITION BY case_id ORDER BY sequence)) x ON x.event_id = c.event_id GROUP BY 1, 2", ent=_ENT))
def _(t: Tables):
    return e.entity_linkage(t("evidence_events"), as_of=True)


@query("E5_repeated_entity_paths", _ev(
    "SELECT e.case_id, e.value, n AS path_count, concat('event_', CAST(sequence AS VARCHAR), '.', kind, '_id') AS path FROM ent e JOIN ("
    "SELECT case_id, value, count(*) AS n FROM ent GROUP BY ALL HAVING count(*) > 1) r ON r.case_id = e.case_id AND r.value = e.value", ent=_ENT))
def _(t: Tables):
    return e.repeated_entity_paths(t("evidence_events"))


def _obs(parts: dict[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"'{n}=' || {c}" for n, c in sorted(parts.items())) + ")"


def _joined(column: str):
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "|")


_BEHAVIOR = _obs({"behavior_automation_suspected": "CAST(behavior_automation_suspected AS VARCHAR)", "verification_retry_count": "CAST(verification_retry_count AS VARCHAR)"})
_COMM = _obs({"urgency_level": "CAST(urgency_level AS VARCHAR)", "channel_switch_count": "CAST(channel_switch_count AS VARCHAR)"})


@query("E6_behavioral_observations", _ev(f"SELECT * FROM (SELECT case_id, event_id, {_BEHAVIOR} AS signals FROM evidence_events) q WHERE signals <> ''"))
def _(t: Tables):
    return e.behavioral_observations(t("evidence_events")).withColumn("signals", _joined("signals"))


@query("E7_communication_observations", _ev(
    f"SELECT case_id, event_id, signals FROM (SELECT *, {_COMM} AS signals FROM evidence_events) q WHERE signals <> '' OR event_type = 'COMMUNICATION_RISK_CONTEXT'"))
def _(t: Tables):
    return e.communication_observations(t("evidence_events")).withColumn("signals", _joined("signals"))


@query("E8_evidence_quality", _ev(
    "SELECT case_id, count(*) FILTER (WHERE evidence_conflict_present IS NOT NULL OR profile_consistency_score IS NOT NULL) AS quality_metadata_event_count, "
    "count(*) FILTER (WHERE evidence_conflict_present) AS conflicting_evidence_count FROM evidence_events GROUP BY 1"))
def _(t: Tables):
    return e.evidence_quality(t("evidence_events"))


_GUARD_SQL = "codes AS indicator_codes, CAST(raw AS INT) AS raw_risk_score, ver AS verified, CAST(disc AS INT) AS verification_discount, CAST(gs AS INT) AS observable_risk_score, minact AS minimum_action, band AS risk_band"
_GUARD_OUT = ["raw_risk_score", "verified", "verification_discount", "observable_risk_score", "minimum_action", "risk_band"]


def _codes():
    return F.array_join("indicator_codes", "|").alias("indicator_codes")


@query("E9_risk_indicators", _ev("SELECT event_id, codes AS indicator_codes, CAST(raw AS INT) AS raw_risk_score FROM sc"))
def _(t: Tables):
    return e.risk_indicators(e.case_state(t("evidence_events"))).select("event_id", _codes(), "raw_risk_score")


@query("E10_E11_case_guard", _ev(f"SELECT event_id, {_GUARD_SQL} FROM gd"))
def _(t: Tables):
    return e.case_guard(t("evidence_events")).select("event_id", _codes(), *_GUARD_OUT)


@query("E11_case_guard_final", _ev(f"SELECT case_id, {_GUARD_SQL} FROM gd QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY sequence DESC) = 1"))
def _(t: Tables):
    return e.case_guard(t("evidence_events"), as_of=False).select("case_id", _codes(), *_GUARD_OUT)


@query("E13_evidence_packets", _ev(
    "SELECT case_id, event_id AS as_of_event_id, tool AS tool_name, concat('evidence_', right(CAST(event_id AS VARCHAR), 8), '_', CAST(i AS VARCHAR)) AS evidence_id, 9e-1 AS confidence, "
    "CASE tool WHEN 'velocity_profile' THEN pays WHEN 'case_risk_synthesis' THEN gs WHEN 'entity_linkage' THEN u WHEN 'legitimate_alternatives' THEN CAST(ver AS INT) END AS fact FROM ("
    "SELECT g.*, u FROM gd g JOIN (SELECT c.event_id, count(DISTINCT p.value) AS u FROM evidence_events c JOIN ent p ON p.case_id = c.case_id AND p.sequence <= c.sequence GROUP BY 1) n "
    "ON n.event_id = g.event_id) q, (SELECT unnest(['case_risk_synthesis', 'legitimate_alternatives', 'velocity_profile', 'entity_linkage']) AS tool, unnest([1, 2, 3, 4]) AS i) tl", ent=_ENT
).replace("CAST(ver AS INT) END AS fact", "CAST(ver AS INT) END::BIGINT AS fact"))
def _(t: Tables):
    tools = ["case_risk_synthesis", "legitimate_alternatives", "velocity_profile", "entity_linkage"]
    packets = e.evidence_packets(t("evidence_events"), tools)
    paths = {
        "case_risk_synthesis": "$.observable_risk_score", "velocity_profile": "$.declared_payment_count",
        "entity_linkage": "$.unique_entity_count", "legitimate_alternatives": "$.independent_verification_found",
    }
    fact = None
    for tool, path in paths.items():
        value = F.get_json_object("facts", path)
        value = value.cast("boolean").cast("long") if tool == "legitimate_alternatives" else value.cast("long")
        fact = (F.when if fact is None else fact.when)(F.col("tool_name") == tool, value)
    return packets.select("case_id", "as_of_event_id", "tool_name", "evidence_id", "confidence", fact.alias("fact"))


@query("E14_cooccurrence_edges", _ev(
    "SELECT event_id, sender_account_id AS source, 'sender_account' AS source_kind, beneficiary_id AS target, 'beneficiary' AS target_kind FROM evidence_events WHERE beneficiary_id IS NOT NULL UNION ALL "
    "SELECT event_id, sender_account_id, 'sender_account', device_id, 'device' FROM evidence_events WHERE device_id IS NOT NULL UNION ALL "
    "SELECT event_id, beneficiary_id, 'beneficiary', device_id, 'device' FROM evidence_events WHERE beneficiary_id IS NOT NULL AND device_id IS NOT NULL"))
def _(t: Tables):
    return e.cooccurrence_edges(t("evidence_events"))


# ---------------------------------------------------------------- policy

_RANK = "CASE {c} WHEN 'allow' THEN 0 WHEN 'monitor' THEN 1 WHEN 'step_up' THEN 2 WHEN 'hold' THEN 3 WHEN 'block' THEN 4 ELSE -1 END"


def _rank(c: str) -> str:
    return _RANK.format(c=c)


_OPEN = (
    "SELECT *, nullif(last_value(CASE WHEN has_legitimate_context AND action IN ('allow', 'monitor', 'step_up') THEN '-' WHEN action IN ('step_up', 'hold', 'block') THEN action END IGNORE NULLS) "
    "OVER (PARTITION BY case_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-') AS unresolved FROM decisions"
)


@query("G1_unresolved_alert_state", with_views("SELECT event_id, unresolved AS unresolved_alert FROM o", "decisions", o=_OPEN))
def _(t: Tables):
    return g.unresolved_alert_state(t("decisions")).select("event_id", "unresolved_alert")


_JOINED = "SELECT g.*, o.action, o.unresolved, o.has_legitimate_context FROM gd g JOIN o ON o.event_id = g.event_id"
_OPMIN = (
    f"SELECT *, CASE WHEN unresolved IN ('step_up', 'hold') AND vm AND {_rank('minact')} < 3 THEN 'hold' ELSE minact END AS opmin FROM j"
)


def _policy(sql: str, **extra: str) -> str:
    return _ev(sql, "decisions", o=_OPEN, j=_JOINED, om=_OPMIN, **extra)


def guarded_decisions(t: Tables):
    guard = e.case_guard(t("evidence_events"))
    open_alerts = g.unresolved_alert_state(t("decisions")).select("event_id", "action", "unresolved_alert", "has_legitimate_context")
    return g.operational_minimum(guard.join(open_alerts, "event_id"))


@query("G2_operational_minimum", _policy("SELECT event_id, opmin AS operational_minimum_action FROM om"))
def _(t: Tables):
    return guarded_decisions(t).select("event_id", "operational_minimum_action")


_LANE_BASE = (
    "SELECT *, k % 10 = 0 AS above, ver AND minact = 'allow' AND NOT (k % 10 = 0) AS ex, CASE WHEN k % 10 = 0 AND minact IN ('allow', 'monitor') THEN 'step_up' "
    "WHEN minact = 'allow' THEN 'monitor' ELSE minact END AS raised FROM gd"
)
_LANE = (
    "SELECT *, CASE WHEN prior AND vm THEN 'hold' WHEN ex AND NOT prior THEN 'allow' ELSE raised END AS act FROM (SELECT *, coalesce(bool_or(NOT ex AND raised IN ('step_up', 'hold', 'block')) "
    "OVER (PARTITION BY case_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prior FROM lb) q"
)
_CODE_LIST = "string_split(codes, '|')"
_REASONS = (
    "concat_ws('|', " + ", ".join(
        f"CASE WHEN list_has_any({_CODE_LIST}, [{_quoted(signals)}]) THEN '{reason}' END" for signals, reason in g.REASON_GROUPS
    ) + ", CASE WHEN above THEN 'behavior_sequence' END)"
)
_LANE_REASON = (
    f"CASE WHEN ex AND NOT prior THEN 'legitimate_context' WHEN {_REASONS} = '' THEN 'insufficient_evidence' ELSE array_to_string(string_split({_REASONS}, '|')[1:5], '|') END"
)


@query("G3_deterministic_lane", _ev(
    "SELECT event_id, act AS action, CASE act WHEN 'allow' THEN 'low' WHEN 'monitor' THEN 'medium' WHEN 'step_up' THEN CASE WHEN gs >= 5 THEN 'high' ELSE 'medium' END ELSE 'high' END AS risk_level, "
    f"CASE WHEN ex AND NOT prior THEN 98e-2 WHEN act = 'hold' THEN 78e-2 ELSE 64e-2 END AS confidence, {_LANE_REASON} AS reason_codes FROM ln", lb=_LANE_BASE, ln=_LANE))
def _(t: Tables):
    events = t("evidence_events").withColumn("above", F.col("k") % 10 == 0)
    out = g.decide_cases(events, "above")
    return out.select("event_id", "action", "risk_level", "confidence", F.array_join("reason_codes", "|").alias("reason_codes"))


@query("G4_fallback_reason_codes", _ev(
    f"SELECT event_id, CASE WHEN {_REASONS} = '' THEN 'insufficient_evidence' ELSE array_to_string(string_split({_REASONS}, '|')[1:5], '|') END AS reason_codes FROM lb", lb=_LANE_BASE))
def _(t: Tables):
    guard = e.case_guard(t("evidence_events"))
    reasons = g.fallback_reason_codes(F.col("indicator_codes"), F.col("k") % 10 == 0)
    return guard.select("event_id", F.array_join(reasons, "|").alias("reason_codes"))


# Decisions with reasons, references and a risk level, deliberately inconsistent in places.
_DEC = (
    "SELECT *, CASE WHEN has_legitimate_context THEN CASE WHEN k % 2 = 0 THEN ['legitimate_context'] ELSE ['velocity', 'legitimate_context'] END "
    "WHEN k % 5 = 0 THEN ['insufficient_evidence'] WHEN k % 7 = 0 THEN ['made_up', 'velocity'] ELSE ['velocity', 'amount_anomaly'] END AS reasons, "
    "CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS risk, "
    "CASE WHEN k % 9 = 0 THEN 12e-1 ELSE 5e-1 END AS conf, CASE WHEN k % 8 = 0 THEN ['e1', 'e9'] ELSE ['e1'] END AS refs FROM om"
)


def full_decisions(t: Tables):
    k, ctx = F.col("k"), F.col("has_legitimate_context")

    def texts(*values):
        return F.array(*[F.lit(v) for v in values])

    reasons = (
        F.when(ctx & (k % 2 == 0), texts("legitimate_context")).when(ctx, texts("velocity", "legitimate_context"))
        .when(k % 5 == 0, texts("insufficient_evidence")).when(k % 7 == 0, texts("made_up", "velocity"))
        .otherwise(texts("velocity", "amount_anomaly"))
    )
    risk = F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("critical")
    return guarded_decisions(t).withColumns({
        "reason_codes": reasons, "risk_level": risk, "confidence": F.when(k % 9 == 0, 1.2).otherwise(0.5),
        "evidence_refs": F.when(k % 8 == 0, texts("e1", "e9")).otherwise(texts("e1")),
        "available_evidence": texts("e1", "e2"), "risk_evidence_id": F.lit("e2"),
    }).drop("has_legitimate_context")


_FLOOR = (
    "SELECT *, CASE WHEN lc THEN minact ELSE opmin END AS floor, guardr FROM (SELECT *, CASE WHEN list_contains(reasons, 'legitimate_context') AND NOT ver THEN list_filter(reasons, lambda x: x <> 'legitimate_context') "
    "ELSE reasons END AS kept, list_contains(reasons, 'legitimate_context') AND ver AS lc, CASE WHEN codes LIKE '%cross_phase_progression%' THEN 'cross_phase_pattern' ELSE 'behavior_sequence' END AS guardr FROM dec) q"
)
_UP = f"{_rank('action')} < {_rank('floor')}"


@query("G5_apply_floor", _policy(
    f"SELECT event_id, CASE WHEN {_UP} THEN floor ELSE action END AS action, CASE WHEN {_UP} THEN band ELSE risk END AS risk_level, "
    f"CASE WHEN {_UP} THEN array_to_string(list_concat(list_filter(kept, lambda x: x <> 'insufficient_evidence'), [guardr]), '|') "
    "WHEN len(kept) = 0 THEN 'behavior_sequence' ELSE array_to_string(kept, '|') END AS reason_codes, "
    f"CASE WHEN {_UP} THEN array_to_string(list_concat(refs, ['e2']), '|') ELSE array_to_string(refs, '|') END AS evidence_refs, "
    "concat_ws('|', CASE WHEN list_contains(reasons, 'legitimate_context') AND NOT ver THEN 'removed_unsupported_context' END, "
    f"CASE WHEN {_UP} THEN concat('raised_from_', action, '_to_', floor) END) AS adjustments FROM fl", dec=_DEC, fl=_FLOOR))
def _(t: Tables):
    out = g.apply_floor(full_decisions(t))
    return out.select("event_id", "action", "risk_level", *[F.array_join(c, "|").alias(c) for c in ("reason_codes", "evidence_refs", "adjustments")])


@query("G6_normalize_risk_label", _policy(
    "SELECT event_id, CASE WHEN unresolved IS NOT NULL AND NOT list_contains(reasons, 'legitimate_context') AND fixed = 'low' AND action <> 'allow' THEN 'medium' ELSE fixed END AS risk_level FROM ("
    "SELECT *, CASE WHEN action = 'allow' THEN 'low' WHEN action = 'step_up' AND risk = 'low' THEN 'medium' WHEN action = 'hold' AND risk IN ('low', 'medium') THEN 'high' "
    "WHEN action = 'block' THEN 'critical' ELSE risk END AS fixed FROM dec) q", dec=_DEC))
def _(t: Tables):
    return g.normalize_risk_label(full_decisions(t)).select("event_id", "risk_level")


_CTX = "list_contains(reasons, 'legitimate_context')"
_VIOLATIONS = {
    "confidence_range": "conf > 1",
    "invalid_reasons": "list_contains(reasons, 'made_up')",
    "unavailable_evidence": "list_contains(refs, 'e9')",
    "action_risk_mismatch": "NOT (action = 'allow' AND risk = 'low' OR action = 'monitor' AND risk IN ('low', 'medium', 'high') OR action = 'step_up' AND risk IN ('medium', 'high', 'critical') "
                            "OR action = 'hold' AND risk IN ('high', 'critical') OR action = 'block' AND risk = 'critical')",
    "unsupported_context": f"{_CTX} AND NOT ver",
    "below_floor": f"{_rank('action')} < {_rank('fl')}",
    "open_alert_low_risk": f"unresolved IS NOT NULL AND NOT {_CTX} AND risk = 'low'",
    "open_step_up_must_escalate": f"unresolved = 'step_up' AND vm AND NOT {_CTX} AND action NOT IN ('hold', 'block')",
    "open_hold_must_stay": f"unresolved = 'hold' AND vm AND NOT {_CTX} AND action NOT IN ('hold', 'block')",
    "open_alert_downgrade": f"action = 'allow' AND unresolved IS NOT NULL AND NOT {_CTX}",
    "allow_without_reason": f"action = 'allow' AND unresolved IS NULL AND NOT {_CTX} AND NOT list_contains(reasons, 'insufficient_evidence')",
    "allow_over_floor": "action = 'allow' AND fl IN ('step_up', 'hold', 'block')",
}


@query("G7_policy_violations", _policy(
    "SELECT event_id, concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _VIOLATIONS.items())
    + f") AS violations FROM (SELECT *, CASE WHEN {_CTX} AND ver THEN minact ELSE opmin END AS fl FROM dec) q", dec=_DEC))
def _(t: Tables):
    return g.policy_violations(full_decisions(t)).select("event_id", F.array_join("violations", "|").alias("violations"))


DECISIVE = (
    "SELECT case_id, coalesce(b, h) AS decisive_sequence FROM (SELECT d.case_id, min(CASE WHEN action = 'block' THEN sequence END) AS b, "
    "min(CASE WHEN action = 'hold' AND sequence > coalesce(r, 0) THEN sequence END) AS h FROM decisions d JOIN (SELECT case_id, max(CASE WHEN has_legitimate_context AND action IN ('allow', 'monitor', 'step_up') "
    "THEN sequence END) AS r FROM decisions GROUP BY 1) x ON x.case_id = d.case_id GROUP BY 1) q WHERE coalesce(b, h) IS NOT NULL"
)


@query("G8_effective_decisive_turn", with_views("SELECT * FROM dt", "decisions", dt=DECISIVE))
def _(t: Tables):
    return g.effective_decisive_turn(t("decisions"))


@query("G9_stop_on_block", with_views(
    "SELECT event_id, case_id, sequence, action FROM (SELECT *, coalesce(bool_or(action = 'block') OVER (PARTITION BY case_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped "
    "FROM decisions) q WHERE NOT stopped", "decisions"))
def _(t: Tables):
    return g.stop_on_block(t("decisions")).select("event_id", "case_id", "sequence", "action")
