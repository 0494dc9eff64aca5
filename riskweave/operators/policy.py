"""Decision policy over decision tables. Stateful rules are closed forms over ordered cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators.evidence import case_guard, is_value_moving
from riskweave.operators.ordered import HotGroups, Running, find_hot, running

# Reason given for each group of guard indicators, in reporting order.
REASON_GROUPS = (
    (("new_device",), "device_novelty"),
    (("new_network",), "network_novelty"),
    (("new_beneficiary", "novel_payout_destination"), "beneficiary_novelty"),
    (("amount_deviation", "subtle_amount_deviation", "extreme_amount_deviation"), "amount_anomaly"),
    (("repeated_value_movement", "cumulative_value_sequence", "rapid_outflow", "sales_velocity_shift"), "velocity"),
    (("cross_phase_progression",), "cross_phase_pattern"),
    (("shared_infrastructure", "fan_in_concentration"), "graph_concentration"),
)
MAX_REASONS = 5


def action_rank(action: Column) -> Column:
    """0 for allow up to 4 for block; -1 for anything else."""
    out = None
    for i, name in enumerate(d.ACTIONS):
        out = (F.when if out is None else out.when)(action == name, F.lit(i))
    return out.otherwise(F.lit(-1))


def action_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in d.ACTIONS]), (rank + 1).cast("int"))


def cites_context(df: DataFrame) -> Column:
    """Whether the decision cites legitimate_context (flag column or reason list)."""
    if "has_legitimate_context" in df.columns:
        return F.coalesce(F.col("has_legitimate_context"), F.lit(False))
    return F.coalesce(F.array_contains("reason_codes", "legitimate_context"), F.lit(False))


def resolves(df: DataFrame) -> Column:
    return cites_context(df) & F.col("action").isin(*d.RESOLVING_ACTIONS)


def unresolved_alert_state(
    decisions: DataFrame, case: str = "case_id", order: Sequence[str] = ("sequence",), hot: HotGroups | None = None
) -> DataFrame:
    """G1: the last alert action of earlier decisions that no resolving decision has cleared."""
    mark = F.when(resolves(decisions), F.lit("-")).when(F.col("action").isin(*d.ALERT_ACTIONS), F.col("action"))
    walked = running(decisions, [case], order, {"_mark": Running("last", mark, current=False)}, hot=hot)
    return walked.withColumn("unresolved_alert", F.nullif("_mark", F.lit("-"))).drop("_mark")


def continuity_minimum(unresolved: Column, value_moving: Column) -> Column:
    return F.when(unresolved.isin("step_up", "hold") & value_moving, F.lit("hold")).otherwise(F.lit("allow"))


def operational_minimum(df: DataFrame, unresolved: str = "unresolved_alert") -> DataFrame:
    """The stronger of the guard minimum and the continuity minimum."""
    floor = continuity_minimum(F.col(unresolved), is_value_moving(F.col("event_type")))
    rank = F.greatest(action_rank(F.col("minimum_action")), action_rank(floor))
    return df.withColumn("operational_minimum_action", action_of_rank(rank))


def fallback_reason_codes(codes: Column, above: Column) -> Column:
    """Reasons from indicator groups, behaviour when the model is above threshold, at most five."""
    found = [
        F.when(F.arrays_overlap(codes, F.array(*[F.lit(s) for s in signals])), F.lit(reason))
        for signals, reason in REASON_GROUPS
    ]
    named = F.array_distinct(F.array_compact(F.array(*found, F.when(above, F.lit("behavior_sequence")))))
    return F.when(F.size(named) == 0, F.array(F.lit("insufficient_evidence"))).otherwise(F.slice(named, 1, MAX_REASONS))


def deterministic_lane(
    guarded: DataFrame, above: str | None = None, case: str = "case_id", order: Sequence[str] = ("sequence",),
    hot: HotGroups | None = None,
) -> DataFrame:
    """Decisions of the rule lane.

    The lane cites legitimate context only while no alert is open, so an alert is never cleared inside
    it: "an alert happened before" is enough to know the state, and no recursion is needed.
    """
    over = F.coalesce(F.col(above), F.lit(False)) if above else F.lit(False)
    floor = F.col("minimum_action")
    exit_allowed = F.col("verified") & (floor == "allow") & ~over
    raised = F.when(floor == "allow", F.lit("monitor")).otherwise(floor)
    raised = F.when(over & (action_rank(raised) < action_rank(F.lit("step_up"))), F.lit("step_up")).otherwise(raised)
    base = F.when(exit_allowed, F.lit("allow")).otherwise(raised)
    walked = running(
        guarded.withColumns({"_base": base, "_raised": raised, "_exit": exit_allowed}), [case], order,
        {"_prior": Running("max", base.isin(*d.ALERT_ACTIONS).cast("int"), current=False)}, hot=hot,
    )
    prior = F.coalesce(F.col("_prior"), F.lit(0)) == 1
    fast = F.col("_exit") & ~prior
    action = (
        F.when(prior & is_value_moving(F.col("event_type")), F.lit("hold"))
        .when(fast, F.lit("allow")).otherwise(F.col("_raised"))
    )
    chosen = F.col("action")
    risk = (
        F.when(chosen == "allow", F.lit("low")).when(chosen == "monitor", F.lit("medium"))
        .when(chosen == "step_up", F.when(F.col("observable_risk_score") >= 5, F.lit("high")).otherwise(F.lit("medium")))
        .when(chosen == "hold", F.lit("high")).otherwise(F.lit("critical"))
    )
    confidence = F.when(fast, F.lit(0.98)).when(chosen.isin(*d.DECISIVE_ACTIONS), F.lit(0.78)).otherwise(F.lit(0.64))
    reasons = F.when(fast, F.array(F.lit("legitimate_context"))).otherwise(fallback_reason_codes(F.col("indicator_codes"), over))
    decided = walked.withColumn("action", action)
    return decided.withColumns({"risk_level": risk, "confidence": confidence, "reason_codes": reasons}).drop(
        "_base", "_raised", "_exit", "_prior"
    )


def decide_cases(df: DataFrame, above: str | None = None, case: str = "case_id", ts: str = "event_ts") -> DataFrame:
    """Evidence guard and deterministic lane for every event, with the case sizes counted once."""
    hot = find_hot(df, [case])
    return deterministic_lane(case_guard(df, case, ts=ts, hot=hot), above, case, hot=hot)


def apply_floor(df: DataFrame) -> DataFrame:
    """Strip unsupported context, raise the action to the guard floor and explain it.

    Needs action, risk_level, reason_codes, evidence_refs, verified, minimum_action,
    operational_minimum_action, risk_band, indicator_codes and risk_evidence_id. Adds ``adjustments``.
    """
    reasons = F.col("reason_codes")
    unsupported = F.array_contains(reasons, "legitimate_context") & ~F.col("verified")
    kept = F.when(unsupported, F.array_remove(reasons, "legitimate_context")).otherwise(reasons)
    own = F.array_contains(kept, "legitimate_context") & F.col("verified")
    floor = F.when(own, F.col("minimum_action")).otherwise(F.col("operational_minimum_action"))
    raised = action_rank(F.col("action")) < action_rank(floor)
    guard_reason = F.when(
        F.array_contains("indicator_codes", "cross_phase_progression"), F.lit("cross_phase_pattern")
    ).otherwise(F.lit("behavior_sequence"))
    guarded = F.array_distinct(F.concat(F.array_remove(kept, "insufficient_evidence"), F.array(guard_reason)))
    final = F.when(raised, F.slice(guarded, 1, MAX_REASONS)).otherwise(kept)
    final = F.when(F.size(final) == 0, F.array(F.lit("behavior_sequence"))).otherwise(final)
    refs = F.col("evidence_refs")
    with_ref = F.slice(F.when(F.array_contains(refs, F.col("risk_evidence_id")), refs).otherwise(
        F.concat(refs, F.array(F.col("risk_evidence_id")))), 1, MAX_REASONS)
    notes = F.array_compact(F.array(
        F.when(unsupported, F.lit("removed_unsupported_context")),
        F.when(raised, F.concat(F.lit("raised_from_"), F.col("action"), F.lit("_to_"), floor)),
    ))
    return df.withColumns({
        "action": F.when(raised, floor).otherwise(F.col("action")),
        "risk_level": F.when(raised, F.col("risk_band")).otherwise(F.col("risk_level")),
        "reason_codes": final,
        "evidence_refs": F.when(raised, with_ref).otherwise(refs),
        "adjustments": notes,
    })


def normalize_risk_label(df: DataFrame, unresolved: str = "unresolved_alert") -> DataFrame:
    """Bring the risk level in line with the action."""
    action, risk = F.col("action"), F.col("risk_level")
    fixed = (
        F.when(action == "allow", F.lit("low"))
        .when((action == "step_up") & (risk == "low"), F.lit("medium"))
        .when((action == "hold") & risk.isin("low", "medium"), F.lit("high"))
        .when(action == "block", F.lit("critical")).otherwise(risk)
    )
    lifted = F.col(unresolved).isNotNull() & ~cites_context(df) & (fixed == "low") & (action != "allow")
    return df.withColumn("risk_level", F.when(lifted, F.lit("medium")).otherwise(fixed))


def policy_violations(df: DataFrame) -> DataFrame:
    """Names of the decision rules each decision breaks.

    Needs event_id, event_type, action, risk_level, confidence, reason_codes, evidence_refs,
    available_evidence, verified, minimum_action, operational_minimum_action and unresolved_alert;
    ``decision_event_id`` is compared with event_id when present.
    """
    action, risk, reasons = F.col("action"), F.col("risk_level"), F.col("reason_codes")
    context = F.array_contains(reasons, "legitimate_context")
    verified = F.col("verified")
    floor = F.when(context & verified, F.col("minimum_action")).otherwise(F.col("operational_minimum_action"))
    alert = F.col("unresolved_alert")
    open_alert = alert.isNotNull()
    fits = F.lit(False)
    for name, levels in d.ALLOWED_RISKS.items():
        fits = fits | ((action == name) & risk.isin(*levels))
    known = F.array(*[F.lit(r) for r in d.REASON_CODES])
    moving = is_value_moving(F.col("event_type"))
    weak = ~action.isin(*d.DECISIVE_ACTIONS)
    allow = action == "allow"
    explains = F.arrays_overlap(reasons, F.array(F.lit("legitimate_context"), F.lit("insufficient_evidence")))
    other_event = (
        ~F.col("decision_event_id").eqNullSafe(F.col("event_id")) if "decision_event_id" in df.columns else F.lit(False)
    )
    checks = [
        ("wrong_event", other_event),
        ("unknown_action_or_risk", ~(action.isin(*d.ACTIONS) & risk.isin(*d.RISK_LEVELS))),
        ("confidence_range", ~F.col("confidence").between(0.0, 1.0)),
        ("invalid_reasons", (F.size(F.array_except(reasons, known)) > 0) | (F.size(reasons) == 0)),
        ("unavailable_evidence", F.size(F.array_except("evidence_refs", "available_evidence")) > 0),
        ("action_risk_mismatch", ~fits),
        ("unsupported_context", context & ~verified),
        ("below_floor", action_rank(action) < action_rank(floor)),
        ("open_alert_low_risk", open_alert & ~context & (risk == "low")),
        ("open_step_up_must_escalate", (alert == "step_up") & moving & ~context & weak),
        ("open_hold_must_stay", (alert == "hold") & moving & ~context & weak),
        ("open_alert_downgrade", allow & open_alert & ~context),
        ("allow_without_reason", allow & ~open_alert & ~explains),
        ("allow_over_floor", allow & floor.isin(*d.ALERT_ACTIONS)),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))
    return df.withColumn("violations", found)


def effective_decisive_turn(decisions: DataFrame, case: str = "case_id", by: Sequence[str] = ()) -> DataFrame:
    """Per case, the first block, else the first hold after the last resolving decision.

    Two aggregations; the join between them only carries hold rows and one row per case.
    """
    keys = [*by, case]
    seq = F.col("sequence")
    marks = decisions.groupBy(*keys).agg(
        F.min(F.when(F.col("action") == "block", seq)).alias("_block"), F.max(F.when(resolves(decisions), seq)).alias("_reset")
    )
    holds = decisions.where(F.col("action") == "hold").select(*keys, seq.alias("_hold")).join(
        marks.select(*keys, F.col("_reset").alias("_r")), keys
    ).where(F.col("_r").isNull() | (F.col("_hold") > F.col("_r"))).groupBy(*keys).agg(F.min("_hold").alias("_hold"))
    return (
        marks.join(holds, keys, "left")
        .select(*keys, F.coalesce("_block", "_hold").alias("decisive_sequence"))
        .where(F.col("decisive_sequence").isNotNull())
    )


def stop_on_block(decisions: DataFrame, case: str = "case_id", order: Sequence[str] = ("sequence",)) -> DataFrame:
    """Rows up to and including the first block of each case."""
    blocked = (F.col("action") == "block").cast("int")
    walked = running(decisions, [case], order, {"_b": Running("max", blocked, current=False)})
    return walked.where(F.coalesce("_b", F.lit(0)) == 0).drop("_b")
