"""Scoring of decisions against sealed truth, per round.

Inputs share these columns: ``round_id``, ``case_id``, ``role`` (attack / control / ambient),
``event_id``, ``sequence`` and ``lifecycle_phase``. ``turns`` adds the decision of each evaluated event,
``truth`` is joined on the event only here.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators.metrics import ratio, rounded
from riskweave.operators.ordered import exact_quantiles
from riskweave.operators.policy import effective_decisive_turn


def alerts() -> Column:
    return F.col("action").isin(*d.ALERT_ACTIONS)


def stops() -> Column:
    return F.col("action").isin(*d.DECISIVE_ACTIONS)



def choose(key: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    out = None
    for name, value in table.items():
        out = (F.when if out is None else out.when)(key == name, F.lit(value))
    return out.otherwise(F.lit(default).cast("double"))


def phase_index(phase: Column) -> Column:
    return choose(phase, {p: i for i, p in enumerate(d.PHASES)}).cast("int")


def attack_anchors(turns: DataFrame, truth: DataFrame) -> DataFrame:
    """Per round: the first alert and the effective decisive turn of the attack case, with their truth."""
    attack = turns.where(F.col("role") == "attack")
    keys = ["round_id", "case_id"]
    first = attack.groupBy(*keys).agg(F.min(F.when(alerts(), F.col("sequence"))).alias("alert_sequence"))
    anchors = first.join(effective_decisive_turn(attack, by=["round_id"]), keys, "left")
    known = attack.select(*keys, "sequence", "event_id", "lifecycle_phase").join(
        truth.select("event_id", "offset_seconds", "intervention_point"), "event_id"
    )
    at_alert = known.select(
        *keys, F.col("sequence").alias("alert_sequence"), F.col("offset_seconds").alias("alert_offset"),
        F.col("intervention_point").alias("alert_point"), F.col("lifecycle_phase").alias("alert_phase"), F.col("event_id").alias("alert_event_id"),
    )
    at_decision = known.select(
        *keys, F.col("sequence").alias("decisive_sequence"), F.col("offset_seconds").alias("decisive_offset"),
        F.col("intervention_point").alias("decisive_point"),
    )
    return anchors.join(at_alert, [*keys, "alert_sequence"], "left").join(at_decision, [*keys, "decisive_sequence"], "left")


def prevented_value(events: DataFrame, turns: DataFrame, truth: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Value protected from the decisive offset on, capped at the total, and what got through.

    One row per round with the anchors of ``attack_anchors``.
    """
    anchors = anchors if anchors is not None else attack_anchors(turns, truth)
    values = events.where(F.col("role") == "attack").select("round_id", "event_id").join(
        truth.select("event_id", "value_at_risk_inr", "offset_seconds"), "event_id"
    )
    protected = F.col("decisive_point").isin(*d.INTERVENTION_CREDIT) & (F.col("offset_seconds") >= F.col("decisive_offset"))
    totals = values.join(anchors.select("round_id", "decisive_point", "decisive_offset"), "round_id", "left").groupBy("round_id").agg(
        rounded(F.sum("value_at_risk_inr"), 2).alias("total_value_at_risk_inr"),
        F.count(F.lit(1)).alias("attack_events"),
        F.coalesce(F.sum(F.when(protected, F.col("value_at_risk_inr"))), F.lit(0.0)).alias("_protected"),
    )
    kept = rounded(F.least(F.col("total_value_at_risk_inr"), F.col("_protected")), 2)
    out = totals.withColumn("value_prevented_inr", kept).drop("_protected").withColumns({
        "value_prevented_ratio": rounded(ratio(F.col("value_prevented_inr"), F.col("total_value_at_risk_inr")), 4),
        "realized_impact_inr": rounded(F.greatest(F.lit(0.0), F.col("total_value_at_risk_inr") - F.col("value_prevented_inr")), 2),
    }).withColumn("realized_impact_ratio", rounded(ratio(F.col("realized_impact_inr"), F.col("total_value_at_risk_inr")), 4))
    return out.join(anchors, "round_id", "left")


def case_outcome(prevented: DataFrame) -> DataFrame:
    """Missed, detected, contained or prevented."""
    outcome = (
        F.when(F.col("alert_sequence").isNull(), F.lit("missed"))
        .when(F.col("decisive_point").isNull(), F.lit("detected"))
        .when(F.col("decisive_point") == "CONTAIN", F.lit("contained"))
        .when(F.col("value_prevented_ratio") >= 0.999, F.lit("prevented")).otherwise(F.lit("contained"))
    )
    return prevented.withColumn("outcome", outcome)


def early_credit(prevented: DataFrame) -> DataFrame:
    """Credit for the intervention point of the first alert, and its time and phase."""
    credit = F.coalesce(choose(F.col("alert_point"), d.INTERVENTION_CREDIT, 0.0), F.lit(0.0))
    return prevented.withColumns({
        "early_credit": credit, "time_to_detect_seconds": F.col("alert_offset"), "detected_lifecycle_phase": F.col("alert_phase"),
    })


def case_flags(turns: DataFrame, role: str) -> DataFrame:
    """Per case of a role: any alert, any money-stopping action, any step-up, and the decisive turn."""
    rows = turns.where(F.col("role") == role)
    flags = rows.groupBy("round_id", "case_id").agg(
        F.bool_or(alerts()).alias("alerted"), F.bool_or(stops()).alias("stopped"),
        F.bool_or(F.col("action") == "step_up").alias("stepped"),
    )
    decisive = effective_decisive_turn(rows, by=["round_id"])
    return flags.join(decisive, ["round_id", "case_id"], "left").withColumn("decided", F.col("decisive_sequence").isNotNull())


def _rate(flag: str, name: str, digits: int | None) -> Column:
    share = F.avg(F.col(flag).cast("int"))
    return (share if digits is None else rounded(share, digits)).alias(name)


def control_harm(turns: DataFrame, digits: int | None = 4) -> DataFrame:
    """C4: share of control cases with an effective decisive turn, and with any alert."""
    return case_flags(turns, "control").groupBy("round_id").agg(
        F.count(F.lit(1)).alias("control_cases"),
        _rate("decided", "hard_false_positive_rate", digits), _rate("alerted", "legitimate_friction_rate", digits),
    )


def ambient_harm(turns: DataFrame, digits: int | None = 4) -> DataFrame:
    """The same for ambient cases, where any hold or block counts."""
    return case_flags(turns, "ambient").groupBy("round_id").agg(
        F.count(F.lit(1)).alias("ambient_cases"),
        _rate("stopped", "ambient_false_positive_rate", digits), _rate("alerted", "ambient_friction_rate", digits),
    )


def blue_score(report: DataFrame) -> DataFrame:
    """Weighted defence score and its complement."""
    detect = F.col("alert_sequence").isNotNull().cast("int")
    raw = 100 * (
        0.35 * detect + 0.35 * F.col("value_prevented_ratio") + 0.20 * F.col("early_credit")
        + 0.10 * (1 - F.col("hard_false_positive_rate"))
    ) - 5 * F.col("legitimate_friction_rate")
    return report.withColumn("blue_score", rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)).withColumn(
        "red_score", rounded(100 - F.col("blue_score"), 2)
    )


def round_report(events: DataFrame, turns: DataFrame, truth: DataFrame) -> DataFrame:
    """One wide row per round."""
    anchors = attack_anchors(turns, truth)
    scored = early_credit(case_outcome(prevented_value(events, turns, truth, anchors)))
    harmed = scored.join(control_harm(turns, None), "round_id", "left").join(ambient_harm(turns, None), "round_id", "left")
    zero = [
        "control_cases", "hard_false_positive_rate", "legitimate_friction_rate", "ambient_cases",
        "ambient_false_positive_rate", "ambient_friction_rate",
    ]
    rates = [z for z in zero if z.endswith("_rate")]
    return blue_score(harmed.fillna(0, zero)).withColumns({r: rounded(r, 4) for r in rates})


def coverage_ratios(events: DataFrame, turns: DataFrame, packets: DataFrame) -> DataFrame:
    """Evaluated share of the attack events, and share of evidence tools used."""
    planned = events.where(F.col("role") == "attack").groupBy("round_id").agg(F.count(F.lit(1)).alias("_all"))
    done = turns.where(F.col("role") == "attack").groupBy("round_id").agg(F.count(F.lit(1)).alias("_done"))
    tools = packets.groupBy("round_id").agg(F.countDistinct("tool_name").alias("_tools"))
    joined = planned.join(done, "round_id", "left").join(tools, "round_id", "left")
    return joined.select(
        "round_id", rounded(ratio(F.coalesce("_done", F.lit(0)), F.col("_all")), 4).alias("event_evaluation_ratio"),
        rounded(F.coalesce("_tools", F.lit(0)) / len(d.EVIDENCE_TOOLS), 4).alias("evidence_tool_coverage"),
    )


def coarse_reasons(turns: DataFrame) -> DataFrame:
    """Reasons of the first alert, folded onto the coarse list, each once and in order."""
    attack = turns.where((F.col("role") == "attack") & alerts())
    first = attack.groupBy("round_id").agg(F.min_by("reason_codes", "sequence").alias("_r"))
    folded = F.transform("_r", lambda r: F.coalesce(*[F.when(r == a, F.lit(b)) for a, b in d.REASON_ALIASES.items()], r))
    coarse = F.array(*[F.lit(c) for c in d.COARSE_REASONS])
    return first.select(
        "round_id", F.array_distinct(F.filter(folded, lambda r: F.array_contains(coarse, r))).alias("coarse_reason_categories")
    )


def _control_phase_costs(turns: DataFrame) -> DataFrame:
    friction = choose(F.col("action"), d.ACTION_FRICTION, 0.0)
    per_case = turns.where(F.col("role") == "control").groupBy("round_id", "case_id", "lifecycle_phase").agg(
        F.max(friction).alias("_cost"), F.bool_or(alerts()).alias("_alert"), F.count(F.lit(1)).alias("_events")
    )
    return per_case.groupBy("round_id", F.col("lifecycle_phase").alias("phase")).agg(
        F.count(F.lit(1)).alias("legitimate_comparison_count"), F.avg("_cost").alias("_avg_cost"),
        F.count_if("_alert").alias("false_positives"), F.sum("_events").alias("phase_matched_control_event_count"),
    )


def lifecycle_scorecard(events: DataFrame, turns: DataFrame, truth: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """One row per (round, phase) with status, response, consequence and safety scores.

    ``packets`` (round_id, lifecycle_phase, packet_count) and an ``evidence_refs`` array on turns give the citation rate.
    """
    outcome = truth.select("event_id", "offset_seconds", "value_at_risk_inr")
    planned = events.where(F.col("role") == "attack").select("round_id", "event_id", "sequence", "event_type", "lifecycle_phase").join(outcome, "event_id")
    attack = turns.where(F.col("role") == "attack")
    anchors = attack_anchors(turns, truth).select("round_id", "decisive_offset")

    dims = planned.select("round_id").distinct().select(
        "round_id", F.posexplode(F.array(*[F.lit(p) for p in d.PHASES])).alias("phase_index", "phase")
    )
    spans = planned.groupBy("round_id", F.col("lifecycle_phase").alias("phase")).agg(
        F.count(F.lit(1)).alias("event_count"), F.min("offset_seconds").alias("phase_start"), F.max("offset_seconds").alias("phase_end"),
        F.min_by("event_type", "sequence").alias("first_actionable_event"),
    )
    cites = F.size("evidence_refs") if "evidence_refs" in turns.columns else F.lit(0)
    seen = attack.groupBy("round_id", F.col("lifecycle_phase").alias("phase")).agg(
        F.count(F.lit(1)).alias("evaluated_event_count"), F.min(F.when(alerts(), F.col("sequence"))).alias("_first_alert"), F.sum(cites).alias("_cited"),
        *[F.count_if(F.col("action") == a).alias(f"{a}_count") for a in d.ACTIONS],
    )
    before_alert = attack.select("round_id", F.col("lifecycle_phase").alias("phase"), "sequence", "event_id").join(
        seen.select("round_id", "phase", "_first_alert"), ["round_id", "phase"]
    ).join(outcome.select("event_id", "offset_seconds"), "event_id").groupBy("round_id", "phase").agg(
        F.count_if(F.col("sequence") < F.col("_first_alert")).alias("_alert_index"),
        F.max(F.when(F.col("sequence") == F.col("_first_alert"), F.col("offset_seconds"))).alias("_alert_offset"),
    )
    base = (
        dims.join(spans, ["round_id", "phase"], "left").join(seen, ["round_id", "phase"], "left")
        .join(before_alert, ["round_id", "phase"], "left").join(anchors, "round_id", "left")
    )
    # Every attack event against the (at most three) phases of its round.
    later = planned.select("round_id", phase_index(F.col("lifecycle_phase")).alias("_pi"), "offset_seconds", "value_at_risk_inr").join(
        base.where(F.col("evaluated_event_count").isNotNull()).select("round_id", "phase", "phase_index", "phase_start", "phase_end", "decisive_offset"), "round_id"
    ).groupBy("round_id", "phase").agg(
        F.min(F.when((F.col("offset_seconds") > F.col("phase_end")) & (F.col("_pi") > F.col("phase_index")), F.col("offset_seconds"))).alias("_next"),
        F.sum(F.when(F.col("offset_seconds") >= F.col("phase_start"), F.col("value_at_risk_inr")).otherwise(0.0)).alias("_downstream"),
        F.sum(F.when(
            F.col("offset_seconds") >= F.greatest(F.col("phase_start"), F.col("decisive_offset")), F.col("value_at_risk_inr")
        ).otherwise(0.0)).alias("_controlled"),
    )
    # Phases of a round, three rows at most: reached phases, alerts before a phase, next planned phase.
    summary = base.groupBy("round_id").agg(*[
        col for i in range(len(d.PHASES)) for col in (
            F.max((F.col("phase_index") == i) & F.col("event_count").isNotNull()).alias(f"_planned{i}"),
            F.max((F.col("phase_index") == i) & F.col("evaluated_event_count").isNotNull()).alias(f"_reached{i}"),
            F.max((F.col("phase_index") == i) & F.col("_first_alert").isNotNull()).alias(f"_alerted{i}"),
        )
    ])
    harm = control_harm(turns, None).select("round_id", "hard_false_positive_rate", "legitimate_friction_rate")
    full = (
        base.join(later, ["round_id", "phase"], "left").join(_control_phase_costs(turns), ["round_id", "phase"], "left")
        .join(summary, "round_id").join(harm, "round_id", "left")
    )
    if packets is not None:
        full = full.join(packets.groupBy("round_id", F.col("lifecycle_phase").alias("phase")).agg(F.sum("packet_count").alias("_packets")), ["round_id", "phase"], "left")
    else:
        full = full.withColumn("_packets", F.lit(None).cast("long"))

    reached = F.col("evaluated_event_count").isNotNull()
    alerted = F.col("_first_alert").isNotNull()
    detected = alerted.cast("int")
    deadline = F.coalesce("_next", "phase_end")
    window = F.greatest(F.lit(1), deadline - F.col("phase_start"))
    delay = F.greatest(F.lit(0), F.col("_alert_offset") - F.col("phase_start"))
    response = F.when(~alerted, F.lit(0.0)).when(F.col("_alert_offset") <= F.col("phase_start"), F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - delay / window))
    in_time = F.coalesce(F.col("decisive_offset") <= deadline, F.lit(False))
    controlled = F.when(in_time, F.col("_controlled")).otherwise(F.lit(0.0))
    consequence = F.when(F.col("_downstream") > 0, F.least(F.lit(1.0), controlled / F.col("_downstream"))).otherwise(in_time.cast("double"))
    fallback = 1 - F.least(F.lit(1.0), 0.7 * F.coalesce("hard_false_positive_rate", F.lit(0.0)) + 0.3 * F.coalesce("legitimate_friction_rate", F.lit(0.0)))
    safety = F.when(F.col("_avg_cost").isNotNull(), 1 - F.col("_avg_cost")).otherwise(fallback)
    earlier = F.lit(False)
    for i in range(len(d.PHASES)):
        earlier = earlier | ((F.col("phase_index") > i) & F.col(f"_alerted{i}"))
    stealth = F.when(earlier, F.lit(0.0)).when(~alerted, F.lit(1.0)).otherwise(F.col("_alert_index") / F.greatest(F.lit(1), F.col("evaluated_event_count")))
    escape = F.lit(None).cast("double")
    for i in range(len(d.PHASES)):
        for j in reversed(range(i + 1, len(d.PHASES))):
            skipped = reduce(lambda a, b: a & b, [~F.col(f"_planned{x}") for x in range(i + 1, j)], F.lit(True))
            escape = F.when((F.col("phase_index") == i) & F.col(f"_planned{j}") & skipped, F.col(f"_reached{j}").cast("double")).otherwise(escape)
    fp = F.coalesce("false_positives", F.lit(0))
    comparisons = F.coalesce("legitimate_comparison_count", F.lit(0))
    precision = F.when(detected + fp > 0, detected / (detected + fp))
    f1 = F.when(F.coalesce(precision, F.lit(0.0)) + detected > 0, 2 * precision * detected / (precision + detected)).otherwise(F.lit(0.0))
    score = 100 * (0.25 * detected + 0.20 * response + 0.35 * consequence + 0.20 * safety)
    status = F.when(F.col("event_count").isNull(), F.lit("not_in_scenario")).when(~reached, F.lit("prevented_before_phase")).otherwise(F.lit("reached"))

    def when_reached(col: Column) -> Column:
        return F.when(reached, col)

    return full.select(
        "round_id", "phase", "phase_index", status.alias("status"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("evaluated_event_count", F.lit(0)).alias("evaluated_event_count"),
        F.when(F.col("event_count").isNotNull(), rounded(F.coalesce("evaluated_event_count", F.lit(0)) / F.col("event_count"), 4)).alias("evaluation_coverage"),
        "first_actionable_event",
        when_reached(rounded(score, 2)).alias("phase_score"), when_reached(alerted).alias("opportunity_detected"),
        when_reached(F.when(alerted, delay)).alias("response_time_seconds"), when_reached(rounded(response, 4)).alias("response_score"),
        when_reached(rounded(F.col("_downstream"), 2)).alias("downstream_value_exposed_inr"), when_reached(rounded(controlled, 2)).alias("value_controlled_from_phase_inr"),
        when_reached(rounded(consequence, 4)).alias("consequence_control_ratio"), when_reached(rounded(safety, 4)).alias("legitimate_safety_rate"),
        when_reached(rounded(stealth, 4)).alias("red_stealth_ratio"), when_reached(escape).alias("transition_escape_rate"),
        when_reached(rounded(F.least(F.lit(1.0), ratio(F.col("_cited"), F.col("_packets"))), 4)).alias("evidence_citation_rate"),
        when_reached(comparisons).alias("legitimate_comparison_count"),
        when_reached(F.coalesce("phase_matched_control_event_count", F.lit(0))).alias("phase_matched_control_event_count"),
        when_reached(detected).alias("true_positives"), when_reached(fp).alias("false_positives"),
        when_reached(1 - detected).alias("false_negatives"), when_reached(comparisons - fp).alias("true_negatives"),
        when_reached(rounded(precision, 4)).alias("precision"), when_reached(detected.cast("double")).alias("recall"), when_reached(rounded(f1, 4)).alias("f1"),
        *[when_reached(F.col(f"{a}_count")).alias(f"{a}_count") for a in d.ACTIONS],
    )


def lifecycle_balance(scorecard: DataFrame) -> DataFrame:
    """C11: macro score, worst phase (the earlier one on a tie), gap and balanced score per round."""
    score = F.col("phase_score")
    agg = scorecard.groupBy("round_id").agg(
        F.avg("phase_score").alias("_macro"), F.min("phase_score").alias("_worst"), F.max("phase_score").alias("_best"),
        F.min_by("phase", F.when(score.isNotNull(), F.struct("phase_score", "phase_index"))).alias("worst_lifecycle_phase"),
    )
    macro, worst, best = [F.coalesce(c, F.lit(0.0)) for c in ("_macro", "_worst", "_best")]
    return agg.select(
        "round_id", rounded(0.6 * macro + 0.4 * worst, 2).alias("balanced_lifecycle_defense_score"),
        "worst_lifecycle_phase", rounded(worst, 2).alias("worst_phase_score"), rounded(best - worst, 2).alias("lifecycle_balance_gap"),
    )


def red_capability(scorecard: DataFrame) -> DataFrame:
    """Reach, stealth, breadth and depth of the attack per round."""
    planned = F.count_if(F.col("event_count") > 0)
    stealth = F.coalesce(F.avg("red_stealth_ratio"), F.lit(0.0))
    value = 100 * (
        0.35 * ratio(F.count_if(F.col("evaluated_event_count") > 0), planned) + 0.30 * stealth
        + 0.20 * planned / len(d.PHASES) + 0.15 * F.least(F.lit(1.0), F.sum("event_count") / 6.0)
    )
    return scorecard.groupBy("round_id").agg(rounded(value, 2).alias("red_capability_score"))


def legit_tally(turns: DataFrame) -> DataFrame:
    """C14: legitimate cases stopped, and cases that only got an extra check, per round."""
    flags = turns.where(F.col("role").isin("control", "ambient")).groupBy("round_id", "case_id", "role").agg(
        F.bool_or(stops()).alias("stopped"), F.bool_or(F.col("action") == "step_up").alias("stepped")
    )
    return flags.groupBy("round_id").agg(
        F.count_if(F.col("role") == "control").alias("control_count"), F.count_if(F.col("role") == "ambient").alias("ambient_count"),
        F.count(F.lit(1)).alias("total"), F.count_if("stopped").alias("false_blocks"), F.count_if(~F.col("stopped") & F.col("stepped")).alias("extra_checks"),
    )


def round_fidelity(events: DataFrame, boundary_clean: Column) -> DataFrame:
    """Production-likeness of the attack events of each round.

    Needs event_type, source_system, decision_lane, latency_budget_ms and observable_signals;
    ``boundary_clean`` says per event that no sealed key is visible.
    """
    delivered = (
        F.coalesce(F.col("source_system") != "", F.lit(False)) & F.coalesce(F.col("decision_lane") != "", F.lit(False))
        & F.coalesce(F.col("latency_budget_ms") != 0, F.lit(False))
    )
    attack = F.col("role") == "attack"

    def share(cond: Column) -> Column:
        return F.avg(F.when(attack, cond.cast("int")))

    agg = events.groupBy("round_id").agg(
        share(~F.col("event_type").isin(*d.LAB_ONLY_TYPES)).alias("_production"), share(delivered).alias("_delivery"),
        share(F.coalesce(F.size("observable_signals") > 0, F.lit(False))).alias("_signals"),
        F.min(F.when(attack, boundary_clean.cast("int"))).alias("_clean"),
        F.countDistinct(F.when(F.col("role") == "control", F.col("case_id"))).alias("legitimate_look_alike_cases"),
    )
    part = {n: F.coalesce(n, F.lit(0)) for n in ("_production", "_delivery", "_signals")}
    clean = F.coalesce("_clean", F.lit(1))
    controls = F.least(F.lit(1.0), F.col("legitimate_look_alike_cases") / 3.0)
    score = 100 * (0.25 * part["_production"] + 0.20 * part["_delivery"] + 0.20 * part["_signals"] + 0.20 * clean + 0.15 * controls)
    return agg.select(
        "round_id", rounded(score, 2).alias("fidelity_score"), rounded(part["_production"], 4).alias("production_event_rate"),
        rounded(part["_delivery"], 4).alias("delivery_metadata_rate"), rounded(part["_signals"], 4).alias("observable_signal_rate"),
        (clean == 1).alias("truth_boundary_clean"), "legitimate_look_alike_cases",
    )


def latency_profile(turns: DataFrame) -> DataFrame:
    """Nearest-rank p95 of model calls, calls per event and the counts of each lane, per round.

    Attack and control turns count. Needs ``model_calls`` (array of agent_name, latency_ms),
    ``reason_codes``, ``policy_adjustments``, ``guarded`` and ``operational_minimum_action``.
    """
    used = turns.where(F.col("role").isin("attack", "control"))
    calls = used.select("round_id", F.explode("model_calls").alias("_c")).select(
        "round_id", F.coalesce(F.col("_c.latency_ms").cast("double"), F.lit(0.0)).alias("latency"), "_c.agent_name"
    )
    p95 = exact_quantiles(calls, "latency", {"model_call_p95_ms": 0.95}, ["round_id"], discrete=True)
    repairs = calls.groupBy("round_id").agg(
        F.count(F.lit(1)).alias("blue_model_call_count"), F.count_if(F.col("agent_name") == "blue_event_repair").alias("policy_repair_call_count")
    )
    attack = F.col("role") == "attack"
    raised = F.exists("policy_adjustments", lambda x: x.contains("raised_from"))
    rows = used.groupBy("round_id").agg(
        F.count(F.lit(1)).alias("blue_event_count"),
        F.count_if((F.coalesce(F.size("model_calls"), F.lit(0)) <= 0) & F.array_contains("reason_codes", "legitimate_context")).alias("verified_context_fast_exit_count"),
        F.count_if(attack & raised).alias("fast_guard_intervention_count"),
        F.count_if(attack & F.col("operational_minimum_action").isin(*d.ALERT_ACTIONS)).alias("fast_guard_actionable_event_count"),
        rounded(F.coalesce(F.avg(F.when(attack, F.col("guarded").cast("int"))), F.lit(0.0)), 4).alias("pre_model_fast_path_coverage"),
    )
    joined = rows.join(repairs, "round_id", "left").join(p95, "round_id", "left").fillna(0, ["blue_model_call_count", "policy_repair_call_count"])
    return joined.withColumns({
        "model_call_p95_ms": rounded(F.col("model_call_p95_ms"), 2),
        "model_calls_per_blue_event": rounded(ratio(F.col("blue_model_call_count"), F.col("blue_event_count")), 3),
    })


# Report columns a candidate must not worsen; True means higher is better.
SAFETY_RULES = {
    "hard_false_positive_rate": False, "legitimate_friction_rate": False, "value_prevented_ratio": True,
    "blue_score": True, "balanced_lifecycle_defense_score": True, "realized_impact_ratio": False,
}
GAIN_RULES = {
    "blue_score": True, "value_prevented_ratio": True, "realized_impact_ratio": False,
    "balanced_lifecycle_defense_score": True, "worst_phase_score": True,
}


def candidate_promotion(baseline: DataFrame, candidate: DataFrame, key: str = "round_id") -> DataFrame:
    """C17: promote a replay that keeps all safety rules and gains on at least one measure."""
    names = list(dict.fromkeys([*SAFETY_RULES, *GAIN_RULES, "time_to_detect_seconds"]))
    both = baseline.select(key, *[F.col(n).alias(f"b_{n}") for n in names]).join(
        candidate.select(key, *[F.col(n).alias(f"c_{n}") for n in names]), key
    )
    safe, gain = F.lit(True), F.lit(False)
    for n, higher in SAFETY_RULES.items():
        b, c = F.col(f"b_{n}"), F.col(f"c_{n}")
        safe = safe & (c >= b if higher else c <= b)
    for n, higher in GAIN_RULES.items():
        b, c = F.col(f"b_{n}"), F.col(f"c_{n}")
        gain = gain | (c > b if higher else c < b)
    before, after = F.col("b_time_to_detect_seconds"), F.col("c_time_to_detect_seconds")
    gain = gain | (after.isNotNull() & (before.isNull() | (after < before)))
    reason = F.when(safe & gain, F.lit("promoted")).when(~safe, F.lit("rejected: safety or protection got worse")).otherwise(
        F.lit("rejected: no measurable gain"))
    return both.select(key, (safe & gain).alias("promoted"), reason.alias("reason"))


def live_summary(reports: DataFrame) -> DataFrame:
    """Detection rate and mean outcome over rounds."""
    return reports.agg(
        F.count(F.lit(1)).alias("case_count"), rounded(F.avg((F.col("outcome") != "missed").cast("int")), 4).alias("detection_rate"),
        *[rounded(F.avg(n), 4).alias(f"mean_{n}") for n in ("value_prevented_ratio", "hard_false_positive_rate", "legitimate_friction_rate")],
        rounded(F.avg("balanced_lifecycle_defense_score"), 2).alias("mean_balanced_lifecycle_defense_score"),
    )


def grouped_event_stream(events: DataFrame, decisions: DataFrame, label: Column) -> DataFrame:
    """Events of all roles with kind, label and the decision when there was one."""
    kind = F.when(F.col("role") == "control", F.lit("lookalike")).otherwise(F.col("role"))
    picked = [c for c in ("action", "risk_level") if c in decisions.columns]
    return events.withColumns({"kind": kind, "label": label}).join(decisions.select("event_id", *picked), "event_id", "left")
