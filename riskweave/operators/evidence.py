"""Case evidence as of each event, and the additive rule guard built on it.

Every fact is a running maximum, minimum, sum, count or last value over the case, so one ordered pass
serves all tools. ``as_of=False`` gives one row per case from the same definitions by aggregation.
Attribute columns a table does not carry are read as nulls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.functions.scalar import attr, or_default
from riskweave.operators.ordered import HotGroups, Running, find_hot, first_occurrence, group_rank, running


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_value_moving(event_type: Column) -> Column:
    return event_type.isin(*d.VALUE_MOVING_TYPES)


def amount_ratio(df: DataFrame) -> Column:
    """Amount over max(1, baseline) on value events; a missing baseline is the amount itself."""
    amount = F.coalesce(attr(df, "amount_inr", "double"), F.lit(0.0))
    baseline = or_default(F.coalesce(attr(df, "sender_baseline_amount_inr", "double"), amount), 1.0)
    return F.when(is_value_moving(F.col("event_type")), amount / F.greatest(F.lit(1.0), baseline))


def _signals(df: DataFrame, ts: str) -> dict[str, tuple[str, Column]]:
    """Running definitions: name -> (max | min | sum | last, expression)."""
    kind, phase = F.col("event_type"), F.col("lifecycle_phase")

    def true(name: str) -> Column:
        return _flag(attr(df, name, "boolean"))

    def number(name: str) -> Column:
        return attr(df, name, "double")

    us = F.unix_micros(F.col(ts).cast("timestamp"))
    value = is_value_moving(kind)
    out: dict[str, tuple[str, Column]] = {
        "s_events": ("sum", F.lit(1)),
        "s_value_events": ("sum", _flag(value)),
        "s_first_us": ("min", us),
        "s_last_us": ("max", us),
        "s_value": ("sum", F.when(value, F.coalesce(number("amount_inr"), F.lit(0.0))).otherwise(F.lit(0.0))),
        "s_payments": ("sum", F.when(value, F.coalesce(attr(df, "payment_count", "int"), F.lit(1))).otherwise(0)),
        "s_max_authorized": ("max", attr(df, "authorized_payment_count", "int")),
        "s_max_count": ("max", attr(df, "payment_count", "int")),
        "s_ratio": ("max", amount_ratio(df)),
        "s_change": ("max", _flag(kind.isin(*d.CONTEXT_CHANGE_TYPES))),
        "s_shared": ("max", F.greatest(*[true(n) for n in d.LINKAGE_KEYS[1:]])),
        "s_automation": ("max", true("behavior_automation_suspected")),
        "s_conflict": ("max", true("evidence_conflict_present")),
        "s_new_device": ("max", true("device_is_new")),
        "s_new_network": ("max", true("network_is_new")),
        "s_weak_identity": ("max", F.greatest(*[
            _flag(number(n) < 0.6) for n in ("profile_consistency_score", "document_consistency_score", "liveness_confidence")
        ])),
    }
    for i, name in enumerate(d.PHASES):
        out[f"s_phase_{i}"] = ("min", F.when(phase == name, F.col("sequence")))
    for name, types in {
        "opened": ("DISPUTE_OPENED",), "reviewed": ("DISPUTE_EVIDENCE_REVIEWED",),
        "application": ("IDENTITY_APPLICATION_SUBMITTED",), "account": ("ACCOUNT_OPENED",),
        "payment": ("PAYMENT_INITIATED", "AGENTIC_PAYMENT_INITIATED"),
    }.items():
        out[f"s_seen_{name}"] = ("max", _flag(kind.isin(*types)))
    for name, (field, limit) in _AT_LEAST.items():
        out[f"s_{name}"] = ("max", _flag(number(field) >= limit))
    out["s_new_beneficiary"] = ("max", _flag(number("beneficiary_age_days") <= 7))
    out["s_stale"] = ("max", _flag(number("request_age_seconds") > 300))
    out["s_replay"] = ("max", _flag(number("nonce_reuse_count") > 0))
    out["s_basket"] = ("max", _flag(number("basket_value_multiplier") > 1.25))
    for name in d.AGENT_TRUST_FACTORS:
        out[f"s_failed_{name}"] = ("max", _flag(attr(df, name, "boolean") == F.lit(False)))
        out[f"s_latest_{name}"] = ("last", attr(df, name, "boolean"))
    for name in d.STRONG_BOOLEAN_CONTEXT:
        out[f"s_mark_{name}"] = ("max", true(name))
    out["s_mark_independent_checks_passed"] = ("max", _flag(number("independent_checks_passed") > 0))
    for name in d.HISTORY_DAY_FIELDS:
        out[f"s_mark_{name}"] = ("max", _flag(number(name) >= d.HISTORY_MIN_DAYS))
    return out


# Indicators that need one numeric attribute to reach a limit anywhere in the case.
_AT_LEAST = {
    "communication_pressure": ("urgency_level", 7),
    "channel_switching": ("channel_switch_count", 2),
    "dense_identity_linkage": ("linked_attribute_count", 3),
    "verification_retries": ("verification_retry_count", 3),
    "fan_in_concentration": ("sender_count", 4),
    "rapid_outflow": ("outflow_ratio", 0.5),
    "novel_payout_destination": ("destination_novelty_score", 0.6),
    "sales_velocity_shift": ("sales_velocity_multiplier", 2),
    "linked_dispute_burst": ("linked_dispute_count", 5),
}
MARKERS = tuple(sorted((*d.STRONG_BOOLEAN_CONTEXT, "independent_checks_passed", *d.HISTORY_DAY_FIELDS)))


def case_state(
    df: DataFrame, case: str = "case_id", order: Sequence[str] = ("sequence",), ts: str = "event_ts",
    as_of: bool = True, hot: HotGroups | None = None,
) -> DataFrame:
    """Evidence state per event (as of that event) or, with ``as_of=False``, per finished case.

    Adds the ``s_*`` columns and the current event's ``cur_*`` columns. The input needs case,
    sequence, event_id, event_type, lifecycle_phase and a timestamp.
    """
    current = df.withColumns({
        "cur_repeat": _flag((F.col("event_type") == "PAYMENT_REPEATED") | (or_default(attr(df, "payment_count", "int"), 1) > 1)),
        "cur_accelerated": _flag(attr(df, "accelerated_settlement", "boolean")),
    })
    signals = _signals(df, ts)
    if as_of:
        return running(current, [case], order, {n: Running(how, e) for n, (how, e) in signals.items()}, hot=hot)
    place = F.struct(*order)
    aggs = []
    for name, (how, expr) in signals.items():
        if how == "last":
            aggs.append(F.max_by(expr, F.when(expr.isNotNull(), place)).alias(name))
        else:
            aggs.append(getattr(F, how)(expr).alias(name))
    last = [F.max_by(c, place).alias(c) for c in ("event_id", "event_type", "lifecycle_phase", "cur_repeat", "cur_accelerated", *order)]
    return current.groupBy(case).agg(*aggs, *last)


def _elapsed() -> Column:
    return (F.col("s_last_us") - F.col("s_first_us")) / F.lit(1e6)


def phases_seen() -> Column:
    """Distinct phases in the order they were first seen."""
    firsts = F.array(*[
        F.when(F.col(f"s_phase_{i}").isNotNull(), F.struct(F.col(f"s_phase_{i}").alias("at"), F.lit(n).alias("phase")))
        for i, n in enumerate(d.PHASES)
    ])
    return F.transform(F.array_sort(F.array_compact(firsts)), lambda x: x["phase"])


def phase_count() -> Column:
    out = F.lit(0)
    for i in range(len(d.PHASES)):
        out = out + F.col(f"s_phase_{i}").isNotNull().cast("int")
    return out


def timeline_summary(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Event and value-event counts, phases in first-seen order and elapsed seconds.

    The ordered event list of a case is kept as rows, see ``timeline_positions``.
    """
    return state.select(
        *keys, F.col("s_events").alias("event_count"), F.col("s_value_events").alias("value_event_count"),
        phases_seen().alias("lifecycle_phases_reached"), F.round(_elapsed()).cast("long").alias("elapsed_seconds"),
    )


def timeline_positions(df: DataFrame, case: str = "case_id", order: Sequence[str] = ("sequence",)) -> DataFrame:
    """Ordered event types and phases of each case, one row per position."""
    return group_rank(df.select(case, *order, "event_type", "lifecycle_phase"), [case], order, "position").select(
        case, "position", "event_type", "lifecycle_phase"
    )


def event_type_counts(df: DataFrame, case: str = "case_id") -> DataFrame:
    """Events of each type per case."""
    return df.groupBy(case, "event_type").agg(F.count(F.lit(1)).alias("events"))


def velocity_profile(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Speed and value of the case so far."""
    return state.select(
        *keys, F.round(_elapsed()).cast("long").alias("elapsed_seconds"),
        F.col("s_value_events").alias("value_event_count"), F.col("s_payments").alias("declared_payment_count"),
        F.round("s_value", 2).alias("observed_value_inr"),
        F.round(F.col("s_events") / F.greatest(_elapsed() / 60, F.lit(1.0)), 3).alias("events_per_minute"),
    )


def payment_context(df: DataFrame) -> DataFrame:
    """Amount against the sender's baseline for each event that carries an amount."""
    amount = attr(df, "amount_inr", "double")
    baseline = F.coalesce(attr(df, "sender_baseline_amount_inr", "double"), or_default(amount, 1.0))
    return df.where(amount.isNotNull()).select(
        "case_id", "event_id", amount.alias("amount_inr"), baseline.alias("baseline_amount_inr"),
        F.round(amount / F.greatest(baseline, F.lit(1.0)), 3).alias("amount_to_baseline_ratio"),
        attr(df, "beneficiary_age_days", "double").alias("beneficiary_age_days"),
        F.coalesce(attr(df, "payment_count", "int"), F.lit(1)).alias("payment_count"),
    )


def marker_count() -> Column:
    out = F.lit(0)
    for name in MARKERS:
        out = out + F.col(f"s_mark_{name}")
    return out


def complete_agent_trust() -> Column:
    out = F.lit(True)
    for name in d.AGENT_TRUST_FACTORS:
        out = out & F.coalesce(F.col(f"s_latest_{name}"), F.lit(False))
    return out


def independently_verified() -> Column:
    return (marker_count() > 0) | complete_agent_trust()


def verified_markers() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"s_mark_{n}") == 1, F.lit(n)) for n in MARKERS]))


def legitimate_context(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verified markers, the agent trust chain and how strong the verification is."""
    strength = (
        F.when(complete_agent_trust() & (marker_count() > 0), F.lit("corroborated"))
        .when(independently_verified(), F.lit("verified")).otherwise(F.lit("unverified"))
    )
    return state.select(
        *keys, independently_verified().alias("independent_verification_found"),
        strength.alias("verification_strength"), verified_markers().alias("verified_markers"),
        complete_agent_trust().alias("complete_agent_trust_chain"),
    )


def entity_columns(df: DataFrame, structural: Sequence[str] = ("event_id", "case_id", "chain_id", "scenario_id")) -> list[str]:
    """String attributes that name an entity."""
    return [c for c, t in df.dtypes if c.endswith("_id") and t == "string" and c not in structural]


def _entities(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c.removesuffix("_id")).alias("kind"), F.col(c).alias("value")))
        for c in columns
    ]))


def entity_rows(df: DataFrame, case: str = "case_id", columns: Sequence[str] | None = None) -> DataFrame:
    """Long table (case, event, sequence, kind, value) of entity attributes."""
    names = list(columns or entity_columns(df))
    return df.select(case, "event_id", "sequence", F.explode(_entities(df, names)).alias("_e")).select(
        case, "event_id", "sequence", "_e.kind", "_e.value"
    )


def entity_linkage(df: DataFrame, case: str = "case_id", as_of: bool = False) -> DataFrame:
    """E5: distinct entities, relationship edges and explicit linkage observations of a case.

    Edges are counted from the number of entities per event; the edge list is ``cooccurrence_edges``.
    """
    names = entity_columns(df)
    n = F.size(_entities(df, names))
    explicit = F.lit(False)
    for key in d.LINKAGE_KEYS:
        explicit = explicit | attr(df, key, "string").isNotNull()
    per_event = df.select(
        case, "event_id", "sequence", F.floor(n * (n - 1) / 2).cast("long").alias("_edges"), explicit.cast("long").alias("_explicit")
    )
    rows = entity_rows(df, case, names)
    if not as_of:
        distinct = rows.groupBy(case).agg(F.countDistinct("value").alias("unique_entity_count"))
        repeated = rows.groupBy(case, "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(case).agg(
            F.count(F.lit(1)).alias("repeated_entity_count")
        )
        totals = per_event.groupBy(case).agg(
            F.sum("_edges").alias("relationship_edge_count"), F.sum("_explicit").alias("explicit_linkage_observations")
        )
        joined = totals.join(distinct, case, "left").join(repeated, case, "left")
        return joined.fillna(0, ["unique_entity_count", "repeated_entity_count"])
    firsts = first_occurrence(rows, [case, "value"], ["sequence", "kind"], ["event_id", "kind"], "_new")
    fresh = firsts.groupBy(F.col("event_id").alias("_row")).agg(F.sum(F.col("_new").cast("long")).alias("_fresh"))
    joined = per_event.join(fresh, F.col("event_id") == F.col("_row"), "left").fillna(0, ["_fresh"])
    walked = running(joined, [case], ["sequence"], {
        "unique_entity_count": Running("sum", F.col("_fresh")),
        "relationship_edge_count": Running("sum", F.col("_edges")),
        "explicit_linkage_observations": Running("sum", F.col("_explicit")),
    })
    return walked.select(case, "event_id", "unique_entity_count", "relationship_edge_count", "explicit_linkage_observations")


def repeated_entity_paths(df: DataFrame, case: str = "case_id") -> DataFrame:
    """E5: every place (sequence, kind) of an entity value that a case shows more than once."""
    rows = entity_rows(df, case)
    repeated = rows.groupBy(case, "value").agg(F.count(F.lit(1)).alias("path_count")).where("path_count > 1")
    path = F.concat(F.lit("event_"), F.col("sequence").cast("string"), F.lit("."), F.col("kind"), F.lit("_id"))
    return rows.join(repeated, [case, "value"]).select(case, "value", "path_count", path.alias("path"))


def cooccurrence_edges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Ordered pairs of entities inside one event, from the fixed set of id columns of the row."""
    names = list(columns or entity_columns(df))
    pairs = [
        F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(
            F.col(a).alias("source"), F.lit(a.removesuffix("_id")).alias("source_kind"),
            F.col(b).alias("target"), F.lit(b.removesuffix("_id")).alias("target_kind"),
        ))
        for i, a in enumerate(names) for b in names[i + 1:]
    ]
    return df.select("event_id", F.explode(F.array_compact(F.array(*pairs))).alias("_p")).select("event_id", "_p.*")


def signal_map(df: DataFrame, keys: Sequence[str]) -> Column:
    """Present attributes among ``keys`` as a map of text."""
    full = F.create_map(*[x for k in sorted(keys) for x in (F.lit(k), attr(df, k, "string"))])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def _observations(df: DataFrame, keys: Sequence[str], name: str, also: Column | None = None) -> DataFrame:
    seen = df.select("case_id", "event_id", "event_type", signal_map(df, keys).alias(name))
    keep = F.size(name) > 0
    return seen.where(keep | also if also is not None else keep).drop("event_type")


def behavioral_observations(df: DataFrame) -> DataFrame:
    """Events that carry behavioural signals, with their values."""
    return _observations(df, d.BEHAVIOR_KEYS, "signals")


def communication_observations(df: DataFrame) -> DataFrame:
    """Events that carry communication signals, or report a communication context."""
    return _observations(df, d.COMMUNICATION_KEYS, "signals", F.col("event_type") == "COMMUNICATION_RISK_CONTEXT")


def evidence_quality(df: DataFrame, case: str = "case_id") -> DataFrame:
    """Events with quality metadata and conflicts per case."""
    present = F.size(signal_map(df, d.QUALITY_KEYS)) > 0
    conflict = F.coalesce(attr(df, "evidence_conflict_present", "boolean"), F.lit(False))
    return df.groupBy(case).agg(
        F.count_if(present).alias("quality_metadata_event_count"), F.count_if(conflict).alias("conflicting_evidence_count")
    )


def _rules() -> list[tuple[str, int, Column]]:
    """The rule table in reporting order: (code, points, condition on the state)."""
    kind, ratio = F.col("event_type"), F.coalesce(F.col("s_ratio"), F.lit(1.0))

    def on(name: str) -> Column:
        return F.col(f"s_{name}") == 1

    rules = [
        ("cross_phase_progression", 1, phase_count() >= 2),
        ("cumulative_value_sequence", 2, F.col("s_value_events") >= 2),
        ("repeated_value_movement", 2, F.col("cur_repeat") == 1),
        ("agent_intent_count_mismatch", 4, F.col("s_max_count") > F.col("s_max_authorized")),
        ("downstream_value_release", 2, kind.isin(*d.RELEASE_TYPES)),
        ("sensitive_context_change", 1, on("change")),
        ("context_change_before_value", 2, on("change") & (F.col("s_value_events") > 0)),
        ("new_device", 1, on("new_device")),
        ("new_network", 1, on("new_network")),
        ("shared_infrastructure", 2, on("shared")),
        ("communication_pressure", 2, on("communication_pressure")),
        ("channel_switching", 1, on("channel_switching")),
        ("new_beneficiary", 2, on("new_beneficiary")),
        ("extreme_amount_deviation", 3, ratio >= 3),
        ("amount_deviation", 2, (ratio >= 1.5) & (ratio < 3)),
        ("subtle_amount_deviation", 1, (ratio >= 1.15) & (ratio < 1.5)),
        ("dense_identity_linkage", 2, on("dense_identity_linkage")),
        ("verification_retries", 1, on("verification_retries")),
        ("identity_consistency_gap", 2, on("weak_identity")),
        ("automation_signal", 1, on("automation")),
        ("evidence_conflict", 2, on("conflict")),
        ("fan_in_concentration", 3, on("fan_in_concentration")),
        ("rapid_outflow", 2, on("rapid_outflow")),
        ("novel_payout_destination", 2, on("novel_payout_destination")),
        ("sales_velocity_shift", 2, on("sales_velocity_shift")),
        ("accelerated_payout_after_change", 2, (kind == "PAYOUT_REQUESTED") & (F.col("cur_accelerated") == 1)),
        ("linked_dispute_burst", 2, on("linked_dispute_burst")),
        ("dispute_evidence_sequence", 2, on("seen_opened") & on("seen_reviewed")),
        ("refund_after_dispute_sequence", 3, (kind == "DISPUTE_REFUND_ISSUED") & on("seen_opened")),
        ("identity_to_payment_activation", 2, on("seen_application") & on("seen_account") & on("seen_payment")),
    ]
    rules += [(f"{n}_failed", points, on(f"failed_{n}")) for n, points in d.AGENT_TRUST_POINTS.items()]
    return rules + [
        ("stale_agent_request", 1, on("stale")),
        ("agent_request_replay", 2, on("replay")),
        ("agent_intent_value_mismatch", 2, on("basket")),
    ]


def risk_indicators(state: DataFrame) -> DataFrame:
    """Add the indicator codes, their count and the raw score."""
    rules = _rules()
    codes = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, _, cond in rules]))
    raw = F.lit(0)
    for _, points, cond in rules:
        raw = raw + F.when(cond, F.lit(points)).otherwise(0)
    return state.withColumns({"indicator_codes": codes, "raw_risk_score": raw}).withColumn(
        "indicator_count", F.size("indicator_codes")
    )


def guarded_score(indicated: DataFrame) -> DataFrame:
    """Discount the raw score for verified legitimate context."""
    extra = F.when(complete_agent_trust(), F.lit(2)).otherwise(0)
    discount = F.when(
        independently_verified(), F.lit(4) + 2 * F.greatest(F.lit(0), marker_count() - 1) + extra
    ).otherwise(0)
    return indicated.withColumns({"verified": independently_verified(), "verification_discount": discount}).withColumn(
        "observable_risk_score", F.greatest(F.lit(0), F.col("raw_risk_score") - F.col("verification_discount"))
    )


def minimum_action(scored: DataFrame) -> DataFrame:
    """The weakest action the guard allows, and the risk band that goes with it."""
    g, phase = F.col("observable_risk_score"), F.col("lifecycle_phase")
    mismatch = F.array_contains("indicator_codes", "agent_intent_count_mismatch")
    action = (
        F.when(F.col("verified") & (g < 3), F.lit("allow"))
        .when((phase == "transaction") & mismatch & (g >= 4), F.lit("hold"))
        .when((phase == "transaction") & (g >= 6), F.lit("hold"))
        .when((phase == "post_transaction") & (g >= 8), F.lit("hold"))
        .when(g >= 3, F.lit("step_up")).when(g >= 1, F.lit("monitor")).otherwise(F.lit("allow"))
    )
    chosen = F.col("minimum_action")
    band = (
        F.when(chosen == "allow", F.lit("low")).when(chosen == "monitor", F.lit("medium"))
        .when(chosen == "step_up", F.when(g >= 5, F.lit("high")).otherwise(F.lit("medium"))).otherwise(F.lit("high"))
    )
    return scored.withColumn("minimum_action", action).withColumn("risk_band", band)


def case_guard(
    df: DataFrame, case: str = "case_id", order: Sequence[str] = ("sequence",), ts: str = "event_ts",
    as_of: bool = True, hot: HotGroups | None = None,
) -> DataFrame:
    """E9-E11 in one pass: state, indicators, scores and minimum action."""
    return minimum_action(guarded_score(risk_indicators(case_state(df, case, order, ts, as_of, hot))))


def evidence_packets(df: DataFrame, tools: Sequence[str], case: str = "case_id", ts: str = "event_ts") -> DataFrame:
    """One packet per (event, tool) with the facts as JSON, as of that event.

    All tools read the same running state, so the packets are an explode and not a union of passes.
    """
    tools = list(dict.fromkeys(tools))
    unknown = sorted(set(tools).difference(d.EVIDENCE_TOOLS))
    if unknown:
        raise ValueError(f"Unknown evidence tools requested: {unknown}")
    if not tools:
        raise ValueError("At least one evidence tool is required.")
    hot = find_hot(df, [case])
    counted = df.withColumns({
        "o_behavior": F.size(signal_map(df, d.BEHAVIOR_KEYS)).cast("boolean").cast("int"),
        "o_communication": (
            (F.size(signal_map(df, d.COMMUNICATION_KEYS)) > 0) | (F.col("event_type") == "COMMUNICATION_RISK_CONTEXT")
        ).cast("int"),
        "o_quality": (F.size(signal_map(df, d.QUALITY_KEYS)) > 0).cast("int"),
        "o_conflict": _flag(attr(df, "evidence_conflict_present", "boolean")),
        "o_payment": attr(df, "amount_inr", "double").isNotNull().cast("int"),
    })
    counts = {c: Running("sum", F.col(c)) for c in counted.columns if c.startswith("o_")}
    counted = running(counted, [case], ["sequence"], {f"n_{c}": a for c, a in counts.items()}, hot=hot)
    if "entity_linkage" in tools:
        linked = entity_linkage(df, case, as_of=True).drop(case)
        counted = counted.join(linked, "event_id")
    state = case_guard(counted, case, ts=ts, hot=hot)
    facts: Mapping[str, list[Column]] = {
        "timeline_summary": [F.col("s_events").alias("event_count"), phases_seen().alias("lifecycle_phases_reached"), F.col("s_value_events").alias("value_event_count"), F.round(_elapsed()).cast("long").alias("elapsed_seconds")],
        "velocity_profile": [F.col("s_payments").alias("declared_payment_count"), F.round("s_value", 2).alias("observed_value_inr"), F.round(F.col("s_events") / F.greatest(_elapsed() / 60, F.lit(1.0)), 3).alias("events_per_minute")],
        "payment_context": [F.col("n_o_payment").alias("payment_count")],
        "legitimate_alternatives": [independently_verified().alias("independent_verification_found"), verified_markers().alias("verified_markers"), complete_agent_trust().alias("complete_agent_trust_chain")],
        "behavioral_biometrics": [F.col("n_o_behavior").alias("behavioral_observation_count")],
        "communication_risk": [F.col("n_o_communication").alias("communication_observation_count")],
        "evidence_quality": [F.col("n_o_quality").alias("quality_metadata_event_count"), F.col("n_o_conflict").alias("conflicting_evidence_count")],
        "case_risk_synthesis": [F.col(c) for c in ("observable_risk_score", "raw_risk_score", "risk_band", "minimum_action", "indicator_count", "indicator_codes")],
    }
    if "entity_linkage" in tools:
        facts = {**facts, "entity_linkage": [F.col(c) for c in ("unique_entity_count", "relationship_edge_count", "explicit_linkage_observations")]}
    tail = F.expr("right(cast(event_id as string), 8)")
    packets = F.array(*[
        F.struct(
            F.lit(tool).alias("tool_name"), F.to_json(F.struct(*facts[tool])).alias("facts"),
            F.concat(F.lit("evidence_"), tail, F.lit(f"_{i}")).alias("evidence_id"),
        )
        for i, tool in enumerate(tools, start=1)
    ])
    return state.select(case, F.col("event_id").alias("as_of_event_id"), F.explode(packets).alias("_p")).select(
        case, "as_of_event_id", "_p.*", F.lit(0.9).alias("confidence")
    )
