"""Registered queries: scalar transforms (P), joins (J) and point-in-time features (W)."""

from __future__ import annotations


from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.functions import scalar as p
from riskweave.operators import history as h
from riskweave.operators import joins as j
from riskweave.operators import policy as g
from riskweave.plans.registry import Tables, query
from riskweave.plans.views import with_views


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


# ---------------------------------------------------------------- scalar functions

@query(
    "P1_log_features",
    with_views(
        "SELECT event_id, round(ln(1 + greatest(amount_inr - 20, 0e0)), 6) AS amount_log, "
        "round(ln(1 + greatest(CAST(beneficiary_age_days AS DOUBLE), 0e0) * CASE WHEN beneficiary_age_days IS NULL THEN NULL ELSE 1 END), 6) AS beneficiary_age_log FROM pay_events", "pay_events"),
)
def _(t: Tables):
    return t("pay_events").select(
        "event_id", F.round(p.log1p_clipped(F.col("amount_inr") - 20), 6).alias("amount_log"),
        F.round(p.log1p_clipped(F.col("beneficiary_age_days")), 6).alias("beneficiary_age_log"),
    )


@query(
    "P2_cyclic_hour",
    with_views(
        "SELECT event_id, round(sin(h * 2 * pi() / 24), 6) AS hour_sin, round(cos(h * 2 * pi() / 24), 6) AS hour_cos, "
        "round(sin(e * 2 * pi() / 24), 6) AS elapsed_sin, round(cos(e * 2 * pi() / 24), 6) AS elapsed_cos FROM ("
        "SELECT event_id, hour(event_ts) + minute(event_ts) / 60e0 AS h, (event_id * 977 % 86400) / 3600e0 AS e FROM pay_events) q", "pay_events"),
)
def _(t: Tables):
    a, b = p.cyclic_hour(p.hour_of_timestamp(F.col("event_ts")))
    c, e = p.cyclic_hour(p.hour_of_elapsed((F.col("event_id") * 977).cast("double")))
    names = {"hour_sin": a, "hour_cos": b, "elapsed_sin": c, "elapsed_cos": e}
    return t("pay_events").select("event_id", *[F.round(col, 6).alias(n) for n, col in names.items()])


@query("P3_calendar_parts", with_views(
    "SELECT event_id, CAST(hour(event_ts) AS INT) AS hour_of_day, CAST(isodow(event_ts) - 1 AS INT) AS day_of_week FROM pay_events", "pay_events"))
def _(t: Tables):
    hour, weekday = p.calendar_parts(F.col("event_ts"))
    return t("pay_events").select("event_id", hour.alias("hour_of_day"), weekday.alias("day_of_week"))


@query("P4_clip_ratio", with_views(
    "SELECT event_id, least(greatest(amount_inr - 30, 0e0), 50e0) AS ratio FROM pay_events", "pay_events"))
def _(t: Tables):
    return t("pay_events").select("event_id", p.clip(F.col("amount_inr") - 30, 0.0, 50.0).alias("ratio"))


_PHASE = (
    f"CASE WHEN event_type IN ({_quoted(d.PRE_TRANSACTION_TYPES)}) THEN 'pre_transaction' "
    f"WHEN event_type IN ({_quoted(d.POST_TRANSACTION_TYPES)}) THEN 'post_transaction' ELSE 'transaction' END"
)


@query("P5_lifecycle_phase", with_views(f"SELECT event_id, event_type, {_PHASE} AS phase FROM evidence_events", "evidence_events"))
def _(t: Tables):
    return t("evidence_events").select("event_id", "event_type", p.lifecycle_phase(F.col("event_type")).alias("phase"))


_SOURCE = "CASE WHEN event_type LIKE 'DISPUTE\\_%' ESCAPE '\\' THEN 'dispute_case_stream' " + " ".join(
    f"WHEN event_type IN ({_quoted(types)}) THEN '{system}'" for system, types in d.SOURCE_SYSTEMS.items()
) + " ELSE 'payment_orchestration_stream' END"


@query(
    "P6_delivery_profile",
    with_views(
        f"SELECT event_id, {_SOURCE} AS source_system, CASE phase WHEN 'pre_transaction' THEN 'asynchronous_pre_transaction' "
        "WHEN 'post_transaction' THEN 'streaming_post_transaction' ELSE 'inline_payment_decision' END AS decision_lane, "
        "CASE phase WHEN 'pre_transaction' THEN 2000 WHEN 'post_transaction' THEN 5000 ELSE 300 END AS latency_budget_ms "
        f"FROM (SELECT *, {_PHASE} AS phase FROM evidence_events) e", "evidence_events"),
)
def _(t: Tables):
    source, lane, budget = p.delivery_profile(F.col("event_type"))
    return t("evidence_events").select(
        "event_id", source.alias("source_system"), lane.alias("decision_lane"), budget.alias("latency_budget_ms")
    )


@query(
    "P7_account_baseline",
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 2500e0 ELSE round(800e0 + CAST(concat('0x', substr(md5(concat('acct_', c_custkey)), 1, 8)) AS BIGINT) "
    "/ 4294967295e0 * 11200e0, 2) END AS baseline FROM customer",
)
def _(t: Tables):
    account = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("acct_"), F.col("c_custkey").cast("string")))
    return t("customer").select("c_custkey", p.account_baseline(account).alias("baseline"))


@query(
    "P8_value_at_risk",
    with_views(
        "SELECT event_id, round(CASE WHEN f = 'DISPUTE-01' AND s = 'original_purchase' THEN 0e0 WHEN event_type IN ('PAYMENT_INITIATED', 'AGENTIC_PAYMENT_INITIATED') THEN a "
        "WHEN event_type = 'PAYMENT_REPEATED' THEN a * greatest(1, coalesce(payment_count, 2)) WHEN f = 'MULE-01' AND s = 'fan_in' THEN a * coalesce(sender_count, 1) "
        "WHEN event_type IN ('PAYOUT_REQUESTED', 'DISPUTE_REFUND_ISSUED') THEN a ELSE 0e0 END, 6) AS value_at_risk FROM ("
        "SELECT *, coalesce(amount_inr, 0e0) AS a, CASE k % 3 WHEN 0 THEN 'DISPUTE-01' WHEN 1 THEN 'MULE-01' ELSE 'ATO-01' END AS f, "
        "CASE k % 5 WHEN 0 THEN 'original_purchase' WHEN 1 THEN 'fan_in' ELSE 'other' END AS s FROM evidence_events) q", "evidence_events"),
)
def _(t: Tables):
    k = F.col("k")
    family = F.when(k % 3 == 0, "DISPUTE-01").when(k % 3 == 1, "MULE-01").otherwise("ATO-01")
    stage = F.when(k % 5 == 0, "original_purchase").when(k % 5 == 1, "fan_in").otherwise("other")
    value = p.value_at_risk(family, stage, *[F.col(c) for c in ("event_type", "amount_inr", "payment_count", "sender_count")])
    return t("evidence_events").select("event_id", F.round(value, 6).alias("value_at_risk"))


@query(
    "P9_mitigation_action",
    with_views(
        "SELECT event_id, CASE WHEN risk_score < 5e-1 * 45e-2 THEN 'allow' WHEN risk_score < 5e-1 THEN 'monitor' WHEN risk_score < least(82e-2, 5e-1 + 14e-2) THEN 'step_up' "
        "WHEN risk_score < 95e-2 THEN 'hold' ELSE 'block' END AS action FROM predictions", "predictions"),
)
def _(t: Tables):
    return t("predictions").select("event_id", p.mitigation_action(F.col("risk_score"), 0.5).alias("action"))


@query(
    "P10_logit",
    with_views(
        "SELECT event_id, round(ln(q / (1 - q)), 6) AS logit FROM (SELECT event_id, least(greatest(risk_score, 1e-8), 1 - 1e-8) AS q FROM predictions) s", "predictions"),
)
def _(t: Tables):
    return t("predictions").select("event_id", F.round(p.logit(F.col("risk_score")), 6).alias("logit"))


@query(
    "P11_canonical_channel",
    with_views(
        "SELECT event_id, CASE raw WHEN 'QR' THEN 'MOBILE_APP' WHEN 'ECOMMERCE' THEN 'WEB' WHEN 'ERP' THEN 'API' ELSE raw END AS channel FROM ("
        "SELECT event_id, CASE k % 7 WHEN 0 THEN 'QR' WHEN 1 THEN 'ECOMMERCE' WHEN 2 THEN 'ERP' ELSE channel END AS raw FROM pay_events) q", "pay_events"),
)
def _(t: Tables):
    k = F.col("k") % 7
    raw = F.when(k == 0, "QR").when(k == 1, "ECOMMERCE").when(k == 2, "ERP").otherwise(F.col("channel"))
    return t("pay_events").select("event_id", p.canonical_channel(raw).alias("channel"))


@query(
    "P12_flatten_event",
    with_views(
        "SELECT e.event_id, case_id AS chain_id, event_type, sequence, amount_inr, CAST(regexp_extract(v.props, '([0-9]+)', 1) AS BIGINT) AS k, attack_family, is_attack, "
        "fraud_contributing, value_at_risk_inr, CASE WHEN is_attack AND fraud_contributing THEN 1 ELSE 0 END AS label, "
        "CASE WHEN is_attack THEN 'attack' WHEN case_id IS NOT NULL THEN 'control' ELSE 'ambient' END AS source FROM ("
        "SELECT event_id, event_type, sequence, amount_inr, CASE WHEN event_id % 10 = 0 THEN NULL ELSE case_id END AS case_id FROM case_events) e "
        "JOIN (SELECT event_id, attack_family, is_attack, fraud_contributing, value_at_risk_inr FROM truth) t ON t.event_id = e.event_id "
        "JOIN (SELECT event_id, props FROM events) v ON v.event_id = e.event_id", "case_events", "truth"),
)
def _(t: Tables):
    from riskweave.sources.logs import flatten_events

    chain = F.when(F.col("event_id") % 10 != 0, F.col("case_id"))
    events = t("case_events").select("event_id", chain.alias("chain_id"), "event_type", "sequence", "amount_inr")
    with_text = events.join(t("events").select("event_id", F.col("props").alias("attributes")), "event_id")
    return flatten_events(with_text, t("truth").drop("case_id"), attribute_schema="k BIGINT").drop("group_key", "intervention_point", "offset_seconds")


@query(
    "P13_coalesce_numeric_and_flag",
    with_views(
        "SELECT event_id, coalesce(CAST(payment_count AS DOUBLE), CAST(sender_count AS DOUBLE), 1e0) AS count_value, "
        "CASE WHEN device_is_new THEN 1 ELSE 0 END AS new_device_flag FROM evidence_events", "evidence_events"),
)
def _(t: Tables):
    df = t("evidence_events")
    return df.select(
        "event_id", p.coalesce_numeric(df, ["device_is_new", "payment_count", "sender_count"], 1.0).alias("count_value"),
        p.strict_flag(df, "device_is_new").alias("new_device_flag"),
    )


@query(
    "P14_verification_and_trust_counts",
    with_views(
        "SELECT event_id, coalesce(CAST(strong_authentication_passed AS INT), 0) + coalesce(CAST(dual_approval_complete AS INT), 0) + "
        "CASE WHEN independent_checks_passed > 0 THEN 1 ELSE 0 END AS verifications, "
        "CASE WHEN agent_signature_valid = false THEN 1 ELSE 0 END + CASE WHEN consumer_consent_valid = false THEN 1 ELSE 0 END AS trust_failures FROM evidence_events", "evidence_events"),
)
def _(t: Tables):
    df = t("evidence_events")
    return df.select("event_id", p.verification_count(df).alias("verifications"), p.trust_failure_count(df).alias("trust_failures"))


@query(
    "P15_risk_signal_density",
    with_views(
        "SELECT event_id, round((coalesce(CAST(device_is_new AS INT), 0) + CASE WHEN agent_signature_valid = false THEN 1 ELSE 0 END + CASE WHEN consumer_consent_valid = false THEN 1 ELSE 0 END "
        "+ CASE WHEN beneficiary_age_days < 7 THEN 1 ELSE 0 END + CASE WHEN sender_baseline_amount_inr IS NOT NULL AND amount_inr / greatest(sender_baseline_amount_inr, 1e0) >= 2 THEN 1 ELSE 0 END "
        "+ CASE WHEN payment_count >= 3 THEN 1 ELSE 0 END + CASE WHEN urgency_level >= 4 THEN 1 ELSE 0 END) / CAST(greatest(5, k % 6 + 3) AS DOUBLE), 4) AS density FROM evidence_events",
        "evidence_events"),
)
def _(t: Tables):
    df = t("evidence_events")
    baseline = F.col("sender_baseline_amount_inr")
    ratio = F.when(baseline.isNotNull(), F.col("amount_inr") / F.greatest(baseline, F.lit(1.0)))
    density = p.risk_signal_density(
        p.strict_flag(df, "device_is_new"), p.trust_failure_count(df), F.col("beneficiary_age_days"), ratio,
        F.col("payment_count"), F.col("urgency_level"), F.col("k") % 6,
    )
    return df.select("event_id", density.alias("density"))


@query(
    "P16_coerce_feature_types",
    with_views(
        "SELECT event_id, CAST(amount_inr AS DOUBLE) AS amount_inr, CAST(CAST(label_fraud AS INT) AS DOUBLE) AS label_fraud, TRY_CAST(case_id AS DOUBLE) AS case_id, "
        "CAST(k AS VARCHAR) AS k, payment_rail, CAST(NULL AS DOUBLE) AS absent FROM pay_events", "pay_events"),
)
def _(t: Tables):
    return p.coerce_features(t("pay_events"), ["amount_inr", "label_fraud", "case_id", "absent"], ["k", "payment_rail"], ["event_id"])


def _triage(cond: str) -> str:
    return with_views(
        "SELECT event_id, strftime(event_ts, '%d %b %Y, %H:%M:%S') AS event_ts, attack_family, risk_score, label_fraud, predicted_fraud FROM predictions "
        f"WHERE {cond} ORDER BY risk_score DESC, event_id LIMIT 100", "predictions")


for _kind, _family, _cond in (
    ("false_positive", None, "NOT label_fraud AND predicted_fraud"),
    ("missed_fraud", None, "label_fraud AND NOT predicted_fraud"),
    ("detected_fraud", "FAM-A", "label_fraud AND predicted_fraud AND attack_family = 'FAM-A'"),
    ("all", None, "true"),
):
    def _run(t: Tables, kind=_kind, family=_family):
        found = p.triage_filter(t("predictions"), kind, family)
        return found.select("event_id", "event_ts", "attack_family", "risk_score", "label_fraud", "predicted_fraud")

    query(f"P18_triage_{_kind}", _triage(_cond))(_run)


_VECTORS = (
    "SELECT p_partkey AS vector_id, p_brand AS category, CASE p_partkey % 3 WHEN 0 THEN ['UPI', 'CARD'] WHEN 1 THEN ['WALLET'] ELSE ['CARD', 'WALLET', 'UPI'] END AS rails, "
    "[p_partkey % 100, (p_partkey * 7) % 100, (p_partkey * 3 + 50) % 130] AS source_ids FROM part"
)


def vectors(t: Tables):
    key = F.col("p_partkey")
    rails = (
        F.when(key % 3 == 0, F.array(F.lit("UPI"), F.lit("CARD"))).when(key % 3 == 1, F.array(F.lit("WALLET")))
        .otherwise(F.array(F.lit("CARD"), F.lit("WALLET"), F.lit("UPI")))
    )
    return t("part").select(
        key.alias("vector_id"), F.col("p_brand").alias("category"), rails.alias("rails"),
        F.array(key % 100, (key * 7) % 100, (key * 3 + 50) % 130).alias("source_ids"),
    )


@query("P19_vector_filter", with_views(
    "SELECT vector_id, category FROM vectors WHERE category = 'Brand#11' AND list_contains(rails, 'WALLET')", vectors=_VECTORS))
def _(t: Tables):
    return p.vector_filter(vectors(t), "Brand#11", "WALLET").select("vector_id", "category")


# ---------------------------------------------------------------- joins

@query(
    "J1_decisions_with_truth",
    with_views(
        "SELECT d.event_id, d.case_id, d.sequence, action, has_legitimate_context, is_attack, attack_family, value_at_risk_inr, intervention_point, offset_seconds, fraud_contributing "
        "FROM decisions d JOIN truth t ON t.event_id = d.event_id", "decisions", "truth"),
)
def _(t: Tables):
    return j.decisions_with_truth(t("decisions"), t("truth"))


@query(
    "J2_events_with_decisions",
    with_views(
        "SELECT e.event_id, e.case_id, e.sequence, event_type, lifecycle_phase, action FROM case_events e LEFT JOIN (SELECT * FROM ("
        "SELECT *, coalesce(bool_or(action = 'block') OVER (PARTITION BY case_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM decisions) q WHERE NOT stopped) d "
        "ON d.event_id = e.event_id", "case_events", "decisions"),
)
def _(t: Tables):
    """Events after the first block of their case have no decision."""
    events = t("case_events").select("event_id", "case_id", "sequence", "event_type", "lifecycle_phase")
    return j.events_with_decisions(events, g.stop_on_block(t("decisions")))


@query(
    "J3_vectors_with_sources",
    with_views(
        "SELECT v.vector_id, string_agg(s_name, '|' ORDER BY pos) AS source_names, bool_or(v.vector_id % 50 = 0) AS novel_holdout FROM vectors v LEFT JOIN ("
        "SELECT vector_id, unnest(source_ids) AS sid, generate_subscripts(source_ids, 1) AS pos FROM vectors) x ON x.vector_id = v.vector_id "
        "LEFT JOIN supplier ON s_suppkey = sid GROUP BY 1", vectors=_VECTORS),
)
def _(t: Tables):
    holdout = t("part").where(F.col("p_partkey") % 50 == 0).select("p_partkey")
    out = j.vectors_with_sources(vectors(t), t("supplier"), "vector_id", "s_suppkey", F.col("s_name"), holdout)
    return out.select("vector_id", F.array_join("sources", "|").alias("source_names"), "novel_holdout")


@query(
    "J4_unmatched_reference",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def _(t: Tables):
    urgent = t("orders").where(F.col("o_orderpriority") == "1-URGENT")
    return j.unmatched_reference(t("customer"), urgent, "c_custkey", "o_custkey")


@query(
    "J5_holdout_leak",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _(t: Tables):
    rows = t("orders").withColumn("split", F.when(F.col("o_orderstatus") == "P", "test_novel").otherwise("train"))
    held = t("customer").where(F.col("c_mktsegment") == "BUILDING")
    return j.holdout_leak(rows, held, "o_custkey", "c_custkey")


_EVIDENCE_IDS = "SELECT event_id, concat('evidence_', CAST(event_id AS VARCHAR), '_', CAST(n AS VARCHAR)) AS evidence_id FROM pay_events, (SELECT unnest([1, 2, 3]) AS n) x WHERE n <= 1 + k % 3"


@query(
    "J6_reference_check",
    with_views(
        "SELECT event_id, evidence_id FROM (SELECT event_id, concat('evidence_', CAST(event_id AS VARCHAR), '_', CAST(n AS VARCHAR)) AS evidence_id "
        "FROM pay_events, (SELECT unnest([2, 3]) AS n) x) c WHERE (event_id, evidence_id) NOT IN (SELECT event_id, evidence_id FROM available)", "pay_events", available=_EVIDENCE_IDS),
)
def _(t: Tables):
    events = t("pay_events")
    name = lambda n: F.concat(F.lit("evidence_"), F.col("event_id").cast("string"), F.lit("_"), n.cast("string"))
    available = events.select("event_id", F.explode(F.sequence(F.lit(1), 1 + F.col("k") % 3)).alias("n"))
    cited = events.select("event_id", F.array(name(F.lit(2)), name(F.lit(3)), name(F.lit(3))).alias("evidence_refs"))
    return j.reference_check(cited, available.select("event_id", name(F.col("n")).alias("evidence_id")))


@query(
    "J7_bounds_violations",
    "SELECT coalesce(e.scenario_id, a.scenario_id) AS scenario_id, coalesce(e.parameter, a.parameter) AS parameter, value, CASE WHEN a.scenario_id IS NULL THEN 'missing' "
    "WHEN e.scenario_id IS NULL THEN 'unbounded' ELSE 'out_of_bounds' END AS problem FROM (SELECT o_orderkey AS scenario_id, parameter, lo, hi FROM orders JOIN ("
    "SELECT DISTINCT o_orderpriority AS family, o_orderstatus AS parameter, 20000e0 AS lo, 400000e0 AS hi FROM orders WHERE o_orderstatus <> 'P') b ON family = o_orderpriority) e "
    "FULL JOIN (SELECT o_orderkey AS scenario_id, o_orderstatus AS parameter, o_totalprice AS value FROM orders) a ON a.scenario_id = e.scenario_id AND a.parameter = e.parameter "
    "WHERE a.scenario_id IS NULL OR e.scenario_id IS NULL OR value < lo OR value > hi",
)
def _(t: Tables):
    orders = t("orders")
    scenarios = orders.select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("family"))
    given = orders.select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderstatus").alias("parameter"), F.col("o_totalprice").alias("value"))
    bounds = (
        orders.where(F.col("o_orderstatus") != "P")
        .select(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("parameter")).distinct()
        .withColumns({"min_value": F.lit(20000.0), "max_value": F.lit(400000.0)})
    )
    return j.bounds_violations(scenarios, given, bounds)


# ---------------------------------------------------------------- point-in-time windows

@query("W1_prior_event_count", with_views(
    "SELECT event_id, row_number() OVER (PARTITION BY sender_account_id ORDER BY event_ts, event_id) - 1 AS prior_event_count FROM pay_events", "pay_events"))
def _(t: Tables):
    rows = t("pay_events").select("event_id", "event_ts", "sender_account_id")
    return h.prior_event_count(rows, "sender_account_id", ["event_ts", "event_id"]).select("event_id", "prior_event_count")


_W2 = (
    "SELECT event_id, row_number() OVER w - 1 AS prior_event_count, round(least(50e0, amount_inr / greatest(1e0, coalesce("
    "avg(amount_inr) OVER (PARTITION BY sender_account_id ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
    "(SELECT median(amount_inr) FROM pay_events)))), 6) AS amount_to_prior_mean FROM pay_events WINDOW w AS (PARTITION BY sender_account_id ORDER BY event_ts, event_id)"
)


@query("W2_amount_to_prior_mean", with_views(_W2, "pay_events"))
def _(t: Tables):
    rows = t("pay_events").select("event_id", "event_ts", "sender_account_id", "amount_inr")
    out = h.amount_to_prior_mean(rows, "sender_account_id", ["event_ts", "event_id"])
    return out.select("event_id", "prior_event_count", F.round("amount_to_prior_mean", 6).alias("amount_to_prior_mean"))


_ENTITY_FLAGS = "SELECT *, row_number() OVER (PARTITION BY sender_account_id ORDER BY event_ts, event_id) - 1 AS prior, " + ", ".join(
    f"row_number() OVER (PARTITION BY sender_account_id, {c} ORDER BY event_ts, event_id) = 1 AS first_{k}" for k, c in h.ENTITY_KINDS.items()
) + " FROM pay_events"


@query(
    "W3_is_new_entity",
    with_views("SELECT event_id, " + ", ".join(f"CASE WHEN prior > 0 AND first_{k} THEN 1 ELSE 0 END AS is_new_{k}" for k in h.ENTITY_KINDS) + " FROM flags", "pay_events", flags=_ENTITY_FLAGS),
)
def _(t: Tables):
    rows = t("pay_events").select("event_id", "event_ts", "sender_account_id", *h.ENTITY_KINDS.values())
    counted = h.prior_event_count(rows, "sender_account_id", ["event_ts", "event_id"])
    return h.entity_features(counted).select("event_id", *[f"is_new_{k}" for k in h.ENTITY_KINDS])


@query(
    "W4_prior_distinct_accounts",
    with_views(
        "SELECT event_id, " + ", ".join(
            f"count(*) FILTER (WHERE first_{k}) OVER (PARTITION BY {c} ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {h.ACCOUNT_COUNT_NAMES[k]}"
            for k, c in h.ENTITY_KINDS.items()) + " FROM flags", "pay_events", flags=_ENTITY_FLAGS),
)
def _(t: Tables):
    rows = t("pay_events").select("event_id", "event_ts", "sender_account_id", *h.ENTITY_KINDS.values())
    return h.entity_features(rows.withColumn("prior_event_count", F.lit(1))).select("event_id", *h.ACCOUNT_COUNT_NAMES.values())


@query("W5_prior_case_event_count", with_views(
    "SELECT event_id, row_number() OVER (PARTITION BY case_id ORDER BY sequence) - 1 AS prior_case_event_count FROM case_events", "case_events"))
def _(t: Tables):
    rows = t("case_events").select("event_id", "case_id", "sequence")
    return h.prior_event_count(rows, "case_id", ["sequence"], "prior_case_event_count").select("event_id", "prior_case_event_count")


@query("W6_seconds_since_prev", with_views(
    "SELECT event_id, round(greatest(0e0, (epoch_us(event_ts) - epoch_us(lag(event_ts) OVER (PARTITION BY case_id ORDER BY sequence))) / 1e6) * "
    "CASE WHEN sequence = 1 THEN NULL ELSE 1 END, 6) AS seconds_since_prev_event FROM case_events", "case_events"))
def _(t: Tables):
    rows = t("case_events").select("event_id", "case_id", "sequence", "event_ts")
    out = h.seconds_since_prev(rows, "case_id", ["sequence"], "event_ts")
    return out.select("event_id", F.round("seconds_since_prev_event", 6).alias("seconds_since_prev_event"))


_HOUR = (
    "SELECT c.event_id, count(p.event_id) AS events_last_hour, round(coalesce(sum(p.amount_inr), 0e0) + any_value(c.amount_inr), 2) AS value_sum_last_hour_inr "
    "FROM case_events c LEFT JOIN case_events p ON p.case_id = c.case_id AND p.sequence < c.sequence AND epoch_us(c.event_ts) - epoch_us(p.event_ts) BETWEEN 0 AND 3600000000 GROUP BY 1"
)


@query("W7_W8_trailing_hour", with_views(_HOUR, "case_events"))
def _(t: Tables):
    rows = t("case_events").select("event_id", "case_id", "sequence", "event_ts", "amount_inr")
    out = h.trailing_hour(rows, "case_id", "event_ts", "sequence", "event_id", "amount_inr", sequence=True)
    return out.select("event_id", "events_last_hour", "value_sum_last_hour_inr")


# A few long chains whose sequence is not their time order, with ties and missing times.
_BACKWARD = (
    "SELECT event_id, sender_account_id % 7 AS chain, (event_id * 7919) % 1009 AS sequence, amount_inr, "
    "CASE WHEN k % 13 <> 0 THEN date_trunc('minute', event_ts) END AS event_ts FROM {pay_events}"
)


@query("W7_W8_by_sequence", with_views(
    "SELECT c.event_id, count(p.event_id) AS events_last_hour, CAST(round(coalesce(sum(CAST(p.amount_inr AS DECIMAL(28, 6))), 0) + "
    "coalesce(any_value(CAST(c.amount_inr AS DECIMAL(28, 6))), 0), 2) AS DOUBLE) AS value_sum_last_hour_inr FROM backward c LEFT JOIN backward p ON p.chain = c.chain "
    "AND (p.sequence, p.event_id) < (c.sequence, c.event_id) AND epoch_us(c.event_ts) - epoch_us(p.event_ts) BETWEEN 0 AND 3600000000 GROUP BY 1",
    "pay_events", backward=_BACKWARD.format(pay_events="pay_events")))
def _(t: Tables):
    rows = t.spark.sql(_BACKWARD, pay_events=t("pay_events"))
    out = h.trailing_hour(rows, "chain", "event_ts", "sequence", "event_id", "amount_inr", sequence=True)
    return out.select("event_id", "events_last_hour", "value_sum_last_hour_inr")


_DISTINCT = (
    "SELECT c.event_id, count(DISTINCT p.beneficiary_id) AS distinct_beneficiaries_prior, count(DISTINCT p.device_id) AS distinct_devices_prior "
    "FROM evidence_events c LEFT JOIN evidence_events p ON p.case_id = c.case_id AND p.sequence < c.sequence GROUP BY 1"
)


@query("W9_distinct_prior", with_views(_DISTINCT, "evidence_events"))
def _(t: Tables):
    rows = t("evidence_events").select("event_id", "case_id", "sequence", "beneficiary_id", "device_id")
    fields = {"distinct_beneficiaries_prior": "beneficiary_id", "distinct_devices_prior": "device_id"}
    return h.distinct_prior(rows, "case_id", fields, ["sequence"], "event_id").select("event_id", *fields)


_CHAIN_BASE = "SELECT *, CASE WHEN event_id % 10 = 0 THEN concat('solo_', CAST(event_id AS VARCHAR)) ELSE case_id END AS ck FROM evidence_events"


@query(
    "W10_chain_feature_frame",
    with_views(
        "SELECT c.event_id, CAST(c.beneficiary_age_days AS DOUBLE) AS beneficiary_age_days, CAST(c.urgency_level AS DOUBLE) AS urgency_level, "
        "CAST(row_number() OVER (PARTITION BY c.ck ORDER BY c.sequence) - 1 AS DOUBLE) AS prior_event_count, "
        "round(CAST((epoch_us(c.event_ts) - epoch_us(lag(c.event_ts) OVER (PARTITION BY c.ck ORDER BY c.sequence))) AS DOUBLE) / 1e6, 6) AS seconds_since_prev_event, "
        "CAST(q.n AS DOUBLE) AS events_last_hour, round(q.v + coalesce(c.amount_inr, 0e0), 2) AS value_sum_last_hour_inr, "
        "CAST(q.b AS DOUBLE) AS distinct_beneficiaries_prior, CAST(q.dv AS DOUBLE) AS distinct_devices_prior, 0e0 AS distinct_networks_prior, "
        "CAST(hour(c.event_ts) AS DOUBLE) AS hour_of_day, CAST(isodow(c.event_ts) - 1 AS DOUBLE) AS day_of_week, CAST(CAST(c.device_is_new AS INT) AS DOUBLE) AS device_is_new, "
        "CAST(NULL AS DOUBLE) AS balance_drain_ratio, c.event_type, CAST(NULL AS VARCHAR) AS beneficiary_kyc_tier FROM base c JOIN ("
        "SELECT c.event_id, count(p.event_id) FILTER (WHERE epoch_us(c.event_ts) - epoch_us(p.event_ts) BETWEEN 0 AND 3600000000) AS n, "
        "coalesce(sum(p.amount_inr) FILTER (WHERE epoch_us(c.event_ts) - epoch_us(p.event_ts) BETWEEN 0 AND 3600000000), 0e0) AS v, "
        "count(DISTINCT p.beneficiary_id) AS b, count(DISTINCT p.device_id) AS dv FROM base c LEFT JOIN base p ON p.ck = c.ck AND p.sequence < c.sequence GROUP BY 1) q ON q.event_id = c.event_id",
        "evidence_events", base=_CHAIN_BASE),
)
def _(t: Tables):
    rows = t("evidence_events").withColumn("chain_id", F.when(F.col("event_id") % 10 != 0, F.col("case_id")))
    out = h.chain_feature_frame(rows, "event_ts")
    names = [
        "beneficiary_age_days", "urgency_level", "prior_event_count", "events_last_hour", "value_sum_last_hour_inr",
        "distinct_beneficiaries_prior", "distinct_devices_prior", "distinct_networks_prior", "hour_of_day", "day_of_week",
        "device_is_new", "balance_drain_ratio", "event_type", "beneficiary_kyc_tier",
    ]
    return out.select("event_id", *names, F.round("seconds_since_prev_event", 6).alias("seconds_since_prev_event"))


@query("W11_cumulative_session_risk", with_views(
    "SELECT event_id, max(risk_score) OVER w AS cumulative_risk, max(risk_score) OVER w >= 5e-1 AS above_threshold FROM predictions WINDOW w AS (PARTITION BY case_id ORDER BY sequence)", "predictions"))
def _(t: Tables):
    rows = t("predictions").select("event_id", "case_id", "sequence", "risk_score")
    return h.cumulative_session_risk(rows, "case_id", ["sequence"], "risk_score", 0.5).select("event_id", "cumulative_risk", "above_threshold")


def _history_input(t: Tables):
    return t("pay_events").withColumns({
        "session_age_seconds": F.col("k") * 30, "account_age_days": F.col("sender_account_id") % 900,
        "auth_method": F.when(F.col("k") % 2 == 0, "PIN").otherwise("OTP"),
        "merchant_category": F.when(F.col("k") % 3 == 0, "FUEL").otherwise("DINING"),
    })


@query(
    "W12_point_in_time_features",
    with_views(
        "SELECT f.event_id, round(ln(1 + amount_inr), 6) AS amount_log, round(ln(1 + k * 30), 6) AS session_age_log, round(ln(1 + sender_account_id % 900), 6) AS account_age_log, "
        "round(ln(1 + beneficiary_age_days), 6) AS beneficiary_age_log, round(sin((hour(event_ts) + minute(event_ts) / 60e0) * 2 * pi() / 24), 6) AS event_hour_sin, "
        "round(cos((hour(event_ts) + minute(event_ts) / 60e0) * 2 * pi() / 24), 6) AS event_hour_cos, round(ln(1 + prior), 6) AS sender_prior_event_count_log, amount_to_prior_mean, "
        + ", ".join(f"CASE WHEN prior > 0 AND first_{k} THEN 1 ELSE 0 END AS is_new_{k}" for k in h.ENTITY_KINDS) + ", "
        + ", ".join(
            f"round(ln(1 + count(*) FILTER (WHERE first_{k}) OVER (PARTITION BY {c} ORDER BY event_ts, f.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 6) AS {h.ACCOUNT_COUNT_NAMES[k]}_log"
            for k, c in h.ENTITY_KINDS.items())
        + " FROM flags f JOIN w2 ON w2.event_id = f.event_id", "pay_events", flags=_ENTITY_FLAGS, w2=_W2),
)
def _(t: Tables):
    out = h.point_in_time_features(_history_input(t))
    return out.select("event_id", *[
        F.col(c) if c.startswith("is_new") else F.round(c, 6).alias(c) for c in d.HISTORY_NUMERIC_FEATURES
    ])


@query(
    "W13_benchmark_features",
    with_views(
        "SELECT event_id, round(ln(1 + amount_inr), 6) AS amount_log, round(ln(1 + k), 6) AS baseline_amount_log, round(least(50e0, amount_inr / (7e0 * greatest(k, 1))), 6) AS amount_to_baseline, "
        "round(sin((hour(event_ts) + minute(event_ts) / 60e0) * 2 * pi() / 24), 6) AS event_hour_sin, row_number() OVER (PARTITION BY case_id ORDER BY split, event_ts, sequence) - 1 AS prior_case_event_count, "
        "round(ln(1 + k % 4), 6) AS payment_count_log FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'validation' END AS split FROM case_events) c", "case_events"),
)
def _(t: Tables):
    k = F.col("k")
    rows = t("case_events").withColumns({
        "split": F.when(F.col("event_id") % 2 == 0, "train").otherwise("validation"), "case_role": F.lit("attack"),
        "attack_vector_id": F.col("attack_family"), "sender_baseline_amount_inr": k.cast("double"),
        "amount_to_baseline": F.col("amount_inr") / (7.0 * F.greatest(k, F.lit(1))), "payment_count": k % 4,
    })
    out = h.benchmark_features(rows)
    names = ["amount_log", "baseline_amount_log", "amount_to_baseline", "event_hour_sin", "payment_count_log"]
    return out.select("event_id", "prior_case_event_count", *[F.round(n, 6).alias(n) for n in names])
