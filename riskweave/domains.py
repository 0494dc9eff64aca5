"""Fixed values of the payment-risk model: enumerations, priors, weights and rule constants."""

from __future__ import annotations

# Decision actions from weakest to strongest, and the risk level each action may carry.
ACTIONS = ("allow", "monitor", "step_up", "hold", "block")
ALERT_ACTIONS = ("step_up", "hold", "block")
DECISIVE_ACTIONS = ("hold", "block")
RESOLVING_ACTIONS = ("allow", "monitor", "step_up")
RISK_LEVELS = ("low", "medium", "high", "critical")
ALLOWED_RISKS = {
    "allow": ("low",),
    "monitor": ("low", "medium", "high"),
    "step_up": ("medium", "high", "critical"),
    "hold": ("high", "critical"),
    "block": ("critical",),
}
ACTION_FRICTION = {"allow": 0.0, "monitor": 0.03, "step_up": 0.25, "hold": 0.70, "block": 1.0}

# Reason codes a decision may cite.
REASON_CODES = (
    "device_novelty", "network_novelty", "beneficiary_novelty", "amount_anomaly", "velocity",
    "graph_concentration", "identity_linkage", "communication_risk", "profile_change",
    "verification_inconsistency", "behavior_sequence", "cross_phase_pattern", "legitimate_context",
    "insufficient_evidence",
)
COARSE_REASONS = (
    "device_novelty", "network_novelty", "beneficiary_novelty", "amount_anomaly", "velocity",
    "graph_concentration", "identity_linkage", "communication_risk",
)
REASON_ALIASES = {
    "profile_change": "beneficiary_novelty",
    "verification_inconsistency": "identity_linkage",
    "behavior_sequence": "velocity",
    "cross_phase_pattern": "velocity",
}

# Evidence tools.
EVIDENCE_TOOLS = (
    "timeline_summary", "entity_linkage", "velocity_profile", "payment_context",
    "legitimate_alternatives", "behavioral_biometrics", "communication_risk", "evidence_quality",
    "case_risk_synthesis",
)

# Lifecycle phases, intervention points and the event types of each phase.
PHASES = ("pre_transaction", "transaction", "post_transaction")
INTERVENTION_CREDIT = {"PREVENT": 1.0, "DECIDE": 0.65, "CONTAIN": 0.25}
PRE_TRANSACTION_TYPES = (
    "COMMUNICATION_RISK_CONTEXT", "SESSION_STARTED", "AUTHENTICATION_CONTEXT_CHANGED",
    "IDENTITY_APPLICATION_SUBMITTED", "IDENTITY_VERIFICATION_ATTEMPTED", "ACCOUNT_OPENED",
    "ACCOUNT_WARMUP_ACTIVITY", "ACCOUNT_BEHAVIOR_PROFILE_UPDATED", "BENEFICIARY_ADDED",
    "SUPPLIER_PROFILE_CHANGED", "PAYOUT_DESTINATION_CHANGED", "AGENT_COMMERCE_SESSION_STARTED",
    "AGENT_PAYMENT_INTENT_PRESENTED",
)
POST_TRANSACTION_TYPES = (
    "FUNDS_RECEIVED", "FUNDS_DISPERSED", "PAYOUT_SETTLED", "DISPUTE_OPENED",
    "DISPUTE_EVIDENCE_REVIEWED", "DISPUTE_REFUND_ISSUED",
)
VALUE_MOVING_TYPES = (
    "PAYMENT_INITIATED", "AGENTIC_PAYMENT_INITIATED", "PAYMENT_REPEATED", "FUNDS_RECEIVED",
    "FUNDS_DISPERSED", "PAYOUT_REQUESTED", "PAYOUT_SETTLED", "DISPUTE_REFUND_ISSUED",
)
RELEASE_TYPES = ("FUNDS_DISPERSED", "PAYOUT_SETTLED", "DISPUTE_REFUND_ISSUED")
CONTEXT_CHANGE_TYPES = (
    "AUTHENTICATION_CONTEXT_CHANGED", "BENEFICIARY_ADDED", "SUPPLIER_PROFILE_CHANGED",
    "PAYOUT_DESTINATION_CHANGED",
)
LAB_ONLY_TYPES = ("CAMPAIGN_REPLAYED",)

# The stream that delivers each event type; DISPUTE_* and all others have a default.
SOURCE_SYSTEMS = {
    "channel_risk_gateway": ("COMMUNICATION_RISK_CONTEXT",),
    "identity_verification_stream": (
        "IDENTITY_APPLICATION_SUBMITTED", "IDENTITY_VERIFICATION_ATTEMPTED", "ACCOUNT_OPENED",
    ),
    "authentication_behavior_stream": (
        "SESSION_STARTED", "AUTHENTICATION_CONTEXT_CHANGED", "ACCOUNT_BEHAVIOR_PROFILE_UPDATED",
    ),
    "agentic_commerce_trust_gateway": ("AGENT_COMMERCE_SESSION_STARTED", "AGENT_PAYMENT_INTENT_PRESENTED"),
    "payment_network_stream": ("FUNDS_RECEIVED", "FUNDS_DISPERSED", "PAYOUT_SETTLED"),
    "account_profile_stream": (
        "BENEFICIARY_ADDED", "SUPPLIER_PROFILE_CHANGED", "PAYOUT_DESTINATION_CHANGED",
        "SALES_VELOCITY_CHANGED",
    ),
}
DISPUTE_SOURCE = "dispute_case_stream"
DEFAULT_SOURCE = "payment_orchestration_stream"
LANES = {
    "pre_transaction": ("asynchronous_pre_transaction", 2000),
    "post_transaction": ("streaming_post_transaction", 5000),
    "transaction": ("inline_payment_decision", 300),
}

# Per-account baseline spend range and its default.
BASELINE_LOW, BASELINE_HIGH, BASELINE_DEFAULT = 800.0, 12_000.0, 2_500.0

# Verification, history and agent-trust attributes of legitimate context.
STRONG_BOOLEAN_CONTEXT = (
    "out_of_band_verification_complete", "dual_approval_complete", "customer_notified_change",
    "strong_authentication_passed", "customer_confirmation_complete", "verified_funding_source",
)
HISTORY_DAY_FIELDS = (
    "registered_entity_age_days", "settlement_pattern_seen_days", "recurring_mandate_age_days",
    "known_contact_relationship_days", "supplier_relationship_days", "registered_agent_age_days",
)
HISTORY_MIN_DAYS = 30
AGENT_TRUST_POINTS = {
    "agent_signature_valid": 3,
    "consumer_consent_valid": 3,
    "intent_scope_match": 3,
    "payment_container_match": 3,
    "merchant_scope_match": 2,
}
AGENT_TRUST_FACTORS = tuple(AGENT_TRUST_POINTS)

# Attribute groups of the observation tools.
BEHAVIOR_KEYS = (
    "behavior_automation_suspected", "typing_cadence_similarity", "mouse_movement_humanness",
    "liveness_consistency_score", "liveness_confidence", "identity_consistency_mismatch",
    "voice_session_anomaly", "verification_retry_count",
)
COMMUNICATION_KEYS = (
    "urgency_level", "channel_switch_count", "first_contact_recency",
    "known_contact_relationship_days", "content_available",
)
QUALITY_KEYS = (
    "signal_confidence", "source_reliability", "evidence_delay_seconds", "evidence_conflict_present",
    "document_consistency_score", "profile_consistency_score",
)
LINKAGE_KEYS = (
    "linked_attribute_count", "device_reused_across_profiles", "device_shared_across_accounts",
    "network_shared_across_accounts",
)

# Sensor flags counted into the risk-signal density.
SENSOR_FLAGS = (
    "device_is_new", "network_is_new", "behavior_automation_suspected",
    "identity_consistency_mismatch", "evidence_conflict_present", "device_shared_across_accounts",
    "network_shared_across_accounts", "device_reused_across_profiles",
)

# Splits, severities and their weights.
SPLITS = ("train", "validation", "test_known", "test_novel")
SEVERITY_WEIGHTS = {"critical": 5, "high": 3, "medium": 2, "low": 1}

# Declared rail and channel priors, and channel names folded into their main channel.
RAIL_PRIORS = {"UPI": 0.45, "CARD": 0.25, "BANK_TRANSFER": 0.18, "WALLET": 0.12}
CHANNEL_PRIORS = {"MOBILE_APP": 0.56, "WEB": 0.20, "POS": 0.14, "API": 0.10}
CHANNEL_ALIASES = {"QR": "MOBILE_APP", "ECOMMERCE": "WEB", "ERP": "API"}

# Feature allowlist of the chain detector and the inputs it must never see.
CHAIN_NUMERIC_FEATURES = (
    "amount_to_baseline_ratio", "beneficiary_age_days", "session_age_seconds", "urgency_level",
    "approval_step_count", "prior_event_count", "seconds_since_prev_event", "events_last_hour",
    "distinct_beneficiaries_prior", "distinct_devices_prior", "hour_of_day", "day_of_week",
    "device_is_new", "network_is_new", "strong_authentication_passed",
    "customer_confirmation_complete", "payment_count", "device_shared_across_accounts",
    "network_shared_across_accounts", "device_reused_across_profiles", "sender_count",
    "change_risk_band", "linked_attribute_count", "distinct_networks_prior",
    "value_sum_last_hour_inr", "receiver_inbound_sender_count", "funds_dwell_time_seconds",
    "balance_drain_ratio", "add_to_payment_seconds", "device_binding_age_days",
    "dormancy_days_before_activity", "beneficiary_name_match_score", "round_amount_ratio",
)
CHAIN_CATEGORICAL_FEATURES = ("event_type", "beneficiary_kyc_tier")
CHAIN_FEATURES = CHAIN_NUMERIC_FEATURES + CHAIN_CATEGORICAL_FEATURES
CHAIN_FORBIDDEN = frozenset({
    "is_attack", "fraud_contributing", "stage_id", "attack_family", "scenario_id",
    "intervention_point", "value_at_risk_inr", "label", "sender_account_id", "beneficiary_id",
    "device_id", "network_id", "merchant_id", "identity_id", "supplier_id", "event_id", "case_id",
    "chain_id", "group_key", "occurred_at", "sequence", "offset_seconds", "observable_signals",
})

# Feature lists of the population benchmark and of the point-in-time baseline.
BENCHMARK_NUMERIC_FEATURES = (
    "amount_log", "baseline_amount_log", "amount_to_baseline", "session_age_log", "account_age_log",
    "beneficiary_age_log", "event_hour_sin", "event_hour_cos", "sequence", "prior_case_event_count",
    "payment_count_log", "urgency_level", "channel_switch_count", "observable_signal_count",
    "device_is_new", "network_is_new", "behavior_automation_suspected",
    "identity_consistency_mismatch", "evidence_conflict_present", "trust_failure_count",
    "independent_verification_count", "risk_signal_density", "source_reference_count",
)
BENCHMARK_CATEGORICAL_FEATURES = (
    "event_type", "lifecycle_phase", "payment_rail", "channel", "auth_method", "merchant_category",
    "source_system", "decision_lane",
)
BENCHMARK_REQUIRED = (
    "event_id", "event_ts", "case_id", "sequence", "split", "case_role", "label_fraud",
    "attack_family", "attack_vector_id", "amount_inr", "payment_rail", "channel",
    "sender_account_id", "beneficiary_id",
)
BENCHMARK_FORBIDDEN = frozenset({
    "label_fraud", "attack_family", "attack_vector_id", "difficulty", "scenario_id", "case_id",
    "case_role", "split", "event_id", "value_at_risk_inr", "legitimate_control",
    "near_neighbor_family",
})
HISTORY_NUMERIC_FEATURES = (
    "amount_log", "session_age_log", "account_age_log", "beneficiary_age_log", "event_hour_sin",
    "event_hour_cos", "sender_prior_event_count_log", "amount_to_prior_mean", "is_new_device",
    "is_new_ip", "is_new_beneficiary", "beneficiary_prior_sender_count_log",
    "device_prior_account_count_log", "ip_prior_account_count_log",
)
HISTORY_CATEGORICAL_FEATURES = ("payment_rail", "channel", "auth_method", "merchant_category")
HISTORY_REQUIRED = (
    "event_ts", "sender_account_id", "beneficiary_id", "device_id", "ip_prefix", "amount_inr",
    "session_age_seconds", "account_age_days", "beneficiary_age_days", "payment_rail", "channel",
    "auth_method", "merchant_category",
)
HISTORY_FORBIDDEN = frozenset({
    "label_fraud", "attack_family", "scenario_id", "legitimate_control", "event_id", "transaction_id",
})

# Keys and key fragments that must not appear in observable payloads.
SEALED_KEYS = ("attack_family", "scenario_id", "stage_id", "is_attack", "label_fraud")
FORBIDDEN_KEY_FRAGMENTS = (
    "password", "credential", "otp_value", "pin_value", "cvv", "pan", "real_name", "phone_number",
    "email_address", "message_content", "phishing_url", "malware", "exploit_code",
)

# Two-sided 95 % normal quantile used by the Wilson interval.
WILSON_Z = 1.959963984540054
