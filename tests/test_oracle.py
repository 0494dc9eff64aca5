"""Registered queries against DuckDB. RISKWEAVE_ORACLE=all runs every query, the default a spread of them."""

import os

import pytest

import check
from riskweave.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
SPREAD = (
    "P12_flatten_event", "J3_vectors_with_sources", "J7_bounds_violations", "W4_prior_distinct_accounts", "W7_W8_trailing_hour", "W9_distinct_prior",
    "E5_entity_linkage_as_of", "E10_E11_case_guard", "G3_deterministic_lane", "G8_effective_decisive_turn", "C1_C6_round_report", "Q10_exact_duplicates",
    "Q17_forbidden_json_keys", "F3_spearman", "F8_psi", "M3_roc_auc", "M5_threshold_under_fpr", "M9_expected_calibration_error", "M14_metrics_by_family",
    "M16_chain_summary", "L1_chronological_split", "L4_replay_buffer", "R3_risk_histogram", "R8_population_metadata", "ST4_stream_rollups",
)
NAMES = sorted(ORACLES) if os.environ.get("RISKWEAVE_ORACLE") == "all" else SPREAD


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    assert check.compare(spark, check.oracle_connection(SF_DIR), name, SF_DIR) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


HOT = ("W4_prior_distinct_accounts", "W9_distinct_prior", "W7_W8_trailing_hour", "E10_E11_case_guard", "G3_deterministic_lane", "F10_amount_shape_profile")


@pytest.mark.parametrize("name", HOT)
def test_segmented_paths_match_oracle(spark, small_groups, name):
    assert check.compare(spark, check.oracle_connection(SF_DIR), name, SF_DIR) is None
