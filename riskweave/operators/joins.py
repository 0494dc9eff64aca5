"""Joins of events, decisions, truth and catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decisions_with_truth(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Decisions with their sealed outcome, joined on the event."""
    extra = [c for c in truth.columns if c == "event_id" or c not in decisions.columns]
    return decisions.join(truth.select(*extra), "event_id")


def events_with_decisions(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every event, with action and risk level when it was decided."""
    picked = [c for c in ("action", "risk_level") if c in decisions.columns]
    return events.join(decisions.select("event_id", *picked), "event_id", "left")


def vectors_with_sources(
    vectors: DataFrame, sources: DataFrame, vector_id: str, source_id: str, detail: Column, holdout: DataFrame
) -> DataFrame:
    """Source details of each vector in the order of its ``source_ids``, and the holdout flag.

    Lists are rebuilt per distinct (vector, source_ids) pair, so a list is never longer than the array
    it comes from, however many copies of a vector the table holds.
    """
    pairs = vectors.select(F.col(vector_id).alias("_v"), F.col("source_ids").alias("_ids")).distinct()
    listed = pairs.select("_v", "_ids", F.posexplode("_ids").alias("pos", "_sid"))
    details = sources.select(F.col(source_id).alias("_sid"), detail.alias("_detail"))
    ordered = listed.join(details, "_sid").groupBy("_v", "_ids").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_detail"))), lambda x: x["_detail"]).alias("sources")
    )
    held = holdout.select(F.col(holdout.columns[0]).alias("_hv")).distinct().withColumn("_held", F.lit(True))
    return (
        vectors.join(ordered, (F.col(vector_id) == F.col("_v")) & F.col("source_ids").eqNullSafe(F.col("_ids")), "left")
        .join(held, F.col(vector_id) == F.col("_hv"), "left")
        .select(*vectors.columns, "sources", F.coalesce("_held", F.lit(False)).alias("novel_holdout"))
    )


def unmatched_reference(expected: DataFrame, seen: DataFrame, expected_key: str, seen_key: str) -> DataFrame:
    """Expected keys that never occur."""
    return (
        expected.select(expected_key).distinct()
        .join(seen.select(F.col(seen_key).alias(expected_key)), expected_key, "left_anti")
    )


def holdout_leak(rows: DataFrame, holdout: DataFrame, key: str, holdout_key: str, split: str = "split") -> DataFrame:
    """Held-out keys that occur outside ``test_novel``."""
    outside = rows.where(F.col(split) != "test_novel").select(key).where(F.col(key).isNotNull())
    return outside.join(holdout.select(F.col(holdout_key).alias(key)), key, "left_semi").distinct()


def reference_check(decisions: DataFrame, evidence: DataFrame, refs: str = "evidence_refs", scope: str = "event_id") -> DataFrame:
    """Cited evidence ids that are not available to the decision, one row per citation."""
    cited = decisions.select(scope, F.explode(F.array_distinct(refs)).alias("evidence_id"))
    return cited.join(evidence.select(scope, "evidence_id"), [scope, "evidence_id"], "left_anti")


def bounds_violations(scenarios: DataFrame, parameters: DataFrame, bounds: DataFrame) -> DataFrame:
    """Parameters that are missing, outside their bound, or have no bound.

    scenarios(scenario_id, family), parameters(scenario_id, parameter, value[, text_value]),
    bounds(family, parameter, min_value, max_value[, allowed array]).
    """
    b = bounds if "allowed" in bounds.columns else bounds.withColumn("allowed", F.lit(None).cast("array<string>"))
    v = parameters if "text_value" in parameters.columns else parameters.withColumn("text_value", F.lit(None).cast("string"))
    expected = scenarios.join(b, "family").select(
        "scenario_id", "parameter", "min_value", "max_value", "allowed", F.lit(True).alias("_bounded")
    )
    actual = v.select("scenario_id", "parameter", "value", "text_value", F.lit(True).alias("_given"))
    both = expected.join(actual, ["scenario_id", "parameter"], "full_outer")
    value = F.col("value")
    low = F.coalesce("min_value", value)
    high = F.coalesce("max_value", value)
    numeric_ok = F.coalesce((value >= low) & (value <= high), F.lit(False))
    listed_ok = F.coalesce(F.array_contains("allowed", F.coalesce(F.col("text_value"), value.cast("string"))), F.lit(False))
    inside = F.when(F.col("allowed").isNotNull(), listed_ok).otherwise(numeric_ok)
    problem = (
        F.when(F.col("_given").isNull(), F.lit("missing"))
        .when(F.col("_bounded").isNull(), F.lit("unbounded"))
        .when(~inside, F.lit("out_of_bounds"))
    )
    return both.select("scenario_id", "parameter", "value", problem.alias("problem")).where(F.col("problem").isNotNull())
