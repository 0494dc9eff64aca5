"""Column expressions: transforms, mappings and small rules that need no shuffle."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import domains as d


def attr(df: DataFrame, name: str, dtype: str) -> Column:
    """The attribute column cast to ``dtype``, or a typed null when the table does not carry it.

    Booleans are strict: a column of another type is no flag, so neither 1 nor "yes" is true.
    """
    types = dict(df.dtypes)
    if name in types and (dtype != "boolean" or types[name] == "boolean"):
        return F.col(name).try_cast(dtype)
    return F.lit(None).cast(dtype)


def or_default(col: Column, default: float | int) -> Column:
    """Null and zero both take the default, as in ``value or default``."""
    return F.when(col.isNull() | (col == 0), F.lit(default)).otherwise(col)


def mapped(col: Column, table: Mapping[str, str]) -> Column:
    """Replace the listed values and keep all others."""
    out = None
    for source, target in table.items():
        out = (F.when if out is None else out.when)(col == source, F.lit(target))
    return out.otherwise(col)


def log1p_clipped(col: Column) -> Column:
    """log(1 + max(0, x)); null stays null."""
    return F.when(col.isNotNull(), F.log1p(F.greatest(col.cast("double"), F.lit(0.0))))


def hour_of_timestamp(ts: Column) -> Column:
    """Hour of day with minutes as the fraction."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def hour_of_elapsed(seconds: Column) -> Column:
    """Hour of day from elapsed seconds."""
    return F.pmod(seconds, F.lit(86400.0)) / F.lit(3600.0)


def cyclic_hour(hour: Column) -> tuple[Column, Column]:
    """Sine and cosine of the position in the 24-hour circle."""
    angle = hour * F.lit(2.0) * F.lit(math.pi) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def calendar_parts(ts: Column) -> tuple[Column, Column]:
    """Hour of day and weekday with Monday = 0."""
    return F.hour(ts), F.weekday(ts)


def clip(col: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; null stays null."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def lifecycle_phase(event_type: Column) -> Column:
    """P5: phase of an event type; unknown types count as transaction."""
    return (
        F.when(event_type.isin(*d.PRE_TRANSACTION_TYPES), F.lit("pre_transaction"))
        .when(event_type.isin(*d.POST_TRANSACTION_TYPES), F.lit("post_transaction"))
        .otherwise(F.lit("transaction"))
    )


def delivery_profile(event_type: Column) -> tuple[Column, Column, Column]:
    """Source system, decision lane and latency budget (ms) of an event type."""
    source = F.when(event_type.startswith("DISPUTE_"), F.lit(d.DISPUTE_SOURCE))
    for system, types in d.SOURCE_SYSTEMS.items():
        source = source.when(event_type.isin(*types), F.lit(system))
    phase = lifecycle_phase(event_type)
    lane = budget = None
    for name, (lane_name, budget_ms) in d.LANES.items():
        lane = (F.when if lane is None else lane.when)(phase == name, F.lit(lane_name))
        budget = (F.when if budget is None else budget.when)(phase == name, F.lit(budget_ms))
    return source.otherwise(F.lit(d.DEFAULT_SOURCE)), lane, budget


def account_baseline(account_id: Column) -> Column:
    """Stable per-account baseline spend derived from the id's MD5 prefix."""
    text = account_id.cast("string")
    prefix = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    share = prefix / F.lit(float(0xFFFFFFFF))
    value = F.round(F.lit(d.BASELINE_LOW) + share * F.lit(d.BASELINE_HIGH - d.BASELINE_LOW), 2)
    return F.when(text.isNull() | (text == ""), F.lit(d.BASELINE_DEFAULT)).otherwise(value)


def value_at_risk(
    family: Column, stage: Column, event_type: Column, amount: Column, payment_count: Column, sender_count: Column
) -> Column:
    """Value an event puts at risk; the first matching rule wins.

    A missing payment count on a repeated payment counts as two payments.
    """
    value = F.coalesce(amount, F.lit(0.0))
    repeats = F.greatest(F.lit(1), F.coalesce(payment_count, F.lit(2)).cast("int"))
    return (
        F.when((family == "DISPUTE-01") & (stage == "original_purchase"), F.lit(0.0))
        .when(event_type.isin("PAYMENT_INITIATED", "AGENTIC_PAYMENT_INITIATED"), value)
        .when(event_type == "PAYMENT_REPEATED", value * repeats)
        .when((family == "MULE-01") & (stage == "fan_in"), value * F.coalesce(sender_count, F.lit(1)).cast("int"))
        .when(event_type.isin("PAYOUT_REQUESTED", "DISPUTE_REFUND_ISSUED"), value)
        .otherwise(F.lit(0.0))
    )


def mitigation_action(score: Column, threshold: float | Column) -> Column:
    """Action ladder around the alert threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        F.when(score.isNull() | F.isnan(score), F.lit(None))
        .when(score < t * 0.45, F.lit("allow"))
        .when(score < t, F.lit("monitor"))
        .when(score < F.least(F.lit(0.82), t + 0.14), F.lit("step_up"))
        .when(score < 0.95, F.lit("hold"))
        .otherwise(F.lit("block"))
    )


def logit(p: Column) -> Column:
    """P10: log-odds with the probability kept inside [1e-8, 1 - 1e-8]."""
    inside = clip(p, 1e-8, 1.0 - 1e-8)
    return F.log(inside / (F.lit(1.0) - inside))


def canonical_channel(channel: Column) -> Column:
    """Fold channel variants into their main channel."""
    return mapped(channel, d.CHANNEL_ALIASES)


def coalesce_numeric(df: DataFrame, names: Sequence[str], default: float = 0.0) -> Column:
    """First attribute that is present and numeric; boolean columns do not count as numbers."""
    types = dict(df.dtypes)
    usable = [F.col(n).try_cast("double") for n in names if types.get(n, "boolean") != "boolean"]
    return F.coalesce(*usable, F.lit(float(default)))


def strict_flag(df: DataFrame, name: str) -> Column:
    """1 only when the attribute is a boolean and true."""
    if dict(df.dtypes).get(name) != "boolean":
        return F.lit(0)
    return F.coalesce(F.col(name), F.lit(False)).cast("int")


def count_true(df: DataFrame, names: Sequence[str]) -> Column:
    out = F.lit(0)
    for name in names:
        out = out + F.coalesce(attr(df, name, "boolean"), F.lit(False)).cast("int")
    return out


def verification_count(df: DataFrame) -> Column:
    """True verification attributes, plus one when any independent check passed."""
    checks = (attr(df, "independent_checks_passed", "double") > 0)
    return count_true(df, d.STRONG_BOOLEAN_CONTEXT) + F.coalesce(checks, F.lit(False)).cast("int")


def trust_failure_count(df: DataFrame) -> Column:
    """Agent-trust attributes that are present and false."""
    out = F.lit(0)
    for name in d.AGENT_TRUST_FACTORS:
        failed = attr(df, name, "boolean") == F.lit(False)
        out = out + F.coalesce(failed, F.lit(False)).cast("int")
    return out


def risk_signal_density(
    flags: Column, trust_failures: Column, beneficiary_age: Column, amount_ratio: Column,
    payment_count: Column, urgency: Column, signal_count: Column,
) -> Column:
    """Risk points over max(5, signals + 3), rounded to 4 places."""
    points = flags + trust_failures
    for hit in (beneficiary_age < 7, amount_ratio >= 2, payment_count >= 3, urgency >= 4):
        points = points + F.coalesce(hit, F.lit(False)).cast("int")
    return F.round(points / F.greatest(F.lit(5), signal_count + 3), 4)


def coerce_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric features to double (true/false to 1/0, unreadable text to null), others to text."""
    types = dict(df.dtypes)

    def number(name: str) -> Column:
        if types.get(name) == "boolean":
            return F.col(name).cast("double").alias(name)
        return attr(df, name, "double").alias(name)

    return df.select(*keep, *[number(n) for n in numeric], *[attr(df, c, "string").alias(c) for c in categorical])


def vector_filter(df: DataFrame, category: str | None = None, rail: str | None = None) -> DataFrame:
    """Vectors of a category that use a rail; None means no restriction."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if rail is not None:
        df = df.where(F.array_contains("rails", rail))
    return df


def triage_filter(
    predictions: DataFrame, kind: str = "all", family: str | None = None, limit: int = 100, tiebreak: str = "event_id"
) -> DataFrame:
    """The highest-risk predictions of one triage kind (a top-k report)."""
    fraud, flagged = F.col("label_fraud"), F.col("predicted_fraud")
    kinds = {
        "false_positive": ~fraud & flagged,
        "missed_fraud": fraud & ~flagged,
        "detected_fraud": fraud & flagged,
    }
    if kind in kinds:
        predictions = predictions.where(kinds[kind])
    elif kind != "all":
        raise ValueError(f"unknown triage kind {kind!r}")
    if family is not None:
        predictions = predictions.where(F.col("attack_family") == family)
    return (
        predictions.orderBy(F.col("risk_score").desc(), F.col(tiebreak).asc())
        .limit(limit)
        .withColumn("event_ts", F.date_format("event_ts", "dd MMM yyyy, HH:mm:ss"))
    )


def round_half_up(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)
