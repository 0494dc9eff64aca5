import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators import history as h
from riskweave.operators.ordered import find_hot


def events(spark, rows):
    base = {
        "sender_account_id": "acct-7", "beneficiary_id": "shop-3", "device_id": "tablet", "ip_prefix": "198.51.0.0/16", "amount_inr": 40.0,
        "session_age_seconds": 12, "account_age_days": 31, "beneficiary_age_days": 9, "payment_rail": "UPI", "channel": "MOBILE_APP",
        "auth_method": "PIN", "merchant_category": "P2P_TRANSFER",
    }
    start = datetime(2025, 2, 3, 4)
    full = [{**base, "event_id": i, "event_ts": start + timedelta(hours=i), **row} for i, row in enumerate(rows)]
    return spark.createDataFrame(full)


def test_ties_and_missing_devices_follow_the_event_order(spark):
    """Three events of one instant, then one with a device seen before and one without a device."""
    same = datetime(2025, 2, 3, 4)
    rows = [
        {"event_ts": same, "amount_inr": 10.0}, {"event_ts": same, "device_id": "phone", "amount_inr": 30.0},
        {"event_ts": same, "beneficiary_id": "shop-4", "amount_inr": 50.0}, {"device_id": "phone", "amount_inr": 90.0}, {"device_id": None},
    ]
    out = {r["event_id"]: r for r in h.point_in_time_features(events(spark, rows)).collect()}
    assert [out[i]["sender_prior_event_count"] for i in range(5)] == [0, 1, 2, 3, 4]
    assert [out[i]["is_new_device"] for i in range(4)] == [0, 1, 0, 0]
    assert [out[i]["is_new_beneficiary"] for i in range(4)] == [0, 0, 1, 0]
    assert [out[i]["amount_to_prior_mean"] for i in range(1, 4)] == [pytest.approx(3.0), pytest.approx(2.5), pytest.approx(3.0)]


@pytest.mark.parametrize("limit", [3, 1000])
def test_hourly_sums_are_the_same_for_hot_and_cold_keys(spark, limit):
    start = datetime(2025, 2, 3, 4)
    rows = [(0, "k", start, 1e14)] + [(i, "k", start + timedelta(hours=3, minutes=i), 0.01) for i in range(1, 8)] + [(8, "n", None, 5.0)]
    df = spark.createDataFrame(rows, "event_id long, k string, ts timestamp, amount double")
    out = {r["event_id"]: r for r in h.trailing_hour(df, "k", "ts", "event_id", "event_id", "amount", hot=find_hot(df, ["k"], limit)).collect()}
    assert [out[i]["value_sum_last_hour_inr"] for i in range(1, 8)] == [pytest.approx(i / 100) for i in range(1, 8)]
    assert [out[i]["events_last_hour"] for i in range(9)] == [0, *range(7), 0] and out[8]["value_sum_last_hour_inr"] == 5.0


def test_later_rows_never_change_earlier_features(spark):
    rows = [{"sender_account_id": f"a{i % 3}", "device_id": f"d{i % 4}"} for i in range(12)]
    fixed = spark.createDataFrame([(100.0,)], "m double")
    names = [c for c in d.HISTORY_NUMERIC_FEATURES]
    before = h.point_in_time_features(events(spark, rows[:8]), fallback=fixed).select("event_id", *names).orderBy("event_id").collect()
    after = h.point_in_time_features(events(spark, rows), fallback=fixed).where("event_id < 8").select("event_id", *names).orderBy("event_id").collect()
    assert before == after


def test_prior_accounts_count_other_senders(spark):
    rows = [{"sender_account_id": s} for s in ("a1", "a1", "a2", "a3", "a2")]
    out = h.point_in_time_features(events(spark, rows)).orderBy("event_id").collect()
    assert [r["device_prior_account_count"] for r in out] == [0, 1, 1, 2, 3]


def test_missing_columns_and_forbidden_features_fail_closed(spark):
    with pytest.raises(ValueError, match="device_id"):
        h.point_in_time_features(events(spark, [{}]).drop("device_id"))
    with pytest.raises(ValueError, match="missing required"):
        h.benchmark_features(events(spark, [{}]))
    with pytest.raises(ValueError, match="label_fraud"):
        h.require_clean(["label_fraud", "amount_log"], d.HISTORY_FORBIDDEN)
    assert h.audit_features(d.CHAIN_FEATURES, d.CHAIN_FORBIDDEN) == []
    assert len(d.CHAIN_FEATURES) == 35


def test_chain_frame_treats_missing_chain_as_singleton(spark):
    t0 = datetime(2026, 8, 3, 9)
    rows = [(1, "c", 1, t0, 10.0, "b1"), (2, "c", 2, t0 + timedelta(minutes=30), 20.0, "b2"), (3, "c", 3, t0 + timedelta(hours=2), 5.0, "b1"), (4, None, None, t0, 7.0, "b1")]
    df = spark.createDataFrame(rows, "event_id long, chain_id string, sequence int, occurred_at timestamp, amount_inr double, beneficiary_id string")
    out = {r["event_id"]: r for r in h.chain_feature_frame(df.withColumn("event_type", F.lit("PAYMENT_INITIATED"))).collect()}
    assert [out[i]["prior_event_count"] for i in (1, 2, 3, 4)] == [0, 1, 2, 0]
    assert [out[i]["events_last_hour"] for i in (1, 2, 3, 4)] == [0, 1, 0, 0]
    assert out[2]["value_sum_last_hour_inr"] == 30.0 and out[2]["seconds_since_prev_event"] == 1800.0
    assert [out[i]["distinct_beneficiaries_prior"] for i in (1, 2, 3)] == [0, 1, 2]
    assert out[1]["seconds_since_prev_event"] is None and out[1]["day_of_week"] == 0


@pytest.mark.parametrize("limit", [6, 1000])
def test_the_sequence_alone_decides_what_is_earlier(spark, limit):
    """Chains whose time runs back and forth, with equal times, equal sequences, missing times and a hot chain."""
    rng = random.Random(limit)
    start = datetime(2025, 2, 3, 4)
    rows = [
        (i, "hot" if i % 2 else f"c{i % 6}", rng.randrange(30) if rng.random() > 0.05 else None,
         start + timedelta(minutes=rng.randrange(0, 240, 5)) if rng.random() > 0.1 else None, rng.randrange(900) / 100) for i in range(90)
    ]
    rows += [(100 + i, "ordered", i, start + timedelta(minutes=20 * i), 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, k string, seq int, ts timestamp, amount double")
    spark.conf.set("spark.riskweave.hotGroupRows", str(limit))
    try:
        got = {r["event_id"]: r for r in h.trailing_hour(df, "k", "ts", "seq", "event_id", "amount", sequence=True).collect()}
    finally:
        spark.conf.unset("spark.riskweave.hotGroupRows")

    def place(r):
        return (r[2] is not None, r[2] or 0, r[0])

    for r in rows:
        seen = [x for x in rows if x[1] == r[1] and place(x) < place(r) and r[3] and x[3] and timedelta(0) <= r[3] - x[3] <= timedelta(hours=1)]
        assert got[r[0]]["events_last_hour"] == len(seen)
        assert got[r[0]]["value_sum_last_hour_inr"] == pytest.approx(round(sum(x[4] for x in seen) + r[4], 2))
    assert len(got) == len(rows)


def test_an_event_later_in_the_sequence_is_never_seen(spark):
    at = datetime(2025, 2, 3, 9)
    rows = [(1, "c", 1, at + timedelta(minutes=10), 10.0), (2, "c", 2, at, 20.0)]
    df = spark.createDataFrame(rows, "event_id long, chain_id string, sequence int, occurred_at timestamp, amount_inr double")
    out = {r["event_id"]: r for r in h.chain_feature_frame(df.withColumn("event_type", F.lit("PAYMENT_INITIATED"))).collect()}
    assert [out[i]["events_last_hour"] for i in (1, 2)] == [0, 0]
    assert [out[i]["value_sum_last_hour_inr"] for i in (1, 2)] == [10.0, 20.0]
