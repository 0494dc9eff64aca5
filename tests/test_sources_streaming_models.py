import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators import history as h
from riskweave.operators import models as md
from riskweave.sources import logs, readers, writers
from riskweave.streaming import stateful as st


def test_log_round_trip_and_missing_path(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "event_id INT, note STRING"
    assert logs.load_log(spark, path, schema).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, None)], schema)
    assert logs.append_log(rows, path) == 2 and logs.append_log(rows, path) == 2
    assert logs.load_log(spark, path, schema).count() == 4


def test_transactions_coerce_and_reject_suffix(spark, tmp_path):
    path = writers.write_dataset(spark.createDataFrame([("1.5", "x", "t")], "Amount string, Time string, note string"), str(tmp_path / "tx.csv"))
    row = readers.load_transactions(spark, path).first()
    assert (row["Amount"], row["Time"], row["note"]) == (1.5, None, "t")
    with pytest.raises(ValueError, match="Parquet or CSV"):
        readers.load_transactions(spark, "data.arff")


def test_missing_events_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="event data"):
        readers.load_events(spark, str(tmp_path / "none.csv"), str(tmp_path / "none2.csv"))


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("v"))
    same = readers.dataset_fingerprint(df).first()
    assert same == readers.dataset_fingerprint(df.orderBy(F.desc("id")).repartition(5)).first()
    assert same != readers.dataset_fingerprint(df.withColumn("v", F.coalesce("v", F.lit(0)))).first()


def chain_events(n=40):
    t0 = datetime(2026, 8, 1, 9)
    return [(i, f"c{i % 4}", i // 4 + 1, t0 + timedelta(minutes=7 * i), float(i), f"b{i % 3}", f"d{i % 5}") for i in range(n)]


SCHEMA = "event_id long, chain_id string, sequence int, event_ts timestamp, amount_inr double, beneficiary_id string, device_id string"


def test_stream_equals_batch_over_micro_batches_and_flags_late_rows(spark, tmp_path):
    rows = chain_events()
    source = str(tmp_path / "in")
    for lo in range(0, 40, 10):
        spark.createDataFrame(rows[lo:lo + 10], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    late = (99, "c0", 1, datetime(2026, 8, 1, 8), 1.0, "b9", "d9")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    features = st.stream_point_in_time_features(stream, "chain_id", "event_ts", "event_id", watermark="12 hours")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    st.run_available(features, out, state)
    spark.createDataFrame([late], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    got = {r["event_id"]: r for r in st.run_available(features, out, state).collect()}
    want = h.chain_feature_frame(spark.createDataFrame(rows, SCHEMA).withColumn("event_type", F.lit("x")), "event_ts").collect()
    for row in want:
        for name in ("prior_event_count", "seconds_since_prev_event", "events_last_hour", "value_sum_last_hour_inr", "distinct_beneficiaries_prior", "distinct_devices_prior"):
            assert got[row["event_id"]][name] == row[name], (row["event_id"], name)
        assert not got[row["event_id"]]["late"]
    assert got[99]["late"] and got[99]["prior_event_count"] is None


def test_rollups_give_open_windows_and_survive_an_empty_source(spark, tmp_path):
    t0 = datetime(2026, 8, 1, 9)
    rows = [(t0 + timedelta(hours=h), h % 3 == 0, 1.5) for h in range(0, 60, 5)]
    schema, source = "event_ts timestamp, label_fraud boolean, amount_inr double", str(tmp_path / "in")
    for k, part in enumerate(([], rows[:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        got = st.run_latest(st.stream_rollups(stream), ["window_start"], str(tmp_path / "out"), str(tmp_path / "state")).collect()
        seen = [] if k == 0 else rows[:5] if k == 1 else rows
        days = {d.replace(hour=0) for d, *_ in seen}
        assert {(r["window_start"], r["legitimate"], r["fraud"]) for r in got} == {
            (d, sum(x.date() == d.date() and not y for x, y, _ in seen), sum(x.date() == d.date() and y for x, y, _ in seen)) for d in days}


@pytest.mark.parametrize(("ttl", "back"), [(None, 3), ("7 days", 0)])
def test_a_chain_that_was_silent_for_a_month_goes_on(spark, tmp_path, ttl, back):
    """Chain c0 has half the rows and is silent from the second micro-batch to the fourth; a ttl forgets it."""
    t0 = datetime(2026, 8, 1, 9)
    parts = [
        [(i, "c0", i, t0 + timedelta(minutes=i), 0.1, "b1", "d1") for i in range(3)] + [(10, "c1", 1, t0, 1.0, "b1", "d1")],
        [(20, "c1", 2, t0 + timedelta(days=12), 1.0, "b2", "d1")],
        [(30, "c1", 3, t0 + timedelta(days=25), 1.0, "b2", "d2")],
        [(40, "c0", 3, t0 + timedelta(days=33), 0.2, "b2", "d1"), (41, "c1", 4, t0 + timedelta(days=33), 1.0, "b3", "d1")],
    ]
    source = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    features = st.stream_point_in_time_features(stream, "chain_id", "event_ts", "event_id", watermark="1 hour", ttl=ttl)
    got = {r["event_id"]: r for r in st.run_available(features, str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    assert len(got) == 8 and [got[i]["prior_event_count"] for i in (10, 20, 30, 41)] == [0, 1, 2, 3]
    assert (got[40]["prior_event_count"], got[40]["events_last_hour"], got[40]["value_sum_last_hour_inr"]) == (back, 0, 0.2)
    assert [got[i]["value_sum_last_hour_inr"] for i in range(3)] == [0.1, 0.2, 0.3]


def test_model_round_trip_and_feature_check(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 5).cast("double").alias("a"), F.lit(None).cast("double").alias("empty"),
                                 F.when(F.col("id") % 9 != 0, (F.col("id") % 3).cast("string")).alias("c"), (F.col("id") % 5 == 4).cast("int").alias("y"))
    model = md.fit_model("lr", df, "y", ["a", "empty"], ["c"], lambda n, c: md.logistic_stages(n, c, 20))
    model.save(str(tmp_path / "m"))
    again = md.ScoringModel.load(spark, str(tmp_path / "m"), ["a", "empty"], ["c"])
    first = model.score(df, ["id", "y"]).orderBy("id").collect()
    assert first == again.score(df, ["id", "y"]).orderBy("id").collect()
    assert min(r["risk_score"] for r in first if r["y"]) > max(r["risk_score"] for r in first if not r["y"])
    unseen = df.limit(1).withColumn("c", F.lit("new"))
    assert again.score(unseen, ["id"]).count() == 1
    with pytest.raises(ValueError, match="allowlist"):
        md.ScoringModel.load(spark, str(tmp_path / "m"), ["a"], ["c"])


def test_detector_allowlist_is_clean():
    assert not set(d.CHAIN_FEATURES) & d.CHAIN_FORBIDDEN
    assert not set(d.BENCHMARK_NUMERIC_FEATURES + d.BENCHMARK_CATEGORICAL_FEATURES) & d.BENCHMARK_FORBIDDEN


def test_recorded_runs_are_read_backfilled_and_catalogued(spark, tmp_path):
    import json

    from riskweave.operators import rollups as r

    def run(name, rounds):
        (tmp_path / name).write_text(json.dumps({"rounds": rounds}, indent=1))

    one = {"red": {"scenario": {"attack_family": "ATO", "difficulty": "easy"}}, "referee": {"total_value_at_risk_inr": 5.0, "value_prevented_inr": 2.0}}
    run("a.json", [one])
    run("b.json", [{"red": {"scenario": {"attack_family": "MULE", "difficulty": "hard"}}, "referee": {"loss_avoided_inr": 1.0}}, one])
    run("c.json", [])
    (tmp_path / "d.json").write_text("not json")
    schema = ("rounds ARRAY<STRUCT<red: STRUCT<scenario: STRUCT<attack_family: STRING, difficulty: STRING>>, referee: STRUCT<total_value_at_risk_inr: DOUBLE, "
              "value_prevented_inr: DOUBLE, no_defense_loss_inr: DOUBLE, loss_avoided_inr: DOUBLE>>>")
    runs = readers.load_runs(spark, str(tmp_path), schema)
    got = sorted(tuple(x) for x in r.run_catalog(r.rounds_of_runs(runs)).collect())
    assert got == [("ATO", "easy", i) for i in range(1, 6)] + [("MULE", "hard", 1), ("MULE", "hard", 2)]
    filled = {x["run_id"]: x["rounds"][0]["referee"] for x in r.backfill_run_fields(runs).collect()}
    assert (filled["a.json"]["no_defense_loss_inr"], filled["a.json"]["loss_avoided_inr"]) == (5.0, 2.0)
    assert (filled["b.json"]["no_defense_loss_inr"], filled["b.json"]["loss_avoided_inr"]) == (0.0, 1.0)


def test_histogram_keeps_empty_bins(spark):
    from riskweave.operators import rollups as r

    df = spark.createDataFrame([(0.1, True), (1.0, False)], "risk_score double, label_fraud boolean")
    assert {x["bucket"]: (x["legitimate"], x["fraud"]) for x in r.risk_histogram(df).collect()} == {
        "0-20": (0, 1), "20-40": (0, 0), "40-60": (0, 0), "60-80": (0, 0), "80-100": (1, 0)}
