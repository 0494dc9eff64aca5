"""Keys dealt to buckets give the rows of one group per key, late rows, timeless rows and forgotten keys included."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.streaming import stateful as st

T0 = datetime(2026, 8, 1, 9)
SCHEMA = "event_id long, chain_id string, event_ts timestamp, local_ts timestamp_ntz, amount_inr double, beneficiary_id string, device_id string, note string"


def event(i, chain, after, amount=1.0):
    when = T0 + timedelta(microseconds=1, **after) if after is not None else None
    return (i, chain, when, when, amount, f"b{i % 3}", f"d{i % 2}", f'line\n"{i}"' if i % 2 else None)


PARTS = [
    [event(i, f"c{i % 5}", {"minutes": i}, i / 10) for i in range(20)] + [event(90, None, {"minutes": 1})],
    [event(20, "c1", {"days": 12}), event(21, None, {"days": 12})],
    [event(30, "c1", {"days": 25}), event(31, "c1", {"days": 24, "hours": 23}), event(32, "c2", None)],
    [event(40, "c0", {"days": 33}), event(41, "c1", {"days": 33}), event(42, "c2", {"days": 33})],
    [event(50, "c1", {"days": 32, "hours": 23, "minutes": 30})],
]


def walked(spark, source, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    features = st.stream_point_in_time_features(stream, "chain_id", "event_ts", "event_id", watermark="1 hour", **options)
    return {r["event_id"]: r for r in st.run_available(features, f"{folder}/out", f"{folder}/state").collect()}


@pytest.mark.parametrize("ttl", [None, "7 days"])
def test_buckets_equal_groups_of_one_key(spark, tmp_path, ttl):
    source = str(tmp_path / "in")
    for part in PARTS:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in the order of their times
    got = walked(spark, source, tmp_path / "buckets", ttl=ttl, buckets=2)
    want = walked(spark, source, tmp_path / "keys", ttl=ttl)
    assert {i: str(r) for i, r in got.items()} == {i: str(r) for i, r in want.items()}
    assert (got[20]["prior_event_count"], got[41]["prior_event_count"], got[40]["prior_event_count"]) == (4, 7, 4 if ttl is None else 0)
    assert got[50]["late"] and got[50]["prior_event_count"] is None and got[32]["late"] and not got[21]["late"]
    sent = {e[0]: e for part in PARTS for e in part}
    assert all((r["chain_id"], r["event_ts"], r["local_ts"], r["note"]) == (sent[i][1], sent[i][2], sent[i][3], sent[i][7]) for i, r in got.items())


def test_one_call_folds_all_keys_of_a_bucket(spark, tmp_path):
    """A call per key made ST1 and ST2 too slow: there are as many groups as buckets, however many keys."""
    source = str(tmp_path / "in")
    spark.range(500).select(
        F.col("id").alias("event_id"), F.col("id").cast("string").alias("chain_id"), F.lit(T0).alias("event_ts"), F.lit(T0).cast("timestamp_ntz").alias("local_ts"),
        F.lit(1.0).alias("amount_inr"), F.lit("b").alias("beneficiary_id"), F.lit("d").alias("device_id"), F.lit("n").alias("note")).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = (st.stream_point_in_time_features(stream, "chain_id", "event_ts", "event_id", buckets=4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 4
    assert spark.read.parquet(str(tmp_path / "out")).where("prior_event_count = 0 AND NOT late").count() == 500
