"""Running aggregates, ranks and quantiles against brute force, with one key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import ordered as o
from riskweave.operators.history import distinct_prior, trailing_hour


def skewed(n=400, seed=3):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 30, n))
    value = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 50, n).astype(float))
    return pd.DataFrame({"id": np.arange(n), "key": key, "ts": rng.integers(0, 60, n), "value": value, "label": rng.random(n) < 0.3})


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def brute(pdf, keys):
    rows = []
    groups = pdf.groupby(keys) if keys else [((), pdf)]
    for _, g in groups:
        total, low, last, prev = None, None, None, None
        for i, row in enumerate(g.sort_values(["ts", "id"]).itertuples()):
            v = None if np.isnan(row.value) else row.value
            out = {"id": row.id, "n": i, "prior_sum": total, "lag": prev, "last": last}
            if v is not None:
                total = v if total is None else total + v
                low = v if low is None else min(low, v)
                last = v
            rows.append({**out, "low": low})
            prev = v
    return pd.DataFrame(rows).set_index("id").sort_index()


AGGS = {
    "n": ("count", False), "prior_sum": ("sum", False), "low": ("min", True), "lag": ("lag", False), "last": ("last", False),
}


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_running_matches_brute_force(spark, small_groups, keys, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pdf = skewed()
        aggs = {n: o.Running(how, F.col("value"), cur) for n, (how, cur) in AGGS.items()}
        got = o.running(frame(spark, pdf), keys, ["ts", "id"], aggs).toPandas().set_index("id").sort_index()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute(pdf, keys)
    assert len(got) == len(pdf)
    for name in AGGS:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), err_msg=name)


def test_hot_keys_are_split_and_rows_kept(spark, small_groups):
    df = frame(spark, skewed())
    hot = o.find_hot(df, ["key"])
    cold, heavy = o.split_hot(df, hot)
    assert heavy.select("key").distinct().collect()[0]["key"] == 0
    assert cold.count() + heavy.count() == df.count()


def test_hot_null_key_stays_in(spark, small_groups):
    df = spark.range(100).select("id", F.when(F.col("id") >= 70, F.col("id")).alias("key"))
    ranked = o.group_rank(df, ["key"], ["id"])
    assert ranked.count() == 100
    assert ranked.where("key IS NULL").agg(F.max("rank")).first()[0] == 70


def test_global_rank_with_heavy_ties(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("score"))
    got = o.global_rank(df, [F.col("score").desc(), F.col("id").asc()]).orderBy("rank").toPandas()
    want = got.sort_values(["score", "id"], ascending=[False, True])
    assert got["rank"].tolist() == list(range(1, 1001))
    assert got["id"].tolist() == want["id"].tolist()


def test_exact_quantiles(spark, small_groups):
    pdf = skewed().dropna()
    got = o.exact_quantiles(frame(spark, pdf), "value", {"q1": 0.1, "q5": 0.5, "q99": 0.99}, ["key"]).toPandas().set_index("key")
    for key, g in pdf.groupby("key"):
        np.testing.assert_allclose(got.loc[key, ["q1", "q5", "q99"]].astype(float), np.quantile(g["value"], [0.1, 0.5, 0.99]))
    disc = o.exact_quantiles(frame(spark, pdf), "value", {"p95": 0.95}, discrete=True).first()["p95"]
    ordered = sorted(pdf["value"])
    assert disc == ordered[int(np.ceil(0.95 * len(ordered))) - 1]


def test_first_occurrence_hot_and_cold_agree(spark, small_groups):
    pdf = skewed()
    got = o.first_occurrence(frame(spark, pdf), ["key"], ["ts", "id"], ["id"], "first").toPandas()
    want = set(pdf.sort_values(["ts", "id"]).groupby("key").head(1)["id"])
    assert set(got[got["first"]]["id"]) == want and len(got) == len(pdf)


def test_score_curve_counts_ties_once(spark):
    df = spark.createDataFrame([(0.9, True), (0.9, False), (0.5, True), (0.1, False)], "score double, y boolean")
    rows = [tuple(r) for r in o.score_curve(df, "score", "y").orderBy(F.desc("score")).select("score", "tp", "fp").collect()]
    assert rows == [(0.9, 1, 1), (0.5, 2, 1), (0.1, 2, 2)]


def test_trailing_hour_hot_matches_brute_force(spark, small_groups):
    rng = np.random.default_rng(5)
    n = 200
    pdf = pd.DataFrame({
        "id": np.arange(n), "key": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 20, n)),
        "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 30, n) * 600, unit="s"), "amount": rng.integers(1, 90, n).astype(float),
    })
    got = trailing_hour(spark.createDataFrame(pdf), "key", "ts", "id", "id", "amount").toPandas().set_index("id")
    for row in pdf.itertuples():
        prior = pdf[(pdf.key == row.key) & ((pdf.ts < row.ts) | ((pdf.ts == row.ts) & (pdf.id < row.id)))]
        inside = prior[(row.ts - prior.ts) <= pd.Timedelta("1h")]
        assert got.loc[row.id, "events_last_hour"] == len(inside)
        assert got.loc[row.id, "value_sum_last_hour_inr"] == pytest.approx(inside.amount.sum() + row.amount)


def test_distinct_prior_hot(spark, small_groups):
    pdf = skewed()
    pdf["seq"] = pdf["id"]
    got = distinct_prior(frame(spark, pdf), "key", {"seen": "value"}, ["seq"], "id").toPandas().set_index("id")
    for _, g in pdf.groupby("key"):
        seen = set()
        for row in g.sort_values("seq").itertuples():
            assert got.loc[row.id, "seen"] == len(seen)
            if not np.isnan(row.value):
                seen.add(row.value)
