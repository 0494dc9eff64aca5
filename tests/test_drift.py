"""Isotonic calibration, Page-Hinkley and late labels against plain loops: ties, nulls, large groups cut into segments, empty tables."""

import math
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.operators import calibration as c
from riskweave.operators import drift as x
from riskweave.streaming import stateful as st

START = datetime(2025, 2, 3)


def pooled(points):
    """Plain pool-adjacent-violators over (score, rows, positives) in score order: (upto, rows, positives) of the blocks."""
    blocks = []
    for score, n, pos in points:
        blocks.append([score, n, pos])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            upto, n, pos = blocks.pop()
            blocks[-1] = [upto, blocks[-1][1] + n, blocks[-1][2] + pos]
    return [tuple(b) for b in blocks]


def scored(rng, n, step):
    rows = []
    for i in range(n):
        s = rng.randrange(0, 100, step) / 100
        rows.append((i, s if rng.random() > 0.05 else None, rng.random() < s * s if rng.random() > 0.05 else None))
    return [*rows, (n, math.nan, True), (n + 1, None, None)]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("step", [1, 7])
def test_blocks_and_calibration_equal_pooling(spark, request, hot, step):
    if hot:
        request.getfixturevalue("small_groups")
    rows = scored(random.Random(step), 400, step)
    cells = {}
    for _, s, y in rows:
        if s is not None and y is not None and not math.isnan(s):
            n, pos = cells.get(s, (0, 0))
            cells[s] = (n + 1, pos + y)
    want = pooled([(s, *cells[s]) for s in sorted(cells)])
    df = spark.createDataFrame(rows, "id long, score double, label boolean")
    blocks = c.isotonic_blocks(df, "score", "label")
    got = sorted((r["upto"], r["n"], r["pos"], r["above"], r["value"]) for r in blocks.collect())
    assert [g[:3] for g in got] == want and len(want) > 3
    assert [g[3] for g in got] == [None, *[g[0] for g in got[:-1]]]
    values = [g[4] for g in got]
    assert values == sorted(values) and values == [pytest.approx(p / n) for _, n, p in want]
    new = [*rows, (900, -5.0, None), (901, 5.0, None), (902, 0.005, None)]
    for r in c.isotonic_calibrate(spark.createDataFrame(new, "id long, score double, label boolean"), blocks, "score").collect():
        s = r["score"]
        if s is None or math.isnan(s):
            assert r["calibrated"] is None
        else:
            assert r["calibrated"] == pytest.approx(next((p / n for upto, n, p in want if s <= upto), values[-1]))


def test_many_rounds_of_hulls_give_the_same_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i / 1000, rng.random() < i / 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "score double, label boolean")
    want = sorted((r["upto"], r["n"], r["pos"]) for r in c.isotonic_blocks(df, "score", "label").collect())
    spark.conf.set("spark.riskweave.hotGroupRows", "9")
    monkeypatch.setattr(c, "segment_count", lambda df, rows=None: 40)
    try:
        got = sorted((r["upto"], r["n"], r["pos"]) for r in c.isotonic_blocks(df, "score", "label").collect())
    finally:
        spark.conf.unset("spark.riskweave.hotGroupRows")
    assert got == want == sorted(pooled([(s, 1, int(y)) for s, y in rows]))


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(0.1, False), (0.7, False)], "score double, label boolean")
    only = [(r["upto"], r["n"], r["value"]) for r in c.isotonic_blocks(df, "score", "label").collect()]
    assert only == [(0.7, 2, 0.0)]
    nothing = c.isotonic_blocks(df.limit(0), "score", "label")
    assert nothing.count() == 0
    assert [r["calibrated"] for r in c.isotonic_calibrate(df, nothing, "score").collect()] == [None, None]


def plain_drift(values, delta):
    total, low, n, s, out = 0.0, 0.0, 0, 0.0, []
    for v in values:
        if v is not None:
            n, s = n + 1, s + v
            total += v - s / n - delta
        low = min(low, total)
        out.append(total - low)
    return out


@pytest.mark.parametrize("limit", [7, 1000])
def test_page_hinkley_hot_and_cold(spark, limit):
    rng = random.Random(3)
    rows = [(i, f"k{i % 4}" if i % 2 else "hot", (round(rng.gauss(5 + (i > 100), 2), 2) if rng.random() > 0.05 else None)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    spark.conf.set("spark.riskweave.hotGroupRows", str(limit))
    try:
        tested = x.page_hinkley(df, ["k"], ["id"], "v", 0.05, 8.0)
        got = {r["id"]: r for r in tested.collect()}
        firsts = {r["k"]: r for r in x.first_drift(tested, ["k"], ["id"]).collect()}
        whole = {r["id"]: r["drift_statistic"] for r in x.page_hinkley(df, [], ["id"], "v", 0.05, 8.0).collect()}
    finally:
        spark.conf.unset("spark.riskweave.hotGroupRows")
    for key in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == key]
        want = plain_drift([r[2] for r in own], 0.05)
        alarms = [r[0] for r, w in zip(own, want, strict=True) if w > 8.0]
        for r, w in zip(own, want, strict=True):
            assert got[r[0]]["drift_statistic"] == pytest.approx(w, abs=1e-3) and got[r[0]]["drift"] == (w > 8.0)
        assert firsts[key]["first_id"] == (alarms[0] if alarms else None) and firsts[key]["rows"] == len(own)
    assert any(r["drift"] for r in got.values())
    assert whole == {r[0]: pytest.approx(w, abs=1e-3) for r, w in zip(rows, plain_drift([r[2] for r in rows], 0.05), strict=True)}
    assert x.page_hinkley(df.limit(0), ["k"], ["id"], "v", 0.05, 8.0).count() == 0


def labelled(rng, n):
    return [(
        i, START + timedelta(minutes=30 * rng.randrange(n)) if rng.random() > 0.05 else None, rng.random() < 0.3 if rng.random() > 0.1 else None,
        rng.random() if rng.random() > 0.05 else None, "hot" if i % 2 else f"k{i % 5}") for i in range(n)]


@pytest.mark.parametrize("limit", [7, 1000])
def test_labels_are_known_after_the_embargo(spark, limit):
    rows = labelled(random.Random(limit), 120)
    rows += [(500, START, True, 0.5, "edge"), (501, START + timedelta(hours=6), True, 0.5, "edge"), (502, START + timedelta(hours=6, microseconds=-1), True, 0.5, "edge")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, label boolean, score double, k string")
    spark.conf.set("spark.riskweave.hotGroupRows", str(limit))
    try:
        got = {r["id"]: (r["labels_known"], r["positives_known"]) for r in x.labels_known(df, "ts", "label", "id", 6 * 3600, ["k"]).collect()}
        everywhere = {r["id"]: r["labels_known"] for r in x.labels_known(df, "ts", "label", "id", 6 * 3600).collect()}
    finally:
        spark.conf.unset("spark.riskweave.hotGroupRows")
    for i, ts, *_, k in rows:
        seen = [r for r in rows if ts and r[1] and r[2] is not None and r[1] + timedelta(hours=6) <= ts]
        assert got[i] == (sum(r[4] == k for r in seen), sum(r[4] == k and r[2] for r in seen)) and everywhere[i] == len(seen)
    assert [got[i] for i in (500, 501, 502)] == [(0, 0), (1, 1), (0, 0)]


def test_generations_learn_from_known_labels_only(spark):
    rows = [r for r in labelled(random.Random(4), 200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, label boolean, score double, k string")
    got = {r["generation"]: r for r in x.prequential_report(df, "ts", "label", "score", 86_400, 43_200, 0.5).collect()}
    zero = datetime(1970, 1, 1)
    usable = [r for r in rows if r[1] and r[2] is not None]
    assert set(got) == {(r[1] - zero).days for r in usable}
    for day, r in got.items():
        start = zero + timedelta(days=day)
        train = [u for u in usable if u[1] + timedelta(hours=12) <= start]
        held = [u for u in usable if start <= u[1] < start + timedelta(days=1)]
        hits = [u for u in held if (u[3] or 0) >= 0.5]
        caught = sum(u[2] for u in hits)
        assert (r["train_rows"], r["train_positives"], r["rows"], r["positives"]) == (len(train), sum(u[2] for u in train), len(held), sum(u[2] for u in held))
        assert (r["true_positives"], r["false_positives"]) == (caught, len(hits) - caught)
        assert r["brier"] == pytest.approx(sum(((u[3] or 0) - u[2]) ** 2 for u in held) / len(held), abs=1e-6)
        rate = sum(u[2] for u in train) / len(train) if train else None
        assert r["brier_of_known_rate"] == (None if rate is None else pytest.approx(sum((rate - u[2]) ** 2 for u in held) / len(held)))
    assert x.prequential_report(df.limit(0), "ts", "label", "score", 86_400, 43_200, 0.5).count() == 0


def plain_windows(values, delta):
    """Every cut of the raw window is looked at; the oldest value goes while one of them tells the parts apart."""
    window, out = [], []
    for v in values:
        dropped = False
        if v is not None:
            window.append(v)
            while any(
                abs(sum(window[:k]) / k - sum(window[k:]) / (len(window) - k)) >= math.sqrt(math.log(4 * len(window) / delta) / 2 * (1 / k + 1 / (len(window) - k)))
                for k in range(1, len(window))
            ):
                window, dropped = window[1:], True
        out.append((len(window), sum(window) / len(window) if window else None, dropped))
    return out


def shifting(seed, n=160):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else min(1.0, max(0.0, rng.gauss(0.2 if i < n // 2 else 0.8, 0.1))) for i in range(n)]


def test_adaptive_windows_equal_the_plain_rule(spark):
    rows = [(k, i, v) for k in ("a", "b") for i, v in enumerate(shifting(k))]
    random.Random(1).shuffle(rows)
    series = spark.createDataFrame(rows, "k string, period long, rate double")
    got = {(r["k"], r["period"]): r for r in x.adwin(series, ["k"], "period", "rate", 0.05, most=1000).collect()}
    for k in ("a", "b"):
        want = plain_windows(shifting(k), 0.05)
        for i, (size, mean, dropped) in enumerate(want):
            r = got[k, i]
            assert (r["window_size"], r["drift"]) == (size, dropped) and r["window_mean"] == (None if mean is None else pytest.approx(mean))
        assert any(d for *_, d in want) and want[-1][0] < 120
    assert x.adwin(series.limit(0), ["k"], "period", "rate").count() == 0


def test_buckets_stay_few_and_see_the_same_shift():
    window, drops = [], []
    for i in range(3000):
        window, dropped = x.adwin_step(window, 0.2 + 0.6 * (i >= 2000) + 0.001 * (i % 7), 0.002, 5)
        drops += [i] if dropped else []
        counts = [n for _, n in window]
        assert len(window) <= 5 * (math.log2(i + 1) + 1) and counts == sorted(counts, reverse=True)
    assert drops and 2000 <= drops[0] <= 2030 and sum(n for _, n in window) <= 1100


def test_rates_of_periods(spark):
    rows = [("a", START + timedelta(minutes=10 * i), None if i == 3 else i % 2 == 0) for i in range(9)] + [("a", None, True)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, flag boolean")
    got = {r["period"] - int(START.timestamp() // 3600): (r["rows"], r["rate"]) for r in x.rate_series(df, ["k"], "ts", 3600, F.col("flag")).collect()}
    assert sorted(got.values()) == sorted([(5, 0.6), (3, pytest.approx(2 / 3))])


def test_windows_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    values = [v if v is not None else 0.5 for v in shifting("s", 60)]
    rows = [("a", i, v) for i, v in enumerate(values)]
    parts = [rows[:13], rows[13:30] + [("a", 4, 0.9)], rows[30:31], rows[31:]]  # one period comes late
    source = str(tmp_path / "series")
    for part in parts:
        spark.createDataFrame(part, "k string, period long, rate double").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema("k string, period long, rate double").option("maxFilesPerTrigger", 1).parquet(source)
    out = st.run_available(st.stream_adwin(stream, ["k"], "period", "rate", 0.05), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    batch = {r["period"]: r for r in x.adwin(spark.createDataFrame(rows, "k string, period long, rate double"), ["k"], "period", "rate", 0.05).collect()}
    late = [r for r in out if r["late"]]
    assert [(r["period"], r["rate"], r["drift"]) for r in late] == [(4, 0.9, None)] and len(out) == 61
    for r in out:
        if not r["late"]:
            b = batch[r["period"]]
            assert (r["window_size"], r["drift"]) == (b["window_size"], b["drift"]) and r["window_mean"] == pytest.approx(b["window_mean"])
    assert any(b["drift"] for b in batch.values())
