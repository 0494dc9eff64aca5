import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import fidelity as fd
from riskweave.operators import metrics as m
from riskweave.operators import models as md
from riskweave.operators import quality as q
from riskweave.operators import splits as s


def scores(spark, pairs):
    return spark.createDataFrame([(i, float(p), bool(y)) for i, (p, y) in enumerate(pairs)], "id long, score double, y boolean")


def test_budget_threshold(spark):
    df = scores(spark, [(0.1, 0), (0.9, 0), (0.5, 0), (0.7, 0), (0.3, 0)])
    assert m.threshold_for_budget(df, "score", 2).first()[0] == 0.7
    assert m.threshold_for_budget(df, "score", 10).first()[0] == 0.0
    assert m.threshold_for_budget(df, "score", 0).first()[0] == float("inf")


def test_average_precision_and_auc_by_hand(spark):
    df = scores(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.2, 1)])
    got = m.curve_areas(df, "score", "y").first()
    assert got["pr_auc"] == pytest.approx((1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5), abs=1e-6)
    assert got["roc_auc"] == pytest.approx((2 + 1.5 + 0) / 6, abs=1e-6)
    assert m.average_precision(scores(spark, [(0.5, 1)]), "score", "y").first()[0] is None


def test_wilson_recomputes_reported_intervals(spark):
    row = spark.createDataFrame([(48, 55, 48, 74, 7, 56672)], "tp int, flagged int, tp2 int, pos int, fp int, neg int")
    bounds = [b for k, n in (("tp2", "pos"), ("fp", "neg")) for b in m.wilson_interval(F.col(k), F.col(n))]
    low_r, high_r, low_f, high_f = row.select(*bounds).first()
    assert low_r < 0.648649 < high_r
    assert (low_f, high_f) == (6e-05, 0.000255)
    assert spark.range(1).select(*m.wilson_interval(F.lit(0), F.lit(0))).first()[0] is None


def test_calibration_bins_are_dealt_like_array_split(spark):
    df = scores(spark, [(i / 13, i % 2) for i in range(13)])
    sizes = [r["rows"] for r in m.calibration_bins(df, "score", "y", "id", bins=5).orderBy("bin").collect()]
    assert sizes == [len(x) for x in np.array_split(np.arange(13), 5)]


def test_gate_truth_table(spark):
    old = spark.createDataFrame([(0.9, 0.05)], "chain_recall double, hard_false_positive_rate double")
    table = [(0.92, 0.04, True), (0.895, 0.051, False), (0.80, 0.04, False), (0.95, 0.10, False), (0.95, 0.055, False), (0.95, 0.051, True)]
    for recall, fp, want in table:
        new = spark.createDataFrame([(recall, fp)], old.schema)
        assert md.promotion_gate(new, old).first()["promoted"] is want
    assert md.promotion_gate(spark.createDataFrame([(0.1, 0.9)], old.schema), None).first()["promoted"]


def test_fold_aggregate_means(spark):
    folds = spark.createDataFrame([(0.6, 0.03, 1.0), (0.9, 0.0, None), (0.3, 0.06, 3.0)], "chain_recall double, hard_false_positive_rate double, mean_caught_at_stage double")
    got = {r["metric"]: (r["mean"], r["std"]) for r in m.fold_aggregate(folds, folds.columns).collect()}
    assert got["chain_recall"] == (0.6, 0.2449)
    assert got["hard_false_positive_rate"][0] == 0.03 and got["mean_caught_at_stage"] == (2.0, 1.0)


def test_bootstrap_interval_brackets_the_estimate_and_repeats(spark):
    rng = np.random.default_rng(1)
    pairs = [(min(1.0, 0.6 * rng.random() + 0.4 * y), y) for y in (rng.random(400) < 0.3).astype(int)]
    df = scores(spark, pairs)
    estimate = m.average_precision(df, "score", "y").first()[0]
    first = m.bootstrap_pr_auc(df, "score", "y", "id", 60, seed=1).first()
    assert first["pr_auc_low"] < estimate < first["pr_auc_high"] and first["replicates"] == 60
    assert first == m.bootstrap_pr_auc(df.repartition(7), "score", "y", "id", 60, seed=1).first()


@pytest.mark.parametrize("drawn", [3, 4096])
def test_bootstrap_equals_a_plain_loop_over_the_same_draws(spark, monkeypatch, drawn):
    monkeypatch.setattr(m, "_DRAWN", drawn)
    rng = np.random.default_rng(2)
    pairs = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(300)]
    cells = {}
    for s, y in pairs:
        pos, neg = cells.get(s, (0, 0))
        cells[s] = (pos + y, neg + 1 - y)
    order = sorted(cells, reverse=True)
    draws = m.cell_draws(np.array(order), np.array([cells[s] for s in order], float), 40, 7)
    areas = []
    for b in range(40):
        tp = fp = area = 0.0
        for pos, neg in draws[:, :, b]:
            tp, fp = tp + pos, fp + neg
            area += pos * tp / max(tp + fp, 1)
        areas.append(round(area / tp, 6))
    got = m.bootstrap_pr_auc(scores(spark, pairs), "score", "y", "id", 40, seed=7).first()
    assert got["replicates"] == 40
    assert (got["pr_auc_low"], got["pr_auc_high"]) == (pytest.approx(np.percentile(areas, 2.5), abs=2e-6), pytest.approx(np.percentile(areas, 97.5), abs=2e-6))
    assert m.bootstrap_pr_auc(scores(spark, [(0.5, 1), (0.4, 1)]), "score", "y", "id", 5).first()["replicates"] == 0
    assert m.bootstrap_pr_auc(scores(spark, pairs).limit(0), "score", "y", "id", 5).first()["replicates"] == 0


def test_folds_keep_groups_whole_and_balance_strata(spark):
    df = spark.range(600).select((F.col("id") % 120).alias("g"), F.when(F.col("id") % 120 < 30, "A").alias("fam"))
    folds = s.group_folds(df, "g", "fam", 3)
    assert folds.count() == folds.select("g").distinct().count() == 120
    assert {r["n"] for r in folds.groupBy("stratum", "fold").agg(F.count("*").alias("n")).collect()} == {10, 30}


def test_prevalence_sampling_and_split_guard(spark):
    df = spark.range(1000).select("id", (F.col("id") % 100 == 0).alias("y"))
    kept = s.sample_to_prevalence(df, "y", "id", 0.1)
    assert (kept.count(), kept.where("y").count()) == (100, 10)
    with pytest.raises(ValueError, match="both classes"):
        s.chronological_split(df.withColumn("y", F.col("id") < 5), "id", "id", label="y")


def test_gate_stops_on_critical_failure(spark):
    df = spark.createDataFrame([(1, -5.0), (1, 3.0)], "id int, amount double")
    checks = q.checks_table(df, [
        q.Check("ids", "critical", "0", "duplicates", frame=q.duplicate_keys(df, ["id"])), q.Check("amount", "high", "0", q.out_of_range("amount")),
        q.Check("rows", "low", "2", F.count(F.lit(1)), 2),
    ])
    assert q.quality_score(checks).first()["score"] == pytest.approx(11.11)
    with pytest.raises(ValueError, match="ids"):
        q.enforce_gate(checks)


def test_missing_schema_ends_the_card_gate_early(spark):
    checks = q.card_checks(spark.range(3), ["v1"], "time", "amount", "class", "id", 3, 0)
    assert [r["name"] for r in checks.collect()] == ["required_schema"]
    assert q.quality_score(checks).first()["score"] == 0.0


def test_forbidden_keys_in_schema(spark):
    df = spark.range(1).select(F.struct(F.array(F.struct(F.lit(1).alias("stage_id"), F.lit(2).alias("user_cvv"))).alias("list"), F.lit(1).alias("fine")).alias("payload"))
    assert q.forbidden_schema_keys(df) == ["stage_id", "user_cvv"]


def test_psi_zero_for_same_and_constant_features(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    got = {r["feature"]: r["psi"] for r in fd.psi_by_feature(df, df, ["a", "b"]).collect()}
    assert got == {"a": 0.0, "b": 0.0}


def test_forbidden_keys_fail_closed(spark):
    texts = ['{"password-hash": 1}', '{"user.password x": 1}', '{"a": [{"is_attack": true}, 3]}', '{"is_attack": true', '{"note": "\\"password\\": no"}', '{"a": 1}', None, '{"pass\\u0077ord": 1}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    found = q.forbidden_json_keys(rows, "payload", "id", keys=["is_attack"], fragments=["password"]).collect()
    assert sorted((r["id"], r["key"]) for r in found) == [
        (0, "password-hash"), (1, "user.password x"), (2, "is_attack"), (3, "<unparsable>"), (3, "is_attack"), (7, "password")]
