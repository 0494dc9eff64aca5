"""Small folds are fitted side by side, large ones one after the other; the rows of a fit are dealt in whole rounds of the cores."""

import threading

from pyspark.sql import functions as F

from riskweave.operators import models as md
from riskweave.operators.splits import fold_count


class Plain:
    def score(self, df, keep):
        return df.select(*keep, (F.col("event_id") % 97 / 97).alias("risk_score"))


def rows(spark):
    attack = F.col("event_id") % 7 == 0
    return spark.range(600).select(
        F.col("id").alias("event_id"), F.concat(F.lit("c"), (F.col("id") % 60).cast("string")).alias("chain_id")).select(
        "*", (F.col("event_id") / 60).cast("int").alias("sequence"), F.when(attack, "A").alias("attack_family"), attack.alias("is_attack"),
        attack.alias("fraud_contributing"), F.when(attack, 10.0).otherwise(0.0).alias("value_at_risk_inr"), attack.cast("int").alias("label"),
        F.when(attack, "attack").otherwise("control").alias("source"), F.col("chain_id").alias("group_key"))


def test_small_folds_are_fitted_side_by_side(spark, monkeypatch):
    k = fold_count(0.3)
    meeting, inside, most = threading.Barrier(k), [], []

    def together(train):
        meeting.wait(120)  # broken unless all folds are being fitted
        return Plain()

    def alone(train):
        inside.append(1)
        most.append(len(inside))
        assert train.count() > 0
        inside.pop()
        return Plain()

    df = rows(spark).cache()
    order = lambda report: sorted(map(str, report.collect()))
    want = order(md.cross_validate(df, together))
    monkeypatch.setattr(md, "FIT_ROWS", 0)
    assert order(md.cross_validate(df, alone)) == want and len(want) == k and max(most) == 1


def test_rows_are_dealt_in_whole_rounds(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(1000)
    monkeypatch.setattr(md, "FIT_ROWS", 1000 // (cores + 1))
    assert md.spread(df).rdd.getNumPartitions() == 2 * cores
    monkeypatch.setattr(md, "FIT_ROWS", 1000)
    assert md.spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()
