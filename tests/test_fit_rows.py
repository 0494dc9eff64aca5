"""A classifier reads stored rows, and trees are grown without the features that have a single value, which changes no score."""

from pyspark.sql import functions as F

from riskweave.operators import models as md


def rows(spark):
    return spark.range(0, 2000, 1, 4).select(
        "id", (F.col("id") % 50).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, 5.0).alias("some"), F.lit(2.0).alias("same"),
        F.lit(None).cast("double").alias("empty"), (F.col("id") % 4).cast("string").alias("c"), F.lit("x").alias("one"),
        (F.col("id") % 50 + F.col("id") % 4 > 40).cast("int").alias("y"))


def test_single_values_are_left_out_and_rows_are_stored(spark, monkeypatch):
    numeric, text = ["a", "some", "same", "empty"], ["c", "one"]
    build = lambda n, c: md.boosted_stages(n, c, 4, early_stopping=True, missing_flags=True)
    df, read, own = rows(spark), [], md.spread

    def spy(stored):
        read.extend(stored.inputFiles())
        return own(stored)

    def fit():
        model = md.fit_model("b", df, "y", numeric, text, build, row_id="id")
        return model, {r["id"]: r["risk_score"] for r in model.score(df, ["id"]).collect()}

    monkeypatch.setattr(md, "spread", spy)
    model, got = fit()
    assert read and all("fit-rows" in f for f in read)
    assert model.pipeline.stages[-1].numFeatures == 3  # a, whether some is missing, c
    monkeypatch.setattr(md, "_varying_only", lambda pipeline, single: None)
    whole, want = fit()
    assert whole.pipeline.stages[-1].numFeatures == 10
    assert got == want and len(got) == 2000 and len(set(got.values())) > 1


def test_features_without_any_difference(spark):
    df = rows(spark)
    build = lambda n, c: md.boosted_stages(n, c, 2, missing_flags=True)
    model = md.fit_model("b", df, "y", ["same", "empty"], ["one"], build)
    scores = {r["risk_score"] for r in model.score(df, ["id"]).collect()}
    assert len(scores) == 1 and model.pipeline.stages[-1].numFeatures == 1
