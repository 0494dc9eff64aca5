"""A classifier trains on partitions of a bounded number of rows, and gives the model it gives on fewer, larger ones."""

from pyspark.sql import functions as F

from riskweave.operators import models as md


def test_classifier_trains_on_bounded_partitions(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 2).select("id", (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 50 > 40).cast("int").alias("y"))
    build = lambda n, c: md.boosted_stages(n, c, 3, early_stopping=True)
    fit = lambda: {r["id"]: r["risk_score"] for r in md.fit_model("b", df, "y", ["a"], ["c"], build, row_id="id").score(df, ["id"]).collect()}
    sizes, own = [], md.spread

    def spy(rows):
        out = own(rows)
        sizes.append(max(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()))
        return out

    monkeypatch.setattr(md, "spread", spy)
    want = fit()
    monkeypatch.setattr(md, "FIT_ROWS", 200)
    got = fit()
    assert sizes[0] == 1500 and sizes[1] <= 220
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9 and len(got) == 3000
