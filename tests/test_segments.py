"""Segments follow the rows of a table, not the product that Catalyst takes for the size of a join."""

from pyspark.sql import functions as F

from riskweave.session import SEGMENT_BYTES, estimated_bytes, segment_count


def test_a_joined_table_gets_segments_for_its_rows(spark, tmp_path):
    spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("k")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    totals = rows.groupBy(F.col("k").alias("h")).agg(F.count("id").alias("n"))
    joined = rows.join(totals, rows["k"].eqNullSafe(totals["h"]))
    spark.conf.set(SEGMENT_BYTES, "16384")
    try:
        assert estimated_bytes(joined) // 16384 > 1000
        assert segment_count(joined) <= 3000 * 4 * 16 // 16384 + 1 and segment_count(joined, 300) <= 4
    finally:
        spark.conf.unset(SEGMENT_BYTES)

