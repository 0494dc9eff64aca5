"""Dataset and report writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# CSV time formats that keep microseconds.
CSV_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_dataset(df: DataFrame, path: str) -> str:
    """CSV when the path asks for it, else Parquet; returns the path."""
    if path.rstrip("/").lower().endswith(".csv"):
        df.write.mode("overwrite").options(header=True, **CSV_TIMES).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def write_report(out: str, report: DataFrame, quality: DataFrame, predictions: DataFrame, extra: Mapping[str, DataFrame] | None = None) -> dict[str, str]:
    """Report and quality rows as JSON, predictions as CSV; returns the written paths.

    Spark's output committer publishes each folder only when its job has finished.
    """
    paths = {"report": f"{out}/latest", "quality": f"{out}/data_quality", "predictions": f"{out}/predictions"}
    report.write.mode("overwrite").json(paths["report"])
    quality.write.mode("overwrite").json(paths["quality"])
    predictions.write.mode("overwrite").options(header=True, **CSV_TIMES).csv(paths["predictions"])
    for name, frame in (extra or {}).items():
        paths[name] = f"{out}/{name}"
        frame.write.mode("overwrite").json(paths[name])
    return paths


def publish_pointer(spark, root: str, version: str) -> None:
    """Point readers of ``root`` to a version that is completely written."""
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/pointer")


def current_version(spark, root: str) -> str | None:
    """The version published last, or None."""
    from pyspark.sql.utils import AnalysisException

    try:
        pointers = spark.read.schema("version STRING").json(f"{root}/pointer")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return pointers.agg(F.max("version").alias("v")).first()["v"]
