"""Readers with explicit typing, and content fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

# Columns of the public card data set.
CARD_FEATURES = tuple(f"V{i}" for i in range(1, 29))
CARD_NUMERIC = (*CARD_FEATURES, "Time", "Amount", "Class")

EVENT_SCHEMA = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("event_id", T.StringType()), ("event_ts", T.StringType()), ("transaction_id", T.StringType()),
        ("sender_account_id", T.StringType()), ("beneficiary_id", T.StringType()), ("payment_rail", T.StringType()),
        ("channel", T.StringType()), ("amount_inr", T.DoubleType()), ("currency", T.StringType()),
        ("merchant_category", T.StringType()), ("transaction_status", T.StringType()), ("device_id", T.StringType()),
        ("ip_prefix", T.StringType()), ("geo_region", T.StringType()), ("auth_method", T.StringType()),
        ("session_age_seconds", T.LongType()), ("account_age_days", T.LongType()), ("beneficiary_age_days", T.LongType()),
        ("label_fraud", T.BooleanType()), ("attack_family", T.StringType()), ("scenario_id", T.StringType()),
        ("legitimate_control", T.StringType()),
    )
])
PREDICTION_SCHEMA = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("event_id", T.StringType()), ("event_ts", T.StringType()), ("label_fraud", T.BooleanType()),
        ("attack_family", T.StringType()), ("scenario_id", T.StringType()), ("legitimate_control", T.StringType()),
        ("risk_score", T.DoubleType()), ("predicted_fraud", T.BooleanType()),
    )
])


def load_transactions(spark: SparkSession, path: str, numeric: Sequence[str] = CARD_NUMERIC) -> DataFrame:
    """Read Parquet or CSV by suffix; the numeric columns become doubles and bad values null."""
    clean = path.rstrip("/").lower()
    if clean.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    elif clean.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"Transactions must be Parquet or CSV: {path}")
    return df.withColumns({c: F.col(c).try_cast("double") for c in numeric if c in df.columns})


def load_table(spark: SparkSession, path: str, schema: T.StructType, what: str) -> DataFrame:
    """CSV files (one or a glob) with a header that names the schema's columns in order (else an error); event_ts is parsed as UTC."""
    try:
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise FileNotFoundError(f"Missing {what} data: {path}") from error
    return df.withColumn("event_ts", F.to_timestamp("event_ts"))


def load_events(
    spark: SparkSession, events: str, predictions: str,
    event_schema: T.StructType = EVENT_SCHEMA, prediction_schema: T.StructType = PREDICTION_SCHEMA,
) -> tuple[DataFrame, DataFrame]:
    """Event and prediction tables; the session time zone must be UTC."""
    return (
        load_table(spark, events, event_schema, "event"), load_table(spark, predictions, prediction_schema, "prediction"),
    )


def load_runs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Recorded run documents, one JSON object per file; unreadable files and empty runs are left out."""
    runs = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return runs.where(F.size("rounds") > 0).withColumn("run_id", F.element_at(F.split(F.input_file_name(), "/"), -1))


def _row_hash(df: DataFrame) -> Column:
    """Hash of all columns; each value is tagged with its null flag so that nulls change the hash."""
    parts = []
    for name in sorted(df.columns):
        parts += [F.col(name), F.col(name).isNull()]
    return F.xxhash64(*parts)


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Content digest that does not depend on row order or partitioning: count, xor and sum mod 2^64."""
    hashed = df.select(_row_hash(df).alias("h"))
    total = F.sum(F.col("h").cast("decimal(38,0)")) % F.lit("18446744073709551616").cast("decimal(38,0)")
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_digest"), total.cast("string").alias("sum_digest")
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each source file, for files small enough to be one binary value."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
