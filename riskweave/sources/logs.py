"""Event / truth flattening and the append-only training log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from riskweave.session import pin


def flatten_events(
    events: DataFrame, truth: DataFrame, source: str | None = None, attribute_schema: str | None = None,
    group_key: Column | None = None,
) -> DataFrame:
    """One training row per event: attributes as columns, truth, label and source.

    ``events`` carries event_id and chain_id; attributes are columns already, or JSON text in
    ``attributes`` that is read with ``attribute_schema``.
    """
    flat = events
    if attribute_schema is not None:
        parsed = events.withColumn("_a", F.from_json("attributes", attribute_schema))
        flat = parsed.select(*[c for c in events.columns if c != "attributes"], "_a.*")
    joined = flat.join(truth, "event_id")
    default = (
        F.when(F.col("is_attack"), F.lit("attack")).when(F.col("chain_id").isNotNull(), F.lit("control"))
        .otherwise(F.lit("ambient"))
    )
    return joined.withColumns({
        "label": (F.col("is_attack") & F.col("fraud_contributing")).cast("int"),
        "source": F.lit(source) if source is not None else default,
        "group_key": group_key if group_key is not None else F.col("chain_id"),
    })


def log_round(
    attack_events: DataFrame, attack_truth: DataFrame, control_events: DataFrame, control_truth: DataFrame
) -> DataFrame:
    """Every stage of the attack and control cases, also those after an early stop."""
    return flatten_events(attack_events, attack_truth, "attack").unionByName(
        flatten_events(control_events, control_truth, "control"), allowMissingColumns=True
    )


def append_log(rows: DataFrame, path: str) -> int:
    """S3: append rows as JSON lines and return how many were written.

    The rows are stored once before, so the count and the log come from the same computation.
    """
    stored = pin(rows, "log_rows")
    stored.write.mode("append").json(path)
    return stored.count()


def load_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read a JSON-lines log with an explicit schema; a missing path gives an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        parsed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return spark.createDataFrame([], parsed)
