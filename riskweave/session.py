"""Session settings, shared scratch storage and size estimates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HOT_GROUP_ROWS = "spark.riskweave.hotGroupRows"
SEGMENT_BYTES = "spark.riskweave.segmentBytes"

DEFAULTS = {
    # Largest group one task may hold; bigger groups are cut into ordered segments.
    HOT_GROUP_ROWS: "2000000",
    # Target input size of one ordered segment; file sizes are compressed, so rows take more in memory.
    SEGMENT_BYTES: str(64 * 1024 * 1024),
}


def int_conf(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, DEFAULTS[key]))


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every riskweave session wants; cluster sizing stays with the caller."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Wide expressions are built much faster without recording a call site per column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only on a local master, where driver and executors are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskweave-"))
    return sc.getCheckpointDir().rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables this process stored in the shared folder; results that read them must be done."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        done += bool(path.getFileSystem(hadoop).delete(path, True))
    return done


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where rows carry values that must not be computed twice (segment ids), so that the
    branches of a plan, and tasks rerun after a lost executor, all see the same rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; no job is run. Used for sizing only, never as a broadcast proof."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def row_bytes(df: DataFrame) -> int:
    """Bytes a row may take: 200 for a column without a fixed size, 16 for any other."""
    return sum(16 if isinstance(f.dataType, T.NumericType | T.BooleanType | T.DatetimeType) else 200 for f in df.schema.fields)


def segment_count(df: DataFrame, rows: int | None = None) -> int:
    """Number of ordered segments so that one segment stays within the configured sizes.

    Small inputs get as many segments as there are cores, within the shuffle partitions of the session. Catalyst's estimate of a
    join is the product of both sides, so one that asks for more is held against the rows there are; they are counted if not given.
    """
    spark = df.sparkSession
    wanted = [min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)]
    size, limit = estimated_bytes(df), int_conf(spark, SEGMENT_BYTES)
    if size // limit + 1 > wanted[0]:
        size = min(size, (df.count() if rows is None else rows) * row_bytes(df))
    wanted.append(size // limit + 1)
    if rows is not None:
        wanted.append(rows // int_conf(spark, HOT_GROUP_ROWS) + 1)
    return min(max(wanted), 100_000)
