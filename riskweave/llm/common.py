"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the fixed-size id filter of ``prune_to_ids``: its two columns never exceed 65,536 rows.
FILTER_BITS = 22
SLICE_ROWS = 1 << 17
BATCH_BYTES, _BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark) -> None:
    """Rows of whole texts go to Python in Arrow batches of about ``BATCH_BYTES``, whatever their number; a lower setting is kept.

    Both ends hold a batch in memory, and a stage of the corpus that follows another finds the workers of the one before still
    there. The setting belongs to the session, as plans are run after the call that made them has returned.
    """
    now = spark.conf.get(_BATCH_SETTING, None)
    if now is None or (now.isdigit() and int(now) > BATCH_BYTES):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def documents(spark, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows the driver knows, handed to the JVM as Arrow data: no Python worker is needed to read them."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [tuple(f.split()) for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    table = pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
    return spark.createDataFrame(table)


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def prune_to_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids`` (one column of the same name).

    A Bloom filter with one hash and a fixed number of bits: false positives pass, true members always do, so a
    later join stays exact and only moves fewer rows. The broadcast table has at most 2^16 rows whatever the input.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << FILTER_BITS))
    words = (
        ids.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("_bits"))
    )
    return (
        df.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(words), "_word")
        .where(F.expr("(shiftright(_bits, cast(_place & 63 as int)) & 1) = 1")).drop("_place", "_word", "_bits")
    )


def gapless(df: DataFrame, group: str, order: list[str], sizes: dict[int, int], per_chunk: int = 1_000) -> DataFrame:
    """Number the rows of each group from 0 without holding a group in one task: adds ``slot``.

    ``sizes`` has the expected rows of every group; groups are few by nature (shards, lengths). Rows of a group are dealt by hash
    into chunks of about ``per_chunk`` rows. A row's number is its place in its chunk plus the rows of the group's earlier chunks,
    which are summed over a table of one row per chunk.
    """
    spark = df.sparkSession
    chunks = F.broadcast(small_frame(spark, [(g, n // per_chunk + 1) for g, n in sizes.items()], "_of long, _chunks long"))
    dealt = df.join(chunks, F.col(group) == F.col("_of")).withColumn("_chunk", F.pmod(F.xxhash64(*order), F.col("_chunks"))).drop("_of", "_chunks")
    counted = dealt.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select(group, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(*order)).cast("long") - 1
    return (
        dealt.withColumn("_inside", inside).join(bases, [group, "_chunk"])
        .withColumn("slot", F.col("_base") + F.col("_inside")).drop("_chunk", "_inside", "_base")
    )


def text_slices(batch: pa.RecordBatch, column: str, budget: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with at most ``budget`` text bytes and ``SLICE_ROWS`` rows (one at least).

    Yields (first row, end row, bytes of the run, offsets of its rows in those bytes). Nulls are empty.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first, n = 0, len(col)
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1
        end = min(max(end, first + 1), n, first + SLICE_ROWS)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def id_array(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))
