"""Exact deduplication with a heavy-hitter split.

Every partition keeps a Misra-Gries summary of its digests. Summed over partitions, a summary undercounts a digest by less than
rows / (counters + 1), so digests that can be frequent are at most ``counters + 1``. Those are counted exactly; the verified
winners are broadcast and their rows resolved where they are read. All other groups are small and take an ordinary shuffle.

Of equal texts the row with the largest doc_id stays. A null text is the empty text, a null doc_id is lowest. Of repeated rows
(same id and text) one stays. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import small_frame
from riskweave.session import pin

COUNTERS = 1024


def text_digest(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def misra_gries(counts: pd.Series, counters: int) -> pd.Series:
    """Reduce exact or summed counts to at most ``counters`` positive ones: subtract the next largest from all."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False, kind="stable")
    counts = counts.iloc[:counters] - counts.iloc[counters]
    return counts[counts > 0]


def frequent_digests(rows: DataFrame, counters: int = COUNTERS, column: str = "digest") -> DataFrame:
    """Digests that may have rows / (counters + 1) rows or more, with their exact counts and largest row."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, seen = pd.Series(dtype="int64"), 0
        for batch in batches:
            seen += len(batch)
            kept = misra_gries(kept.add(batch[column].value_counts(), fill_value=0).astype("int64"), counters)
        if seen:
            yield pd.DataFrame({column: kept.index.astype(str), "low": kept.to_numpy()})

    total = rows.count()
    summed = rows.select(column).mapInPandas(summarise, f"{column} string, low long").groupBy(column).agg(F.sum("low").alias("low"))
    likely = [r[0] for r in summed.where(F.col("low") * (counters + 1) >= total).collect()]  # sums of lows stay within the rows
    winners = small_frame(rows.sparkSession, [(d,) for d in likely], f"{column} string")
    return (
        rows.join(F.broadcast(winners), column).groupBy(column)
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_keep"))
        .where(F.col("group_size") * (counters + 1) >= total)
    )


def digest_rows(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, digest and a row number of every document, stored once: later passes don't read texts again."""
    row = F.monotonically_increasing_id() if key is None else F.col(key).cast("long")
    return pin(docs.select("doc_id", text_digest(docs["text"]).alias("digest"), row.alias("_row")), "digests")


def exact_groups(docs: DataFrame, counters: int = COUNTERS, key: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, and ``key``, a column that numbers the rows, if one is named."""
    rows = digest_rows(docs, key)
    spark = rows.sparkSession
    found = frequent_digests(rows, counters).collect()  # at most counters + 1 rows
    winners = F.broadcast(small_frame(
        spark, [(r["digest"], r["group_size"], r["_keep"]["doc_id"], r["_keep"]["_row"]) for r in found],
        "digest string, group_size long, keep_id long, _keep_row long"))
    hot = rows.join(winners, "digest")
    group = Window.partitionBy("digest")
    rest = (
        rows.join(winners.select("digest"), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(group)).withColumn("_keep", F.max(F.struct("doc_id", "_row")).over(group))
        .select("digest", "doc_id", "_row", "group_size", F.col("_keep.doc_id").alias("keep_id"), F.col("_keep._row").alias("_keep_row"))
    )
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("_row") == F.col("_keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"), *([] if key is None else [F.col("_row").alias(key)]))
