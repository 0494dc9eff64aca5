"""Splits, replay buffers, training assembly and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordered import Running, global_rank, group_rank, running


def chronological_split(
    df: DataFrame, time: str, tiebreak: str, validation: float = 0.2, test: float = 0.2,
    label: str | None = None, at_least_one: bool = False,
) -> DataFrame:
    """L1: tag rows train / validation / test by global time rank.

    With ``label`` every part must hold both classes, which is checked by one aggregation.
    ``at_least_one`` keeps at least one row in train and in validation.
    """
    ranked = global_rank(df, [time, tiebreak], "_rank")
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    first = F.floor(F.col("_rows") * F.lit(1.0 - validation - test))
    second = F.floor(F.col("_rows") * F.lit(1.0 - test))
    if at_least_one:
        first = F.greatest(F.lit(1), first)
        second = F.greatest(first + 1, second)
    tagged = ranked.crossJoin(F.broadcast(rows)).select(
        *df.columns,
        F.when(F.col("_rank") <= first, F.lit("train"))
        .when(F.col("_rank") <= second, F.lit("validation"))
        .otherwise(F.lit("test")).alias("split"),
    )
    if label is not None:
        classes = tagged.groupBy("split").agg(F.countDistinct(label).alias("n")).where(F.col("n") == 2).count()
        if classes < 3:
            raise ValueError("Every chronological partition must contain both classes.")
    return tagged


def _fraction_split(fraction: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    out = None
    for cut, name in cuts:
        out = (F.when if out is None else out.when)(fraction <= cut, F.lit(name))
    return out.otherwise(F.lit(last))


def sealed_split(variants: DataFrame, vector: str, order: Sequence[str], holdout: DataFrame) -> DataFrame:
    """L2: held-out vectors go to test_novel, others by position inside their vector.

    ``holdout`` has one column of vector ids; it is joined, not assumed to be small.
    """
    ranked = group_rank(variants, [vector], list(order), "_rank")
    counts = variants.groupBy(F.col(vector).alias("_v")).agg(F.count(F.lit(1)).alias("_rows"))
    held = holdout.select(F.col(holdout.columns[0]).alias("_hv")).distinct().withColumn("_held", F.lit(True))
    joined = ranked.join(counts, F.col(vector) == F.col("_v")).join(held, F.col(vector) == F.col("_hv"), "left")
    fraction = (F.col("_rank") - F.lit(0.5)) / F.col("_rows")
    known = _fraction_split(fraction, [(0.60, "train"), (0.80, "validation")], "test_known")
    return joined.select(*variants.columns, F.when(F.col("_held"), F.lit("test_novel")).otherwise(known).alias("split"))


def ordinary_split(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """L2: ordinary traffic is cut at 60 / 78 / 92 percent of its order."""
    ranked = global_rank(rows, list(order), "_rank")
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"))
    fraction = (F.col("_rank") - F.lit(0.5)) / F.col("_rows")
    cuts = [(0.60, "train"), (0.78, "validation"), (0.92, "test_known")]
    return ranked.crossJoin(F.broadcast(counts)).select(
        *rows.columns, _fraction_split(fraction, cuts, "test_novel").alias("split")
    )


def fold_count(test_share: float) -> int:
    return max(2, round(1 / test_share))


def group_folds(df: DataFrame, group: str, stratum: str, folds: int, seed: int = 42) -> DataFrame:
    """L3: fold per group; groups stay whole and each stratum is dealt evenly over the folds.

    The stratum of a group is its largest non-null value; dealing follows a hash of group and seed.
    """
    groups = df.groupBy(group).agg(F.coalesce(F.max(stratum), F.lit("none")).alias("_stratum"))
    keyed = groups.withColumn("_h", F.xxhash64(F.col(group), F.lit(seed)))
    dealt = running(keyed, ["_stratum"], ["_h", group], {"_rank": Running("count")})
    return dealt.select(group, F.col("_stratum").alias("stratum"), ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))


def dedup_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row per key; the whole row is one struct so copies combine on the map side."""
    rest = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select("_r.*")


def replay_buffer(existing: DataFrame | None, new: DataFrame, ingest_order: str, cap: int = 500) -> DataFrame:
    """L4: positives of old and new rows, first per event, then the oldest ``cap`` of each family.

    The cap is the feature itself (a bounded replay buffer), not a guard against skew. Existing rows
    come before new ones; rows without a family are dropped.
    """
    fresh = new.where(F.col("label") == 1).withColumn("_src", F.lit(1))
    merged = fresh
    if existing is not None:
        merged = existing.withColumn("_src", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    first = dedup_first(merged, "event_id", ["_src", ingest_order])
    named = first.where(F.col("attack_family").isNotNull())
    ranked = group_rank(named, ["attack_family"], ["_src", ingest_order, "event_id"], "_rank")
    return ranked.where(F.col("_rank") <= cap).drop("_rank", "_src")


def assemble_training(*sources: DataFrame, order: str = "event_id") -> DataFrame:
    """Union of sources in priority order, one row per event from the earliest source."""
    merged = None
    for priority, source in enumerate(sources):
        part = source.withColumn("_src", F.lit(priority))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return dedup_first(merged, "event_id", ["_src", order]).drop("_src")


def class_weights(df: DataFrame, label: str, mode: str = "balanced") -> DataFrame:
    """Add ``weight``: N / (2 n_class), or negatives / positives on positive rows."""
    y = F.col(label).cast("int")
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(y), F.lit(0)).alias("_pos"))
    positives = F.greatest(F.col("_pos"), F.lit(1))
    if mode == "balanced":
        own = F.when(y == 1, F.col("_pos")).otherwise(F.col("_n") - F.col("_pos"))
        weight = F.col("_n") / (2 * own)
    elif mode == "inverse_prevalence":
        weight = F.when(y == 1, (F.col("_n") - positives) / positives).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown weight mode {mode!r}")
    return df.crossJoin(F.broadcast(counts)).select(*df.columns, weight.alias("weight"))


def sample_to_prevalence(
    df: DataFrame, label: str, row_id: str, share: float, keep: Column | None = None, seed: int = 42
) -> DataFrame:
    """Keep positives (and rows of ``keep``) and as many negatives as give the target share.

    Negatives are taken in the order of a hash of id and seed, so the choice does not depend on
    partitioning. Sampling is the operator's purpose.
    """
    positive = F.col(label).cast("boolean")
    fixed = positive | keep if keep is not None else positive
    need = df.agg(
        F.count_if(positive).alias("_pos"), F.count_if(fixed & ~positive).alias("_others"), F.count_if(positive).alias("_p")
    ).select(
        F.greatest(F.lit(0), F.floor(F.col("_pos") / F.lit(share)) - F.col("_pos") - F.col("_others")).alias("_need")
    )
    negatives = df.where(~fixed).withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed)))
    ranked = global_rank(negatives, ["_h", row_id], "_rank").crossJoin(F.broadcast(need))
    chosen = ranked.where(F.col("_rank") <= F.col("_need")).select(*df.columns)
    return df.where(fixed).unionByName(chosen)
