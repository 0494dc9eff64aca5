"""Distribution fidelity and drift."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.metrics import ratio
from riskweave.operators.ordered import Running, exact_quantiles, running

# Weights of the fidelity score.
FIDELITY_WEIGHTS = {
    "rail_similarity": 0.16, "channel_similarity": 0.12, "amount_calibration": 0.12, "amount_baseline_spearman": 0.10,
    "edge_case_calibration": 0.10, "vector_coverage": 0.16, "family_coverage": 0.10, "sequence_validity": 0.08,
    "difficulty_gradient": 0.06,
}
PSI_BINS = 10
SHAPE_QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def js_similarity(df: DataFrame, column: str, priors: DataFrame, key: str, share: str, name: str = "similarity") -> DataFrame:
    """1 - Jensen-Shannon divergence / ln 2 between observed shares and priors; nulls are dropped."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    both = counts.join(priors.select(F.col(key).alias("_k"), F.col(share).alias("_s")), "_k", "full_outer").fillna(0, ["_n", "_s"])
    totals = both.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    shares = both.crossJoin(F.broadcast(totals)).select((F.col("_n") / F.col("_tn")).alias("p"), (F.col("_s") / F.col("_ts")).alias("q"))
    mid = (F.col("p") + F.col("q")) / 2

    def part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / mid)).otherwise(F.lit(0.0))

    divergence = 0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q"))
    return shares.agg(F.round(F.greatest(F.lit(0.0), 1 - divergence / math.log(2.0)), 6).alias(name))


def amount_calibration(df: DataFrame, amount: str, ratio_column: str) -> DataFrame:
    """how close the median amount-to-baseline ratio of positive amounts is to one."""
    median = exact_quantiles(df.where(F.col(amount) > 0).select(ratio_column), ratio_column, {"median_ratio": 0.5})
    score = F.greatest(F.lit(0.0), 1 - F.abs(F.log(F.greatest(F.col("median_ratio"), F.lit(0.01)))) / math.log(3.0))
    return median.select(F.round("median_ratio", 4).alias("median_ratio"), F.round(score, 6).alias("amount_calibration"))


def _average_ranks(cells: DataFrame, column: str, name: str) -> DataFrame:
    counts = cells.groupBy(F.col(column).alias(f"_v_{name}")).agg(F.sum("_n").alias("_c"))
    cum = running(counts, [], [f"_v_{name}"], {"_cum": Running("sum", F.col("_c"))})
    return cum.select(f"_v_{name}", (F.col("_cum") - (F.col("_c") - 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str, name: str = "spearman") -> DataFrame:
    """Pearson correlation of average-tie ranks, on (x, y) cells with counts.

    Pairs with a null are left out. The mean of average-tie ranks is (N + 1) / 2, so the products can
    be centred without a second pass.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    total = cells.agg(F.sum("_n").alias("_total"))
    ranked = (
        cells.join(_average_ranks(cells, "_x", "rx"), F.col("_x") == F.col("_v_rx"))
        .join(_average_ranks(cells, "_y", "ry"), F.col("_y") == F.col("_v_ry"))
        .crossJoin(F.broadcast(total))
    )
    mean = (F.col("_total") + 1) / 2
    dx, dy, n = F.col("rx") - mean, F.col("ry") - mean, F.col("_n")
    value = F.sum(n * dx * dy) / F.sqrt(F.sum(n * dx * dx) * F.sum(n * dy * dy))
    return ranked.agg(F.round(value, 6).alias(name))


def edge_case_calibration(df: DataFrame, control: Column, target: float = 0.12) -> DataFrame:
    """observed share of legitimate edge cases against the declared one."""
    rate = F.avg(control.cast("int"))
    return df.agg(
        F.round(rate, 6).alias("edge_case_rate"),
        F.round(F.greatest(F.lit(0.0), 1 - F.abs(rate - target) / target), 6).alias("edge_case_calibration"),
    )


def catalog_coverage(rows: DataFrame, vectors: DataFrame, vector: str, family: str, vector_id: str, vector_family: str) -> DataFrame:
    """share of catalogue vectors and families that occur in the rows."""
    catalogue = vectors.select(F.col(vector_id).alias("_v"), F.col(vector_family).alias("_f")).distinct()
    seen = rows.select(F.col(vector).alias("_v")).where(F.col("_v").isNotNull()).distinct().withColumn("_seen", F.lit(1))
    ids = catalogue.select("_v").distinct().join(seen, "_v", "left").agg(
        F.round(ratio(F.count("_seen"), F.count(F.lit(1))), 6).alias("vector_coverage")
    )
    families = rows.agg(F.countDistinct(family).alias("_a")).crossJoin(
        F.broadcast(catalogue.agg(F.countDistinct("_f").alias("_b")))
    ).select(F.round(ratio(F.col("_a"), F.col("_b")), 6).alias("family_coverage"))
    return ids.crossJoin(F.broadcast(families))


def difficulty_gradient(df: DataFrame, label: str = "label_fraud", difficulty: str = "difficulty", density: str = "risk_signal_density") -> DataFrame:
    """mean signal density of positives by difficulty, and whether easy >= medium >= hard."""
    means = {
        level: F.coalesce(F.avg(F.when(F.col(label) & (F.col(difficulty) == level), F.col(density))), F.lit(0.0))
        for level in ("easy", "medium", "hard")
    }
    wide = df.agg(*[m.alias(n) for n, m in means.items()])
    holds = (F.col("easy") >= F.col("medium")) & (F.col("medium") >= F.col("hard"))
    return wide.select(*[F.round(n, 6).alias(f"mean_{n}") for n in means], holds.alias("difficulty_gradient"))


def fidelity_score(parts: DataFrame) -> DataFrame:
    """weighted score of a one-row frame that carries the nine parts."""
    total = F.lit(0.0)
    for name, weight in FIDELITY_WEIGHTS.items():
        value = F.col(name).cast("double")
        if name == "amount_baseline_spearman":
            value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
        total = total + weight * value
    return parts.withColumn("fidelity_score", F.round(100 * total, 2))


def _long(df: DataFrame, features: Sequence[str], is_reference: Column) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    return (
        df.select(is_reference.alias("_ref"), F.explode(F.array(*pairs)).alias("p")).select("_ref", "p.*")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def psi_by_feature(reference: DataFrame, observed: DataFrame, features: Sequence[str]) -> DataFrame:
    """F8: population stability index of each feature over equal-frequency reference bins.

    All features are handled in one pass over long rows. The edge table has one row per feature, so
    its size is bounded by the schema and it is broadcast.
    """
    ref, obs = _long(reference, features, F.lit(True)), _long(observed, features, F.lit(False))
    probabilities = {f"e{i}": i / PSI_BINS for i in range(PSI_BINS + 1)}
    edges = exact_quantiles(ref, "value", probabilities, ["feature"]).select(
        "feature", F.array_sort(F.array_distinct(F.array(*list(probabilities)))).alias("_edges")
    ).select("feature", F.when(F.size("_edges") >= 3, F.slice("_edges", F.lit(2), F.size("_edges") - 2)).alias("_inner"))
    cells = ref.unionByName(obs).groupBy("feature", "value").agg(
        F.count_if("_ref").alias("_r"), F.count_if(~F.col("_ref")).alias("_o")
    )
    binned = cells.join(F.broadcast(edges), "feature").withColumn(
        "_bin", F.size(F.filter("_inner", lambda edge: edge <= F.col("value")))
    )
    counts = binned.groupBy("feature", "_bin").agg(F.sum("_r").alias("_r"), F.sum("_o").alias("_o"), F.first("_inner").isNotNull().alias("_ok"))
    totals = counts.groupBy("feature").agg(F.greatest(F.lit(1), F.sum("_r")).alias("_tr"), F.greatest(F.lit(1), F.sum("_o")).alias("_to"))
    shares = counts.join(F.broadcast(totals), "feature").select(
        "feature", "_ok", F.greatest(F.col("_r") / F.col("_tr"), F.lit(1e-6)).alias("r"), F.greatest(F.col("_o") / F.col("_to"), F.lit(1e-6)).alias("o")
    )
    term = F.when(F.col("_ok"), (F.col("o") - F.col("r")) * F.log(F.col("o") / F.col("r"))).otherwise(F.lit(0.0))
    return shares.groupBy("feature").agg(F.round(F.sum(term), 6).alias("psi"))


def psi_report(reference: DataFrame, observed: DataFrame, features: Sequence[str], top: int = 8) -> DataFrame:
    """the most drifted features with their band (a top-k report over one row per feature)."""
    band = F.when(F.col("psi") < 0.10, F.lit("small")).when(F.col("psi") <= 0.25, F.lit("moderate")).otherwise(F.lit("large"))
    return psi_by_feature(reference, observed, features).withColumn("band", band).orderBy(F.col("psi").desc(), "feature").limit(top)


def amount_shape_profile(df: DataFrame, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """zero rate, median of positive amounts and quantiles over that median."""
    by = list(by)
    counts = df.groupBy(*by).agg(
        F.count_if(F.col(amount) > 0).alias("positive_count"), F.round(F.avg((F.col(amount) == 0).cast("int")), 6).alias("zero_rate")
    )
    raw = exact_quantiles(df.where(F.col(amount) > 0).select(*by, amount), amount, SHAPE_QUANTILES, by)
    median = F.greatest(F.col("p50"), F.lit(1e-9))
    shaped = raw.select(*by, F.round(median, 6).alias("median"), *[F.round(F.col(q) / median, 6).alias(q) for q in SHAPE_QUANTILES])
    return counts.join(shaped, by) if by else counts.crossJoin(F.broadcast(shaped))


def shape_similarity(a: DataFrame, b: DataFrame, prevalence_a: Column | None = None, prevalence_b: Column | None = None) -> DataFrame:
    """exp(-mean |log quantile ratio|) of two one-row profiles, and the prevalence multiplier b / a."""
    left = a.select(*[F.col(q).alias(f"a_{q}") for q in SHAPE_QUANTILES], (prevalence_a if prevalence_a is not None else F.lit(None).cast("double")).alias("_pa"))
    right = b.select(*[F.col(q).alias(f"b_{q}") for q in SHAPE_QUANTILES], (prevalence_b if prevalence_b is not None else F.lit(None).cast("double")).alias("_pb"))
    gap = F.lit(0.0)
    for q in SHAPE_QUANTILES:
        gap = gap + F.abs(F.log(F.greatest(F.col(f"b_{q}"), F.lit(1e-9)) / F.greatest(F.col(f"a_{q}"), F.lit(1e-9))))
    return left.crossJoin(F.broadcast(right)).select(
        F.round(F.exp(-gap / len(SHAPE_QUANTILES)), 6).alias("shape_similarity"),
        F.round(ratio(F.col("_pb"), F.col("_pa")), 2).alias("prevalence_multiplier"),
    )


def fidelity_parts(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row with the named parts, each taken from a column of a one-row frame."""
    out = None
    for name, (frame, column) in frames.items():
        part = frame.select(F.col(column).cast("double").alias(name))
        out = part if out is None else out.crossJoin(F.broadcast(part))
    return out
