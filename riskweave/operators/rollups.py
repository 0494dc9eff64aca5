"""Summary tables behind the monitoring views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators import quality
from riskweave.operators.metrics import confusion_metrics, ratio, rounded

# Score bins of the histogram, left-closed; the last bin also takes a score of one.
HISTOGRAM_BINS = (("0-20", 0.0, 0.2), ("20-40", 0.2, 0.4), ("40-60", 0.4, 0.6), ("60-80", 0.6, 0.8), ("80-100", 0.8, 1.000001))


def domain_frame(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """The declared values of a domain as a table of a few rows."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def summary(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Event, positive and campaign counts with the headline test metrics."""
    counts = events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if("label_fraud").alias("fraud_events"), F.countDistinct("scenario_id").alias("campaigns")
    )
    headline = confusion_metrics(predictions, "label_fraud", "predicted_fraud").select("precision", "recall", "f1", "false_positive_rate")
    return counts.crossJoin(F.broadcast(headline))


def timeline(events: DataFrame) -> DataFrame:
    """R2: legitimate and fraud events per day."""
    return events.groupBy(F.to_date("event_ts").alias("day")).agg(
        F.count_if(~F.col("label_fraud")).alias("legitimate"), F.count_if("label_fraud").alias("fraud")
    )


def risk_histogram(predictions: DataFrame) -> DataFrame:
    """Legitimate and fraud rows per score bin; empty bins stay with zeros."""
    score, bucket = F.col("risk_score"), None
    for name, low, high in HISTOGRAM_BINS:
        bucket = (F.when if bucket is None else bucket.when)((score >= low) & (score < high), F.lit(name))
    counts = predictions.groupBy(bucket.alias("bucket")).agg(
        F.count_if(~F.col("label_fraud")).alias("legitimate"), F.count_if("label_fraud").alias("fraud")
    )
    return domain_frame(predictions, "bucket", [b[0] for b in HISTOGRAM_BINS]).join(counts, "bucket", "left").fillna(0)


def campaigns(events: DataFrame) -> DataFrame:
    """Size, mean amount and start of each (family, scenario), null keys included.

    Difficulty cycles with the number at the end of the scenario id.
    """
    number = F.element_at(F.split("scenario_id", "-"), -1).try_cast("int")
    levels = F.array(F.lit("Easy"), F.lit("Medium"), F.lit("Hard"))
    return events.where("label_fraud").groupBy("attack_family", "scenario_id").agg(
        F.count(F.lit(1)).alias("events"), rounded(F.avg("amount_inr"), 2).alias("average_amount"), F.min("event_ts").alias("start")
    ).withColumn("difficulty", F.when(number.isNotNull(), F.element_at(levels, (F.pmod(number - 1, F.lit(3)) + 1).cast("int"))))


def largest_campaign_network(events: DataFrame, family: str, order: Sequence[str], size: int = 100) -> DataFrame:
    """Edges of the first ``size`` events of the family's largest scenario (a top-k report).

    The scenario id that sorts first wins a tie. Nodes are the distinct ends of the edges.
    """
    own = events.where((F.col("attack_family") == family) & F.col("scenario_id").isNotNull())
    biggest = own.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "scenario_id").limit(1)
    return (
        own.join(F.broadcast(biggest), "scenario_id").orderBy(*order).limit(size)
        .select("scenario_id", "event_id", F.col("sender_account_id").alias("source"), F.col("beneficiary_id").alias("target"), rounded(F.col("amount_inr"), 2).alias("amount"))
    )


def network_nodes(edges: DataFrame) -> DataFrame:
    """Distinct accounts and beneficiaries of the edges."""
    ends = F.array(
        F.struct(F.col("source").cast("string").alias("id"), F.lit("account").alias("kind")),
        F.struct(F.col("target").cast("string").alias("id"), F.lit("beneficiary").alias("kind")),
    )
    return edges.select(F.explode(ends).alias("n")).select("n.*").distinct()


def atlas_summary(vectors: DataFrame, sources: DataFrame, holdout: DataFrame, arrays: Mapping[str, str], ignore: Sequence[str] = ("none",)) -> DataFrame:
    """Vector, family and source counts, distinct values of array columns, high-confidence share.

    ``arrays`` maps output names to array columns.
    """
    base = vectors.agg(
        F.count(F.lit(1)).alias("vector_count"), F.countDistinct("simulation_family").alias("attack_family_count"),
        rounded(ratio(F.count_if(F.col("research_confidence") == "high"), F.count(F.lit(1))), 4).alias("high_confidence_vector_rate"),
    )
    pairs = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(c).alias("values")) for n, c in arrays.items()
    ])
    values = vectors.select(F.explode(pairs).alias("p")).select("p.name", F.explode("p.values").alias("value")).where(~F.col("value").isin(*ignore))
    distinct = values.distinct().agg(*[F.count_if(F.col("name") == n).alias(n) for n in arrays])
    frames = [base, distinct, sources.agg(F.count(F.lit(1)).alias("source_count")), holdout.distinct().agg(F.count(F.lit(1)).alias("novel_holdout_vector_count"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def coverage_matrix(stages: DataFrame, surfaces: DataFrame, refs: DataFrame) -> DataFrame:
    """Per family, distinct surfaces and phases, stages and source counts.

    stages(attack_family, stage_id, lifecycle_phase), surfaces(attack_family, surface),
    refs(attack_family, url).
    """
    by_stage = stages.groupBy("attack_family").agg(
        F.count(F.lit(1)).alias("stage_count"), F.array_join(F.array_sort(F.collect_set("lifecycle_phase")), "|").alias("lifecycle_phases")
    )
    by_surface = surfaces.groupBy("attack_family").agg(F.countDistinct("surface").alias("payment_surface_count"))
    by_ref = refs.groupBy("attack_family").agg(
        F.count(F.lit(1)).alias("source_count"), F.countDistinct(url_host(F.col("url"))).alias("source_domain_count")
    )
    return by_stage.join(by_surface, "attack_family", "left").join(by_ref, "attack_family", "left").fillna(0)


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def source_domains(refs: DataFrame, url: str = "url") -> DataFrame:
    """Distinct hosts of the source addresses with their number of distinct addresses."""
    return refs.where(F.col(url).isNotNull()).groupBy(url_host(F.col(url)).alias("domain")).agg(F.countDistinct(url).alias("urls"))


def population_metadata(df: DataFrame, dims: Mapping[str, str | None] | None = None) -> DataFrame:
    """Rows per value of each dimension as (dimension, value, rows); splits are zero-filled.

    All dimensions come from one pass over the table.
    """
    dims = dims or {"role": "case_role", "split": "split", "family": "attack_family", "vector": "attack_vector_id"}
    pairs = []
    for name, column in dims.items():
        value = F.col(column).cast("string")
        if name in ("family", "vector"):
            value = F.when(F.col("label_fraud"), value)
        pairs.append(F.struct(F.lit(name).alias("dimension"), value.alias("value")))
    counts = (
        df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(F.col("value").isNotNull())
        .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"))
    )
    if "split" not in dims:
        return counts
    splits = domain_frame(df, "value", d.SPLITS).withColumn("dimension", F.lit("split"))
    return counts.join(splits, ["dimension", "value"], "full_outer").fillna(0, ["rows"])


def atlas_validation(vectors: DataFrame, sources: DataFrame, families: DataFrame, holdout: DataFrame) -> DataFrame:
    """Catalogue rule violations as (rule, violations) rows.

    vectors(id, simulation_family, source_ids, rails, channels, genai_capabilities, lifecycle_phases,
    plausibility, novelty, research_confidence), sources(id), families(family), holdout(id).
    """
    def empty(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    phases = F.array(*[F.lit(p) for p in d.PHASES])
    inline = vectors.agg(
        F.count_if(empty("source_ids")).alias("vectors_without_sources"),
        F.count_if(~F.col("plausibility").between(1, 5) | ~F.col("novelty").between(1, 5)).alias("ratings_out_of_range"),
        F.count_if(~F.col("research_confidence").isin("high", "medium", "low")).alias("invalid_confidence"),
        F.count_if(empty("rails") | empty("channels") | empty("genai_capabilities")).alias("missing_dimensions"),
        F.count_if(F.size(F.array_except("lifecycle_phases", phases)) > 0).alias("unknown_phases"),
    )

    def missing(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
        return left.join(right, key, "left_anti").agg(F.count(F.lit(1)).alias(name))

    ids = vectors.select("id")
    used = vectors.select(F.explode("source_ids").alias("id")).distinct()
    mapped = vectors.select(F.col("simulation_family").alias("family")).distinct()
    frames = [
        inline, quality.duplicate_keys(vectors, ["id"], "duplicate_vectors"), quality.duplicate_keys(sources, ["id"], "duplicate_sources"),
        missing(used, sources.select("id"), "id", "unknown_sources"), missing(mapped, families, "family", "unknown_families"),
        missing(families.distinct(), mapped, "family", "uncovered_families"), missing(holdout.distinct(), ids, "id", "unknown_holdouts"),
    ]
    wide = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)
    rows = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations")) for c in wide.columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def run_catalog(rounds: DataFrame, max_rounds: int = 5) -> DataFrame:
    """Selectable (family, difficulty, rounds) combinations of the recorded runs.

    ``rounds`` has one row per recorded round: run_id, round_number, attack_family, difficulty. A run of
    one round offers the full range; the first round names family and difficulty.
    """
    runs = rounds.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("attack_family", "difficulty"), "round_number").alias("_s")
    )
    capacity = F.when(F.col("_n") == 1, F.lit(max_rounds)).otherwise(F.least(F.col("_n"), F.lit(max_rounds)))
    best = runs.where(F.col("_s.attack_family").isNotNull() & F.col("_s.difficulty").isNotNull()).groupBy("_s.attack_family", "_s.difficulty").agg(
        F.max(capacity).cast("int").alias("_cap")
    )
    return best.select("attack_family", "difficulty", F.explode(F.sequence(F.lit(1), F.col("_cap"))).alias("rounds"))


def backfill_run_fields(runs: DataFrame, rounds: str = "rounds") -> DataFrame:
    """Fill newer report fields of recorded rounds from the older ones."""
    def fill(r: Column) -> Column:
        report = r["referee"]
        zero = F.lit(0.0)
        report = report.withField("no_defense_loss_inr", F.coalesce(report["no_defense_loss_inr"], report["total_value_at_risk_inr"], zero))
        report = report.withField("loss_avoided_inr", F.coalesce(report["loss_avoided_inr"], report["value_prevented_inr"], zero))
        return r.withField("referee", report)

    return runs.withColumn(rounds, F.transform(rounds, fill))


def rounds_of_runs(runs: DataFrame) -> DataFrame:
    """One row per recorded round from nested run documents (run_id, rounds[])."""
    listed = runs.select("run_id", F.posexplode("rounds").alias("_i", "_r"))
    return listed.select(
        "run_id", (F.col("_i") + 1).alias("round_number"), F.col("_r.red.scenario.attack_family").alias("attack_family"),
        F.col("_r.red.scenario.difficulty").alias("difficulty"),
    )

