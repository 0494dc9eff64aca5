"""Model training, calibration, selection and promotion on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.functions.scalar import coerce_features, logit, mitigation_action
from riskweave.operators import metrics as m
from riskweave.operators.history import require_clean
from riskweave.operators.splits import assemble_training, class_weights, fold_count, group_folds, replay_buffer
from riskweave.session import pin
from riskweave.sources.writers import current_version, publish_pointer


#: Rows of a partition a classifier trains on; it keeps its partitions in memory, far larger than in the files they are read from.
FIT_ROWS = 1 << 18


@dataclass(frozen=True)
class ScoringModel:
    """A fitted pipeline with the text fills, feature lists and threshold it was trained with."""

    name: str
    pipeline: PipelineModel
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    fills: Mapping[str, object]
    threshold: float | None = None
    meta: Mapping[str, object] | None = None

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns plus ``risk_score``."""
        ready = prepare(df, self.numeric, self.categorical, self.fills, keep)
        probability = vector_to_array("probability")[1]
        return self.pipeline.transform(ready).select(*keep, probability.alias("risk_score"))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        bundle = {
            "name": self.name, "numeric": list(self.numeric), "categorical": list(self.categorical),
            "fills": dict(self.fills), "threshold": self.threshold, "meta": dict(self.meta or {}),
        }
        spark = SparkSession.active()
        spark.range(1).select(F.lit(json.dumps(bundle)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str, numeric: Sequence[str], categorical: Sequence[str]) -> ScoringModel:
        """Read a saved model; its feature lists must equal the current allowlist."""
        bundle = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        if bundle["numeric"] != list(numeric) or bundle["categorical"] != list(categorical):
            raise ValueError("Saved model feature list does not match the current allowlist.")
        return ScoringModel(
            bundle["name"], PipelineModel.load(f"{path}/pipeline"), tuple(numeric), tuple(categorical),
            bundle["fills"], bundle["threshold"], bundle["meta"],
        )


def text_values(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, int]]:
    """Most frequent value of each text column, the smallest of ties, and the number of its values: one aggregation, one result row per column."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"), F.count(F.lit(1)).alias("values")).collect()
    return {c: ("missing", 1) for c in columns} | {r["c"]: (r["v"], r["values"]) for r in rows}


def number_ranges(df: DataFrame, numeric: Sequence[str]) -> tuple[int, dict[str, tuple[int, float | None, float | None]]]:
    """Rows, and the number of values, the least and the largest of each numeric feature: one aggregation."""
    typed = coerce_features(df, numeric, [])
    three = [e for c in numeric for e in (F.count(c).alias(f"n {c}"), F.min(c).alias(f"a {c}"), F.max(c).alias(f"b {c}"))]
    found = typed.agg(F.count(F.lit(1)).alias("rows"), *three).first()
    return found["rows"], {c: (found[f"n {c}"], found[f"a {c}"], found[f"b {c}"]) for c in numeric}


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fills: Mapping[str, object], keep: Sequence[str]) -> DataFrame:
    """Typed features with filled text, and a missing flag per numeric feature."""
    typed = coerce_features(df, numeric, categorical, [c for c in keep if c not in (*numeric, *categorical)])
    flags = {f"{c}__missing": F.col(c).isNull().cast("double") for c in numeric}
    return typed.withColumns(flags).fillna(dict(fills))


def _stages(numeric: Sequence[str], categorical: Sequence[str], one_hot: bool) -> tuple[list, list[str]]:
    filled = [f"{c}__filled" for c in numeric]
    stages: list = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled)]
    inputs = [*filled]
    if categorical:
        codes = [f"{c}__code" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=codes, handleInvalid="keep"))
        if one_hot:
            vectors = [f"{c}__hot" for c in categorical]
            stages.append(OneHotEncoder(inputCols=codes, outputCols=vectors, handleInvalid="keep"))
            codes = vectors
        inputs += codes
    return stages, inputs


def logistic_stages(numeric: Sequence[str], categorical: Sequence[str], iterations: int = 100) -> Pipeline:
    """Median fill and scaling of numbers, one-hot text, weighted logistic regression."""
    stages, inputs = _stages(numeric, categorical, one_hot=True)
    numbers = [c for c in inputs if c.endswith("__filled")]
    others = [c for c in inputs if not c.endswith("__filled")]
    stages += [
        VectorAssembler(inputCols=numbers, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_scaled", *others], outputCol="features"),
        LogisticRegression(labelCol="_label", weightCol="weight", maxIter=iterations, regParam=1e-4),
    ]
    return Pipeline(stages=stages)


def boosted_stages(
    numeric: Sequence[str], categorical: Sequence[str], iterations: int = 140, step: float = 0.07, depth: int = 5,
    min_rows: int = 15, seed: int = 42, early_stopping: bool = False, missing_flags: bool = False,
) -> Pipeline:
    """Gradient-boosted trees on filled numbers and text codes."""
    stages, inputs = _stages(numeric, categorical, one_hot=False)
    if missing_flags:
        inputs = inputs + [f"{c}__missing" for c in numeric]
    classifier = GBTClassifier(
        labelCol="_label", weightCol="weight", maxIter=iterations, stepSize=step, maxDepth=depth,
        minInstancesPerNode=min_rows, seed=seed, maxBins=128,
    )
    if early_stopping:
        classifier = classifier.setValidationIndicatorCol("_validation")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), classifier])


def spread(df: DataFrame) -> DataFrame:
    """``df`` in partitions of at most about ``FIT_ROWS`` rows, as many for each core, where one per core would be larger.

    Every level of every tree waits for its last task, so a part that is left over costs as much as a whole round of the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = -(-df.count() // FIT_ROWS)
    return df.repartition(-(-parts // cores) * cores) if parts > cores else df


def _fitted(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """The fitted pipeline; its last stage, the classifier, trains on spread rows of the columns it reads.

    A classifier goes over its rows many times before it keeps them, so they are stored once all other stages are through.
    """
    *before, last = pipeline.getStages()
    ready = Pipeline(stages=before).fit(df)
    names = ["features", "_label", "weight"] + [c for c in ["_validation"] if c in df.columns]
    return PipelineModel([*ready.stages, last.fit(spread(pin(ready.transform(df).select(*names), "fit-rows")))])


def _varying_only(pipeline: Pipeline, single: set[str]) -> None:
    """Leave features with a single value out of the vector that trees are grown on: no tree can split on one.

    Medians of numbers that have none but the filled value, or one value, are not needed then either. One feature always stays.
    """
    for stage in pipeline.getStages():
        if isinstance(stage, VectorAssembler):
            names = stage.getInputCols()
            kept = [c for c in names if c not in single] or names[:1]
            stage.setInputCols(kept)
    for stage in pipeline.getStages():
        if isinstance(stage, Imputer):
            pairs = [(a, b) for a, b in zip(stage.getInputCols(), stage.getOutputCols(), strict=True) if b in kept]
            if pairs:
                stage.setInputCols([a for a, _ in pairs]).setOutputCols([b for _, b in pairs])


def fit_model(
    name: str, df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str],
    build: Callable[[Sequence[str], Sequence[str]], Pipeline], weights: str = "balanced",
    row_id: str | None = None, validation_share: float = 0.15,
) -> ScoringModel:
    """Fit a pipeline on class-weighted rows. ``row_id`` drives the hash split for early stopping."""
    texts = text_values(df, categorical)
    rows, ranges = number_ranges(df, numeric)
    # Numeric features without any value have no median.
    fills = {c: v for c, (v, _) in texts.items()} | {c: 0.0 for c, (n, _, _) in ranges.items() if n == 0}
    keep = [label] + ([row_id] if row_id else [])
    ready = prepare(df, numeric, categorical, fills, keep).withColumn("_label", F.col(label).cast("double"))
    weighted = class_weights(ready, "_label", weights)
    if row_id:
        weighted = weighted.withColumn("_validation", F.pmod(F.xxhash64(row_id), F.lit(1000)) < int(1000 * validation_share))
    pipeline = build(numeric, categorical)
    for stage in pipeline.getStages():
        if isinstance(stage, GBTClassifier):
            if categorical:  # a category needs a bin of its own, and one more for values not seen
                stage.setMaxBins(max(stage.getMaxBins(), max(n for _, n in texts.values()) + 1))
            single = {f"{c}__code" for c, (_, n) in texts.items() if n == 1}
            single |= {f"{c}__filled" for c, (n, low, high) in ranges.items() if n == 0 or low == high}
            _varying_only(pipeline, single | {f"{c}__missing" for c, (n, _, _) in ranges.items() if n in (0, rows)})
    return ScoringModel(name, _fitted(pipeline, weighted), tuple(numeric), tuple(categorical), fills)


def fraud_detector(df: DataFrame, label: str = "label", iterations: int = 400) -> ScoringModel:
    """Boosted detector on the allowlisted chain features with early stopping on 15 % of events."""
    require_clean(d.CHAIN_FEATURES, d.CHAIN_FORBIDDEN)

    def build(n, c):
        return boosted_stages(n, c, iterations, 0.06, 5, 40, 0, early_stopping=True, missing_flags=True)

    return fit_model(
        "fraud_detector", df, label, d.CHAIN_NUMERIC_FEATURES, d.CHAIN_CATEGORICAL_FEATURES, build, "inverse_prevalence", "event_id",
    )


@dataclass(frozen=True)
class Calibrator:
    """T4: logistic map from the log-odds of a raw score to a calibrated probability."""

    slope: float
    intercept: float

    def apply(self, score: Column) -> Column:
        return F.lit(1.0) / (1 + F.exp(-(F.lit(self.slope) * logit(score) + F.lit(self.intercept))))


def platt_calibrate(validation: DataFrame, score: str, label: str) -> Calibrator:
    """T4: fit the calibration on validation rows only."""
    rows = validation.select(logit(F.col(score)).alias("_x"), F.col(label).cast("double").alias("_label"))
    assembled = VectorAssembler(inputCols=["_x"], outputCol="features").transform(rows)
    fitted = LogisticRegression(labelCol="_label", maxIter=100).fit(assembled)
    return Calibrator(float(fitted.coefficients[0]), float(fitted.intercept))


@dataclass(frozen=True)
class Selection:
    """The choice that is frozen before any test row is looked at."""

    model: ScoringModel
    calibrator: Calibrator | None
    threshold: float
    validation_pr_auc: Mapping[str, float]


def select_by_validation(
    candidates: Mapping[str, ScoringModel], validation: DataFrame, label: str, row_id: str,
    fpr_cap: float | None = None, calibrate: bool = False,
) -> Selection:
    """T5: the candidate with the best validation PR-AUC (the first on a tie) and its threshold.

    With ``fpr_cap`` the threshold is the best F1 under the cap, else the F1 / precision rule.
    """
    areas, scored, calibrators = {}, {}, {}
    for name, model in candidates.items():
        rows = pin(model.score(validation, [row_id, label]), "validation")
        calibrators[name] = platt_calibrate(rows, "risk_score", label) if calibrate else None
        if calibrate:
            rows = rows.withColumn("risk_score", calibrators[name].apply(F.col("risk_score")))
        scored[name] = rows.withColumn(label, F.col(label).cast("boolean"))
        areas[name] = m.average_precision(scored[name], "risk_score", label).first()["pr_auc"] or 0.0
    best = max(areas, key=areas.get)
    if fpr_cap is None:
        threshold = m.threshold_f1_precision(scored[best], "risk_score", label).first()["threshold"]
    else:
        threshold = m.threshold_under_fpr(scored[best], "risk_score", label, fpr_cap, row_id).first()["threshold"]
    return Selection(replace(candidates[best], threshold=float(threshold)), calibrators[best], float(threshold), areas)


def score_events(df: DataFrame, selection: Selection, keep: Sequence[str]) -> DataFrame:
    """Score, flag and mitigation action of each event."""
    rows = selection.model.score(df, keep)
    if selection.calibrator is not None:
        rows = rows.withColumn("risk_score", selection.calibrator.apply(F.col("risk_score")))
    return rows.withColumns({
        "predicted_fraud": F.col("risk_score") >= selection.threshold,
        "mitigation_action": mitigation_action(F.col("risk_score"), selection.threshold),
    })


CHAIN_META = (
    "event_id", "chain_id", "sequence", "attack_family", "is_attack", "fraud_contributing", "value_at_risk_inr", "label", "source",
)
FOLD_METRICS = (
    "chain_recall", "prevented_share", "chain_precision", "row_recall", "row_precision", "hard_false_positive_rate",
    "ambient_friction_rate", "threshold", "mean_caught_at_stage",
)


def cross_validate(
    df: DataFrame, fit: Callable[[DataFrame], ScoringModel], group: str = "group_key", test_share: float = 0.3,
    alert_rate: float = 0.01, seed: int = 42,
) -> DataFrame:
    """One chain report per grouped fold, with the budget threshold of the fold.

    Fitting and scoring of a fold are Spark jobs on the whole fold, most of them far shorter than it takes to start them, so the
    few folds run side by side. Folds that fill the cores more than once go one after the other: each holds its rows in memory.
    """
    k = fold_count(test_share)
    folds = group_folds(df, group, "attack_family", k, seed).withColumnRenamed(group, "_g")
    tagged = pin(df.join(folds, F.col(group) == F.col("_g")).drop("_g", "stratum"), "folds")

    def scored_fold(fold: int) -> DataFrame:
        train, test = tagged.where(F.col("fold") != fold), tagged.where(F.col("fold") == fold)
        return pin(fit(train).score(test, list(CHAIN_META)), "scored")

    spark = df.sparkSession
    small = tagged.count() <= FIT_ROWS * spark.sparkContext.defaultParallelism
    with ThreadPoolExecutor(k if small else 1) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(scored_fold), fold) for fold in range(k)]
        folds_scored = [r.result() for r in running]
    reports = []
    for fold, scored in enumerate(folds_scored):
        budget = F.greatest(F.lit(1), F.round(F.col("_rows") * alert_rate).cast("long"))
        cut = m.threshold_for_budget(scored, "risk_score", budget)
        alerted = scored.crossJoin(F.broadcast(cut)).withColumn("alert", F.col("risk_score") >= F.col("threshold"))
        report = m.chain_summary(alerted).crossJoin(F.broadcast(cut))
        reports.append(report.withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, reports)


GATE_METRICS = ("chain_recall", "hard_false_positive_rate", "chain_precision", "prevented_share")


def promotion_gate(
    challenger: DataFrame, incumbent: DataFrame | None, key: str | None = None, min_delta: float = 0.01,
    fp_tolerance: float = 0.002, min_improvement: float = 0.001,
) -> DataFrame:
    """Promote when recall and hard false positives hold and at least one metric improves.

    Both frames carry the gate metrics, one row each or one row per ``key``. Without an incumbent the
    challenger is promoted.
    """
    names = [n for n in GATE_METRICS if n in challenger.columns]
    keys = [key] if key else []
    if incumbent is None:
        return challenger.select(*keys, *names).withColumn("promoted", F.lit(True))
    shared = [n for n in names if n in incumbent.columns]
    old = incumbent.select(*keys, *[F.col(n).alias(f"i_{n}") for n in shared])
    both = challenger.select(*keys, *names)
    both = both.join(old, key) if key else both.crossJoin(F.broadcast(old))
    recall_gain = F.col("chain_recall") - F.col("i_chain_recall")
    fp_gain = F.col("i_hard_false_positive_rate") - F.col("hard_false_positive_rate")
    gains = [recall_gain, fp_gain] + [F.col(n) - F.col(f"i_{n}") for n in ("chain_precision", "prevented_share") if n in shared]
    # Rates carry four decimals; the tolerance comparison must not fail on the last bit of a double.
    slack = 1e-9
    ok = (recall_gain >= -min_delta - slack) & (fp_gain >= -fp_tolerance - slack) & (F.greatest(*gains) >= min_improvement - slack)
    return both.withColumn("promoted", ok)


def retrain_generation(
    spark: SparkSession, sources: Sequence[DataFrame], root: str, generation: int,
    features: Callable[[DataFrame], DataFrame], fit: Callable[[DataFrame], ScoringModel], replay: DataFrame | None = None,
    ingest_order: str = "event_id", alert_rate: float = 0.01, test_share: float = 0.3, in_sample_threshold: bool = True,
) -> tuple[dict[str, object], DataFrame | None]:
    """Assemble, cross-validate, gate, and on promotion refit, save a version and move the pointer.

    Returns the decision record and the new replay buffer (None when nothing was promoted). The
    threshold comes from all training scores, or from the mean of the fold thresholds.
    """
    parts = [*sources, replay] if replay is not None else list(sources)
    assembled = pin(assemble_training(*parts, order=ingest_order), "training")
    rows = pin(features(assembled), "features")
    folds = pin(cross_validate(rows, fit, test_share=test_share, alert_rate=alert_rate), "fold_reports")
    challenger = folds.agg(*[F.round(F.avg(n), 4).alias(n) for n in GATE_METRICS], F.avg("threshold").alias("threshold"))
    version = current_version(spark, root)
    incumbent = None
    if version is not None:
        bundle = json.loads(spark.read.text(f"{root}/{version}/metadata").first()["value"])
        gate = bundle["meta"]["gate_metrics"]
        incumbent = spark.range(1).select(*[F.lit(float(gate[n])).alias(n) for n in GATE_METRICS])
    verdict = promotion_gate(challenger, incumbent).first().asDict()
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("fraud_rows")).first()
    decision: dict[str, object] = {
        "generation": generation, "rows": counts["rows"], "fraud_rows": counts["fraud_rows"], "promoted": verdict["promoted"],
        "challenger": {n: verdict[n] for n in GATE_METRICS},
        "incumbent": {n: verdict[f"i_{n}"] for n in GATE_METRICS} if incumbent is not None else None,
    }
    if not verdict["promoted"]:
        return decision, None
    champion = fit(rows)
    if in_sample_threshold:
        scored = champion.score(rows, ["event_id"])
        budget = F.greatest(F.lit(1), F.round(F.col("_rows") * alert_rate).cast("long"))
        threshold = m.threshold_for_budget(scored, "risk_score", budget).first()["threshold"]
    else:
        threshold = challenger.first()["threshold"]
    new_version = f"gen_{generation:06d}"
    meta = {"generation": generation, "rows": counts["rows"], "gate_metrics": decision["challenger"]}
    replace(champion, threshold=float(threshold), meta=meta).save(f"{root}/{new_version}")
    publish_pointer(spark, root, new_version)
    decision["champion_threshold"] = round(float(threshold), 6)
    return decision, replay_buffer(replay, assembled, ingest_order)
