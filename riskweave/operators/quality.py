"""Data-quality checks and the weighted gate. Row-level checks of a table share one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave import domains as d
from riskweave.operators import joins
from riskweave.operators.metrics import ratio
from riskweave.operators.ordered import Running, running


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Q1: required columns the table lacks."""
    return sorted(set(required).difference(df.columns))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "duplicates") -> DataFrame:
    """Q2 and Q10: rows beyond the first of each key, or of each whole row when all columns are given."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def domain_violations(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Q3: values outside the domain with their row counts; nulls are not judged here."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def group_isolation(df: DataFrame, group: str, split: str = "split", name: str = "leaking_groups") -> DataFrame:
    """Q4: groups that occur in more than one split."""
    spread = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi"))
    return spread.agg(F.count_if(F.col("_lo") != F.col("_hi")).alias(name))


def attack_label_errors() -> Column:
    """Q5: attack rows without family or vector."""
    return F.count_if(F.col("label_fraud") & (F.col("attack_family").isNull() | F.col("attack_vector_id").isNull()))


def legitimate_label_errors() -> Column:
    """Q5: legitimate rows that name an attack family."""
    return F.count_if(~F.col("label_fraud") & F.col("attack_family").isNotNull())


def out_of_range(column: str, low: float | None = 0.0, high: float | None = None) -> Column:
    """Q6: rows below the low or above the high limit."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return F.count_if(F.coalesce(bad, F.lit(False)))


def incomplete_rows(columns: Sequence[str]) -> Column:
    """Q7: rows with any null among the columns."""
    return F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def null_cells(columns: Sequence[str]) -> Column:
    """Q7: null cells over the columns."""
    return F.sum(reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in columns]))


def class_coverage(df: DataFrame, split: str, label: str) -> DataFrame:
    """Q8: number of label classes in each split."""
    return df.groupBy(split).agg(F.countDistinct(label).alias("classes"))


def catalog_gaps(rows: DataFrame, key: str, expected: DataFrame, expected_key: str, holdout: DataFrame, holdout_key: str) -> DataFrame:
    """Q9: expected keys never seen, and held-out keys seen outside their split."""
    unseen = joins.unmatched_reference(expected, rows, expected_key, key).agg(F.count(F.lit(1)).alias("missing_vectors"))
    leaked = joins.holdout_leak(rows, holdout, key, holdout_key).agg(F.count(F.lit(1)).alias("leaked_holdouts"))
    return unseen.crossJoin(F.broadcast(leaked))


def deduplicate(df: DataFrame, positive: Column) -> tuple[DataFrame, DataFrame]:
    """Q10: table without exact copies, and row / positive counts before and after."""
    counts = df.withColumn("_positive", positive.cast("int")).groupBy(*df.columns).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_positive").alias("_p")
    )
    report = counts.agg(
        F.sum("_n").alias("raw_row_count"), F.count(F.lit(1)).alias("modeled_row_count"),
        F.sum(F.col("_n") - 1).alias("exact_duplicate_rows_removed"),
        F.sum(F.col("_n") * F.col("_p")).alias("raw_fraud_count"), F.sum(F.col("_p").cast("long")).alias("modeled_fraud_count"),
    )
    return df.dropDuplicates(), report


def non_finite_cells(columns: Sequence[str]) -> Column:
    """Q11: null, NaN or infinite cells over numeric columns."""
    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        return (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("long")
    return F.sum(reduce(lambda a, b: a + b, [bad(c) for c in columns]))


def order_violations(df: DataFrame, time: str, row_id: str, name: str = "order_violations") -> DataFrame:
    """Q12: rows whose time is earlier than that of the previous row in ``row_id`` order."""
    walked = running(df.select(row_id, time), [], [row_id], {"_prev": Running("lag", F.col(time))})
    return walked.agg(F.count_if(F.coalesce(F.col(time) < F.col("_prev"), F.lit(False))).alias(name))


def coverage_audit(df: DataFrame) -> DataFrame:
    """Q14: per event type, how often it is malicious and whether both classes show it."""
    counts = df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("malicious"),
        F.bool_or("is_attack").alias("in_attack"), F.bool_or(~F.col("is_attack")).alias("in_legit"),
    )
    return counts.withColumn("presence_leak", F.col("in_attack") & ~F.col("in_legit"))


def source_mix(df: DataFrame) -> DataFrame:
    """Q14: rows and positives of each source."""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("fraud_rows"))


def class_overlap(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], attack: str = "is_attack") -> DataFrame:
    """Q15: per attribute, presence in both classes and overlap of ranges or of values.

    Numeric attributes come from one aggregation. A categorical value counts as shared when it occurs
    in both classes, which is decided per value and never by collecting value sets.
    """
    y = F.col(attack)
    stats = []
    for c in numeric:
        stats += [
            F.count(F.when(y, F.col(c))).alias(f"an_{c}"), F.count(F.when(~y, F.col(c))).alias(f"ln_{c}"),
            F.min(F.when(y, F.col(c))).alias(f"alo_{c}"), F.max(F.when(y, F.col(c))).alias(f"ahi_{c}"),
            F.min(F.when(~y, F.col(c))).alias(f"llo_{c}"), F.max(F.when(~y, F.col(c))).alias(f"lhi_{c}"),
        ]
    wide = df.agg(*stats)
    rows = [
        F.struct(
            F.lit(c).alias("attribute"), F.col(f"an_{c}").alias("attack_rows"), F.col(f"ln_{c}").alias("legit_rows"),
            F.coalesce((F.col(f"alo_{c}") <= F.col(f"lhi_{c}")) & (F.col(f"llo_{c}") <= F.col(f"ahi_{c}")), F.lit(False)).alias("overlaps"),
        )
        for c in numeric
    ]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if categorical:
        pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in categorical])
        values = (
            df.select(y.alias("_y"), F.explode(pairs).alias("p")).select("_y", "p.*").where(F.col("value").isNotNull())
            .groupBy("attribute", "value").agg(F.count_if("_y").alias("a"), F.count_if(~F.col("_y")).alias("l"))
        )
        out = out.unionByName(values.groupBy("attribute").agg(
            F.sum("a").alias("attack_rows"), F.sum("l").alias("legit_rows"), F.bool_or((F.col("a") > 0) & (F.col("l") > 0)).alias("overlaps")
        ))
    return out


def sequence_contiguity(df: DataFrame, case: str = "case_id", sequence: str = "sequence") -> DataFrame:
    """Q16: cases whose sequence is not exactly 1..n."""
    spans = df.groupBy(case).agg(
        F.count(F.lit(1)).alias("events"), F.min(sequence).alias("_lo"), F.max(sequence).alias("_hi"),
        F.countDistinct(sequence).alias("_distinct"),
    )
    good = (F.col("_lo") == 1) & (F.col("_hi") == F.col("events")) & (F.col("_distinct") == F.col("events"))
    return spans.select(case, "events", good.alias("contiguous"))


def offset_order_violations(df: DataFrame, case: str, sequence: str, offset: str) -> DataFrame:
    """Q16: events whose offset is smaller than that of the previous event of the case."""
    walked = running(df.select(case, sequence, offset), [case], [sequence], {"_prev": Running("lag", F.col(offset))})
    return walked.where(F.col(offset) < F.col("_prev")).select(case, sequence, offset)


def schema_keys(schema: T.DataType) -> set[str]:
    """Q17: every field name of a schema, nested ones included."""
    if isinstance(schema, T.StructType):
        return set(schema.fieldNames()).union(*[schema_keys(f.dataType) for f in schema.fields])
    if isinstance(schema, T.ArrayType):
        return schema_keys(schema.elementType)
    if isinstance(schema, T.MapType):
        return schema_keys(schema.valueType)
    return set()


def forbidden_schema_keys(df: DataFrame, keys: Sequence[str] = d.SEALED_KEYS, fragments: Sequence[str] = d.FORBIDDEN_KEY_FRAGMENTS) -> list[str]:
    names = schema_keys(df.schema)
    return sorted(n for n in names if n in keys or any(f in n.lower() for f in fragments))


def forbidden_json_keys(
    df: DataFrame, column: str, row_id: str, keys: Sequence[str] = d.SEALED_KEYS, fragments: Sequence[str] = d.FORBIDDEN_KEY_FRAGMENTS
) -> DataFrame:
    """Q17: forbidden keys at any depth of JSON text, one row per (row, key).

    Keys are the string tokens of the text that a colon follows, whatever characters they hold; tokens are taken left to right, so
    text inside string values is never mistaken for a key. Text that is not JSON fails closed: it is a row of its own with the
    key ``<unparsable>``, besides any forbidden keys in it. Null is no payload.
    """
    text = F.col(column)
    tokens = F.regexp_extract_all(text, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?)'), F.lit(1))
    quoted = F.transform(F.filter(tokens, lambda t: t.endswith(":")), lambda t: F.regexp_replace(t, r"\s*:$", ""))
    names = F.transform(quoted, lambda t: F.coalesce(F.try_element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(1)), t))
    broken = text.isNotNull() & F.try_parse_json(text).isNull()
    listed = F.array_distinct(F.concat(names, F.when(broken, F.array(F.lit("<unparsable>"))).otherwise(F.array().cast("array<string>"))))
    found = df.select(row_id, F.explode(listed).alias("key"))
    bad = F.col("key").isin(*keys) | (F.col("key") == "<unparsable>")
    for fragment in fragments:
        bad = bad | F.lower("key").contains(fragment)
    return found.where(bad)


def payload_violations(df: DataFrame, entity_columns: Sequence[str], amount: str | None = None, prefix: str = "syn_", low: float = 1.0, high: float = 250_000.0) -> DataFrame:
    """Q17: entity identifiers without the synthetic prefix and amounts outside the lab limit, as counts."""
    checks = [F.count_if(~F.col(c).startswith(prefix)).alias(f"unprefixed_{c}") for c in entity_columns]
    if amount:
        checks.append(F.count_if(~F.col(amount).between(low, high)).alias("amount_out_of_limit"))
    return df.agg(*checks)


@dataclass(frozen=True)
class Check:
    """One gate row. ``observed`` is a count over the table, or a column of a one-row frame in ``frame``."""

    name: str
    severity: str
    expected: str
    observed: Column | str
    target: int | str = 0
    frame: DataFrame | None = None


def checks_table(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Evaluate all checks and return (name, passed, observed, expected, severity) rows.

    Checks given as aggregate columns run together in one pass; grouped checks bring one-row frames.
    """
    inline = [c for c in checks if c.frame is None]
    base = df.agg(*[c.observed.cast("string").alias(f"o_{c.name}") for c in inline]) if inline else None
    for check in checks:
        if check.frame is not None:
            part = check.frame.select(F.col(check.observed).cast("string").alias(f"o_{check.name}"))
            base = part if base is None else base.crossJoin(F.broadcast(part))
    rows = [
        F.struct(
            F.lit(c.name).alias("name"),
            F.coalesce(F.col(f"o_{c.name}") == F.lit(str(c.target)), F.lit(False)).alias("passed"),
            F.col(f"o_{c.name}").alias("observed"), F.lit(c.expected).alias("expected"), F.lit(c.severity).alias("severity"),
        )
        for c in checks
    ]
    return base.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def severity_weight() -> Column:
    out = None
    for name, weight in d.SEVERITY_WEIGHTS.items():
        out = (F.when if out is None else out.when)(F.col("severity") == name, F.lit(weight))
    return out


def quality_score(checks: DataFrame) -> DataFrame:
    """Q18: passed share of the severity weight, with failure counts and status."""
    w, ok = severity_weight(), F.col("passed")
    return checks.agg(
        F.round(100 * ratio(F.sum(F.when(ok, w).otherwise(0)), F.sum(w)), 2).alias("score"),
        F.count_if(~ok).alias("failure_count"),
        F.count_if(~ok & (F.col("severity") == "critical")).alias("critical_failure_count"),
        F.when(F.count_if(~ok) == 0, F.lit("passed")).otherwise(F.lit("failed")).alias("status"),
    )


def enforce_gate(checks: DataFrame) -> DataFrame:
    """Q18: raise when a critical check failed, else return the checks (a handful of rows)."""
    failed = [r["name"] for r in checks.where(~F.col("passed") & (F.col("severity") == "critical")).collect()]
    if failed:
        raise ValueError(f"Stopped because critical data-quality checks failed: {failed}")
    return checks


def population_checks(
    df: DataFrame, vectors: DataFrame, vector_key: str, holdout: DataFrame, holdout_key: str,
    required: Sequence[str] = d.BENCHMARK_REQUIRED,
) -> DataFrame:
    """The population gate: schema, keys, isolation, labels, ranges, coverage and holdout seal."""
    critical, high = "critical", "high"
    gaps = catalog_gaps(df, "attack_vector_id", vectors, vector_key, holdout, holdout_key)
    short = class_coverage(df, "split", "label_fraud").agg(F.count_if(F.col("classes") != 2).alias("n"))
    splits = F.count_if(F.coalesce(~F.col("split").isin(*d.SPLITS), F.lit(True)))
    return checks_table(df, [
        Check("required_schema", critical, "no missing fields", F.lit(len(missing_columns(df, required)))),
        Check("event_id_uniqueness", critical, "0 duplicates", "duplicates", frame=duplicate_keys(df, ["event_id"])),
        Check("split_domain", critical, "only sealed split values", splits),
        Check("scenario_split_isolation", critical, "0 leaking scenarios", "leaking_groups", frame=group_isolation(df, "scenario_id")),
        Check("entity_split_isolation", critical, "0 leaking sender entities", "leaking_groups", frame=group_isolation(df, "sender_account_id")),
        Check("attack_label_integrity", critical, "0 attack rows without labels", attack_label_errors()),
        Check("legitimate_label_integrity", critical, "0 legitimate rows with attack labels", legitimate_label_errors()),
        Check("amount_domain", high, "INR 0 to 250000", out_of_range("amount_inr", 0, 250_000)),
        Check("core_completeness", critical, "0 incomplete rows", incomplete_rows(["event_id", "event_ts", "case_id", "split"])),
        Check("class_coverage_by_split", high, "both classes in every split", "n", frame=short),
        Check("threat_vector_coverage", high, "all atlas vectors represented", "missing_vectors", frame=gaps),
        Check("novel_vector_seal", critical, "0 novel vectors outside test_novel", "leaked_holdouts", frame=gaps),
    ])


def card_checks(
    df: DataFrame, features: Sequence[str], time: str, amount: str, label: str, row_id: str,
    expected_rows: int, expected_frauds: int,
) -> DataFrame:
    """The card-transaction gate; copies are judged on all columns but the row id."""
    required = [*features, time, amount, label]
    missing = missing_columns(df, required)
    if missing:
        lacking = Check("required_schema", "critical", "all required columns", F.lit(len(missing)))
        return checks_table(df, [lacking])
    content = [c for c in df.columns if c != row_id]
    labels = F.count_if(~F.col(label).isin(0, 1)) + F.when(F.countDistinct(label) == 2, 0).otherwise(1)
    return checks_table(df, [
        Check("required_schema", "critical", "all required columns", F.lit(0)),
        Check("exact_row_duplicates", "high", "0", "duplicates", frame=duplicate_keys(df, content)),
        Check("required_value_completeness", "critical", "0 null values", null_cells(required)),
        Check("numeric_finiteness", "critical", "0 non-finite values", non_finite_cells([*features, time, amount])),
        Check("label_domain", "critical", "[0, 1]", labels),
        Check("amount_domain", "high", "0 negative amounts", out_of_range(amount)),
        Check("elapsed_time_domain", "high", "0 negative elapsed times", out_of_range(time)),
        Check("published_row_count_reconciliation", "high", str(expected_rows), F.count(F.lit(1)), expected_rows),
        Check("published_fraud_count_reconciliation", "high", str(expected_frauds), F.sum(F.col(label).cast("long")), expected_frauds),
        Check("source_chronological_order", "medium", "non-decreasing time", "order_violations", frame=order_violations(df, time, row_id)),
    ])


def audit_reported_metrics(metrics: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Q19: reported rates against the ones their confusion counts give, per row."""
    derived = {
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "false_positive_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
    }
    return metrics.withColumns({f"{n}_agrees": F.abs(F.col(n) - c) < tolerance for n, c in derived.items()})


def audit_split_ranges(summary: DataFrame, split: str, order: Mapping[str, int]) -> DataFrame:
    """Q19: whether each split ends before the next one starts (one row per adjacent pair)."""
    place = None
    for name, i in order.items():
        place = (F.when if place is None else place.when)(F.col(split) == name, F.lit(i))
    left = summary.select(F.col(split).alias("earlier"), place.alias("_i"), F.col("time_max_seconds").alias("_end"))
    right = summary.select(F.col(split).alias("later"), (place - 1).alias("_i"), F.col("time_min_seconds").alias("_start"))
    return left.join(right, "_i").select("earlier", "later", (F.col("_end") <= F.col("_start")).alias("ordered"))
