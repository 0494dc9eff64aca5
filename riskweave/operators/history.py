"""Point-in-time features: what was known before each event, per account, entity, case and chain.

Entity features are computed on a narrow long table (one row per event and entity kind), so all kinds
share one pass, and come back to the events by event id, which is never skewed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.functions import scalar as p
from riskweave.operators.ordered import (
    HotGroups, Running, exact_quantiles, find_hot, first_occurrence, group_rank, lookup_join, running, split_hot,
)
from riskweave.session import pin

HOUR_MICROS = 3_600_000_000


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns).difference(df.columns))
    if missing:
        raise ValueError(f"Missing required event fields: {missing}")


def audit_features(features: Sequence[str], forbidden: frozenset[str]) -> list[str]:
    """Q13: features that are label, truth or key columns; an empty list means clean."""
    return sorted(set(features) & forbidden)


def require_clean(features: Sequence[str], forbidden: frozenset[str]) -> None:
    leaked = audit_features(features, forbidden)
    if leaked:
        raise ValueError(f"Feature list contains forbidden columns: {leaked}")


def prior_event_count(df: DataFrame, key: str, order: Sequence[str], name: str = "prior_event_count") -> DataFrame:
    """Rows of the same key before this one."""
    return running(df, [key], order, {name: Running("count", current=False)})


def amount_to_prior_mean(
    df: DataFrame, key: str, order: Sequence[str], amount: str = "amount_inr", fallback: DataFrame | None = None
) -> DataFrame:
    """Prior count, and amount over the mean of earlier amounts, capped at 50.

    A first event compares with the whole-table median. That median also sees later rows; pass
    ``fallback`` (one row, one column) to take it from training rows only.
    """
    if fallback is None:
        fallback = exact_quantiles(df.select(amount), amount, {"_median": 0.5})
    with_history = running(df, [key], order, {
        "prior_event_count": Running("count", current=False),
        "_prior_sum": Running("sum", F.col(amount), current=False),
    })
    prior_mean = F.when(F.col("prior_event_count") > 0, F.col("_prior_sum") / F.col("prior_event_count"))
    base = F.greatest(F.lit(1.0), F.coalesce(prior_mean, F.col("_fallback")))
    value = F.when(F.col(amount).isNotNull(), F.least(F.lit(50.0), F.col(amount) / base))
    single = F.broadcast(fallback.select(F.col(fallback.columns[0]).alias("_fallback")))
    return with_history.crossJoin(single).withColumn("amount_to_prior_mean", value).drop("_prior_sum", "_fallback")


def _entity_rows(df: DataFrame, kinds: Mapping[str, str], account: str, order: Sequence[str], row_id: str) -> DataFrame:
    pairs = [F.struct(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("entity")) for kind, col in kinds.items()]
    extra = [c for c in dict.fromkeys([account, row_id, *order])]
    return df.select(*extra, F.explode(F.array(*pairs)).alias("_p")).select(*extra, "_p.kind", "_p.entity")


def entity_history(
    df: DataFrame, kinds: Mapping[str, str], account: str, order: Sequence[str], row_id: str
) -> DataFrame:
    """Per (event, kind): is this the account's first use of the entity, and how many accounts used it before."""
    rows = _entity_rows(df, kinds, account, order, row_id)
    hot = find_hot(rows, ["kind", "entity"])
    if hot.frame is None:
        # Rows placed by (kind, entity) serve the per-account window as well: one exchange for both.
        rows = rows.repartition("kind", "entity")
    flagged = first_occurrence(rows, ["kind", "entity", account], order, ["kind", row_id], "first_use", within=hot)
    return running(
        flagged, ["kind", "entity"], order,
        {"prior_accounts": Running("sum", F.col("first_use").cast("long"), current=False)}, hot=hot,
    )


def _pivot_entities(history: DataFrame, kinds: Sequence[str], row_id: str) -> DataFrame:
    pick = []
    for kind in kinds:
        mine = F.col("kind") == kind
        pick.append(F.max(F.when(mine, F.col("first_use").cast("int"))).alias(f"_first_{kind}"))
        pick.append(F.max(F.when(mine, F.coalesce("prior_accounts", F.lit(0)))).alias(f"_accounts_{kind}"))
    return history.groupBy(F.col(row_id).alias("_row")).agg(*pick)


ENTITY_KINDS = {"device": "device_id", "ip": "ip_prefix", "beneficiary": "beneficiary_id"}
ACCOUNT_COUNT_NAMES = {
    "device": "device_prior_account_count", "ip": "ip_prior_account_count",
    "beneficiary": "beneficiary_prior_sender_count",
}


def entity_features(
    df: DataFrame, account: str = "sender_account_id", order: Sequence[str] = ("event_ts", "event_id"),
    row_id: str = "event_id", prior_count: str = "prior_event_count", source: DataFrame | None = None,
) -> DataFrame:
    """Novelty flags (only once the account has history) and prior distinct accounts.

    ``source`` holds the same events before other features were added; the entity pass then reads only
    its id columns.
    """
    rows = source if source is not None else df
    history = _pivot_entities(entity_history(rows, ENTITY_KINDS, account, list(order), row_id), list(ENTITY_KINDS), row_id)
    joined = df.join(history, F.col(row_id) == F.col("_row"))
    seasoned = F.col(prior_count) > 0
    new = [(seasoned & (F.col(f"_first_{k}") == 1)).cast("int").alias(f"is_new_{k}") for k in ENTITY_KINDS]
    counts = [F.col(f"_accounts_{k}").alias(n) for k, n in ACCOUNT_COUNT_NAMES.items()]
    return joined.select(*df.columns, *new, *counts)


def point_in_time_features(
    df: DataFrame, order: Sequence[str] = ("event_ts", "event_id"), row_id: str = "event_id",
    fallback: DataFrame | None = None,
) -> DataFrame:
    """The causal account and entity features with the log and clock transforms."""
    _require(df, d.HISTORY_REQUIRED)
    require_clean(d.HISTORY_NUMERIC_FEATURES + d.HISTORY_CATEGORICAL_FEATURES, d.HISTORY_FORBIDDEN)
    base = amount_to_prior_mean(df, "sender_account_id", order, fallback=fallback)
    full = entity_features(base, "sender_account_id", order, row_id, source=df).withColumnRenamed(
        "prior_event_count", "sender_prior_event_count"
    )
    hour_sin, hour_cos = p.cyclic_hour(p.hour_of_timestamp(F.col("event_ts")))
    logs = {
        "amount_log": "amount_inr", "session_age_log": "session_age_seconds", "account_age_log": "account_age_days",
        "beneficiary_age_log": "beneficiary_age_days", "sender_prior_event_count_log": "sender_prior_event_count",
        **{f"{n}_log": n for n in ACCOUNT_COUNT_NAMES.values()},
    }
    return full.withColumns({
        **{name: p.log1p_clipped(F.col(col)) for name, col in logs.items()},
        "event_hour_sin": hour_sin, "event_hour_cos": hour_cos,
    })


def benchmark_features(df: DataFrame, case_order: Sequence[str] = ("event_ts", "sequence")) -> DataFrame:
    """Population benchmark features; fails closed on missing or forbidden columns."""
    missing = sorted(set(d.BENCHMARK_REQUIRED).difference(df.columns))
    if missing:
        raise ValueError(f"Population dataset is missing required fields: {missing}")
    require_clean(d.BENCHMARK_NUMERIC_FEATURES + d.BENCHMARK_CATEGORICAL_FEATURES, d.BENCHMARK_FORBIDDEN)
    counted = prior_event_count(df, "case_id", ["split", *case_order], "prior_case_event_count")
    hour_sin, hour_cos = p.cyclic_hour(p.hour_of_timestamp(F.col("event_ts")))
    logs = {
        "amount_log": "amount_inr", "baseline_amount_log": "sender_baseline_amount_inr",
        "session_age_log": "session_age_seconds", "account_age_log": "account_age_days",
        "beneficiary_age_log": "beneficiary_age_days", "payment_count_log": "payment_count",
    }
    return counted.withColumns({
        **{name: p.log1p_clipped(p.attr(df, col, "double")) for name, col in logs.items()},
        "amount_to_baseline": p.clip(p.attr(df, "amount_to_baseline", "double"), 0.0, 50.0),
        "event_hour_sin": hour_sin, "event_hour_cos": hour_cos,
    })


def seconds_since_prev(df: DataFrame, key: str, order: Sequence[str], ts: str, name: str = "seconds_since_prev_event") -> DataFrame:
    """Seconds since the previous event of the key, never negative; null on the first."""
    walked = running(df, [key], order, {"_prev": Running("lag", F.col(ts))})
    return walked.withColumn(name, gap_seconds(F.col("_prev"), F.col(ts))).drop("_prev")


def gap_seconds(before: Column, after: Column) -> Column:
    micros = F.unix_micros(after.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return F.when(before.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(1e6)))


def trailing_hour(
    df: DataFrame, key: str, ts: str, tiebreak: str, row_id: str, amount: str | None = None,
    hot: HotGroups | None = None, sequence: bool = False,
) -> DataFrame:
    """Earlier events of the key in the trailing hour, and their amount with the current one.

    Both ends of the hour are inclusive. Order is (ts, tiebreak, row_id), so events at the same instant count only when they come
    earlier in the tiebreak. With ``sequence`` the tiebreak is the sequence of the key and decides alone what is earlier: an event
    that comes later in it never counts, whatever its time. Ordinary keys use a range frame. Rows of large keys are compared as
    prefix totals: everything before the row, less everything that is more than an hour older, where the older total is read at a
    probe row placed one hour back. Keys whose time runs against the sequence are counted by ``_earlier_within_hour``. Events
    without a time count nowhere and see only themselves.
    """
    # Decimals: a difference of prefix totals is then the same number as the sum of the frame.
    zero = F.lit(0).cast("decimal(28,6)")
    money = F.coalesce(F.col(amount).try_cast("decimal(28,6)"), zero) if amount else zero
    base = df.withColumns({"_us": F.unix_micros(F.col(ts).cast("timestamp")), "_m": money})
    hot = hot or find_hot(df, [key])
    cold, heavy = split_hot(base, hot)

    by_time = Window.partitionBy(key).orderBy("_us", tiebreak, row_id)
    older = Window.partitionBy(key).orderBy("_us").rangeBetween(Window.unboundedPreceding, -HOUR_MICROS - 1)
    hour = Window.partitionBy(key).orderBy("_us").rangeBetween(-HOUR_MICROS, Window.currentRow)
    peers = Window.partitionBy(key, "_us").orderBy(tiebreak, row_id).rowsBetween(1, Window.unboundedFollowing)
    count = F.row_number().over(by_time) - 1 - F.count(F.lit(1)).over(older)
    value = F.sum("_m").over(hour) - F.coalesce(F.sum("_m").over(peers), zero)
    out = cold.withColumns({"events_last_hour": count.cast("long"), "value_sum_last_hour": value})
    if heavy is not None:
        out = out.unionByName(_trailing_hour_segmented(heavy, key, tiebreak, row_id))
    timed = F.col("_us").isNotNull()  # without a time nothing is in the hour but the row itself
    backward = _keys_running_back(base, key, tiebreak, row_id, hot) if sequence else None
    if backward is not None:
        exact = _earlier_within_hour(lookup_join(base, backward, key, hot=hot), key, tiebreak, row_id)
        out = out.join(exact, F.col(row_id) == F.col("_row"), "left").withColumns({
            "events_last_hour": F.coalesce("_earlier_n", "events_last_hour"),
            "value_sum_last_hour": F.coalesce(F.col("_earlier_m") + F.col("_m"), F.col("value_sum_last_hour"))})
    result = out.select(
        *df.columns, F.when(timed, F.col("events_last_hour")).otherwise(F.lit(0).cast("long")).alias("events_last_hour"),
        F.round(F.when(timed, F.col("value_sum_last_hour")).otherwise(F.col("_m")).cast("double"), 2).alias("value_sum_last_hour_inr"))
    return result if amount else result.drop("value_sum_last_hour_inr")


def _keys_running_back(base: DataFrame, key: str, tiebreak: str, row_id: str, hot: HotGroups) -> DataFrame | None:
    """Keys with an event that is older than one before it in the sequence; None if there are none."""
    timed = base.where("_us IS NOT NULL").select(key, row_id, "_us", F.col(tiebreak).alias("_tie"))
    walked = running(timed, [key], ["_tie", row_id], {"_latest": Running("max", F.col("_us"), current=False)}, hot=hot)
    found = pin(walked.where("_latest > _us").select(key).distinct(), "backward-keys")
    return None if found.isEmpty() else found


def _earlier_within_hour(rows: DataFrame, key: str, tiebreak: str, row_id: str) -> DataFrame:
    """Row id with the number and amount of events that come earlier in the sequence and lie in the trailing hour.

    Two orders at once, solved like a merge sort. Events are put into groups of their hour and the next one, so a group holds all
    that an event of its hour can see, and numbered there by sequence. Two numbers first differ at one bit: at that level the
    smaller lies in the left half of a block and the larger in the right. So at each level every event of a right half counts
    the events of its left half by time alone, as a difference of prefix totals at the event and at a probe an hour back.
    A group larger than a task should hold is numbered and summed in segments.
    """
    hour = F.floor(F.col("_us") / HOUR_MICROS).cast("long")
    zero = F.lit(0).cast("decimal(28,6)")
    timed = rows.where("_us IS NOT NULL").select(
        F.col(row_id).alias("_row"), "_us", "_m", F.col(tiebreak).alias("_tie"), F.col(key).cast("string").alias("_key"), hour.alias("_hour"))
    copies = F.explode(F.array(F.struct(F.col("_hour").alias("at"), F.lit(True).alias("asks")), F.struct((F.col("_hour") + 1).alias("at"), F.lit(False).alias("asks"))))
    spread = timed.withColumn("_c", copies).select(
        "_row", "_us", "_m", "_tie", "_c.asks", F.concat("_key", F.lit("|"), F.col("_c.at").cast("string")).alias("_group"))
    numbered = pin(group_rank(spread, ["_group"], ["_tie", "_row"], "_n").withColumn("_n", F.col("_n") - 1), "numbered")
    last = numbered.groupBy("_group").agg(F.max("_n").alias("_last"))
    sized = lookup_join(numbered, last, "_group")
    # The left half of level k counts if its right half begins within the group; right halves count for rows that ask.
    levels = F.expr(
        "filter(sequence(0, length(bin(_last)) - 1), k -> if((shiftright(_n, k) & 1) = 1, asks, ((shiftright(_n, k) | 1) * shiftleft(1L, k)) <= _last))")
    dealt = sized.select("_row", "_us", "_m", "_group", "_n", F.explode(levels).alias("_level")).select(
        "_row", "_us", "_m", "_group", "_level", F.expr("shiftright(_n, _level + 1)").alias("_block"),
        (F.expr("shiftright(_n, _level) & 1") == 1).alias("_right"))
    left = dealt.where("NOT _right").select("_row", "_us", "_m", "_group", "_level", "_block", F.lit(1).alias("_kind"), F.lit(1).cast("long").alias("_one"))
    asked = dealt.where("_right").withColumn("_m", zero).withColumn("_one", F.lit(0).cast("long"))
    # At one instant: probes see what is strictly older, events what is as old.
    here = asked.withColumn("_kind", F.lit(2)).select(left.columns)
    probe = asked.withColumn("_kind", F.lit(0)).withColumn("_us", F.col("_us") - HOUR_MICROS).select(left.columns)
    walked = running(left.unionByName(here).unionByName(probe), ["_group", "_level", "_block"], ["_us", "_kind", "_row"], {
        "_count": Running("sum", F.col("_one")), "_sum": Running("sum", F.col("_m"))}).where("_kind <> 1")
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    seen = walked.groupBy("_row").agg(F.sum(F.col("_count") * sign).alias("_earlier_n"), F.sum(F.col("_sum") * sign).cast("decimal(28,6)").alias("_earlier_m"))
    # The first event of a group asks nothing, and yet has no earlier one.
    return timed.select("_row").join(seen, "_row", "left").select("_row", F.coalesce("_earlier_n", F.lit(0)).alias("_earlier_n"), F.coalesce("_earlier_m", zero).alias("_earlier_m"))


def _trailing_hour_segmented(heavy: DataFrame, key: str, tiebreak: str, row_id: str) -> DataFrame:
    narrow = heavy.select(key, row_id, "_us", F.col(tiebreak).alias("_tie"), "_m")
    events = narrow.select("*", F.lit(1).alias("_kind"), F.lit(1).alias("_one"))
    # A probe sorts before all events of its instant: it sees strictly older rows only.
    probes = narrow.select(
        key, row_id, (F.col("_us") - HOUR_MICROS).alias("_us"), "_tie", F.lit(0).cast("decimal(28,6)").alias("_m"),
        F.lit(0).alias("_kind"), F.lit(0).alias("_one"),
    )
    walked = running(events.unionByName(probes), [key], ["_us", "_kind", "_tie", row_id], {
        "_n": Running("sum", F.col("_one")), "_v": Running("sum", F.col("_m")),
    })
    at_event, at_probe = F.col("_kind") == 1, F.col("_kind") == 0
    spans = walked.groupBy(F.col(row_id).alias("_row")).agg(
        F.max(F.when(at_event, F.col("_n"))).alias("_n1"), F.max(F.when(at_probe, F.col("_n"))).alias("_n0"),
        F.max(F.when(at_event, F.col("_v"))).alias("_v1"), F.max(F.when(at_probe, F.col("_v"))).alias("_v0"),
    )
    return heavy.join(spans, F.col(row_id) == F.col("_row")).select(
        *heavy.columns,
        (F.col("_n1") - 1 - F.coalesce("_n0", F.lit(0))).cast("long").alias("events_last_hour"),
        (F.col("_v1") - F.coalesce("_v0", F.lit(0).cast("decimal(28,6)"))).alias("value_sum_last_hour"),
    )


def distinct_prior(
    df: DataFrame, key: str, fields: Mapping[str, str], order: Sequence[str], row_id: str,
    hot: HotGroups | None = None, placed: bool = False,
) -> DataFrame:
    """Distinct non-null values of each field among strictly earlier events of the key.

    ``fields`` maps output names to columns. Ordinary keys are placed once and flag first uses with
    windows on that placement (``placed`` says the rows already are). For large keys, first uses come
    from an aggregation over the rows that carry a value, joined back by row id, and the counts run
    over segments.
    """
    hot = hot or find_hot(df, [key])
    cold, heavy = split_hot(df, hot)
    sums = {name: Running("sum", F.col(f"_new_{name}"), current=False) for name in fields}
    flagged = cold if placed else cold.repartition(key)
    for name, col in fields.items():
        first = F.row_number().over(Window.partitionBy(key, col).orderBy(*order)) == 1
        flagged = flagged.withColumn(f"_new_{name}", (F.col(col).isNotNull() & first).cast("long"))
    nothing_hot = HotGroups((key,), 0, None)
    walked = running(flagged, [key], order, sums, hot=nothing_hot)
    if heavy is not None:
        marked = _first_uses(heavy, key, fields, order, row_id)
        walked = walked.unionByName(running(marked, [key], order, sums, hot=hot))
    return walked.select(*df.columns, *[F.coalesce(name, F.lit(0)).alias(name) for name in fields])


def _first_uses(heavy: DataFrame, key: str, fields: Mapping[str, str], order: Sequence[str], row_id: str) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias("_field"), F.col(col).cast("string").alias("_value")) for name, col in fields.items()]
    extra = list(dict.fromkeys([key, row_id, *order]))
    long = heavy.select(*extra, F.explode(F.array(*pairs)).alias("_p")).select(*extra, "_p._field", "_p._value")
    firsts = first_occurrence(
        long.where(F.col("_value").isNotNull()), [key, "_field", "_value"], order, ["_field", row_id], "_new"
    )
    flags = firsts.where("_new").groupBy(F.col(row_id).alias("_row")).agg(*[
        F.max((F.col("_field") == name).cast("long")).alias(f"_new_{name}") for name in fields
    ])
    joined = heavy.join(flags, F.col(row_id) == F.col("_row"), "left").drop("_row")
    return joined.fillna(0, [f"_new_{name}" for name in fields])


def cumulative_session_risk(
    df: DataFrame, case: str, order: Sequence[str], score: str, threshold: float | None = None, hot: HotGroups | None = None
) -> DataFrame:
    """Highest score of the case so far, and whether it reaches the threshold."""
    walked = running(df, [case], order, {"cumulative_risk": Running("max", F.col(score))}, hot=hot)
    above = F.col("cumulative_risk") >= threshold if threshold is not None else F.lit(False)
    return walked.withColumn("above_threshold", above)


DISTINCT_FIELDS = {
    "distinct_beneficiaries_prior": "beneficiary_id", "distinct_devices_prior": "device_id",
    "distinct_networks_prior": "network_id",
}


def chain_feature_frame(df: DataFrame, ts: str = "occurred_at", keep: Sequence[str] = ()) -> DataFrame:
    """The allowlisted chain features, one row per event.

    Rows without a chain are chains of their own. Attribute columns the table lacks become nulls.
    """
    require_clean(d.CHAIN_FEATURES, d.CHAIN_FORBIDDEN)
    keep = list(keep)
    have = set(df.columns)
    base = df.withColumns({
        "_chain": F.coalesce(F.col("chain_id").cast("string"), F.concat(F.lit("solo_"), F.col("event_id").cast("string"))),
        "_seq": F.coalesce(F.col("sequence"), F.lit(0)),
        "_ts": F.to_timestamp(F.col(ts)) if dict(df.dtypes)[ts] == "string" else F.col(ts),
        "_amount": p.attr(df, "amount_inr", "double"),
        **{c: F.lit(None).cast("string") for c in DISTINCT_FIELDS.values() if c not in have},
    })
    hot = find_hot(base, ["_chain"])
    order = ["_seq", "event_id"]
    walked = running(base, ["_chain"], order, {
        "prior_event_count": Running("count", current=False), "_prev": Running("lag", F.col("_ts")),
    }, hot=hot)
    hourly = trailing_hour(walked, "_chain", "_ts", "_seq", "event_id", "_amount", hot=hot, sequence=True)
    full = distinct_prior(hourly, "_chain", DISTINCT_FIELDS, order, "event_id", hot=hot, placed=True)
    hour, weekday = p.calendar_parts(F.col("_ts"))
    full = full.withColumns({
        "seconds_since_prev_event": gap_seconds(F.col("_prev"), F.col("_ts")),
        "hour_of_day": hour, "day_of_week": weekday,
    })
    return p.coerce_features(full, d.CHAIN_NUMERIC_FEATURES, d.CHAIN_CATEGORICAL_FEATURES, keep=["event_id", *keep])
