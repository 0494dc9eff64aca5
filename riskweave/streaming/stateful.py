"""Structured Streaming forms: running values per key, causal features, the case guard, logs and rollups.

Order and late data. Each micro-batch is sorted by (event time, tiebreak) inside a key before state
moves on. An event that sorts before the last one already folded for its key is late: it is emitted with
``late = true`` and null running values, leaves the state alone, and ``late_router`` writes it to a
side table; so is an event without a time. State is kept for good unless a ``ttl`` is given: then that of a key that stays silent for so much event time is
dropped, and a chain that comes back later starts again.

A key's rows of one micro-batch are folded by one task, so bound the micro-batch at the source
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.functions.scalar import attr
from riskweave.operators import drift, evidence, policy
from riskweave.operators.history import DISTINCT_FIELDS, HOUR_MICROS
from riskweave.operators.ordered import Running


def _fold_block(values: np.ndarray, how: str, carry: np.ndarray) -> np.ndarray:
    """Running values of all columns folded the same way, with the carried state as first row."""
    block = np.vstack([carry, values])
    if how == "sum":
        return np.cumsum(np.nan_to_num(block), axis=0)
    if how == "min":
        return np.fmin.accumulate(block, axis=0)
    if how == "max":
        return np.fmax.accumulate(block, axis=0)
    if how == "last":
        rows = np.where(np.isnan(block), 0, np.arange(len(block))[:, None])
        return np.take_along_axis(block, np.maximum.accumulate(rows, axis=0), axis=0)
    return block


def _millionths(amount: float) -> int:
    return round(amount * 1e6)


def _extend_hour(events: Sequence[tuple[int, float]], tail: list[list[float]]) -> tuple[list[int], list[float], list[list[float]]]:
    """Earlier rows within the hour and their amount, for each ordered (time, amount); the tail holds the same."""
    counts, sums, start = [], [], 0
    held = sum(_millionths(a) for _, a in tail)  # whole numbers: what goes out is exactly what came in
    for us, amount in events:
        while start < len(tail) and tail[start][0] < us - HOUR_MICROS:
            held -= _millionths(tail[start][1])
            start += 1
        counts.append(len(tail) - start)
        held += _millionths(amount)
        sums.append(held / 1e6)
        tail.append([us, amount])
    return counts, sums, tail[start:]


def _packed(columns: Sequence[tuple[str, T.DataType]]) -> tuple[Column, Callable[[Column], list[Column]]]:
    """Columns as one JSON text, and how to read them from it. Times are microseconds there."""
    def shaped(kind: T.DataType) -> T.DataType:
        return T.LongType() if isinstance(kind, T.TimestampType) else kind

    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    whole = F.struct(*[(F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.col(c)).alias(f"c{i}") for i, (c, kind) in enumerate(columns)])
    schema = T.StructType([T.StructField(f"c{i}", shaped(kind)) for i, (_, kind) in enumerate(columns)])

    def unpacked(text: Column) -> list[Column]:
        row = F.from_json(text, schema, options)
        return [(F.timestamp_micros(row[f"c{i}"]) if isinstance(kind, T.TimestampType) else row[f"c{i}"]).alias(c) for i, (c, kind) in enumerate(columns)]

    return F.to_json(whole, options), unpacked


def stream_running(
    df: DataFrame, key: str, ts: str, tiebreak: str, aggs: Mapping[str, Running],
    distinct: Mapping[str, str] | None = None, hour_amount: str | None = None, ttl: str | None = None, watermark: str = "1 hour",
    keep: Sequence[str] | None = None, buckets: int | None = None,
) -> DataFrame:
    """The streaming counterpart of ``ordered.running``: numeric running values per key.

    ``distinct`` maps output names to columns whose distinct earlier values are counted;
    ``hour_amount`` adds events_last_hour and value_sum_last_hour_inr. All values are doubles, NaN where
    there is none. An event crosses to Python and back as one text; ``keep`` limits the event
    columns that travel with it (key, time and tiebreak always do).

    A call of Python per key costs far more than folding a few events. With ``buckets`` the keys are dealt to so many groups by
    hash, and one call folds all keys of a group; each still has a state of its own. A group's state is stored as a whole when
    one of its keys has events, so buckets suit micro-batches that touch many keys (a backfill), not a trickle.
    """
    distinct = dict(distinct or {})
    spec = {name: ("sum" if agg.how == "count" else agg.how, agg.current and agg.how != "lag") for name, agg in aggs.items()}
    groups: dict[tuple[str, bool], list[int]] = {}
    for place, kind in enumerate(spec.values()):
        groups.setdefault(kind, []).append(place)
    hourly = ["events_last_hour", "value_sum_last_hour_inr"] if hour_amount else []
    added = [*spec, *distinct, *hourly]
    kept = list(dict.fromkeys([key, ts, tiebreak, *(df.columns if keep is None else keep)]))
    inputs = [(F.lit(1) if a.how == "count" else a.expr).cast("double") for a in aggs.values()]
    event = F.struct(
        (F.lit("") if buckets is None else F.col(key).cast("string")).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tiebreak).alias("tie"),
        F.array(*inputs).cast("array<double>").alias("given"), F.array(*[attr(df, c, "string") for c in distinct.values()]).cast("array<string>").alias("texts"),
        (F.coalesce(attr(df, hour_amount, "double"), F.lit(0.0)) if hour_amount else F.lit(0.0)).alias("amount"),
    )
    passed, unpacked = _packed([(c, df.schema[c].dataType) for c in kept])
    group = F.col(key) if buckets is None else F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("string")
    shaped = df.select(  # JSON has no plain line break, so the first one parts the event from the columns that pass through
        group.alias("_group"), F.concat_ws("\n", F.to_json(event), passed).alias("_event"), F.col(ts).cast("timestamp").alias("_time"),
    ).withWatermark("_time", watermark)
    schema = "_kept string, _values array<double>, late boolean"
    ttl_ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    width = len(added)

    def values_of(events: list[dict], memory: dict) -> np.ndarray:
        out = np.full((len(events), width), np.nan)
        given = np.array([e["given"] for e in events], dtype=float)
        carried = np.array(memory["carry"], dtype=float)
        for (how, current), places in groups.items():
            block = _fold_block(given[:, places], how, carried[places])
            carried[places] = block[-1]
            out[:, places] = block[1:] if current else block[:-1]
        memory["carry"] = carried.tolist()
        for offset, name in enumerate(distinct):
            seen = set(memory["seen"][name])
            for row, e in enumerate(events):
                out[row, len(spec) + offset] = len(seen)
                if e["texts"][offset] is not None:
                    seen.add(e["texts"][offset])
            memory["seen"][name] = sorted(seen)
        if hour_amount:
            counts, sums, memory["tail"] = _extend_hour([(e["us"], float(e["amount"])) for e in events], memory["tail"])
            out[:, width - 2], out[:, width - 1] = counts, np.round(sums, 2)
        return out

    def fold_key(events: list[dict], memory: dict) -> tuple[list[dict], list, list[bool]]:
        """Events in order, late ones and those without a time last; their values; which are late."""
        last = memory["last"]
        on_time = [e for e in events if "us" in e and (last is None or (e["us"], e["tie"]) > (last[0], last[1]))]
        on_time.sort(key=lambda e: (e["us"], e["tie"]))
        left = {id(e) for e in on_time}
        late = [e for e in events if id(e) not in left]
        values = values_of(on_time, memory).tolist() if on_time else []
        if on_time:
            memory["last"] = [on_time[-1]["us"], on_time[-1]["tie"]]
        return on_time + late, values + [[np.nan] * width] * len(late), [False] * len(on_time) + [True] * len(late)

    def fold(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The serializer joins the frames of many keys and warns once per empty one.
        warnings.simplefilter("ignore", FutureWarning)
        memories = dict(json.loads(state.get[0])) if state.exists else {}
        arrived: dict[str | None, list[dict]] = {}
        for chunk in () if state.hasTimedOut else chunks:
            for text in chunk["_event"]:
                head, tail = text.split("\n", 1)
                event = json.loads(head)
                event["kept"] = tail
                arrived.setdefault(event.get("key"), []).append(event)
        rows, values, late = [], [], []
        for name, events in arrived.items():
            fresh = {"last": None, "carry": [float("nan")] * len(spec), "seen": {n: [] for n in distinct}, "tail": []}
            memory = memories.get(name, fresh)
            for part, more in zip((rows, values, late), fold_key(events, memory), strict=True):
                part.extend(more)
            if memory["last"] is not None:
                memories[name] = memory
        if ttl_ms is not None:
            now = state.getCurrentWatermarkMs()
            for name in arrived.keys() & memories.keys():  # a time that has passed already is due at the next one the watermark reaches
                memories[name]["due"] = max(memories[name]["last"][0] // 1000 + ttl_ms, now + 1)
            memories = {name: memory for name, memory in memories.items() if name in arrived or memory["due"] >= now}
        if memories:
            state.update((json.dumps(list(memories.items())),))
            if ttl_ms is not None:
                state.setTimeoutTimestamp(max(min(m["due"] for m in memories.values()), now + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame({"_kept": [e["kept"] for e in rows], "_values": values, "late": late})

    walked = shaped.groupBy("_group").applyInPandasWithState(fold, schema, "memory STRING", "append", GroupStateTimeout.EventTimeTimeout)
    read = walked.select(*unpacked(F.col("_kept")), "_values", "late")
    return read.select(*kept, *[F.col("_values")[i].alias(n) for i, n in enumerate(added)], "late")


def stream_point_in_time_features(df: DataFrame, chain: str, ts: str, tiebreak: str, amount: str | None = "amount_inr", **options) -> DataFrame:
    """ST1: the chain features of the batch form, computed once per arriving event."""
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    aggs = {"prior_event_count": Running("count", current=False), "_prev_us": Running("lag", micros)}
    walked = stream_running(df, chain, ts, tiebreak, aggs, DISTINCT_FIELDS, amount, **options)
    gap = F.greatest(F.lit(0.0), (F.unix_micros(F.col(ts).cast("timestamp")) - F.col("_prev_us")) / F.lit(1e6))
    present = lambda c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c))
    count = F.when(F.col("late"), F.lit(None)).otherwise(F.coalesce(present("prior_event_count"), F.lit(0.0)))
    return walked.withColumns({
        "prior_event_count": count,
        "seconds_since_prev_event": F.when(present("_prev_us").isNotNull(), gap),
    }).drop("_prev_us")


def stream_case_guard(
    df: DataFrame, case: str, ts: str, tiebreak: str, score: str | None = None, threshold: float | None = None,
    keep: Sequence[str] | None = None, **options
) -> DataFrame:
    """ST2: guard, session risk and open alert of each event, from the same rules as the batch guard.

    Only the running values live in state; rules, scores and actions are the shared column
    expressions. With an ``action`` column (and ``has_legitimate_context``) the open alert before the
    event is carried as well.
    """
    signals = evidence._signals(df, ts)
    aggs = {n: Running(how, e.cast("double")) for n, (how, e) in signals.items()}
    if score is not None:
        aggs["cumulative_risk"] = Running("max", F.col(score))
    if "action" in df.columns:
        rank = policy.action_rank(F.col("action"))
        mark = F.when(policy.resolves(df), F.lit(-1)).when(F.col("action").isin("step_up", "hold", "block"), rank)
        aggs["_open"] = Running("last", mark.cast("double"), current=False)
    current = df.withColumns({
        "cur_repeat": evidence._flag((F.col("event_type") == "PAYMENT_REPEATED") | (F.coalesce(attr(df, "payment_count", "int"), F.lit(1)) > 1)),
        "cur_accelerated": evidence._flag(attr(df, "accelerated_settlement", "boolean")),
    })
    needed = ["event_type", "lifecycle_phase", "cur_repeat", "cur_accelerated"]
    if keep is not None:
        options["keep"] = [*keep, *needed]
    state = stream_running(current, case, ts, tiebreak, aggs, **options)
    typed = {}
    for n, (how, _) in signals.items():
        value = F.when(~F.isnan(n), F.col(n))
        if n.startswith("s_latest_"):
            typed[n] = value.cast("boolean")
        elif n in ("s_ratio", "s_value"):
            typed[n] = value
        else:
            typed[n] = value.cast("long")
    out = state.withColumns(typed)
    if score is not None and threshold is not None:
        out = out.withColumn("above_threshold", F.col("cumulative_risk") >= threshold)
    if "_open" in aggs:
        opened = F.when((F.col("_open") >= 0) & ~F.isnan("_open"), policy.action_of_rank(F.col("_open")))
        out = out.withColumn("unresolved_alert", opened).drop("_open")
    return evidence.minimum_action(evidence.guarded_score(evidence.risk_indicators(out)))


def late_router(on_time: Callable[[DataFrame, int], None], late_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: late rows go to a side table per batch, the rest to ``on_time``."""
    def route(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.where("late").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        on_time(kept.where("NOT late").drop("late"), batch_id)
        kept.unpersist()

    return route


def stream_adwin(series: DataFrame, keys: Sequence[str], order: str, value: str, delta: float = 0.002, most: int = 5) -> DataFrame:
    """The adaptive windows of the batch form over a stream of periods; a period not after the last one folded is ``late`` and adds nothing.

    State is the window's buckets as two arrays, a few dozen numbers a key, and the last period. It never expires.
    """
    keys = list(keys)
    schema = T.StructType([*drift.adwin_schema(series.schema).fields, T.StructField("late", T.BooleanType())])

    def fold(_, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sums, counts = state.get if state.exists else (None, [], [])
        rows = pd.concat(list(chunks)).sort_values(order, kind="stable")  # one micro-batch of periods
        late = (rows[order] <= last) if last is not None else pd.Series(False, index=rows.index)
        late |= rows[order].duplicated()
        known, window = drift.adwin_fold(rows[~late], value, list(zip(sums, counts, strict=True)), delta, most)
        if len(known):
            state.update((int(known[order].iloc[-1]), [float(s) for s, _ in window], [int(c) for _, c in window]))
        yield pd.concat([known.assign(late=False), rows[late].assign(window_size=None, window_mean=None, drift=None, late=True)])[schema.names]

    return series.groupBy(*keys).applyInPandasWithState(
        fold, schema, "last LONG, sums ARRAY<DOUBLE>, counts ARRAY<LONG>", "append", GroupStateTimeout.NoTimeout)


def label_log_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: one folder per batch, overwritten on a retry, so a batch is logged once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def stream_label_log(rows: DataFrame, path: str, checkpoint: str, ts: str, delay: str = "1 day"):
    """ST3: append post-outcome rows once per event; starts the query and returns it."""
    unique = rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])
    return (
        unique.writeStream.foreachBatch(label_log_writer(path)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_rollups(events: DataFrame, ts: str = "event_ts", width: str = "1 day", slide: str | None = None, delay: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """ST4: legitimate and fraud counts per window, final once the watermark has passed; ``run_latest`` gives open windows too."""
    window = F.window("_time", width, slide) if slide else F.window("_time", width)
    timed = events.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", delay)
    return timed.groupBy(window.alias("w"), *by).agg(
        F.count_if(~F.col("label_fraud")).alias("legitimate"), F.count_if("label_fraud").alias("fraud"),
        F.round(F.sum("amount_inr"), 2).alias("amount"),
    ).select(F.col("w.start").alias("window_start"), *by, "legitimate", "fraud", "amount")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what the source holds now into Parquet and return the written table."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_latest(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Process what the source holds now and return every key's latest row, those of windows the watermark leaves open too.

    Each micro-batch stores the rows it changed in a folder of its own, overwritten on a retry; the highest batch of a key counts.
    """
    spark, values = stream.sparkSession, [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")  # there is a table even if nothing came
    changed = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    latest = changed.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])
