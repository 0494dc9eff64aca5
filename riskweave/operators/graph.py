"""Graph features of payment events: shared infrastructure, money two hops upstream, circular flows, community risk.

Graphs are edge tables. A node that a large part of all rows touch is the rule here, not the exception, so nothing collects the
neighbours of a node: per-node values are aggregates with a map-side part, and joins that bring a value of a node back to its edges
go through ``ordered.lookup_join``, which keeps the edges of hot nodes where they are. Iterations store each round in the shared folder.

Features of an event use earlier events only: the graph of the last closed period (components), connections strictly before the
event (fan-in, flows), or a graph fixed before the events and positives before each of them (community risk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordered import Running, lookup_join, running
from riskweave.session import HOT_GROUP_ROWS, int_conf, pin

INFRASTRUCTURE = {"account": "sender_account_id", "device": "device_id", "ip": "ip_prefix", "beneficiary": "beneficiary_id"}
#: A fixpoint needs few rounds; more than this many means the input is no set of edges.
MAX_ROUNDS = 1_000


@dataclass(frozen=True)
class Fixpoint:
    """Result of an iteration and the number of rounds it took."""

    frame: DataFrame
    rounds: int


def _fingerprint(df: DataFrame) -> tuple:
    hashed = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return tuple(df.agg(F.count(F.lit(1)), F.sum(hashed)).first())


# Components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> Fixpoint:
    """node and component (its least node) of an undirected graph, by large-star and small-star steps.

    An edge is kept as (child, parent) with the parent the smaller one. Large-star hangs the larger neighbours of every node on
    the least node it knows, small-star hangs a child's parents on the least of them; both keep the components and never add
    edges. Rounds grow with the logarithm of the longest path. Edges with a null end are ignored, self-loops name a node.
    """
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    known = pin(known.distinct(), "edges")
    links = pin(known.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct(), "links")
    state, rounds = _fingerprint(links), 0
    while True:
        links = pin(_small_star(pin(_large_star(links), "large-star")), "small-star")
        rounds += 1
        reached = _fingerprint(links)
        if reached == state:
            break
        if rounds >= MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        state = reached
    nodes = known.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parents = links.select(F.col("child").alias("node"), "parent")
    return Fixpoint(nodes.join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("component")), rounds)


def _large_star(links: DataFrame) -> DataFrame:
    """Every child goes to the least node among its parent and that parent's neighbours."""
    ends = links.select(F.col("child").alias("node"), F.col("parent").alias("other")).unionByName(
        links.select(F.col("parent").alias("node"), F.col("child").alias("other")))
    least = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    joined = lookup_join(links.select(F.col("parent").alias("node"), "child"), least, "node")
    return joined.select("child", F.col("least").alias("parent")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A child and its other parents go to the least of its parents."""
    least = links.groupBy("child").agg(F.min("parent").alias("least"))
    joined = lookup_join(links, least, "child").where("parent <> least")
    moved = joined.select(F.col("parent").alias("child"), F.col("least").alias("parent"))
    return moved.unionByName(least.select("child", F.col("least").alias("parent"))).distinct()


def _period(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def _node(period: Column, kind: str, value: Column) -> Column:
    """Name of an entity in the graph of a period; null without a value."""
    return F.when(value.isNotNull(), F.concat(period.cast("string"), F.lit(f"|{kind}:"), value.cast("string")))


def infrastructure_edges(events: DataFrame, seconds: int, ts: str = "event_ts", kinds: Mapping[str, str] = INFRASTRUCTURE) -> DataFrame:
    """a, b: the account of each event with every other entity it used, in the graph of the event's period."""
    period = _period(F.col(ts), seconds)
    account, *others = [_node(period, kind, F.col(column)) for kind, column in kinds.items()]
    return events.select(account.alias("a"), F.explode(F.array(account, *others)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def component_sizes(events: DataFrame, seconds: int, ts: str = "event_ts", kinds: Mapping[str, str] = INFRASTRUCTURE) -> DataFrame:
    """node, component, component_nodes and component_accounts of every entity in the graph of every period."""
    found = pin(connected_components(infrastructure_edges(events, seconds, ts, kinds)).frame, "components")
    account = F.split_part(F.split_part("node", F.lit("|"), F.lit(2)), F.lit(":"), F.lit(1)) == next(iter(kinds))
    sizes = found.groupBy("component").agg(
        F.count(F.lit(1)).alias("component_nodes"), F.sum(account.cast("long")).alias("component_accounts"))
    return lookup_join(found, sizes, "component").select("node", "component", "component_nodes", "component_accounts")


def component_features(
    events: DataFrame, seconds: int, ts: str = "event_ts", row_id: str = "event_id", kinds: Mapping[str, str] = INFRASTRUCTURE
) -> DataFrame:
    """Event id with the size of the largest component that an entity of the event had in the period before its own.

    Entities that did not occur then count nothing; without any, both sizes are 0. An event without a time has sizes 0.
    """
    sizes = pin(component_sizes(events, seconds, ts, kinds), "component-sizes")
    before = _period(F.col(ts), seconds) - 1
    used = events.select(row_id, F.explode(F.array(*[_node(before, k, F.col(c)) for k, c in kinds.items()])).alias("node"))
    best = lookup_join(used.where("node IS NOT NULL"), sizes, "node").groupBy(row_id).agg(
        F.max(F.struct("component_accounts", "component_nodes")).alias("best"))
    zero = F.lit(0).cast("long")
    return events.select(row_id).join(best, row_id, "left").select(
        row_id, F.coalesce("best.component_accounts", zero).alias("component_accounts"),
        F.coalesce("best.component_nodes", zero).alias("component_nodes"))


# Two hops upstream


def _first_payments(events: DataFrame, payer: str, payee: str, ts: str) -> DataFrame:
    kept = events.where(F.col(payer).isNotNull() & F.col(payee).isNotNull() & F.col(ts).isNotNull() & (F.col(payer) != F.col(payee)))
    return kept.groupBy(F.col(payer).alias("payer"), F.col(payee).alias("payee")).agg(F.min(ts).alias("since"))


def wedges(first: DataFrame, limit: int | None = None) -> DataFrame:
    """source, target and the time ``since`` which some account both took from the source and paid the target.

    Pairs of payments meet at the account in the middle. Where an account has more than ``limit`` (hotGroupRows) payers or
    payees, the longer list is cut into parts by hash and the shorter one goes to every part: each task gets a part, and the
    rows that are copied are those of the smaller degree. Only the first time of a pair leaves a task.
    """
    limit = limit or int_conf(first.sparkSession, HOT_GROUP_ROWS)
    ends = first.select(F.col("payee").alias("middle"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out")).unionByName(
        first.select(F.col("payer").alias("middle"), F.lit(0).alias("n_in"), F.lit(1).alias("n_out")))
    degrees = ends.groupBy("middle").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).where("n_in > 0 AND n_out > 0")
    split = degrees.where(F.greatest("n_in", "n_out") > limit).select(
        "middle", (F.col("n_in") >= F.col("n_out")).alias("cut_in"), F.ceil(F.greatest("n_in", "n_out") / limit).cast("int").alias("parts"))
    split = F.broadcast(split)  # at most 2 * edges / limit rows

    def dealt(side: DataFrame, by: str, cut: Column) -> DataFrame:
        parts = F.coalesce("parts", F.lit(1))
        one = F.array(F.pmod(F.xxhash64(by), parts).cast("int"))
        every = F.sequence(F.lit(0), parts - 1)
        return side.join(split, "middle", "left").select(
            "middle", by, "since", F.explode(F.when(F.coalesce(cut, F.lit(True)), one).otherwise(every)).alias("part"))

    into = dealt(first.select(F.col("payee").alias("middle"), F.col("payer").alias("source"), "since"), "source", F.col("cut_in"))
    out = dealt(first.select(F.col("payer").alias("middle"), F.col("payee").alias("target"), "since"), "target", ~F.col("cut_in"))
    met = into.withColumnRenamed("since", "since_in").join(out, ["middle", "part"]).where("source <> target")
    return met.groupBy("source", "target").agg(F.min(F.greatest("since_in", "since")).alias("since"))


def two_hop_fan_in(
    events: DataFrame, payer: str = "sender_account_id", payee: str = "beneficiary_id", ts: str = "event_ts", row_id: str = "event_id"
) -> DataFrame:
    """Event id with the accounts that had paid somebody who had paid this event's payee, both strictly before the event.

    An account counts once however many ways lead from it, and the payee itself does not count. Payments to oneself and
    payments with a null party or time connect nothing; an event without payee or time gets 0.
    """
    connected = wedges(pin(_first_payments(events, payer, payee, ts), "first-payments"))
    steps = connected.groupBy("target", "since").agg(F.count(F.lit(1)).alias("n"))
    asked = events.select(F.col(payee).alias("target"), F.col(ts).alias("since"), F.lit(0).cast("long").alias("n"), F.col(row_id).alias("_row"))
    rows = steps.select("target", "since", "n", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.lit(1).alias("_kind")).unionByName(
        asked.where("target IS NOT NULL AND since IS NOT NULL").withColumn("_kind", F.lit(0)))
    # Events sort before the steps of their instant, so they see strictly earlier ones.
    walked = running(rows, ["target"], ["since", "_kind", "_row"], {"_total": Running("sum", F.col("n"))}).where("_kind = 0")
    counted = walked.select(F.col("_row").alias(row_id), F.col("_total").alias("two_hop_fan_in"))
    return events.select(row_id).join(counted, row_id, "left").select(
        row_id, F.coalesce("two_hop_fan_in", F.lit(0)).cast("long").alias("two_hop_fan_in"))


# Circular flows


def _trim(edges: DataFrame, rounds: int) -> DataFrame:
    """Drop edges whose start nothing enters or whose end nothing leaves, a few times; what is dropped lies on no cycle."""
    for _ in range(rounds):
        starts = edges.select(F.col("src").alias("dst")).distinct()
        ends = edges.select(F.col("dst").alias("src")).distinct()
        kept = lookup_join(lookup_join(edges, ends.withColumn("_in", F.lit(1)), "src"), starts.withColumn("_out", F.lit(1)), "dst")
        edges = pin(kept.select("src", "dst"), "trimmed")
    return edges


def _spread_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """A node's label becomes the largest among its own and those of the nodes that lead to it, until none changes."""
    state = _fingerprint(labels)
    for _ in range(MAX_ROUNDS):
        sent = lookup_join(edges, labels.select(F.col("node").alias("src"), "label"), "src").select(F.col("dst").alias("node"), "label")
        labels = pin(labels.unionByName(sent).groupBy("node").agg(F.max("label").alias("label")), "labels")
        reached = _fingerprint(labels)
        if reached == state:
            return labels
        state = reached
    raise RuntimeError("labels did not settle")


def strongly_connected(edges: DataFrame, src: str = "src", dst: str = "dst", trim: int = 2) -> Fixpoint:
    """node and circle (its largest node) of every node that lies on a directed cycle; the others are left out.

    Colouring: the largest node that reaches a node is its colour; the nodes of a colour from which its largest node can be
    reached again are one strongly connected part. Parts found go, edges between colours go, the rest is coloured anew. The
    rounds of one colouring follow the longest way inside a part; ``trim`` rounds first drop the ends that lie on no cycle.
    """
    live = pin(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct(), "directed")
    found, rounds = None, 0
    while True:
        live = _trim(live, trim)
        if live.isEmpty():
            break
        rounds += 1
        nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = _spread_labels(live, pin(nodes.select("node", F.col("node").alias("label")), "colours"))
        inside = lookup_join(live, colours.select(F.col("node").alias("src"), F.col("label").alias("colour")), "src")
        inside = lookup_join(inside, colours.select(F.col("node").alias("dst"), "label"), "dst").where("colour = label")
        inside = pin(inside.select("src", "dst", "label"), "inside")
        back = _reached_back(inside)
        part = back.join(back.groupBy("circle").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("circle"), "circle").select("node", "circle")
        found = part if found is None else found.unionByName(part)
        done = back.select("node")
        live = inside.select("src", "dst").join(done.withColumnRenamed("node", "src"), "src", "left_anti")
        live = pin(live.join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "left-over")
        if rounds >= MAX_ROUNDS:
            raise RuntimeError("parts did not settle")
    if found is None:
        found = live.select(F.col("src").alias("node"), F.col("dst").alias("circle"))
    return Fixpoint(found, rounds)


def _reached_back(inside: DataFrame) -> DataFrame:
    """node, circle: nodes of a colour from which its largest node is reached along edges of that colour."""
    reached = pin(inside.select(F.col("label").alias("node"), F.col("label").alias("circle")).distinct(), "roots")
    size = reached.count()
    for _ in range(MAX_ROUNDS):
        one_back = lookup_join(inside, reached.select(F.col("node").alias("dst"), "circle"), "dst").where("circle = label")
        reached = pin(reached.unionByName(one_back.select(F.col("src").alias("node"), "circle")).distinct(), "reached")
        grown = reached.count()
        if grown == size:
            return reached
        size = grown
    raise RuntimeError("nodes did not settle")


def circular_flows(
    events: DataFrame, window_seconds: int, max_hops: int = 4, payer: str = "sender_account_id", payee: str = "beneficiary_id",
    ts: str = "event_ts", row_id: str = "event_id",
) -> DataFrame:
    """Event id, whether the event closes a circular flow, and the payments of the shortest one (``flow_hops``, else null).

    A flow is a chain of payments, each by the payee of the one before and strictly later, that ends with this event at the
    account it began with, within ``window_seconds`` (inclusive) and ``max_hops`` payments. Payments to oneself and payments
    with a null party or time are no part of a flow.

    Payments outside a strongly connected part lie on no cycle and go first. Then messages (origin, when it began) travel along
    payments, one hop a round; of the messages of one origin that a payment passes on only the latest beginning matters. They
    meet payments by account and bucket of time, so an account with many payments is split by time.
    """
    span = window_seconds * 1_000_000
    moved = events.select(
        F.col(row_id).alias("id"), F.col(payer).alias("src"), F.col(payee).alias("dst"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")
    ).where("src IS NOT NULL AND dst IS NOT NULL AND at IS NOT NULL AND src <> dst")
    circles = pin(strongly_connected(moved).frame, "circles")
    moved = lookup_join(moved, circles.select(F.col("node").alias("src"), F.col("circle").alias("_a")), "src")
    moved = lookup_join(moved, circles.select(F.col("node").alias("dst"), F.col("circle").alias("_b")), "dst").where("_a = _b")
    moved = pin(moved.select("id", "src", "dst", "at", F.floor(F.col("at") / span).cast("long").alias("bucket")), "moved")
    messages = moved.select("id", F.col("src").alias("origin"), F.col("dst").alias("src"), F.col("at").alias("began"), F.col("at").alias("last"))
    closed: list[DataFrame] = []
    for hop in range(2, max_hops + 1):
        bucket = F.floor(F.col("last") / span).cast("long")
        sent = messages.select("origin", "src", "began", "last", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
        met = sent.join(moved, ["src", "bucket"]).where((F.col("at") > F.col("last")) & (F.col("at") - F.col("began") <= span))
        passed = pin(met.groupBy("id", "dst", "at", "origin").agg(F.max("began").alias("began")), "messages")
        closed.append(passed.where("dst = origin").select("id", F.lit(hop).alias("hops")))
        messages = passed.where("dst <> origin").select("id", "origin", F.col("dst").alias("src"), "began", F.col("at").alias("last"))
    shortest = closed[0]
    for more in closed[1:]:
        shortest = shortest.unionByName(more)
    shortest = shortest.groupBy(F.col("id").alias(row_id)).agg(F.min("hops").alias("flow_hops"))
    return events.select(row_id).join(shortest, row_id, "left").select(
        row_id, F.col("flow_hops").isNotNull().alias("closes_flow"), "flow_hops")


# Communities


def weighted_edges(events: DataFrame, account: str = "sender_account_id", others: Sequence[str] = ("device_id", "beneficiary_id")) -> DataFrame:
    """a, b, weight: accounts with the entities they used, weighted by events. Names carry the column's kind."""
    def name(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{column}:"), F.col(column).cast("string")))

    pairs = events.select(name(account).alias("a"), F.explode(F.array(*[name(o) for o in others])).alias("b"))
    return pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def label_propagation(edges: DataFrame, rounds: int, own_weight: int = 1) -> DataFrame:
    """node and label after so many synchronous rounds of weighted votes over undirected edges (a, b, weight).

    Every node starts with its own name. In a round it takes the label with the most votes among its neighbours' labels and, with
    ``own_weight``, its own; ties go to the least label. Votes are whole numbers, so rounds give the same labels everywhere.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = pin(both.where("a <> b").groupBy(F.col("a").alias("voter_of"), F.col("b").alias("node")).agg(F.sum("weight").alias("weight")), "votes")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = pin(ends.select("node", F.col("node").alias("label")), "labels")
    for _ in range(rounds):
        heard = lookup_join(both, labels, "node").select(F.col("voter_of").alias("node"), "label", "weight")
        own = labels.select("node", "label", F.lit(own_weight).cast("long").alias("weight"))
        tally = heard.unionByName(own).groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        chosen = tally.groupBy("node").agg(F.min(F.struct((-F.col("weight")).alias("less"), "label")).alias("best"))
        labels = pin(chosen.select("node", F.col("best.label").alias("label")), "labels")
    return labels


def community_risk_density(
    events: DataFrame, labels: DataFrame, account: str = "sender_account_id", positive: str = "label_fraud", ts: str = "event_ts",
    row_id: str = "event_id",
) -> DataFrame:
    """Event id, community of its account, events and positives of the community before the event, and their ratio.

    Before means earlier in time: events of the same instant do not see each other. The ratio is null without earlier events and
    for accounts without a community. A null outcome is not positive, a null time comes before all others.
    """
    named = events.select(
        F.col(row_id).alias("_row"), F.col(ts).alias("_ts"), F.coalesce(F.col(positive).cast("boolean"), F.lit(False)).cast("long").alias("_hit"),
        F.concat(F.lit(f"{account}:"), F.col(account).cast("string")).alias("node"))
    placed = lookup_join(named, labels, "node").select("_row", "_ts", "_hit", F.col("label").alias("community"))
    # One row an instant, so that equal times share what lies before them.
    instants = placed.groupBy("community", "_ts").agg(F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_hits"))
    before = running(instants, ["community"], [F.col("_ts").asc_nulls_first()], {
        "_events": Running("sum", F.col("_n"), current=False), "_positives": Running("sum", F.col("_hits"), current=False)})
    before = before.select(F.col("community").alias("_c"), F.col("_ts").alias("_t"), "_events", "_positives")
    same = (F.col("community") == F.col("_c")) & F.col("_ts").eqNullSafe(F.col("_t"))
    zero = F.lit(0).cast("long")
    seen = placed.join(before, same).select(
        F.col("_row").alias(row_id), "community", F.coalesce("_events", zero).alias("community_events"),
        F.coalesce("_positives", zero).alias("community_positives"))
    density = F.when(F.col("community_events") > 0, F.col("community_positives") / F.col("community_events"))
    return events.select(row_id).join(seen, row_id, "left").withColumn("community_risk_density", density)
