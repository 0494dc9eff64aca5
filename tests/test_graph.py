"""Graph features against plain versions, with hubs above the hot limit, ties in time, nulls, repeated rows and empty tables."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.operators import graph as g

START = datetime(2025, 2, 3, 4)
EVENTS = "event_id long, event_ts timestamp, sender_account_id long, beneficiary_id long, device_id long, ip_prefix long, label_fraud boolean"


def components_of(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def found_components(spark, edges, kind="long"):
    out = g.connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}"))
    return {r["node"]: r["component"] for r in out.frame.collect()}, out.rounds


def payments(rng, n, accounts=12, hub=0.3):
    rows = []
    for i in range(n):
        def who():
            return 0 if rng.random() < hub else rng.randrange(accounts)
        rows.append((
            i, START + timedelta(minutes=10 * rng.randrange(n // 2)) if rng.random() > 0.03 else None, who(),
            None if rng.random() < 0.03 else who(), None if rng.random() < 0.1 else rng.randrange(9), rng.randrange(6), rng.random() < 0.2))
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_components_of_random_graphs_with_a_hub(spark, request, hot):
    if hot:
        request.getfixturevalue("small_groups")
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(250, rng.randrange(1000, 1100)) for _ in range(70)]
    edges += edges[:20] + [(b, a) for a, b in edges[:20]] + [(7, 7), (9999, 9999)]
    got, _ = found_components(spark, edges + [(None, 3), (4, None)])
    assert got == components_of(edges)


def test_rounds_grow_with_the_logarithm_of_a_path(spark):
    ids = list(range(200))
    random.Random(5).shuffle(ids)
    got, rounds = found_components(spark, list(zip(ids, ids[1:])))
    assert set(got.values()) == {0} and len(got) == 200
    assert rounds <= 2 * math.log2(200) + 2


def test_components_of_text_nodes_and_of_nothing(spark):
    got, rounds = found_components(spark, [("d:9", "a:1"), ("d:9", "a:2"), ("b:1", "b:1")], "string")
    assert got == {"d:9": "a:1", "a:1": "a:1", "a:2": "a:1", "b:1": "b:1"} and rounds <= 3
    assert found_components(spark, [])[0] == {}


def test_a_hub_with_a_third_of_the_rows_is_joined_where_its_rows_are(spark, small_groups):
    """With the hub hot, its rows never pass an exchange by key: the plan joins them with a broadcast."""
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(300)], "node long, other long")
    table = rows.select("node").distinct().withColumn("value", F.col("node") * 2)
    joined = g.lookup_join(rows, table, "node")
    assert {(r["node"], r["other"], r["value"]) for r in joined.collect()} == {(0 if i % 3 == 0 else i, i, 0 if i % 3 == 0 else 2 * i) for i in range(300)}
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_component_features_see_the_period_before(spark):
    rows = payments(random.Random(8), 200)
    rows += rows[:3]
    events = spark.createDataFrame(rows, EVENTS).withColumn("node", F.lit("clash")).dropDuplicates(["event_id"])
    rows = rows[:200]

    def entities(r, period):
        return [(period, k, v) for k, v in zip("abcd", (r[2], r[4], r[5], r[3])) if v is not None]

    def period(r):
        return None if r[1] is None else int((r[1] - datetime(1970, 1, 1)).total_seconds() // 3600)

    edges = [(e, entities(r, period(r))[0]) for r in rows if r[1] is not None for e in entities(r, period(r))]
    whole = components_of(edges)
    members = defaultdict(set)
    for node, root in whole.items():
        members[root].add(node)
    sizes = {node: (sum(n[1] == "a" for n in members[root]), len(members[root])) for node, root in whole.items()}
    got = {r[0]: (r[1], r[2]) for r in g.component_features(events, 3600).collect()}
    for r in rows:
        before = [sizes.get(e, (0, 0)) for e in entities(r, period(r) - 1)] if r[1] is not None else []
        assert got[r[0]] == max(before, default=(0, 0))
    assert len({v for v in got.values()}) > 3


@pytest.mark.parametrize("limit", [3, 1000])
def test_wedges_and_two_hop_fan_in(spark, limit):
    rng = random.Random(11)
    rows = payments(rng, 160)
    first = {}
    for r in rows:
        if r[1] is not None and r[3] is not None and r[2] != r[3]:
            first[r[2], r[3]] = min(first.get((r[2], r[3]), r[1]), r[1])
    pairs = {}
    for (u, m), t in first.items():
        for (m2, b), t2 in first.items():
            if m == m2 and u != b:
                pairs[u, b] = min(pairs.get((u, b), datetime.max), max(t, t2))
    frame = spark.createDataFrame([(u, m, t) for (u, m), t in first.items()], "payer long, payee long, since timestamp")
    assert {(r["source"], r["target"]): r["since"] for r in g.wedges(frame, limit).collect()} == pairs
    spark.conf.set("spark.riskweave.hotGroupRows", str(limit))
    try:
        got = {r[0]: r[1] for r in g.two_hop_fan_in(spark.createDataFrame(rows, EVENTS)).collect()}
    finally:
        spark.conf.unset("spark.riskweave.hotGroupRows")
    want = {r[0]: sum(b == r[3] and r[1] is not None and t < r[1] for (_, b), t in pairs.items()) for r in rows}
    assert got == want and max(want.values()) > 3


def test_a_hub_in_the_middle_is_dealt_to_many_tasks(spark):
    """90 payers and 40 payees of one account: no part holds more than the limit of the longer list."""
    rows = [(i, 1000, START) for i in range(90)] + [(1000, 2000 + i, START) for i in range(40)]
    first = spark.createDataFrame(rows, "payer long, payee long, since timestamp")
    assert g.wedges(first, 10).count() == 90 * 40
    assert g.wedges(first.where("payer < 1000"), 10).count() == 0


def strong_parts(edges):
    nodes = {x for e in edges for x in e}
    reach = {x: {x} for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for x in nodes:
                if a in reach[x] and b not in reach[x]:
                    reach[x].add(b)
                    changed = True
    out = {}
    for x in nodes:
        part = {y for y in reach[x] if x in reach[y]}
        if len(part) > 1:
            out[x] = max(part)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strongly_connected_parts(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(36)] + [(40, 41), (41, 42), (42, 40), (42, 43), (50, 50)]
    got = g.strongly_connected(spark.createDataFrame(edges, "src long, dst long"), trim=seed % 2)
    assert {r["node"]: r["circle"] for r in got.frame.collect()} == strong_parts([e for e in edges if e[0] != e[1]])


def plain_flows(rows, window, most):
    moved = [(r[0], r[2], r[3], r[1]) for r in rows if r[1] is not None and r[3] is not None and r[2] != r[3]]
    best = {}

    def go(origin, holder, began, last, hops):
        for i, a, b, t in moved:
            if a == holder and t > last and t - began <= window:
                if b == origin:
                    best[i] = min(best.get(i, 99), hops + 1)
                elif hops + 1 < most:
                    go(origin, b, began, t, hops + 1)

    for _, a, b, t in moved:
        go(a, b, t, t, 1)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_circular_flows_with_ties_in_time(spark, seed):
    rng = random.Random(seed)
    rows = payments(rng, 70, accounts=9)
    # Both payments of an instant: no flow; one microsecond later: a flow; exactly at the window's end: a flow; beyond: none.
    at = START + timedelta(days=50)
    for k, later in enumerate((timedelta(0), timedelta(microseconds=1), timedelta(hours=2), timedelta(hours=2, microseconds=1))):
        rows += [(900 + 2 * k, at + timedelta(days=k), 500 + k, 600 + k, 1, 1, False), (901 + 2 * k, at + timedelta(days=k) + later, 600 + k, 500 + k, 1, 1, False)]
    want = plain_flows(rows, timedelta(hours=2), 4)
    got = g.circular_flows(spark.createDataFrame(rows, EVENTS), 7200, 4).collect()
    assert {r["event_id"]: r["flow_hops"] for r in got if r["closes_flow"]} == want
    assert len(got) == len(rows) and {901, 903, 905, 907} & set(want) == {903, 905}
    assert all(r["closes_flow"] == (r["flow_hops"] is not None) for r in got)


def test_no_flow_without_a_cycle(spark):
    rows = [(i, START + timedelta(minutes=i), i, i + 1, 1, 1, False) for i in range(12)]
    events = spark.createDataFrame(rows, EVENTS)
    assert [r["closes_flow"] for r in g.circular_flows(events, 7200).collect()] == [False] * 12
    assert g.circular_flows(events.limit(0), 7200).count() == 0


def plain_votes(edges, rounds, own):
    near = defaultdict(Counter)
    for a, b, w in edges:
        if a != b:
            near[a][b] += w
            near[b][a] += w
    labels = {x: x for a, b, _ in edges for x in (a, b)}
    for _ in range(rounds):
        new = {}
        for x, label in labels.items():
            votes = Counter()
            votes[label] += own
            for y, w in near[x].items():
                votes[labels[y]] += w
            new[x] = min(votes, key=lambda v: (-votes[v], v))
        labels = new
    return labels


@pytest.mark.parametrize("hot", [False, True])
def test_votes_equal_a_plain_loop(spark, request, hot):
    if hot:
        request.getfixturevalue("small_groups")
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.randrange(1, 4)) for _ in range(90)] + [("n0", f"n{i}", 1) for i in range(40)]
    frame = spark.createDataFrame(edges, "a string, b string, weight long")
    for rounds in (0, 1, 3):
        assert {r["node"]: r["label"] for r in g.label_propagation(frame, rounds).collect()} == plain_votes(edges, rounds, 1)


@pytest.mark.parametrize("hot", [False, True])
def test_community_density_counts_strictly_earlier_events(spark, request, hot):
    if hot:
        request.getfixturevalue("small_groups")
    rows = payments(random.Random(6), 150)
    labels = {a: a % 3 for a in range(10)}
    known = spark.createDataFrame([(f"sender_account_id:{a}", f"c{c}") for a, c in labels.items()], "node string, label string")
    got = {r["event_id"]: r for r in g.community_risk_density(spark.createDataFrame(rows, EVENTS), known).collect()}
    low = datetime.min
    for r in rows:
        own = got[r[0]]
        if r[2] not in labels:
            assert own["community"] is None and own["community_risk_density"] is None
            continue
        earlier = [x for x in rows if labels.get(x[2]) == labels[r[2]] and (x[1] or low) < (r[1] or low)]
        hits = sum(x[6] for x in earlier)
        assert (own["community"], own["community_events"], own["community_positives"]) == (f"c{labels[r[2]]}", len(earlier), hits)
        assert own["community_risk_density"] == (pytest.approx(hits / len(earlier)) if earlier else None)
    assert len(got) == len(rows)


def test_weighted_edges_skip_missing_entities(spark):
    rows = [(1, START, 5, 1, None, 1, False), (2, START, 5, 1, 2, 1, False), (3, START, None, 1, 2, 1, False)]
    got = {(r["a"], r["b"]): r["weight"] for r in g.weighted_edges(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {("sender_account_id:5", "device_id:2"): 1, ("sender_account_id:5", "beneficiary_id:1"): 2}
    empty = spark.createDataFrame([], EVENTS)
    assert g.label_propagation(g.weighted_edges(empty), 2).count() == 0
    assert g.component_features(empty, 3600).count() == 0 and g.two_hop_fan_in(empty).count() == 0
    assert g.community_risk_density(empty, spark.createDataFrame([], "node string, label string")).count() == 0
