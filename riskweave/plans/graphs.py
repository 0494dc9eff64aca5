"""Registered queries of the graph features, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import graph as g
from riskweave.plans.registry import Tables, query
from riskweave.plans.views import with_views

#: Production parameters of the queries.
PERIOD_SECONDS = 3_600
FLOW_SECONDS, FLOW_HOPS = 86_400, 4
VOTE_ROUNDS = 3
COMMUNITY_ENTITIES = ("ip_prefix", "beneficiary_id")


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_NAMED = f"""
SELECT event_id, p || '|account:' || sender_account_id AS account, p || '|device:' || device_id AS device, p || '|ip:' || ip_prefix AS ip,
  p || '|beneficiary:' || beneficiary_id AS beneficiary, (p - 1) || '|account:' || sender_account_id AS account_before,
  (p - 1) || '|device:' || device_id AS device_before, (p - 1) || '|ip:' || ip_prefix AS ip_before,
  (p - 1) || '|beneficiary:' || beneficiary_id AS beneficiary_before
FROM (SELECT *, epoch_us(event_ts) // {PERIOD_SECONDS * 1_000_000} AS p FROM pay_events)"""
_COMPONENT_CTES = {
    "named": _NAMED,
    "ways": " UNION ".join(
        f"SELECT {a} AS a, {b} AS b FROM named" for e in ("device", "ip", "beneficiary") for a, b in (("account", e), (e, "account"))),
    "reach": "SELECT DISTINCT a AS src, a AS node FROM ways UNION SELECT r.src, w.b FROM reach r JOIN ways w ON w.a = r.node",
    "found": "SELECT node, min(src) AS component FROM reach GROUP BY node",
    "sizes": "SELECT component, count(*) AS component_nodes, count(*) FILTER (contains(node, '|account:')) AS component_accounts FROM found GROUP BY 1",
    "node_sizes": "SELECT node, component, component_nodes, component_accounts FROM found JOIN sizes USING (component)",
}


@query("X4_component_sizes", recursive(with_views("SELECT * FROM node_sizes", "pay_events", **_COMPONENT_CTES)))
def _(t: Tables):
    """Connected components of shared accounts, devices, networks and beneficiaries, hour by hour."""
    return g.component_sizes(t("pay_events"), PERIOD_SECONDS)


@query("X4_component_features", recursive(with_views(
    "SELECT event_id, coalesce(max(component_accounts), 0) AS component_accounts, "
    "coalesce(max(component_accounts * 1000000 + component_nodes) % 1000000, 0) AS component_nodes "
    "FROM used LEFT JOIN node_sizes ON node_sizes.node = used.node GROUP BY event_id",
    "pay_events", **_COMPONENT_CTES,
    used=" UNION ALL ".join(f"SELECT event_id, {e}_before AS node FROM named" for e in ("account", "device", "ip", "beneficiary")))))
def _(t: Tables):
    """For each event the largest component its entities belonged to in the hour before."""
    return g.component_features(t("pay_events"), PERIOD_SECONDS)


@query("X5_two_hop_fan_in", with_views(
    "SELECT e.event_id, count(p.source) AS two_hop_fan_in FROM pay_events e "
    "LEFT JOIN pairs p ON p.target = e.beneficiary_id AND p.since < e.event_ts GROUP BY e.event_id",
    "pay_events",
    first_paid="SELECT sender_account_id AS payer, beneficiary_id AS payee, min(event_ts) AS since FROM pay_events "
               "WHERE sender_account_id <> beneficiary_id GROUP BY 1, 2",
    pairs="SELECT a.payer AS source, b.payee AS target, min(greatest(a.since, b.since)) AS since FROM first_paid a "
          "JOIN first_paid b ON a.payee = b.payer WHERE a.payer <> b.payee GROUP BY 1, 2"))
def _(t: Tables):
    """Accounts two payments upstream of each event's payee, as known before the event."""
    return g.two_hop_fan_in(t("pay_events"))


@query("X6_circular_flows", recursive(with_views(
    "SELECT e.event_id, s.hops IS NOT NULL AS closes_flow, s.hops AS flow_hops FROM pay_events e LEFT JOIN "
    "(SELECT id, min(hops) AS hops FROM chains WHERE holder = origin GROUP BY id) s ON s.id = e.event_id",
    "pay_events",
    moved="SELECT event_id AS id, sender_account_id AS src, beneficiary_id AS dst, epoch_us(event_ts) AS at_us FROM pay_events "
          "WHERE sender_account_id <> beneficiary_id",
    chains="SELECT id, src AS origin, dst AS holder, at_us AS began, at_us AS last_us, 1 AS hops FROM moved UNION "
           "SELECT m.id, c.origin, m.dst, c.began, m.at_us, c.hops + 1 FROM chains c JOIN moved m ON m.src = c.holder AND m.at_us > c.last_us "
           f"AND m.at_us - c.began <= {FLOW_SECONDS * 1_000_000} WHERE c.holder <> c.origin AND c.hops < {FLOW_HOPS}")))
def _(t: Tables):
    """Events that bring money back to where it came from within a day and four payments."""
    return g.circular_flows(t("pay_events"), FLOW_SECONDS, FLOW_HOPS)


def _vote_ctes() -> dict[str, str]:
    parts = " UNION ALL ".join(
        f"SELECT 'sender_account_id:' || sender_account_id AS a, '{c}:' || {c} AS b FROM earlier WHERE {c} IS NOT NULL" for c in COMMUNITY_ENTITIES)
    ctes = {
        "cut": "SELECT (min(epoch_us(event_ts)) + max(epoch_us(event_ts))) // 2 AS us FROM pay_events",
        "earlier": "SELECT * FROM pay_events, cut WHERE epoch_us(event_ts) < us",
        "weighted": f"SELECT a, b, count(*) AS weight FROM ({parts}) GROUP BY 1, 2",
        "votes": "SELECT a AS node, b AS other, weight FROM weighted UNION ALL SELECT b, a, weight FROM weighted",
        "round0": "SELECT DISTINCT node, node AS label FROM votes",
    }
    for k in range(1, VOTE_ROUNDS + 1):
        before = f"round{k - 1}"
        ctes[f"round{k}"] = (
            "SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY sum(weight) DESC, label) AS place FROM ("
            f"SELECT v.node, l.label, v.weight FROM votes v JOIN {before} l ON l.node = v.other UNION ALL SELECT node, label, 1 FROM {before}"
            ") GROUP BY node, label) WHERE place = 1")
    return ctes


@query("X7_communities", with_views(f"SELECT node, label FROM round{VOTE_ROUNDS}", "pay_events", **_vote_ctes()))
def _(t: Tables):
    """Communities of accounts and entities over the first half of the time."""
    return g.label_propagation(g.weighted_edges(_first_half(t), others=COMMUNITY_ENTITIES), VOTE_ROUNDS)


@query("X7_community_risk", with_views(
    "SELECT p.event_id, p.community, p.community_events, p.community_positives, "
    "CASE WHEN p.community_events > 0 THEN p.community_positives / p.community_events END AS community_risk_density FROM ("
    "SELECT a.event_id, any_value(a.label) AS community, CASE WHEN any_value(a.label) IS NOT NULL THEN count(b.event_id) END AS community_events, "
    "CASE WHEN any_value(a.label) IS NOT NULL THEN count(b.event_id) FILTER (b.label_fraud) END AS community_positives "
    "FROM placed a LEFT JOIN placed b ON b.label = a.label AND b.event_ts < a.event_ts GROUP BY a.event_id) p",
    "pay_events", **_vote_ctes(),
    placed=f"SELECT e.*, r.label FROM pay_events e LEFT JOIN round{VOTE_ROUNDS} r ON r.node = 'sender_account_id:' || e.sender_account_id"))
def _(t: Tables):
    """Share of earlier positives in the community of each event's account."""
    labels = g.label_propagation(g.weighted_edges(_first_half(t), others=COMMUNITY_ENTITIES), VOTE_ROUNDS)
    return g.community_risk_density(t("pay_events"), labels)


def _first_half(t: Tables):
    events = t("pay_events")
    micros = F.unix_micros(F.col("event_ts").cast("timestamp"))
    ends = events.agg(F.min(micros).alias("low"), F.max(micros).alias("high")).first()
    return events.where(micros < ((ends["low"] or 0) + (ends["high"] or 0)) // 2)
