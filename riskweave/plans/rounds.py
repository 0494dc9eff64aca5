"""Registered queries: truth-joined scoring (C) and summary tables (R, S9, S11)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators import metrics as m
from riskweave.operators import policy as g
from riskweave.operators import quality as q
from riskweave.operators import rollups as r
from riskweave.operators import scoring as c
from riskweave.operators.ordered import global_rank
from riskweave.plans import gates
from riskweave.plans.features import _VECTORS, vectors
from riskweave.plans.registry import Tables, query
from riskweave.plans.views import with_views
from riskweave.session import pin

# One round per case with fraud, numbered in case order. Clean cases are controls or ambient traffic, dealt to the rounds in turn.
_ROLES = (
    "SELECT case_id, CASE WHEN fraud THEN place ELSE 1 + (place - 1) % greatest(1, sum(CAST(fraud AS INT)) OVER ()) END AS round_id, CASE WHEN fraud THEN 'attack' WHEN n % 2 = 1 THEN 'control' ELSE 'ambient' END AS role FROM ("
    "SELECT *, row_number() OVER (PARTITION BY fraud ORDER BY case_id) AS place FROM (SELECT case_id, bool_or(label_fraud) AS fraud, count(*) AS n FROM case_events GROUP BY case_id) a) b"
)
_EVENTS = (
    "SELECT e.event_id, e.case_id, e.sequence, e.event_type, e.lifecycle_phase, e.k, e.attack_family, CAST(r.round_id AS BIGINT) AS round_id, r.role FROM {case_events} e JOIN {roles} r ON r.case_id = e.case_id"
)


def roles(cases: DataFrame) -> DataFrame:
    """case_id, round_id and role of every case."""
    known = pin(cases.groupBy("case_id").agg(F.bool_or("label_fraud").alias("fraud"), F.count(F.lit(1)).alias("n")), "cases")
    attacks = known.where("fraud").count()
    attack = global_rank(known.where("fraud"), ["case_id"], "round_id").withColumn("role", F.lit("attack"))
    clean = global_rank(known.where("NOT fraud"), ["case_id"], "place").withColumns({
        "round_id": 1 + (F.col("place") - 1) % max(1, attacks), "role": F.when(F.col("n") % 2 == 1, "control").otherwise("ambient")})
    return attack.select("case_id", "round_id", "role").unionByName(clean.select("case_id", "round_id", "role"))


_REASONS_SQL = (
    "CASE k % 4 WHEN 0 THEN ['profile_change', 'device_novelty'] WHEN 1 THEN ['behavior_sequence', 'velocity', 'insufficient_evidence'] WHEN 2 THEN ['amount_anomaly'] ELSE ['cross_phase_pattern', 'graph_concentration'] END"
)
_BASE = {
    "roles": _ROLES,
    "rev": _EVENTS.format(case_events="case_events", roles="roles"),
    "turns": "SELECT e.*, d.action, d.has_legitimate_context FROM rev e JOIN (SELECT *, coalesce(bool_or(action = 'block') OVER (PARTITION BY case_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped "
             "FROM decisions) d ON d.event_id = e.event_id WHERE NOT stopped",
    "tt": "SELECT t.*, offset_seconds, intervention_point FROM turns t JOIN truth x ON x.event_id = t.event_id",
    "dec": "SELECT round_id, case_id, role, coalesce(b, h) AS ds FROM (SELECT d.round_id, d.case_id, d.role, min(CASE WHEN action = 'block' THEN sequence END) AS b, min(CASE WHEN action = 'hold' AND sequence > coalesce(rs, 0) THEN sequence END) AS h "
           "FROM turns d JOIN (SELECT case_id, max(CASE WHEN has_legitimate_context AND action IN ('allow', 'monitor', 'step_up') THEN sequence END) AS rs FROM turns GROUP BY 1) x ON x.case_id = d.case_id GROUP BY 1, 2, 3) q",
    "anch": "SELECT a.*, x.offset_seconds AS ao, x.intervention_point AS ap, x.lifecycle_phase AS aph, y.offset_seconds AS dof, y.intervention_point AS dp FROM ("
            "SELECT t.round_id, t.case_id, min(CASE WHEN action IN ('step_up', 'hold', 'block') THEN sequence END) AS al, any_value(d.ds) AS ds FROM turns t LEFT JOIN dec d ON d.case_id = t.case_id WHERE t.role = 'attack' GROUP BY 1, 2) a "
            "LEFT JOIN tt x ON x.case_id = a.case_id AND x.sequence = a.al LEFT JOIN tt y ON y.case_id = a.case_id AND y.sequence = a.ds",
    "ev": "SELECT e.*, x.offset_seconds, x.value_at_risk_inr FROM rev e JOIN truth x ON x.event_id = e.event_id WHERE role = 'attack'",
    "prev": "SELECT e.round_id, round(sum(value_at_risk_inr), 2) AS total, count(*) AS n, round(least(round(sum(value_at_risk_inr), 2), sum(CASE WHEN dof IS NOT NULL AND offset_seconds >= dof THEN value_at_risk_inr ELSE 0e0 END)), 2) AS kept FROM ev e LEFT JOIN anch a ON a.round_id = e.round_id GROUP BY 1",
    "cf": "SELECT t.round_id, t.case_id, t.role, bool_or(action IN ('step_up', 'hold', 'block')) AS alerted, bool_or(action IN ('hold', 'block')) AS stopped, bool_or(action = 'step_up') AS stepped, any_value(ds) IS NOT NULL AS decided "
          "FROM turns t LEFT JOIN dec d ON d.case_id = t.case_id GROUP BY 1, 2, 3",
    "ctl": "SELECT round_id, count(*) AS cc, avg(CAST(CAST(decided AS INT) AS DOUBLE)) AS hfp, avg(CAST(CAST(alerted AS INT) AS DOUBLE)) AS fr FROM cf WHERE role = 'control' GROUP BY 1",
    "amb": "SELECT round_id, count(*) AS ac, avg(CAST(CAST(stopped AS INT) AS DOUBLE)) AS afp, avg(CAST(CAST(alerted AS INT) AS DOUBLE)) AS afr FROM cf WHERE role = 'ambient' GROUP BY 1",
}
_REPORT = (
    "SELECT p.round_id, total, n, kept, CASE WHEN total = 0 THEN 0e0 ELSE round(kept / total, 4) END AS ratio, round(greatest(0e0, total - kept), 2) AS impact, a.case_id, al, ds, ao, ap, aph, dof, dp, "
    "CASE ap WHEN 'PREVENT' THEN 1e0 WHEN 'DECIDE' THEN 65e-2 WHEN 'CONTAIN' THEN 25e-2 ELSE 0e0 END AS credit, coalesce(cc, 0) AS cc, coalesce(hfp, 0e0) AS hfp, coalesce(fr, 0e0) AS fr, coalesce(ac, 0) AS ac, coalesce(afp, 0e0) AS afp, coalesce(afr, 0e0) AS afr "
    "FROM prev p LEFT JOIN anch a ON a.round_id = p.round_id LEFT JOIN ctl ON ctl.round_id = p.round_id LEFT JOIN amb ON amb.round_id = p.round_id"
)
_OUTCOME = "CASE WHEN al IS NULL THEN 'missed' WHEN dp IS NULL THEN 'detected' WHEN dp = 'CONTAIN' THEN 'contained' WHEN ratio >= 999e-3 THEN 'prevented' ELSE 'contained' END"
_BLUE = "CAST(round(CAST(greatest(0e0, least(100e0, 100 * (35e-2 * CAST(al IS NOT NULL AS INT) + 35e-2 * ratio + 20e-2 * credit + 10e-2 * (1 - hfp)) - 5 * fr)) AS DECIMAL(30, 9)), 2) AS DOUBLE)"


def _sql(text: str, **extra: str) -> str:
    return with_views(text, "case_events", "decisions", "truth", **_BASE, rep=_REPORT, **extra)


class Rounds:
    """Events, turns and truth of the fixture rounds.

    The scores read these tables many times, so each one that is used is written once.
    """

    def __init__(self, t: Tables) -> None:
        self._t = t

    @cached_property
    def events(self):
        cases = self._t("case_events")
        return pin(self._t.spark.sql(_EVENTS, case_events=cases, roles=roles(cases)), "events")

    @cached_property
    def truth(self):
        return pin(self._t("truth").select("event_id", "offset_seconds", "intervention_point", "value_at_risk_inr"), "truth")

    @cached_property
    def turns(self):
        decided = g.stop_on_block(self._t("decisions")).select("event_id", "action", "has_legitimate_context")
        return pin(self.events.join(decided, "event_id"), "turns")

    def report(self):
        return c.round_report(self.events, self.turns, self.truth)


@query("C1_C6_round_report", _sql(
    f"SELECT round_id, {_OUTCOME} AS outcome, total AS total_value_at_risk_inr, kept AS value_prevented_inr, ratio AS value_prevented_ratio, impact AS realized_impact_inr, "
    "CASE WHEN total = 0 THEN 0e0 ELSE round(impact / total, 4) END AS realized_impact_ratio, credit AS early_credit, ao AS time_to_detect_seconds, aph AS detected_lifecycle_phase, round(hfp, 4) AS hard_false_positive_rate, "
    f"round(fr, 4) AS legitimate_friction_rate, round(afp, 4) AS ambient_false_positive_rate, round(afr, 4) AS ambient_friction_rate, {_BLUE} AS blue_score, round(100 - {_BLUE}, 2) AS red_score FROM rep"))
def _(t: Tables):
    return Rounds(t).report().select(
        "round_id", "outcome", "total_value_at_risk_inr", "value_prevented_inr", "value_prevented_ratio", "realized_impact_inr", "realized_impact_ratio",
        "early_credit", "time_to_detect_seconds", "detected_lifecycle_phase", "hard_false_positive_rate", "legitimate_friction_rate",
        "ambient_false_positive_rate", "ambient_friction_rate", "blue_score", "red_score",
    )


@query("C1_case_outcome", _sql(f"SELECT round_id, {_OUTCOME} AS outcome FROM rep"))
def _(t: Tables):
    x = Rounds(t)
    return c.case_outcome(c.prevented_value(x.events, x.turns, x.truth)).select("round_id", "outcome")


@query("C2_prevented_value", _sql("SELECT round_id, total AS total_value_at_risk_inr, kept AS value_prevented_inr, ratio AS value_prevented_ratio FROM rep"))
def _(t: Tables):
    x = Rounds(t)
    return c.prevented_value(x.events, x.turns, x.truth).select("round_id", "total_value_at_risk_inr", "value_prevented_inr", "value_prevented_ratio")


@query("C3_early_credit", _sql("SELECT round_id, al AS alert_sequence, ao AS alert_offset, ap AS alert_point, aph AS alert_phase, ds AS decisive_sequence, dof AS decisive_offset FROM anch"))
def _(t: Tables):
    x = Rounds(t)
    return c.attack_anchors(x.turns, x.truth).select("round_id", "alert_sequence", "alert_offset", "alert_point", "alert_phase", "decisive_sequence", "decisive_offset")


@query("C4_control_harm", _sql("SELECT round_id, cc AS control_cases, round(hfp, 4) AS hard_false_positive_rate, round(fr, 4) AS legitimate_friction_rate FROM ctl"))
def _(t: Tables):
    return c.control_harm(Rounds(t).turns)


@query("C5_ambient_harm", _sql("SELECT round_id, ac AS ambient_cases, round(afp, 4) AS ambient_false_positive_rate, round(afr, 4) AS ambient_friction_rate FROM amb"))
def _(t: Tables):
    return c.ambient_harm(Rounds(t).turns)


_TOOLS = list(d.EVIDENCE_TOOLS)


def packets(x: Rounds):
    names = F.array(*[F.lit(n) for n in _TOOLS])
    used = F.transform(F.sequence(F.lit(0), F.col("k") % 3), lambda i: F.element_at(names, ((F.col("k") + i) % 9 + 1).cast("int")))
    return x.turns.where(F.col("role") == "attack").select("round_id", "lifecycle_phase", F.explode(used).alias("tool_name"), F.lit(1).alias("packet_count"))


@query("C7_coverage_ratios", _sql(
    "SELECT e.round_id, round(coalesce(dn, 0) / CAST(an AS DOUBLE), 4) AS event_evaluation_ratio, round(coalesce(tn, 0) / CAST(9 AS DOUBLE), 4) AS evidence_tool_coverage FROM (SELECT round_id, count(*) AS an FROM rev WHERE role = 'attack' GROUP BY 1) e "
    "LEFT JOIN (SELECT round_id, count(*) AS dn FROM turns WHERE role = 'attack' GROUP BY 1) t ON t.round_id = e.round_id "
    "LEFT JOIN (SELECT round_id, count(DISTINCT (k + i) % 9) AS tn FROM turns, (SELECT unnest([0, 1, 2]) AS i) x WHERE role = 'attack' AND i <= k % 3 GROUP BY 1) p ON p.round_id = e.round_id"))
def _(t: Tables):
    x = Rounds(t)
    return c.coverage_ratios(x.events, x.turns, packets(x))


def with_reasons(turns):
    k = F.col("k") % 4

    def texts(*values):
        return F.array(*[F.lit(v) for v in values])

    return turns.withColumn("reason_codes", F.when(k == 0, texts("profile_change", "device_novelty")).when(k == 1, texts("behavior_sequence", "velocity", "insufficient_evidence"))
                            .when(k == 2, texts("amount_anomaly")).otherwise(texts("cross_phase_pattern", "graph_concentration")))


@query("C8_coarse_reasons", _sql(
    "SELECT round_id, CASE k % 4 WHEN 0 THEN 'beneficiary_novelty|device_novelty' WHEN 1 THEN 'velocity' WHEN 2 THEN 'amount_anomaly' ELSE 'velocity|graph_concentration' END AS coarse_reason_categories "
    "FROM turns t JOIN anch a ON a.case_id = t.case_id AND a.al = t.sequence".replace("SELECT round_id", "SELECT t.round_id")))
def _(t: Tables):
    out = c.coarse_reasons(with_reasons(Rounds(t).turns))
    return out.withColumn("coarse_reason_categories", F.array_join("coarse_reason_categories", "|"))


_PI = "CASE {x} WHEN 'pre_transaction' THEN 0 WHEN 'transaction' THEN 1 ELSE 2 END"
_C9 = {
    "ph": "SELECT unnest(['pre_transaction', 'transaction', 'post_transaction']) AS phase, unnest([0, 1, 2]) AS phase_index",
    "sp": f"SELECT round_id, lifecycle_phase AS phase, count(*) AS event_count, min(offset_seconds) AS st, max(offset_seconds) AS en, arg_min(event_type, sequence) AS first_type FROM ev GROUP BY 1, 2",
    "fa": "SELECT round_id, lifecycle_phase AS phase, count(*) AS n, min(CASE WHEN action IN ('step_up', 'hold', 'block') THEN sequence END) AS fa, sum(k % 3) AS cited, sum(1 + k % 3) AS pk, "
          + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS n_{a}" for a in d.ACTIONS) + " FROM turns WHERE role = 'attack' GROUP BY 1, 2",
    "ix": "SELECT t.round_id, t.lifecycle_phase AS phase, count(*) FILTER (WHERE t.sequence < fa) AS ai, max(CASE WHEN t.sequence = fa THEN offset_seconds END) AS ao FROM tt t JOIN fa ON fa.round_id = t.round_id AND fa.phase = t.lifecycle_phase WHERE t.role = 'attack' GROUP BY 1, 2",
    "cc9": "SELECT round_id, phase, count(*) AS lc, avg(cost) AS ac, count(*) FILTER (WHERE al) AS fp, sum(ne) AS pn FROM (SELECT round_id, case_id, lifecycle_phase AS phase, count(*) AS ne, max(CASE action WHEN 'allow' THEN 0e0 WHEN 'monitor' THEN 3e-2 WHEN 'step_up' THEN 25e-2 WHEN 'hold' THEN 70e-2 ELSE 1e0 END) AS cost, "
           "bool_or(action IN ('step_up', 'hold', 'block')) AS al FROM turns WHERE role = 'control' GROUP BY 1, 2, 3) z GROUP BY 1, 2",
    "c9a": "SELECT rr.round_id, ph.phase, ph.phase_index, event_count, st, en, first_type, fa.n, fa.fa, cited, pk, " + ", ".join(f"n_{a}" for a in d.ACTIONS)
           + ", ai, ix.ao, dof, lc, ac, fp, pn, coalesce(hfp, 0e0) AS hfp, coalesce(fr, 0e0) AS fr, "
             f"coalesce((SELECT min(offset_seconds) FROM ev e WHERE e.round_id = rr.round_id AND e.offset_seconds > sp.en AND {_PI.format(x='e.lifecycle_phase')} > ph.phase_index), sp.en) AS dl, "
             "(SELECT sum(value_at_risk_inr) FROM ev e WHERE e.round_id = rr.round_id AND e.offset_seconds >= sp.st) AS dv, "
             "coalesce((SELECT sum(value_at_risk_inr) FROM ev e WHERE e.round_id = rr.round_id AND e.offset_seconds >= greatest(sp.st, dof)), 0e0) AS cv, "
             f"(SELECT min({_PI.format(x='e.lifecycle_phase')}) FROM ev e WHERE e.round_id = rr.round_id AND {_PI.format(x='e.lifecycle_phase')} > ph.phase_index) AS nextp, "
             f"(SELECT count(*) FROM fa f WHERE f.round_id = rr.round_id AND f.fa IS NOT NULL AND {_PI.format(x='f.phase')} < ph.phase_index) AS earlier "
             "FROM (SELECT DISTINCT round_id FROM ev) rr CROSS JOIN ph LEFT JOIN sp ON sp.round_id = rr.round_id AND sp.phase = ph.phase LEFT JOIN fa ON fa.round_id = rr.round_id AND fa.phase = ph.phase "
             "LEFT JOIN ix ON ix.round_id = rr.round_id AND ix.phase = ph.phase LEFT JOIN anch a ON a.round_id = rr.round_id LEFT JOIN cc9 ON cc9.round_id = rr.round_id AND cc9.phase = ph.phase LEFT JOIN ctl ON ctl.round_id = rr.round_id",
    "c9b": "SELECT *, CASE WHEN fa IS NULL THEN 0e0 WHEN ao <= st THEN 1e0 ELSE greatest(0e0, 1 - greatest(0, ao - st) / CAST(greatest(1, dl - st) AS DOUBLE)) END AS resp, coalesce(dof <= dl, false) AS it, "
           "CASE WHEN ac IS NOT NULL THEN 1 - ac ELSE 1 - least(1e0, 7e-1 * hfp + 3e-1 * fr) END AS safe, CASE WHEN earlier > 0 THEN 0e0 WHEN fa IS NULL THEN 1e0 ELSE ai / CAST(greatest(1, n) AS DOUBLE) END AS stealth FROM c9a",
    "c9c": "SELECT *, CASE WHEN it THEN cv ELSE 0e0 END AS ctrl, CASE WHEN dv > 0 THEN least(1e0, CASE WHEN it THEN cv ELSE 0e0 END / dv) ELSE CAST(CAST(it AS INT) AS DOUBLE) END AS cons FROM c9b",
    "c9": "SELECT *, CASE WHEN n IS NOT NULL THEN CAST(round(CAST(100 * (25e-2 * CAST(fa IS NOT NULL AS INT) + 20e-2 * resp + 35e-2 * cons + 20e-2 * safe) AS DECIMAL(30, 9)), 2) AS DOUBLE) END AS phase_score FROM c9c",
}


def scorecard(t: Tables, x: Rounds | None = None):
    x = x or Rounds(t)
    cites = F.transform(F.sequence(F.lit(0), F.col("k") % 3), lambda i: i.cast("string"))
    cited = x.turns.withColumn("evidence_refs", F.slice(cites, 1, F.col("k") % 3))
    return c.lifecycle_scorecard(x.events, cited, x.truth, packets(x))


@query("C9_lifecycle_scorecard", _sql(
    "SELECT round_id, phase, CASE WHEN event_count IS NULL THEN 'not_in_scenario' WHEN n IS NULL THEN 'prevented_before_phase' ELSE 'reached' END AS status, coalesce(event_count, 0) AS event_count, coalesce(n, 0) AS evaluated_event_count, "
    "CASE WHEN event_count IS NOT NULL THEN round(coalesce(n, 0) / CAST(event_count AS DOUBLE), 4) END AS evaluation_coverage, CASE WHEN n IS NOT NULL THEN CAST(coalesce(pn, 0) AS BIGINT) END AS phase_matched_control_event_count, "
    "first_type AS first_actionable_event, phase_score, CASE WHEN fa IS NOT NULL THEN greatest(0, ao - st) END AS response_time_seconds, CASE WHEN n IS NOT NULL THEN round(resp, 4) END AS response_score, "
    "CASE WHEN n IS NOT NULL THEN round(dv, 2) END AS downstream_value_exposed_inr, CASE WHEN n IS NOT NULL THEN round(ctrl, 2) END AS value_controlled_from_phase_inr, CASE WHEN n IS NOT NULL THEN round(cons, 4) END AS consequence_control_ratio, "
    "CASE WHEN n IS NOT NULL THEN CAST(round(CAST(safe AS DECIMAL(30, 9)), 4) AS DOUBLE) END AS legitimate_safety_rate, CASE WHEN n IS NOT NULL THEN round(stealth, 4) END AS red_stealth_ratio, "
    f"CASE WHEN n IS NOT NULL AND nextp IS NOT NULL THEN CAST((SELECT count(*) FROM fa f WHERE f.round_id = c9.round_id AND {_PI.format(x='f.phase')} = nextp) AS DOUBLE) END AS transition_escape_rate, "
    "CASE WHEN n IS NOT NULL THEN round(least(1e0, cited / CAST(pk AS DOUBLE)), 4) END AS evidence_citation_rate, CASE WHEN n IS NOT NULL THEN n_hold END AS hold_count, CASE WHEN n IS NOT NULL THEN n_allow END AS allow_count FROM c9", **_C9))
def _(t: Tables):
    return scorecard(t).select(
        "round_id", "phase", "status", "event_count", "evaluated_event_count", "first_actionable_event", "phase_score", "response_time_seconds", "response_score",
        "downstream_value_exposed_inr", "value_controlled_from_phase_inr", "consequence_control_ratio", "legitimate_safety_rate", "red_stealth_ratio",
        "transition_escape_rate", "evidence_citation_rate", "hold_count", "allow_count", "evaluation_coverage", "phase_matched_control_event_count",
    )


@query("C10_phase_classification", _sql(
    "SELECT round_id, phase, tp AS true_positives, fpn AS false_positives, 1 - tp AS false_negatives, lcn - fpn AS true_negatives, round(pr, 4) AS precision, CAST(tp AS DOUBLE) AS recall, "
    "round(CASE WHEN coalesce(pr, 0e0) + tp > 0 THEN 2 * pr * tp / (pr + tp) ELSE 0e0 END, 4) AS f1 FROM (SELECT *, CASE WHEN tp + fpn > 0 THEN tp / CAST(tp + fpn AS DOUBLE) END AS pr FROM ("
    "SELECT round_id, phase, CAST(fa IS NOT NULL AS INT) AS tp, coalesce(fp, 0) AS fpn, coalesce(lc, 0) AS lcn FROM c9 WHERE n IS NOT NULL) a) b", **_C9))
def _(t: Tables):
    return scorecard(t).where(F.col("status") == "reached").select(
        "round_id", "phase", "true_positives", "false_positives", "false_negatives", "true_negatives", "precision", "recall", "f1")


@query("C11_lifecycle_balance", _sql(
    "SELECT round_id, CAST(round(CAST(6e-1 * coalesce(avg(phase_score), 0e0) + 4e-1 * coalesce(min(phase_score), 0e0) AS DECIMAL(30, 9)), 2) AS DOUBLE) AS balanced_lifecycle_defense_score, arg_min(phase, phase_score * 10 + phase_index) FILTER (WHERE phase_score IS NOT NULL) AS worst_lifecycle_phase, "
    "coalesce(min(phase_score), 0e0) AS worst_phase_score, round(coalesce(max(phase_score) - min(phase_score), 0e0), 2) AS lifecycle_balance_gap FROM c9 GROUP BY 1".replace("phase_score * 10 + phase_index", "round(phase_score * 1000) + phase_index"), **_C9))
def _(t: Tables):
    return c.lifecycle_balance(scorecard(t))


@query("C12_red_capability", _sql(
    "SELECT round_id, round(100 * (35e-2 * count(n) / CAST(count(event_count) AS DOUBLE) + 30e-2 * coalesce(avg(CASE WHEN n IS NOT NULL THEN round(stealth, 4) END), 0e0) + 20e-2 * count(event_count) / CAST(3 AS DOUBLE) "
    "+ 15e-2 * least(1e0, sum(event_count) / CAST(6 AS DOUBLE))), 2) AS red_capability_score FROM c9 GROUP BY 1", **_C9))
def _(t: Tables):
    return c.red_capability(scorecard(t))


@query("C14_legit_tally", _sql(
    "SELECT round_id, count(*) FILTER (WHERE role = 'control') AS control_count, count(*) FILTER (WHERE role = 'ambient') AS ambient_count, count(*) AS total, count(*) FILTER (WHERE stopped) AS false_blocks, "
    "count(*) FILTER (WHERE NOT stopped AND stepped) AS extra_checks FROM cf WHERE role IN ('control', 'ambient') GROUP BY 1"))
def _(t: Tables):
    return c.legit_tally(Rounds(t).turns)


@query("C15_round_fidelity", _sql(
    "SELECT round_id, round(100 * (25e-2 * coalesce(p, 0) + 20e-2 * coalesce(dl, 0) + 20e-2 * coalesce(sg, 0) + 20e-2 * coalesce(cl, 1) + 15e-2 * least(1e0, cc / CAST(3 AS DOUBLE))), 2) AS fidelity_score, round(coalesce(p, 0e0), 4) AS production_event_rate, "
    "round(coalesce(dl, 0e0), 4) AS delivery_metadata_rate, round(coalesce(sg, 0e0), 4) AS observable_signal_rate, coalesce(cl, 1) = 1 AS truth_boundary_clean, cc AS legitimate_look_alike_cases FROM ("
    "SELECT round_id, avg(CASE WHEN k % 17 = 0 THEN 0e0 ELSE 1e0 END) FILTER (WHERE role = 'attack') AS p, avg(CASE WHEN k % 5 = 0 THEN 0e0 ELSE 1e0 END) FILTER (WHERE role = 'attack') AS dl, avg(CASE WHEN k % 4 = 0 THEN 0e0 ELSE 1e0 END) FILTER (WHERE role = 'attack') AS sg, "
    "min(CASE WHEN k % 23 = 0 THEN 0 ELSE 1 END) FILTER (WHERE role = 'attack') AS cl, count(DISTINCT case_id) FILTER (WHERE role = 'control') AS cc FROM rev GROUP BY 1) x"))
def _(t: Tables):
    k = F.col("k")
    shaped = Rounds(t).events.withColumns({
        "event_type": F.when(k % 17 == 0, "CAMPAIGN_REPLAYED").otherwise(F.col("event_type")),
        "source_system": F.when(k % 5 != 0, "stream"), "decision_lane": F.lit("inline"), "latency_budget_ms": F.lit(300),
        "observable_signals": F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))),
    })
    return c.round_fidelity(shaped, k % 23 != 0)


_CALLS = "SELECT round_id, CAST((k * 37 + i * 11) % 500 AS DOUBLE) AS ms, i FROM turns, (SELECT unnest([1, 2, 3]) AS i) z WHERE role IN ('attack', 'control') AND i <= k % 4"


@query("C16_latency_profile", _sql(
    "SELECT a.round_id, round(p, 2) AS model_call_p95_ms, coalesce(b.n, 0) AS blue_model_call_count, coalesce(rp, 0) AS policy_repair_call_count, a.n AS blue_event_count, round(coalesce(b.n, 0) / CAST(a.n AS DOUBLE), 3) AS model_calls_per_blue_event, fx AS verified_context_fast_exit_count, "
    "gi AS fast_guard_intervention_count, act AS fast_guard_actionable_event_count, round(coalesce(cv, 0e0), 4) AS pre_model_fast_path_coverage FROM ("
    "SELECT round_id, count(*) AS n, count(*) FILTER (WHERE k % 4 = 0 AND has_legitimate_context) AS fx, count(*) FILTER (WHERE role = 'attack' AND k % 3 = 0) AS gi, count(*) FILTER (WHERE role = 'attack' AND action IN ('step_up', 'hold', 'block')) AS act, "
    "avg(CASE WHEN k % 9 = 0 THEN 0e0 ELSE 1e0 END) FILTER (WHERE role = 'attack') AS cv FROM turns WHERE role IN ('attack', 'control') GROUP BY 1) a "
    "LEFT JOIN (SELECT round_id, quantile_disc(ms, 0.95) AS p, count(*) AS n, count(*) FILTER (WHERE i = 3) AS rp FROM calls GROUP BY 1) b ON b.round_id = a.round_id", calls=_CALLS))
def _(t: Tables):
    k = F.col("k")
    call = lambda i: F.struct(
        F.when(i == 3, F.lit("blue_event_repair")).otherwise(F.lit("blue_event")).alias("agent_name"), ((k * 37 + i * 11) % 500).cast("double").alias("latency_ms"))
    calls = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), k % 4), call))
    turns = Rounds(t).turns.withColumns({
        "model_calls": calls, "reason_codes": F.when(F.col("has_legitimate_context"), F.array(F.lit("legitimate_context"))).otherwise(F.array(F.lit("velocity"))),
        "policy_adjustments": F.when(k % 3 == 0, F.array(F.lit("raised_from_allow_to_hold"))).otherwise(F.array().cast("array<string>")),
        "guarded": k % 9 != 0, "operational_minimum_action": F.col("action"),
    })
    return c.latency_profile(turns)


_PAIRED = (
    "SELECT round_id, al, hfp, fr, ratio, blue, impact_ratio, bal, worst, ao FROM (SELECT rep.round_id, al, round(hfp, 4) AS hfp, round(fr, 4) AS fr, ratio, " + _BLUE + " AS blue, CASE WHEN total = 0 THEN 0e0 ELSE round(impact / total, 4) END AS impact_ratio, bal, worst, ao FROM rep "
    "JOIN (SELECT round_id, CAST(round(CAST(6e-1 * coalesce(avg(phase_score), 0e0) + 4e-1 * coalesce(min(phase_score), 0e0) AS DECIMAL(30, 9)), 2) AS DOUBLE) AS bal, coalesce(min(phase_score), 0e0) AS worst FROM c9 GROUP BY 1) b ON b.round_id = rep.round_id) z"
)


def full_report(t: Tables):
    x = Rounds(t)
    return pin(x.report().join(c.lifecycle_balance(scorecard(t, x)), "round_id"), "reports")


@query("C17_candidate_promotion", _sql(
    "SELECT b.round_id, safe AND gain AS promoted, CASE WHEN safe AND gain THEN 'promoted' WHEN NOT safe THEN 'rejected: safety or protection got worse' ELSE 'rejected: no measurable gain' END AS reason FROM ("
    "SELECT b.round_id, c.hfp <= b.hfp AND c.fr <= b.fr AND c.ratio >= b.ratio AND c.blue >= b.blue AND c.bal >= b.bal AND c.impact_ratio <= b.impact_ratio AS safe, "
    "c.blue > b.blue OR c.ratio > b.ratio OR c.impact_ratio < b.impact_ratio OR c.bal > b.bal OR c.worst > b.worst OR coalesce(c.ao IS NOT NULL AND (b.ao IS NULL OR c.ao < b.ao), false) AS gain "
    "FROM pr b JOIN (SELECT * REPLACE (round_id - 1 AS round_id) FROM pr) c ON c.round_id = b.round_id) b", **_C9, pr=_PAIRED))
def _(t: Tables):
    reports = full_report(t)
    return c.candidate_promotion(reports, reports.withColumn("round_id", F.col("round_id") - 1))


@query("C18_live_summary", _sql(
    f"SELECT count(*) AS case_count, round(avg(CASE WHEN {_OUTCOME} = 'missed' THEN 0e0 ELSE 1e0 END), 4) AS detection_rate, round(avg(ratio), 4) AS mean_value_prevented_ratio, round(avg(round(hfp, 4)), 4) AS mean_hard_false_positive_rate, "
    "round(avg(round(fr, 4)), 4) AS mean_legitimate_friction_rate, round(avg(bal), 2) AS mean_balanced_lifecycle_defense_score FROM rep JOIN (SELECT round_id, bal FROM pr) p ON p.round_id = rep.round_id", **_C9, pr=_PAIRED))
def _(t: Tables):
    return c.live_summary(full_report(t))


@query("C19_grouped_event_stream", _sql(
    "SELECT e.event_id, e.round_id, CASE e.role WHEN 'control' THEN 'lookalike' ELSE e.role END AS kind, coalesce(e.attack_family, e.role) AS label, action FROM rev e LEFT JOIN turns t ON t.event_id = e.event_id"))
def _(t: Tables):
    x = Rounds(t)
    out = c.grouped_event_stream(x.events, x.turns, F.coalesce("attack_family", "role"))
    return out.select("event_id", "round_id", "kind", "label", "action")


# ---------------------------------------------------------------- rollups

_SCEN = "SELECT p.*, CASE WHEN label_fraud AND k <> 94 THEN concat(attack_family, '-', CAST(sender_account_id % 20 AS STRING)) END AS scenario_id FROM {pay_events} p"


def campaign_events(t: Tables):
    return t.spark.sql(_SCEN, pay_events=t("pay_events"))


def _scen(sql: str, *views: str) -> str:
    return with_views(sql, "pay_events", *views, sc=_SCEN.format(pay_events="pay_events"))


@query("R1_summary", _scen(
    "SELECT (SELECT count(*) FROM sc) AS events, (SELECT count(*) FROM sc WHERE label_fraud) AS fraud_events, (SELECT count(DISTINCT scenario_id) FROM sc) AS campaigns, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, "
    "round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(fp / CAST(fp + tn AS DOUBLE), 6) AS false_positive_rate FROM (SELECT count(*) FILTER (WHERE label_fraud AND predicted_fraud) AS tp, "
    "count(*) FILTER (WHERE NOT label_fraud AND predicted_fraud) AS fp, count(*) FILTER (WHERE label_fraud AND NOT predicted_fraud) AS fn, count(*) FILTER (WHERE NOT label_fraud AND NOT predicted_fraud) AS tn FROM predictions) x", "predictions"))
def _(t: Tables):
    return r.summary(campaign_events(t), t("predictions"))


@query("R2_timeline", with_views("SELECT CAST(event_ts AS DATE) AS day, count(*) FILTER (WHERE NOT label_fraud) AS legitimate, count(*) FILTER (WHERE label_fraud) AS fraud FROM pay_events GROUP BY 1", "pay_events"))
def _(t: Tables):
    return r.timeline(t("pay_events"))


@query("R3_risk_histogram", with_views(
    "SELECT b AS bucket, count(p.event_id) FILTER (WHERE NOT label_fraud) AS legitimate, count(p.event_id) FILTER (WHERE label_fraud) AS fraud FROM ("
    "SELECT unnest(['0-20', '20-40', '40-60', '60-80', '80-100']) AS b, unnest([0e0, 2e-1, 4e-1, 6e-1, 8e-1]) AS lo, unnest([2e-1, 4e-1, 6e-1, 8e-1, 1000001e-6]) AS hi) d "
    "LEFT JOIN predictions p ON risk_score >= lo AND risk_score < hi GROUP BY 1", "predictions"))
def _(t: Tables):
    return r.risk_histogram(t("predictions"))


@query("R4_campaigns", _scen(
    "SELECT attack_family, scenario_id, count(*) AS events, CAST(round(CAST(avg(amount_inr) AS DECIMAL(30, 9)), 2) AS DOUBLE) AS average_amount, min(event_ts) AS start, "
    "['Easy', 'Medium', 'Hard'][((TRY_CAST(string_split(scenario_id, '-')[3] AS INT) + 2) % 3) + 1] AS difficulty FROM sc WHERE label_fraud GROUP BY 1, 2"))
def _(t: Tables):
    return r.campaigns(campaign_events(t))


@query("R5_largest_campaign_network", _scen(
    "SELECT scenario_id, event_id, sender_account_id AS source, beneficiary_id AS target, round(amount_inr, 2) AS amount FROM sc WHERE scenario_id = (SELECT scenario_id FROM sc WHERE attack_family = 'FAM-B' AND scenario_id IS NOT NULL GROUP BY 1 "
    "ORDER BY count(*) DESC, scenario_id LIMIT 1) ORDER BY event_ts, event_id LIMIT 100"))
def _(t: Tables):
    return r.largest_campaign_network(campaign_events(t), "FAM-B", ["event_ts", "event_id"])


@query("R5_network_nodes", _scen(
    "SELECT DISTINCT id, kind FROM (SELECT CAST(sender_account_id AS VARCHAR) AS id, 'account' AS kind FROM n UNION ALL SELECT CAST(beneficiary_id AS VARCHAR), 'beneficiary' FROM n) u".replace(
        "FROM n", "FROM (SELECT * FROM sc WHERE scenario_id = (SELECT scenario_id FROM sc WHERE attack_family = 'FAM-B' AND scenario_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, scenario_id LIMIT 1) ORDER BY event_ts, event_id LIMIT 100) n")))
def _(t: Tables):
    return r.network_nodes(r.largest_campaign_network(campaign_events(t), "FAM-B", ["event_ts", "event_id"]))


def atlas(t: Tables):
    key = F.col("vector_id")
    return vectors(t).withColumns({
        "id": key, "simulation_family": F.concat(F.lit("F"), (key % 9).cast("string")),
        "research_confidence": F.when(key % 3 == 0, "high").when(key % 20 == 1, "unknown").otherwise("low"),
        "plausibility": (key % 6).cast("int"), "novelty": F.lit(3), "channels": F.col("rails"),
        "genai_capabilities": F.when(key % 40 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("persona"))),
        "lifecycle_phases": F.when(key % 30 == 0, F.array(F.lit("later"))).otherwise(F.array(F.lit("transaction"))),
    })


_ATLAS_HOLD = "SELECT p_partkey FROM part WHERE p_partkey % 50 = 0"


@query("R6_atlas_summary", with_views(
    "SELECT count(*) AS vector_count, count(DISTINCT vector_id % 9) AS attack_family_count, round(avg(CASE WHEN vector_id % 3 = 0 THEN 1e0 ELSE 0e0 END), 4) AS high_confidence_vector_rate, "
    "(SELECT count(DISTINCT x) FROM (SELECT unnest(rails) AS x FROM vectors) z) AS rail_count, (SELECT count(DISTINCT x) FROM (SELECT unnest(source_ids) AS x FROM vectors) z) AS cited_source_count, "
    "(SELECT count(*) FROM supplier) AS source_count, (SELECT count(*) FROM part WHERE p_partkey % 50 = 0) AS novel_holdout_vector_count FROM vectors", vectors=_VECTORS))
def _(t: Tables):
    rows = atlas(t).withColumn("source_ids", F.transform("source_ids", lambda x: x.cast("string")))
    held = t("part").where(F.col("p_partkey") % 50 == 0).select("p_partkey")
    return r.atlas_summary(rows, t("supplier"), held, {"rail_count": "rails", "cited_source_count": "source_ids"})


@query("R7_coverage_matrix", with_views(
    "SELECT s.attack_family, s.n AS stage_count, s.p AS lifecycle_phases, coalesce(f.n, 0) AS payment_surface_count, coalesce(u.n, 0) AS source_count, coalesce(u.h, 0) AS source_domain_count FROM ("
    "SELECT attack_family, count(*) AS n, string_agg(DISTINCT lifecycle_phase, '|' ORDER BY lifecycle_phase) AS p FROM pay_events WHERE label_fraud GROUP BY 1) s "
    "LEFT JOIN (SELECT attack_family, count(DISTINCT payment_rail) AS n FROM pay_events WHERE label_fraud GROUP BY 1) f ON f.attack_family = s.attack_family "
    "LEFT JOIN (SELECT fam, count(*) AS n, count(DISTINCT h) AS h FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'FAM-A' WHEN 1 THEN 'FAM-B' ELSE 'FAM-D' END AS fam, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS h FROM pages) p GROUP BY 1) u ON u.fam = s.attack_family", "pay_events"))
def _(t: Tables):
    fraud = t("pay_events").where("label_fraud")
    stages = fraud.select("attack_family", F.col("event_id").alias("stage_id"), "lifecycle_phase")
    key = F.col("page_id") % 3
    refs = t("pages").select(F.when(key == 0, "FAM-A").when(key == 1, "FAM-B").otherwise("FAM-D").alias("attack_family"), "url")
    return r.coverage_matrix(stages, fraud.select("attack_family", F.col("payment_rail").alias("surface")), refs)


@query("R7_source_domains", "SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS domain, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def _(t: Tables):
    return r.source_domains(t("pages"))


@query("R8_population_metadata", gates._pop(
    "SELECT 'role' AS dimension, case_role AS value, count(*) AS rows FROM pop GROUP BY 2 UNION ALL SELECT 'split', s, (SELECT count(*) FROM pop WHERE split = s AND split <> 'test_novel') FROM (SELECT unnest(['train', 'validation', 'test_known', 'test_novel']) AS s) x UNION ALL "
    "SELECT 'family', attack_family, count(*) FROM pop WHERE label_fraud AND attack_family IS NOT NULL GROUP BY 2 UNION ALL SELECT 'vector', attack_vector_id, count(*) FROM pop WHERE label_fraud AND attack_vector_id IS NOT NULL GROUP BY 2"))
def _(t: Tables):
    pop = gates.population(t)
    return r.population_metadata(pop.withColumn("split", F.when(F.col("split") != "test_novel", F.col("split"))))


@query("R9_atlas_validation", with_views(
    "SELECT unnest(['vectors_without_sources', 'ratings_out_of_range', 'invalid_confidence', 'missing_dimensions', 'unknown_phases', 'duplicate_vectors', 'duplicate_sources', 'unknown_sources', 'unknown_families', 'uncovered_families', 'unknown_holdouts']) AS rule, "
    "unnest([0, a, b, c, e, 0, 0, f, g, 0, 1]) AS violations FROM (SELECT count(*) FILTER (WHERE vector_id % 6 = 0) AS a, count(*) FILTER (WHERE vector_id % 3 <> 0 AND vector_id % 20 = 1) AS b, count(*) FILTER (WHERE vector_id % 40 = 0) AS c, "
    "count(*) FILTER (WHERE vector_id % 30 = 0) AS e, (SELECT count(DISTINCT x) FROM (SELECT unnest(source_ids) AS x FROM vectors) z WHERE x NOT IN (SELECT s_suppkey FROM supplier)) AS f, (SELECT count(DISTINCT vector_id % 9) FROM vectors WHERE vector_id % 9 > 7) AS g FROM vectors) q", vectors=_VECTORS))
def _(t: Tables):
    families = r.domain_frame(t("part"), "family", [f"F{i}" for i in range(8)])
    held = t("part").where(F.col("p_partkey") % 50 == 0).select(F.col("p_partkey").alias("id"))
    unknown = t("part").agg((F.max("p_partkey") + 1).alias("id"))
    return r.atlas_validation(atlas(t), t("supplier").select(F.col("s_suppkey").alias("id")), families, held.unionByName(unknown))


_ROUNDS = "SELECT case_id AS run_id, sequence AS round_number, CASE WHEN k % 11 = 0 THEN NULL ELSE payment_rail END AS attack_family, CASE k % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM {case_events}"


@query("S9_run_catalog", with_views(
    "SELECT attack_family, difficulty, CAST(unnest(range(1, cap + 1)) AS INT) AS rounds FROM (SELECT f AS attack_family, df AS difficulty, max(CASE WHEN n = 1 THEN 5 ELSE least(n, 5) END) AS cap FROM (SELECT run_id, count(*) AS n, "
    "max(CASE WHEN round_number = 1 THEN attack_family END) AS f, max(CASE WHEN round_number = 1 THEN difficulty END) AS df FROM rr GROUP BY 1) a WHERE f IS NOT NULL GROUP BY 1, 2) b", "case_events", rr=_ROUNDS.format(case_events="case_events")))
def _(t: Tables):
    return r.run_catalog(t.spark.sql(_ROUNDS, case_events=t("case_events")))


@query("S11_backfill_run_fields", with_views(
    "SELECT event_id, i AS round, CASE WHEN i = 1 AND k % 2 = 0 THEN amount_inr WHEN i = 1 THEN amount_inr / 2 ELSE 0e0 END AS no_defense_loss_inr, CASE WHEN i = 1 THEN CAST(k AS DOUBLE) WHEN k % 3 = 0 THEN 1e0 ELSE 0e0 END AS loss_avoided_inr "
    "FROM pay_events, (SELECT unnest([1, 2]) AS i) x", "pay_events"))
def _(t: Tables):
    k, none = F.col("k"), F.lit(None).cast("double")

    def recorded(total, prevented, loss, avoided):
        names = ("total_value_at_risk_inr", "value_prevented_inr", "no_defense_loss_inr", "loss_avoided_inr")
        return F.struct(F.struct(*[x.cast("double").alias(n) for n, x in zip(names, (total, prevented, loss, avoided))]).alias("referee"))

    first = recorded(F.col("amount_inr"), k, F.when(k % 2 == 1, F.col("amount_inr") / 2), none)
    second = recorded(none, none, none, F.when(k % 3 == 0, F.lit(1.0)))
    filled = r.backfill_run_fields(t("pay_events").select("event_id", F.array(first, second).alias("rounds")))
    listed = filled.select("event_id", F.posexplode("rounds").alias("i", "r"))
    return listed.select("event_id", (F.col("i") + 1).alias("round"), "r.referee.no_defense_loss_inr", "r.referee.loss_avoided_inr")


@query("M20_kpi_rollup", gates._pop(
    "SELECT * FROM (SELECT 'guardrails' AS section, 'critical_data_quality_failures' AS metric, CAST(count(*) FILTER (WHERE o <> 0 AND severity = 'critical') AS DOUBLE) AS value, '0' AS target FROM chk UNION ALL "
    "SELECT 'guardrails', 'entity_or_scenario_split_leakage', CAST((SELECT count(*) FROM (SELECT sender_account_id FROM pop GROUP BY 1 HAVING count(DISTINCT split) > 1) x) AS DOUBLE), '0' UNION ALL "
    "SELECT 'primary', 'mean_signal_density', round(avg(risk_signal_density), 6), NULL FROM pop) k", chk=gates._CHECK_SQL))
def _(t: Tables):
    pop = gates.population(t, written=True)
    checks = q.quality_score(q.population_checks(pop, gates.catalogue(t), "vector_id", gates.holdout(t), "vector_id"))
    return m.kpi_rollup({
        "critical_data_quality_failures": ("guardrails", checks, "critical_failure_count", "0"),
        "entity_or_scenario_split_leakage": ("guardrails", q.group_isolation(pop, "sender_account_id"), "leaking_groups", "0"),
        "mean_signal_density": ("primary", pop.agg(F.round(F.avg("risk_signal_density"), 6).alias("v")), "v", None),
    })
