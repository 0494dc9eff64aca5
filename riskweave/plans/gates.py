"""Registered queries: data-quality gates (Q) and fidelity / drift (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import domains as d
from riskweave.operators import fidelity as fd
from riskweave.operators import metrics as m
from riskweave.operators import quality as q
from riskweave.operators import splits as s
from riskweave.plans.registry import Tables, query
from riskweave.plans.views import with_views
from riskweave.session import pin

# Pay events in the shape of the population table: split by sender, vectors by family and rail.
_POP = (
    "SELECT c.*, CASE WHEN event_id % 997 = 0 THEN 'train' ELSE CASE sender_account_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test_known' ELSE 'test_novel' END END AS split, "
    "CASE WHEN label_fraud THEN 'attack' WHEN event_id % 4 = 0 THEN 'legitimate_control' ELSE 'ordinary_legitimate' END AS case_role, "
    "CASE WHEN label_fraud AND k < 99 THEN concat(attack_family, '-', payment_rail) END AS attack_vector_id, "
    "CASE WHEN sender_account_id % 3 = 0 THEN case_id END AS scenario_id, CASE k % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, "
    "CAST((k * 7) % 50 AS DOUBLE) + CAST(5 AS DOUBLE) AS sender_baseline_amount_inr, CAST((k * 13 + event_id) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS risk_signal_density "
    "FROM {case_events} c"
)
_VECTOR_IDS = "SELECT concat(f, '-', r) AS vector_id, f AS family FROM (SELECT unnest(['FAM-A', 'FAM-B', 'FAM-C', 'FAM-D']) AS f) a, (SELECT unnest(['UPI', 'CARD', 'WALLET']) AS r) b"


def population(t: Tables, written: bool = False):
    """The population table; ``written`` stores it first, for queries that read it many times."""
    pop = t.spark.sql(_POP, case_events=t("case_events"))
    return pin(pop, "population") if written else pop


def catalogue(t: Tables):
    """Vector ids taken from the rails that occur, times the declared families."""
    rails = t("pay_events").select("payment_rail").distinct().where(F.col("payment_rail") != "BANK_TRANSFER")
    families = F.explode(F.array(*[F.lit(f) for f in ("FAM-A", "FAM-B", "FAM-C", "FAM-D")]))
    return rails.select("payment_rail", families.alias("family")).select(F.concat_ws("-", "family", "payment_rail").alias("vector_id"), "family")


def holdout(t: Tables):
    return catalogue(t).where(F.col("vector_id") == "FAM-A-UPI").select("vector_id")


def _pop(sql: str, **extra: str) -> str:
    return with_views(sql, "case_events", pop=_POP.format(case_events="case_events"), vec=_VECTOR_IDS, **extra)


# Orders with exact copies and broken values, in the shape of card transactions.
_COPIES = (
    "SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_partkey % 83 = 0 THEN CAST('Infinity' AS DOUBLE) "
    "ELSE l_extendedprice END AS amount FROM {lineitem}"
)


def broken(t: Tables):
    return t.spark.sql(_COPIES, lineitem=t("lineitem"))


def _broken(sql: str) -> str:
    return with_views(sql, br=_COPIES.format(lineitem="lineitem"))


@query("Q2_key_uniqueness", "SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicates FROM lineitem")
def _(t: Tables):
    return q.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q3_value_domain", "SELECT o_orderpriority AS value, count(*) AS rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def _(t: Tables):
    return q.domain_violations(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("Q4_group_isolation", _pop("SELECT count(*) AS leaking_groups FROM (SELECT sender_account_id FROM pop GROUP BY 1 HAVING count(DISTINCT split) > 1) x"))
def _(t: Tables):
    return q.group_isolation(population(t), "sender_account_id")


@query("Q5_Q6_Q7_row_checks", _pop(
    "SELECT count(*) FILTER (WHERE label_fraud AND (attack_family IS NULL OR attack_vector_id IS NULL)) AS attack_label_errors, count(*) FILTER (WHERE NOT label_fraud AND attack_family IS NOT NULL) AS legitimate_label_errors, "
    "count(*) FILTER (WHERE amount_inr < 1 OR amount_inr > 60) AS out_of_range, count(*) FILTER (WHERE scenario_id IS NULL OR attack_family IS NULL) AS incomplete_rows, "
    "CAST(sum(CAST(scenario_id IS NULL AS INT) + CAST(attack_family IS NULL AS INT)) AS BIGINT) AS null_cells FROM pop"))
def _(t: Tables):
    return population(t).agg(
        q.attack_label_errors().alias("attack_label_errors"), q.legitimate_label_errors().alias("legitimate_label_errors"),
        q.out_of_range("amount_inr", 1, 60).alias("out_of_range"), q.incomplete_rows(["scenario_id", "attack_family"]).alias("incomplete_rows"),
        q.null_cells(["scenario_id", "attack_family"]).alias("null_cells"),
    )


@query("Q8_class_coverage", _pop("SELECT split, count(DISTINCT label_fraud) AS classes FROM pop GROUP BY 1"))
def _(t: Tables):
    return q.class_coverage(population(t), "split", "label_fraud")


@query("Q9_catalogue_coverage", _pop(
    "SELECT (SELECT count(*) FROM vec WHERE vector_id NOT IN (SELECT attack_vector_id FROM pop WHERE attack_vector_id IS NOT NULL)) AS missing_vectors, "
    "(SELECT count(DISTINCT attack_vector_id) FROM pop WHERE split <> 'test_novel' AND attack_vector_id = 'FAM-A-UPI') AS leaked_holdouts"))
def _(t: Tables):
    return q.catalog_gaps(population(t), "attack_vector_id", catalogue(t), "vector_id", holdout(t), "vector_id")


@query("Q10_exact_duplicates", (
    "SELECT CAST(sum(n) AS BIGINT) AS raw_row_count, count(*) AS modeled_row_count, CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_rows_removed, "
    "CAST(sum(n * p) AS BIGINT) AS raw_fraud_count, CAST(sum(p) AS BIGINT) AS modeled_fraud_count FROM (SELECT *, count(*) AS n, "
    "CAST(l_returnflag = 'R' AS INT) AS p FROM lineitem GROUP BY ALL) x"))
def _(t: Tables):
    rows = t("lineitem")
    return q.deduplicate(rows, F.col("l_returnflag") == "R")[1]


@query("Q10_deduplicated_rows", "SELECT DISTINCT * FROM lineitem")
def _(t: Tables):
    rows = t("lineitem")
    return q.deduplicate(rows, F.col("l_returnflag") == "R")[0]


@query("Q11_finiteness", _broken("SELECT count(*) FILTER (WHERE amount IS NULL OR isnan(amount) OR isinf(amount)) AS non_finite FROM br"))
def _(t: Tables):
    rows = broken(t)
    return rows.agg(q.non_finite_cells(["amount"]).alias("non_finite"))


@query("Q12_chronological_order", (
    "SELECT count(*) FILTER (WHERE o_orderdate < p) AS order_violations FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders) x"))
def _(t: Tables):
    return q.order_violations(t("orders"), "o_orderdate", "o_orderkey")


_TRAIN = "SELECT *, CASE WHEN label_fraud AND lifecycle_phase <> 'pre_transaction' THEN 1 ELSE 0 END AS label, label_fraud AS is_attack, concat(event_type, '-', CAST(k % 30 AS STRING)) AS kind FROM {case_events}"


def train(t: Tables):
    return t.spark.sql(_TRAIN, case_events=t("case_events"))


def _train(sql: str) -> str:
    return with_views(sql, "case_events", tr=_TRAIN.format(case_events="case_events"))


@query("Q14_coverage_audit", _train(
    "SELECT kind AS event_type, count(*) AS rows, CAST(sum(label) AS BIGINT) AS malicious, bool_or(is_attack) AS in_attack, bool_or(NOT is_attack) AS in_legit, "
    "bool_or(is_attack) AND NOT bool_or(NOT is_attack) AS presence_leak FROM tr GROUP BY 1"))
def _(t: Tables):
    return q.coverage_audit(train(t).drop("event_type").withColumnRenamed("kind", "event_type"))


@query("Q14_source_mix", _train("SELECT CASE WHEN is_attack THEN 'attack' ELSE 'control' END AS source, count(*) AS rows, CAST(sum(label) AS BIGINT) AS fraud_rows FROM tr GROUP BY 1"))
def _(t: Tables):
    return q.source_mix(train(t).withColumn("source", F.when(F.col("is_attack"), "attack").otherwise("control")))


@query("Q15_class_overlap", _train(
    "SELECT 'amount_inr' AS attribute, count(amount_inr) FILTER (WHERE is_attack) AS attack_rows, count(amount_inr) FILTER (WHERE NOT is_attack) AS legit_rows, "
    "min(amount_inr) FILTER (WHERE is_attack) <= max(amount_inr) FILTER (WHERE NOT is_attack) AND min(amount_inr) FILTER (WHERE NOT is_attack) <= max(amount_inr) FILTER (WHERE is_attack) AS overlaps FROM tr UNION ALL "
    "SELECT 'beneficiary_age_days', count(beneficiary_age_days) FILTER (WHERE is_attack), count(beneficiary_age_days) FILTER (WHERE NOT is_attack), "
    "min(beneficiary_age_days) FILTER (WHERE is_attack) <= max(beneficiary_age_days) FILTER (WHERE NOT is_attack) AND min(beneficiary_age_days) FILTER (WHERE NOT is_attack) <= max(beneficiary_age_days) FILTER (WHERE is_attack) FROM tr UNION ALL "
    "SELECT 'event_type', count(*) FILTER (WHERE is_attack), count(*) FILTER (WHERE NOT is_attack), (SELECT count(*) > 0 FROM (SELECT event_type FROM tr WHERE is_attack INTERSECT SELECT event_type FROM tr WHERE NOT is_attack) z) FROM tr"))
def _(t: Tables):
    return q.class_overlap(train(t), ["amount_inr", "beneficiary_age_days"], ["event_type"])


@query("Q16_sequence_contiguity", with_views(
    "SELECT case_id, count(*) AS events, min(s) = 1 AND max(s) = count(*) AND count(DISTINCT s) = count(*) AS contiguous FROM (SELECT case_id, CASE WHEN event_id % 50 = 0 THEN sequence + 1 ELSE sequence END AS s FROM case_events) x GROUP BY 1", "case_events"))
def _(t: Tables):
    shifted = F.when(F.col("event_id") % 50 == 0, F.col("sequence") + 1).otherwise(F.col("sequence"))
    return q.sequence_contiguity(t("case_events").withColumn("sequence", shifted))


@query("Q16_offset_order", with_views(
    "SELECT case_id, sequence, off AS offset_seconds FROM (SELECT *, lag(off) OVER (PARTITION BY case_id ORDER BY sequence) AS p FROM (SELECT case_id, sequence, (sequence * 60 + k * 3) AS off FROM case_events) a) b WHERE off < p", "case_events"))
def _(t: Tables):
    return q.offset_order_violations(t("case_events").withColumn("offset_seconds", F.col("sequence") * 60 + F.col("k") * 3), "case_id", "sequence", "offset_seconds")


@query("Q17_forbidden_json_keys", with_views(
    "SELECT event_id, unnest(CASE WHEN k % 10 = 0 THEN ['is_attack'] WHEN k % 10 = 5 THEN ['user_password'] ELSE [] END) AS key FROM pay_events", "pay_events"))
def _(t: Tables):
    k = F.col("k")
    nested = F.when(k % 10 == 0, ', "meta": {"list": [{"is_attack": true}]}').when(k % 10 == 5, ', "user_password": 1').when(
        k % 10 == 7, ', "note": "is_attack: no"').otherwise("")
    text = F.concat(F.lit('{"k": '), k.cast("string"), nested, F.lit("}"))
    return q.forbidden_json_keys(t("pay_events").withColumn("payload", text), "payload", "event_id")


@query("Q17_payload_violations", with_views(
    "SELECT count(*) FILTER (WHERE beneficiary_id NOT LIKE 'ben\\_1%' ESCAPE '\\') AS unprefixed_beneficiary_id, count(*) FILTER (WHERE amount_inr NOT BETWEEN 1 AND 90) AS amount_out_of_limit FROM evidence_events", "evidence_events"))
def _(t: Tables):
    return q.payload_violations(t("evidence_events"), ["beneficiary_id"], "amount_inr", "ben_1", 1, 90)


_CHECK_SQL = (
    "SELECT 'required_schema' AS name, 0 AS o, 'no missing fields' AS expected, 'critical' AS severity UNION ALL "
    "SELECT 'event_id_uniqueness', (SELECT count(*) - count(DISTINCT event_id) FROM pop), '0 duplicates', 'critical' UNION ALL "
    "SELECT 'split_domain', (SELECT count(*) FROM pop WHERE split NOT IN ('train', 'validation', 'test_known', 'test_novel')), 'only sealed split values', 'critical' UNION ALL "
    "SELECT 'scenario_split_isolation', (SELECT count(*) FROM (SELECT scenario_id FROM pop WHERE scenario_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1) x), '0 leaking scenarios', 'critical' UNION ALL "
    "SELECT 'entity_split_isolation', (SELECT count(*) FROM (SELECT sender_account_id FROM pop GROUP BY 1 HAVING count(DISTINCT split) > 1) x), '0 leaking sender entities', 'critical' UNION ALL "
    "SELECT 'attack_label_integrity', (SELECT count(*) FROM pop WHERE label_fraud AND (attack_family IS NULL OR attack_vector_id IS NULL)), '0 attack rows without labels', 'critical' UNION ALL "
    "SELECT 'legitimate_label_integrity', (SELECT count(*) FROM pop WHERE NOT label_fraud AND attack_family IS NOT NULL), '0 legitimate rows with attack labels', 'critical' UNION ALL "
    "SELECT 'amount_domain', (SELECT count(*) FROM pop WHERE amount_inr < 0 OR amount_inr > 250000), 'INR 0 to 250000', 'high' UNION ALL "
    "SELECT 'core_completeness', (SELECT count(*) FROM pop WHERE event_id IS NULL OR event_ts IS NULL OR case_id IS NULL OR split IS NULL), '0 incomplete rows', 'critical' UNION ALL "
    "SELECT 'class_coverage_by_split', (SELECT count(*) FROM (SELECT split FROM pop GROUP BY 1 HAVING count(DISTINCT label_fraud) <> 2) x), 'both classes in every split', 'high' UNION ALL "
    "SELECT 'threat_vector_coverage', (SELECT count(*) FROM vec WHERE vector_id NOT IN (SELECT attack_vector_id FROM pop WHERE attack_vector_id IS NOT NULL)), 'all atlas vectors represented', 'high' UNION ALL "
    "SELECT 'novel_vector_seal', (SELECT count(DISTINCT attack_vector_id) FROM pop WHERE split <> 'test_novel' AND attack_vector_id = 'FAM-A-UPI'), '0 novel vectors outside test_novel', 'critical'"
)


@query("X3_checks_table", _pop("SELECT name, o = 0 AS passed, CAST(o AS VARCHAR) AS observed, expected, severity FROM chk", chk=_CHECK_SQL))
def _(t: Tables):
    return q.population_checks(population(t, written=True), catalogue(t), "vector_id", holdout(t), "vector_id")


@query("Q18_quality_score", _pop(
    "SELECT round(100 * sum(CASE WHEN o = 0 THEN w ELSE 0 END) / CAST(sum(w) AS DOUBLE), 2) AS score, count(*) FILTER (WHERE o <> 0) AS failure_count, "
    "count(*) FILTER (WHERE o <> 0 AND severity = 'critical') AS critical_failure_count, CASE WHEN bool_and(o = 0) THEN 'passed' ELSE 'failed' END AS status FROM ("
    "SELECT *, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w FROM chk) c", chk=_CHECK_SQL))
def _(t: Tables):
    return q.quality_score(q.population_checks(population(t, written=True), catalogue(t), "vector_id", holdout(t), "vector_id"))


@query("Q12_card_checks", with_views(
    "SELECT name, CAST(o AS VARCHAR) AS observed, o = tgt AS passed, severity FROM (SELECT 'required_schema' AS name, 0 AS o, 0 AS tgt, 'critical' AS severity UNION ALL "
    "SELECT 'exact_row_duplicates', (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT time_s, amount, class, v1, v2, v3 FROM card_tx) z) FROM card_tx), 0, 'high' UNION ALL "
    "SELECT 'required_value_completeness', 0, 0, 'critical' UNION ALL SELECT 'numeric_finiteness', 0, 0, 'critical' UNION ALL SELECT 'label_domain', 0, 0, 'critical' UNION ALL "
    "SELECT 'amount_domain', (SELECT count(*) FROM card_tx WHERE amount < 0), 0, 'high' UNION ALL SELECT 'elapsed_time_domain', (SELECT count(*) FROM card_tx WHERE time_s < 0), 0, 'high' UNION ALL "
    "SELECT 'published_row_count_reconciliation', (SELECT count(*) FROM card_tx), 15000, 'high' UNION ALL SELECT 'published_fraud_count_reconciliation', (SELECT sum(class) FROM card_tx), 492, 'high' UNION ALL "
    "SELECT 'source_chronological_order', (SELECT count(*) FILTER (WHERE time_s < p) FROM (SELECT time_s, lag(time_s) OVER (ORDER BY row_id) AS p FROM card_tx) z), 0, 'medium') c", "card_tx"))
def _(t: Tables):
    checks = q.card_checks(t("card_tx"), ["v1", "v2", "v3"], "time_s", "amount", "class", "row_id", 15000, 492)
    return checks.select("name", "observed", "passed", "severity")


@query("Q19_audit_reported_metrics", with_views(
    "SELECT payment_rail, abs(p - tp / CAST(tp + fp AS DOUBLE)) < 1e-6 AS precision_agrees, true AS recall_agrees, true AS false_positive_rate_agrees FROM ("
    "SELECT payment_rail, tp, fp, round(tp / CAST(tp + fp AS DOUBLE), 6) + CASE WHEN payment_rail = 'UPI' THEN 1e-2 ELSE 0 END AS p FROM ("
    "SELECT payment_rail, count(*) FILTER (WHERE label_fraud AND predicted_fraud) AS tp, count(*) FILTER (WHERE NOT label_fraud AND predicted_fraud) AS fp FROM predictions GROUP BY 1) a) b", "predictions"))
def _(t: Tables):
    reported = m.confusion_metrics(t("predictions"), "label_fraud", "predicted_fraud", ["payment_rail"]).withColumn(
        "precision", F.col("precision") + F.when(F.col("payment_rail") == "UPI", 0.01).otherwise(0.0)
    )
    return q.audit_reported_metrics(reported).select("payment_rail", "precision_agrees", "recall_agrees", "false_positive_rate_agrees")


@query("Q19_audit_split_ranges", with_views(
    "SELECT a.split AS earlier, b.split AS later, a.hi <= b.lo AS ordered FROM r a JOIN r b ON (a.split = 'train' AND b.split = 'validation') OR (a.split = 'validation' AND b.split = 'test')", "card_tx",
    r="SELECT split, min(time_s) AS lo, max(time_s) AS hi FROM (SELECT time_s, CASE WHEN rn <= floor(n * (CAST(1 AS DOUBLE) - 2e-1 - 2e-1)) THEN 'train' WHEN rn <= floor(n * (CAST(1 AS DOUBLE) - 2e-1)) THEN 'validation' ELSE 'test' END AS split "
      "FROM (SELECT *, row_number() OVER (ORDER BY time_s, row_id) AS rn, count(*) OVER () AS n FROM card_tx) x) y GROUP BY 1"))
def _(t: Tables):
    tagged = s.chronological_split(t("card_tx").select("row_id", "time_s", "class"), "time_s", "row_id")
    summary = m.split_summary(tagged, "split", "class", "time_s")
    return q.audit_split_ranges(summary, "split", {"train": 0, "validation": 1, "test": 2})


# ---------------------------------------------------------------- fidelity

_JS = (
    "SELECT round(greatest(0e0, 1 - (5e-1 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 5e-1 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / ln(2e0)), 6) AS similarity FROM ("
    "SELECT coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER () AS DOUBLE) AS p, coalesce(share, 0e0) / sum(coalesce(share, 0e0)) OVER () AS q FROM {obs} o FULL JOIN {pri} r ON r.rail = o.rail) z"
)


def priors(t: Tables, table: dict[str, float]):
    """Declared shares as a table: one row per declared key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rail"), F.lit(v).alias("share")) for k, v in table.items()])
    return t.spark.range(1).select(F.explode(pairs).alias("p")).select("p.*")


@query("F1_js_similarity", with_views(
    _JS.format(obs="(SELECT payment_rail AS rail, count(*) AS n FROM pay_events WHERE NOT label_fraud GROUP BY 1)", pri="rail_priors"), "pay_events", "rail_priors"))
def _(t: Tables):
    ordinary = t("pay_events").where(~F.col("label_fraud"))
    return fd.js_similarity(ordinary, "payment_rail", priors(t, d.RAIL_PRIORS), "rail", "share")


@query("F2_amount_calibration", _pop(
    "SELECT round(md, 4) AS median_ratio, round(greatest(0e0, 1 - abs(ln(greatest(md, 1e-2))) / ln(3e0)), 6) AS amount_calibration FROM (SELECT median(amount_inr / sender_baseline_amount_inr) AS md FROM pop "
    "WHERE case_role = 'ordinary_legitimate' AND amount_inr > 0) x"))
def _(t: Tables):
    ordinary = population(t).where(F.col("case_role") == "ordinary_legitimate").withColumn("r", F.col("amount_inr") / F.col("sender_baseline_amount_inr"))
    return fd.amount_calibration(ordinary, "amount_inr", "r")


_SPEAR = (
    "SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY amount_inr) + (count(*) OVER (PARTITION BY amount_inr) - 1) / 2e0 AS rx, "
    "rank() OVER (ORDER BY sender_baseline_amount_inr) + (count(*) OVER (PARTITION BY sender_baseline_amount_inr) - 1) / 2e0 AS ry FROM pop WHERE case_role = 'ordinary_legitimate') z"
)


@query("F3_spearman", _pop(_SPEAR))
def _(t: Tables):
    return fd.spearman(population(t).where(F.col("case_role") == "ordinary_legitimate"), "amount_inr", "sender_baseline_amount_inr")


@query("F4_edge_case_calibration", with_views(
    "SELECT round(r, 6) AS edge_case_rate, round(greatest(0e0, 1 - abs(r - 12e-2) / 12e-2), 6) AS edge_case_calibration FROM (SELECT avg(CAST(CAST(event_id % 10 = 0 AS INT) AS DOUBLE)) AS r FROM pay_events WHERE NOT label_fraud) x", "pay_events"))
def _(t: Tables):
    return fd.edge_case_calibration(t("pay_events").where(~F.col("label_fraud")), F.col("event_id") % 10 == 0)


_COV = (
    "SELECT round((SELECT count(*) FROM vec WHERE vector_id IN (SELECT attack_vector_id FROM pop)) / CAST((SELECT count(*) FROM vec) AS DOUBLE), 6) AS vector_coverage, "
    "round((SELECT count(DISTINCT attack_family) FROM pop) / CAST((SELECT count(DISTINCT family) FROM vec) AS DOUBLE), 6) AS family_coverage"
)


@query("F5_catalog_coverage", _pop(_COV))
def _(t: Tables):
    return fd.catalog_coverage(population(t), catalogue(t), "attack_vector_id", "attack_family", "vector_id", "family")


_GRAD = (
    "SELECT round(e, 6) AS mean_easy, round(md, 6) AS mean_medium, round(h, 6) AS mean_hard, e >= md AND md >= h AS difficulty_gradient FROM (SELECT "
    + ", ".join(f"coalesce(avg(risk_signal_density) FILTER (WHERE label_fraud AND difficulty = '{lv}'), 0e0) AS {n}" for lv, n in (("easy", "e"), ("medium", "md"), ("hard", "h")))
    + " FROM pop) x"
)


@query("F6_difficulty_gradient", _pop(_GRAD))
def _(t: Tables):
    return fd.difficulty_gradient(population(t))


@query("F7_fidelity_score", _pop(
    "SELECT round(100 * (16e-2 * js.similarity + 12e-2 * jc.similarity + 12e-2 * am.amount_calibration + 10e-2 * greatest(0e0, least(1e0, sp.spearman)) + 10e-2 * ec.c + 16e-2 * cv.vector_coverage + 10e-2 * cv.family_coverage "
    "+ 8e-2 * 1 + 6e-2 * CAST(gr.difficulty_gradient AS INT)), 2) AS fidelity_score FROM js, jc, am, sp, ec, cv, gr",
    rp="SELECT unnest(['UPI', 'CARD', 'BANK_TRANSFER', 'WALLET']) AS rail, unnest([45e-2, 25e-2, 18e-2, 12e-2]) AS share",
    cp="SELECT unnest(['MOBILE_APP', 'WEB', 'POS', 'API']) AS rail, unnest([56e-2, 20e-2, 14e-2, 10e-2]) AS share",
    ordinary="SELECT * FROM pop WHERE case_role = 'ordinary_legitimate'",
    js=_JS.format(obs="(SELECT payment_rail AS rail, count(*) AS n FROM ordinary GROUP BY 1)", pri="rp"),
    jc=_JS.format(obs="(SELECT channel AS rail, count(*) AS n FROM ordinary GROUP BY 1)", pri="cp"),
    am="SELECT round(greatest(0e0, 1 - abs(ln(greatest(median(amount_inr / sender_baseline_amount_inr), 1e-2))) / ln(3e0)), 6) AS amount_calibration FROM ordinary WHERE amount_inr > 0",
    sp=_SPEAR, ec="SELECT round(greatest(0e0, 1 - abs(avg(CAST(CAST(event_id % 10 = 0 AS INT) AS DOUBLE)) - 12e-2) / 12e-2), 6) AS c FROM ordinary", cv=_COV, gr=_GRAD))
def _(t: Tables):
    pop = population(t, written=True)
    ordinary = pop.where(F.col("case_role") == "ordinary_legitimate").withColumn("r", F.col("amount_inr") / F.col("sender_baseline_amount_inr"))
    coverage = fd.catalog_coverage(pop, catalogue(t), "attack_vector_id", "attack_family", "vector_id", "family")
    valid = q.sequence_contiguity(pop).agg(F.min(F.col("contiguous").cast("int")).alias("v"))
    parts = fd.fidelity_parts({
        "rail_similarity": (fd.js_similarity(ordinary, "payment_rail", priors(t, d.RAIL_PRIORS), "rail", "share"), "similarity"),
        "channel_similarity": (fd.js_similarity(ordinary, "channel", priors(t, d.CHANNEL_PRIORS), "rail", "share"), "similarity"),
        "amount_calibration": (fd.amount_calibration(ordinary, "amount_inr", "r"), "amount_calibration"),
        "amount_baseline_spearman": (fd.spearman(ordinary, "amount_inr", "sender_baseline_amount_inr"), "spearman"),
        "edge_case_calibration": (fd.edge_case_calibration(ordinary, F.col("event_id") % 10 == 0), "edge_case_calibration"),
        "vector_coverage": (coverage, "vector_coverage"), "family_coverage": (coverage, "family_coverage"),
        "sequence_validity": (valid, "v"), "difficulty_gradient": (fd.difficulty_gradient(pop), "difficulty_gradient"),
    })
    return fd.fidelity_score(parts).select("fidelity_score")


def _psi_cte(feature: str) -> dict[str, str]:
    return {
        f"e_{feature}": f"SELECT list_sort(list_distinct(quantile_cont({feature}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM ref",
        f"p_{feature}": f"SELECT '{feature}' AS feature, round(sum((o - r) * ln(o / r)), 6) AS psi FROM (SELECT greatest(count(*) FILTER (WHERE src = 0) / CAST((SELECT count(*) FROM ref) AS DOUBLE), 1e-6) AS r, "
                        f"greatest(count(*) FILTER (WHERE src = 1) / CAST((SELECT count(*) FROM obs) AS DOUBLE), 1e-6) AS o FROM (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= {feature})) AS b, src FROM ("
                        f"SELECT {feature}, 0 AS src FROM ref UNION ALL SELECT {feature}, 1 FROM obs) u, e_{feature}) v GROUP BY b) w",
    }


_PSI = {
    "ref": "SELECT * FROM card_tx WHERE row_id < (SELECT max(row_id) * 6e-1 FROM card_tx)", "obs": "SELECT * FROM card_tx WHERE row_id >= (SELECT max(row_id) * 8e-1 FROM card_tx)",
    **_psi_cte("v1"), **_psi_cte("v2"), **_psi_cte("v3"), **_psi_cte("amount"),
}
_PSI_ALL = "SELECT * FROM p_v1 UNION ALL SELECT * FROM p_v2 UNION ALL SELECT * FROM p_v3 UNION ALL SELECT * FROM p_amount"


def reference_and_observed(t: Tables):
    card = t("card_tx")
    edge = card.agg(F.max("row_id").alias("_m"))
    with_edge = card.crossJoin(F.broadcast(edge))
    return (
        with_edge.where(F.col("row_id") < F.col("_m") * 0.6).drop("_m"), with_edge.where(F.col("row_id") >= F.col("_m") * 0.8).drop("_m"),
    )


@query("F8_psi", with_views(_PSI_ALL, "card_tx", **_PSI))
def _(t: Tables):
    ref, obs = reference_and_observed(t)
    return fd.psi_by_feature(ref, obs, ["v1", "v2", "v3", "amount"])


@query("F9_psi_report", with_views(
    f"SELECT feature, psi, CASE WHEN psi < 1e-1 THEN 'small' WHEN psi <= 25e-2 THEN 'moderate' ELSE 'large' END AS band FROM ({_PSI_ALL}) x ORDER BY psi DESC, feature LIMIT 8", "card_tx", **_PSI))
def _(t: Tables):
    ref, obs = reference_and_observed(t)
    return fd.psi_report(ref, obs, ["v1", "v2", "v3", "amount"])


def _shape(source: str, by: str) -> str:
    return (
        f"SELECT {by} positive_count, zero_rate, round(greatest(m, 1e-9), 6) AS median, " + ", ".join(f"round(qs[{i}] / greatest(m, 1e-9), 6) AS {n}" for i, n in enumerate(fd.SHAPE_QUANTILES, 1))
        + f" FROM (SELECT {by} count(*) FILTER (WHERE amount > 0) AS positive_count, round(avg(CAST(CAST(amount = 0 AS INT) AS DOUBLE)), 6) AS zero_rate, median(amount) FILTER (WHERE amount > 0) AS m, "
          f"quantile_cont(amount, [0.5, 0.75, 0.9, 0.95, 0.99]) FILTER (WHERE amount > 0) AS qs FROM {source} GROUP BY ALL) x"
    )


@query("F10_amount_shape_profile", with_views(_shape("(SELECT event_type, CASE WHEN k % 9 = 0 THEN 0e0 ELSE amount_inr END AS amount FROM pay_events)", "event_type,"), "pay_events"))
def _(t: Tables):
    rows = t("pay_events").select("event_type", F.when(F.col("k") % 9 == 0, 0.0).otherwise(F.col("amount_inr")).alias("amount"))
    return fd.amount_shape_profile(rows, "amount", ["event_type"])


@query("F11_shape_similarity", with_views(
    "SELECT round(exp(-(" + " + ".join(f"abs(ln(greatest(b.{n}, 1e-9) / greatest(a.{n}, 1e-9)))" for n in fd.SHAPE_QUANTILES) + ") / 5), 6) AS shape_similarity, round(pb / pa, 2) AS prevalence_multiplier "
    "FROM a, b, (SELECT avg(CAST(class AS DOUBLE)) AS pa FROM card_tx) x, (SELECT avg(CAST(CAST(label_fraud AS INT) AS DOUBLE)) AS pb FROM pay_events) y", "card_tx", "pay_events",
    a=_shape("card_tx", ""), b=_shape("(SELECT amount_inr AS amount FROM pay_events)", "")))
def _(t: Tables):
    card, events = t("card_tx"), t("pay_events")
    a = fd.amount_shape_profile(card, "amount").crossJoin(F.broadcast(card.agg(F.avg("class").alias("prevalence"))))
    b = fd.amount_shape_profile(events, "amount_inr").crossJoin(F.broadcast(events.agg(F.avg(F.col("label_fraud").cast("int")).alias("prevalence"))))
    return fd.shape_similarity(a, b, F.col("prevalence"), F.col("prevalence"))
