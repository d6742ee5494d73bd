"""Dashboard aggregates over the driver tables; "now" is the newest event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.operators import graph, metrics
from deskstream.plans.bindings import NOW, bind
from deskstream.plans.registry import query
from deskstream.sources.bind import Inputs

RECENT = f"ingested_at >= {NOW} - INTERVAL 7 DAY"
LIVE = f"source <> 'SEED' AND {RECENT}"
MADE = f"created_at >= {NOW} - INTERVAL 7 DAY"


@query(
    "metric_totals",
    bind("tickets")
    + f""" SELECT count(*) AS tickets, count(*) FILTER (WHERE status IN ('RESOLVED', 'CLOSED')) AS resolved,
  count(*) FILTER (WHERE queue = 'SENIOR') AS senior_queue, count(*) FILTER (WHERE sla_breached) AS sla_breached,
  coalesce(avg(CAST(escalation_risk AS DOUBLE)), 0) AS avg_risk FROM tickets WHERE {LIVE}""",
    num="avg_risk",
)
def _totals(i: Inputs) -> DataFrame:
    return metrics.metric_totals(i.tickets, i.as_of)


@query(
    "volume_by_day",
    bind("tickets") + f" SELECT strftime(ingested_at, '%Y-%m-%d') AS day, count(*) AS tickets FROM tickets WHERE {LIVE} GROUP BY 1",
)
def _volume(i: Inputs) -> DataFrame:
    return metrics.volume_by_day(i.tickets, i.as_of)


@query(
    "category_mix",
    bind("tickets") + f" SELECT coalesce(category, 'UNCLASSIFIED') AS category, count(*) AS tickets FROM tickets WHERE {LIVE} GROUP BY 1",
)
def _category(i: Inputs) -> DataFrame:
    return metrics.category_mix(i.tickets, i.as_of)


@query(
    "priority_mix",
    bind("tickets") + f" SELECT coalesce(priority, 'UNSET') AS priority, count(*) AS tickets FROM tickets WHERE {LIVE} GROUP BY 1",
)
def _priority(i: Inputs) -> DataFrame:
    return metrics.priority_mix(i.tickets, i.as_of)


@query(
    "risk_histogram",
    bind("tickets")
    + f""" SELECT CASE WHEN escalation_risk >= 1 THEN 11 ELSE CAST(floor(CAST(escalation_risk AS DOUBLE) * 10) AS BIGINT) + 1 END AS bucket,
  count(*) AS tickets FROM tickets WHERE {RECENT} AND escalation_risk IS NOT NULL GROUP BY 1""",
)
def _histogram(i: Inputs) -> DataFrame:
    return metrics.risk_histogram(i.tickets, i.as_of)


@query(
    "draft_outcomes",
    bind("feedback")
    + f""", c AS (SELECT count(*) FILTER (WHERE action = 'APPROVE') AS approved,
  count(*) FILTER (WHERE action = 'EDIT_APPROVE' AND draft_id IS NOT NULL) AS edited, count(*) FILTER (WHERE action = 'REJECT') AS rejected,
  count(*) FILTER (WHERE action = 'EDIT_APPROVE' AND draft_id IS NULL) AS manual,
  coalesce(avg(CAST(edit_ratio AS DOUBLE)) FILTER (WHERE action = 'EDIT_APPROVE' AND draft_id IS NOT NULL), 0) AS mean_edit_ratio,
  coalesce(avg(time_to_review_ms), 0) AS avg_review_ms, coalesce(avg(rating), 0) AS avg_rating FROM feedback WHERE {MADE})
SELECT *, approved + edited + rejected AS reviewed, (approved + edited) / nullif(approved + edited + rejected, 0) AS approval_rate,
  approved / nullif(approved + edited + rejected, 0) AS approved_as_is_rate FROM c""",
    num="mean_edit_ratio avg_review_ms avg_rating approval_rate approved_as_is_rate",
)
def _outcomes(i: Inputs) -> DataFrame:
    return metrics.draft_outcomes(i.feedback, i.as_of)


@query(
    "reject_reasons",
    bind("feedback") + f" SELECT reject_reason AS reason, count(*) AS n FROM feedback WHERE action = 'REJECT' AND {MADE} GROUP BY 1",
)
def _reasons(i: Inputs) -> DataFrame:
    return metrics.reject_reasons(i.feedback, i.as_of)


@query(
    "approval_by_grounding",
    bind("feedback", "drafts")
    + f""" SELECT d.grounding, count(*) AS reviewed,
  round(CAST(count(*) FILTER (WHERE f.action IN ('APPROVE', 'EDIT_APPROVE')) / count(*) AS DECIMAL(20,10)), 3) AS approval_rate,
  round(CAST(coalesce(avg(CAST(f.edit_ratio AS DOUBLE)), 0) AS DECIMAL(20,10)), 3) AS mean_edit_ratio
FROM feedback f JOIN drafts d ON d.id = f.draft_id WHERE f.{MADE} GROUP BY 1""",
    num="approval_rate mean_edit_ratio",
)
def _grounding(i: Inputs) -> DataFrame:
    return metrics.approval_by_grounding(i.feedback, i.drafts, i.as_of)


@query("draft_status_counts", bind("drafts") + f" SELECT status, count(*) AS n FROM drafts WHERE {MADE} GROUP BY 1")
def _draft_status(i: Inputs) -> DataFrame:
    return metrics.draft_status_counts(i.drafts, i.as_of)


@query(
    "llm_usage",
    bind("drafts")
    + f""" SELECT count(*) FILTER (WHERE reused_from_draft_id IS NULL AND model IS NOT NULL AND model <> 'incident-reuse') AS draft_calls,
  count(*) FILTER (WHERE reused_from_draft_id IS NOT NULL) AS reused_drafts, coalesce(sum(cost_usd), 0) AS draft_cost_usd,
  coalesce(avg(latency_ms), 0) AS avg_draft_latency_ms, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM drafts WHERE {MADE}""",
    num="draft_cost_usd avg_draft_latency_ms",
)
def _usage(i: Inputs) -> DataFrame:
    return metrics.llm_usage(i.drafts, i.as_of)


@query(
    "llm_classified_share",
    bind("tickets", "predictions")
    + f""" SELECT (SELECT coalesce(avg(CAST(category_source = 'LLM' AS INT)), 0) FROM tickets WHERE {LIVE} AND category IS NOT NULL) AS llm_classified_share,
  (SELECT count(*) FROM predictions WHERE model_name = 'zeroshot_llm' AND {MADE}) AS classify_calls""",
    num="llm_classified_share",
)
def _share(i: Inputs) -> DataFrame:
    return metrics.llm_classified_share(i.tickets, i.predictions, i.as_of)


@query(
    "cost_by_day",
    bind("drafts")
    + f" SELECT strftime(created_at, '%Y-%m-%d') AS day, sum(cost_usd) AS cost_usd, count(*) AS calls FROM drafts WHERE {MADE} AND cost_usd > 0 GROUP BY 1",
    num="cost_usd",
)
def _cost(i: Inputs) -> DataFrame:
    return metrics.cost_by_day(i.drafts, i.as_of)


@query(
    "label_corrections",
    bind("feedback")
    + f" SELECT count(corrected_category) AS category_corrections, count(corrected_priority) AS priority_corrections FROM feedback WHERE {MADE}",
)
def _corrections(i: Inputs) -> DataFrame:
    return metrics.label_corrections(i.feedback, i.as_of)


@query(
    "latency_percentiles",
    bind("tickets")
    + f""" SELECT coalesce(quantile_cont(epoch_us(triaged_at - ingested_at) / 1e6, 0.5), 0) AS triage_p50,
  coalesce(quantile_cont(epoch_us(triaged_at - ingested_at) / 1e6, 0.95), 0) AS triage_p95 FROM tickets WHERE {LIVE} AND triaged_at IS NOT NULL""".replace(
        "epoch_us(triaged_at - ingested_at)", "(epoch_us(triaged_at) - epoch_us(ingested_at))"
    ),
    num="triage_p50 triage_p95",
)
def _latency(i: Inputs) -> DataFrame:
    return metrics.latency_percentiles(i.tickets, "triaged_at", "triage", i.as_of)


@query(
    "draft_latency_percentiles",
    bind("tickets")
    + f""" SELECT coalesce(quantile_cont((epoch_us(drafted_at) - epoch_us(ingested_at)) / 1e6, 0.5), 0) AS draft_p50,
  coalesce(quantile_cont((epoch_us(drafted_at) - epoch_us(ingested_at)) / 1e6, 0.95), 0) AS draft_p95 FROM tickets WHERE {LIVE} AND drafted_at IS NOT NULL""",
    num="draft_p50 draft_p95",
)
def _draft_latency(i: Inputs) -> DataFrame:
    return metrics.latency_percentiles(i.tickets, "drafted_at", "draft", i.as_of)


@query(
    "ship_delay_percentiles",
    """SELECT coalesce(quantile_cont(d, 0.5), 0) AS delay_p50, coalesce(quantile_cont(d, 0.95), 0) AS delay_p95 FROM (
  SELECT (epoch_us(min(l_shipdate)) - epoch_us(any_value(o_orderdate))) / 1e6 AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) WHERE d >= 0""",
    num="delay_p50 delay_p95",
)
def _ship_delay(i: Inputs) -> DataFrame:
    """The same percentiles over a large table: first shipment after the order, in seconds."""
    from deskstream.operators.windows import exact_percentiles

    first = i.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    joined = i.table("orders").select("o_orderkey", "o_orderdate").join(first, "o_orderkey")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    delay = joined.select(((micros("shipped") - micros("o_orderdate")) / F.lit(1e6)).alias("d")).where("d >= 0")
    return exact_percentiles(delay, "d", [0.5, 0.95], ["delay_p50", "delay_p95"])


@query(
    "queue_counts",
    bind("tickets")
    + """ SELECT queue, count(*) FILTER (WHERE status NOT IN ('RESOLVED', 'CLOSED')) AS open, count(*) FILTER (WHERE status = 'DRAFTED') AS awaiting_review,
  count(*) FILTER (WHERE sla_breached AND status NOT IN ('RESOLVED', 'CLOSED')) AS breached FROM tickets GROUP BY 1""",
)
def _queues(i: Inputs) -> DataFrame:
    return metrics.queue_counts(i.tickets)


@query(
    "active_incidents",
    bind("clusters") + " SELECT count(*) FILTER (WHERE is_incident AND status = 'ACTIVE') AS active_incidents FROM clusters",
)
def _active(i: Inputs) -> DataFrame:
    return metrics.active_incidents(i.clusters)


@query("jobs_depth", bind("jobs") + " SELECT type, status, count(*) AS n FROM jobs WHERE status <> 'DONE' GROUP BY 1, 2")
def _depth(i: Inputs) -> DataFrame:
    return metrics.jobs_depth(i.jobs)


@query(
    "ready_jobs",
    bind("jobs")
    + """ SELECT type, id, priority FROM jobs WHERE status = 'PENDING' AND run_after <= TIMESTAMP '1998-01-01 00:00:00'
QUALIFY row_number() OVER (PARTITION BY type ORDER BY priority DESC, id) <= 32""",
)
def _ready(i: Inputs) -> DataFrame:
    return metrics.ready_jobs(i.jobs, F.lit("1998-01-01 00:00:00").cast("timestamp"), 32).select("type", "id", "priority")


_DRIFT = f""", d AS (SELECT p.label, p.score, CASE WHEN p.created_at >= {NOW} - INTERVAL 7 DAY AND p.created_at < {NOW} THEN 'recent'
  WHEN p.created_at >= {NOW} - INTERVAL 37 DAY AND p.created_at < {NOW} - INTERVAL 7 DAY THEN 'baseline' END AS period
  FROM predictions p JOIN tickets t ON t.id = p.ticket_id WHERE p.task = 'CATEGORY' AND p.model_name <> 'zeroshot_llm' AND t.source <> 'SEED'),
w AS (SELECT period, count(*) AS n, avg(CAST(score < CAST(0.8 AS FLOAT) AS INT)) AS low_share, avg(CAST(score AS DOUBLE)) AS mean_conf
  FROM d WHERE period IS NOT NULL GROUP BY 1),
l AS (SELECT label, count(*) FILTER (WHERE period = 'recent') AS r, count(*) FILTER (WHERE period = 'baseline') AS b FROM d GROUP BY 1),
s AS (SELECT sum(abs(r / (SELECT sum(r) FROM l) - b / (SELECT sum(b) FROM l))) / 2 AS category_shift FROM l)"""


@query("drift_window", bind("predictions", "tickets") + _DRIFT + " SELECT * FROM w", num="low_share mean_conf")
def _drift(i: Inputs) -> DataFrame:
    return metrics.drift_window(i.predictions, i.tickets, i.as_of)


@query("category_shift", bind("predictions", "tickets") + _DRIFT + " SELECT * FROM s", num="category_shift")
def _category_shift(i: Inputs) -> DataFrame:
    return metrics.category_shift(i.predictions, i.tickets, i.as_of)


@query(
    "drift_alert",
    bind("predictions", "tickets")
    + _DRIFT
    + """, x AS (SELECT a.n AS recent_n, a.low_share AS recent_low_share, b.n AS baseline_n, b.low_share AS baseline_low_share, category_shift
  FROM (SELECT * FROM w WHERE period = 'recent') a, (SELECT * FROM w WHERE period = 'baseline') b, s)
SELECT *, recent_n >= 30 AND baseline_n >= 30 AS enough_data,
  (recent_n >= 30 AND baseline_n >= 30) AND ((recent_low_share > 0.05 AND recent_low_share > 2 * baseline_low_share) OR category_shift > 0.2) AS alert FROM x""",
    num="recent_low_share baseline_low_share category_shift",
)
def _alert(i: Inputs) -> DataFrame:
    return metrics.drift_alert(i.predictions, i.tickets, i.as_of).select(
        "recent_n", "recent_low_share", "baseline_n", "baseline_low_share", "category_shift", "enough_data", "alert"
    )


@query(
    "cluster_stats",
    bind("tickets")
    + """ SELECT cluster_id, min(product) AS product, count(*) AS size, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at,
  arg_min(id, (created_at, id)) AS canonical_ticket_id, arg_min(subject, (created_at, id)) AS title FROM tickets WHERE cluster_id IS NOT NULL GROUP BY 1""",
    ts="first_seen_at last_seen_at",
)
def _stats(i: Inputs) -> DataFrame:
    return graph.cluster_stats(i.tickets)


@query(
    "cluster_timeline",
    bind("tickets")
    + " SELECT cluster_id, date_trunc('minute', created_at) AS minute, count(*) AS tickets FROM tickets WHERE cluster_id IS NOT NULL GROUP BY 1, 2",
    ts="minute",
)
def _timeline(i: Inputs) -> DataFrame:
    return metrics.cluster_timeline(i.tickets)


@query(
    "distinct_customers",
    bind("tickets")
    + " SELECT cluster_id, count(DISTINCT coalesce('c' || customer_id, 't' || id)) AS customers FROM tickets WHERE cluster_id IS NOT NULL GROUP BY 1",
)
def _customers(i: Inputs) -> DataFrame:
    return metrics.distinct_customers(i.tickets)


@query(
    "incident_merge_flags",
    bind("clusters", "cluster_mapping")
    + """, j AS (SELECT c.*, m.merged_into, coalesce(m.merged_into, c.id) AS target FROM clusters c LEFT JOIN cluster_mapping m ON m.cluster_id = c.id),
f AS (SELECT target, bool_or(is_incident) AS inc, min(incident_flagged_at) AS flagged, sum(size) AS total FROM j GROUP BY 1)
SELECT j.id, CASE WHEN merged_into IS NULL THEN inc ELSE is_incident END AS is_incident,
  CASE WHEN merged_into IS NULL THEN flagged ELSE incident_flagged_at END AS incident_flagged_at,
  CASE WHEN merged_into IS NULL THEN status ELSE 'MERGED' END AS status, merged_into,
  CAST(CASE WHEN merged_into IS NULL THEN total ELSE 0 END AS BIGINT) AS size
FROM j LEFT JOIN f ON f.target = j.id""",
    ts="incident_flagged_at",
)
def _merge_flags(i: Inputs) -> DataFrame:
    return graph.incident_merge_flags(i.clusters, i.cluster_mapping)


@query(
    "merge_clusters",
    bind("tickets", "cluster_mapping")
    + " SELECT t.id, coalesce(m.merged_into, t.cluster_id) AS cluster_id FROM tickets t LEFT JOIN cluster_mapping m ON m.cluster_id = t.cluster_id",
)
def _merge(i: Inputs) -> DataFrame:
    return graph.merge_clusters(i.tickets.select("id", "cluster_id"), i.cluster_mapping)


@query(
    "dataset_card",
    bind("tickets")
    + " UNION ALL ".join(
        f"{' SELECT' if k == 0 else 'SELECT'} '{c}' AS \"column\", {c} AS value, count(*) AS n FROM tickets GROUP BY 2"
        for k, c in enumerate(["category", "priority", "customer_tier", "product", "status"])
    ),
)
def _card(i: Inputs) -> DataFrame:
    return metrics.dataset_card(i.tickets, ["category", "priority", "customer_tier", "product", "status"])


@query(
    "dataset_card_by_split",
    bind("labelled")
    + """ SELECT split, round(avg(CAST(label IN (1, 2, 3) AS INT)), 3) AS escalated_rate, count(DISTINCT incident_id) AS incidents,
  count(DISTINCT root_cause_id) AS root_causes FROM labelled GROUP BY 1""",
    num="escalated_rate",
)
def _card_split(i: Inputs) -> DataFrame:
    return metrics.escalated_by_split(i.labelled.withColumn("escalated", F.col("label").isin(1, 2, 3)))


@query(
    "llm_usage_by_model",
    bind("drafts")
    + """ SELECT model, count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM drafts WHERE model IS NOT NULL GROUP BY 1""",
)
def _by_model(i: Inputs) -> DataFrame:
    return metrics.llm_usage_by_model(i.drafts)


@query("state_matrix", bind("tickets") + " SELECT status, draft_state, count(*) AS n FROM tickets GROUP BY 1, 2")
def _matrix(i: Inputs) -> DataFrame:
    return metrics.state_matrix(i.tickets)


@query(
    "pivot_counts",
    bind("tickets")
    + " SELECT product, "
    + ", ".join(f"count(*) FILTER (WHERE priority = '{p}') AS \"{p}\"" for p in ["LOW", "MEDIUM", "HIGH", "URGENT"])
    + " FROM tickets GROUP BY 1",
)
def _pivot(i: Inputs) -> DataFrame:
    return metrics.pivot_counts(i.tickets, "product", "priority", ["LOW", "MEDIUM", "HIGH", "URGENT"])
