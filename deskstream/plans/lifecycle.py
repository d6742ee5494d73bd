"""State changes over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.operators import joins, lifecycle
from deskstream.plans.bindings import NOW, bind, pick
from deskstream.plans.registry import query
from deskstream.schemas import CATEGORIES, PRIORITIES
from deskstream.sources.bind import Inputs

_PER_TICKET = """, p AS (SELECT ticket_id, bool_or(action <> 'REJECT') AS resolved, min(CASE WHEN action <> 'REJECT' THEN reviewed_at END) AS at,
  arg_min(final_body, (reviewed_at, draft_id)) FILTER (WHERE action <> 'REJECT') AS body, arg_min(agent_id, (reviewed_at, draft_id)) AS agent FROM accepted GROUP BY 1)"""


@query(
    "apply_review",
    bind("accepted", "review_tickets")
    + _PER_TICKET
    + """ SELECT t.id, CASE WHEN p.resolved THEN 'RESOLVED' WHEN p.resolved = false AND t.status <> 'RESOLVED' THEN 'IN_REVIEW' ELSE t.status END AS status,
  CASE WHEN p.resolved THEN md5(p.body) END AS resolution_hash, CASE WHEN p.resolved THEN p.at END AS resolved_at,
  CASE WHEN p.resolved THEN coalesce(t.first_response_at, p.at) ELSE t.first_response_at END AS first_response_at,
  CASE WHEN p.resolved OR (p.resolved = false AND t.status <> 'RESOLVED') THEN coalesce(t.assigned_agent_id, p.agent) ELSE t.assigned_agent_id END AS assigned_agent_id,
  t.version + CASE WHEN p.resolved OR (p.resolved = false AND t.status <> 'RESOLVED') THEN 1 ELSE 0 END AS version
FROM review_tickets t LEFT JOIN p ON p.ticket_id = t.id""",
    ts="resolved_at first_response_at",
)
def _review(i: Inputs) -> DataFrame:
    tickets, _, _ = lifecycle.apply_review(i.review_tickets, i.review_drafts, i.reviews)
    return tickets.select(
        "id", "status", F.md5("resolution").alias("resolution_hash"), "resolved_at", "first_response_at", "assigned_agent_id", "version"
    )


@query(
    "apply_review_feedback",
    bind("accepted")
    + """ SELECT draft_id, ticket_id, action, CASE action WHEN 'APPROVE' THEN 0 WHEN 'EDIT_APPROVE' THEN levenshtein(draft_body, final_body) END AS edit_distance,
  CASE action WHEN 'APPROVE' THEN 0 WHEN 'EDIT_APPROVE' THEN levenshtein(draft_body, final_body) / greatest(len(draft_body), len(final_body)) END AS edit_ratio FROM accepted""",
    num="edit_ratio",
)
def _review_feedback(i: Inputs) -> DataFrame:
    _, _, feedback = lifecycle.apply_review(i.review_tickets, i.review_drafts, i.reviews)
    return feedback.select("draft_id", "ticket_id", "action", F.col("edit_distance").cast("bigint").alias("edit_distance"), "edit_ratio")


@query(
    "apply_review_drafts",
    bind("accepted")
    + """ SELECT d.id, coalesce(CASE a.action WHEN 'APPROVE' THEN 'APPROVED' WHEN 'EDIT_APPROVE' THEN 'EDITED' WHEN 'REJECT' THEN 'REJECTED' END, d.status) AS status
FROM review_drafts d LEFT JOIN accepted a ON a.draft_id = d.id""",
)
def _review_drafts(i: Inputs) -> DataFrame:
    return lifecycle.apply_review(i.review_tickets, i.review_drafts, i.reviews)[1].select("id", "status")


@query(
    "manual_resolve",
    """WITH t AS ("""
    + f"SELECT conv_id AS id, {pick('conv_id % 6', ['NEW', 'TRIAGED', 'DRAFTED', 'IN_REVIEW', 'RESOLVED', 'CLOSED'])} AS status FROM (SELECT DISTINCT conv_id FROM conversations)"
    + """), r AS (SELECT conv_id AS id, conv_id % 6 AS agent_id, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) AS body, turn FROM conversations WHERE role = 'assistant'),
f AS (SELECT * FROM r WHERE length(body) >= 10 QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn, body) = 1)
SELECT f.id AS ticket_id, f.agent_id, md5(f.body) AS body_hash, length(f.body) AS edit_distance FROM f JOIN t USING (id) WHERE t.status NOT IN ('RESOLVED', 'CLOSED')""",
)
def _manual(i: Inputs) -> DataFrame:
    replies = i.table("conversations").where(F.col("role") == "assistant").selectExpr(
        "conv_id AS ticket_id", "conv_id % 6 AS agent_id", "text AS body",
        "timestamp'2024-01-03 00:00:00' + make_dt_interval(0, 0, 0, turn) AS replied_at",
    )
    _, feedback = lifecycle.manual_resolve(i.review_tickets, replies)
    return feedback.select(
        "ticket_id", "agent_id", F.md5("final_body").alias("body_hash"), F.col("edit_distance").cast("bigint").alias("edit_distance")
    )


_FIX = """, f AS (SELECT ticket_id, arg_max(corrected_category, id) FILTER (WHERE corrected_category IS NOT NULL) AS c,
  arg_max(corrected_priority, id) FILTER (WHERE corrected_priority IS NOT NULL) AS p FROM feedback GROUP BY 1),
j AS (SELECT t.*, f.c, f.p, f.c IS NOT NULL AND t.category IS DISTINCT FROM f.c AS nc, f.p IS NOT NULL AND t.priority IS DISTINCT FROM f.p AS np
  FROM tickets t LEFT JOIN f ON f.ticket_id = t.id)"""


@query(
    "apply_corrections",
    bind("tickets", "feedback", "policies")
    + _FIX
    + """ SELECT j.id, CASE WHEN nc THEN c ELSE category END AS category, CASE WHEN nc THEN 'AGENT' ELSE category_source END AS category_source,
  CASE WHEN np THEN j.p ELSE j.priority END AS priority, CASE WHEN np THEN created_at + to_minutes(coalesce(minutes, 480)) ELSE sla_due_at END AS sla_due_at
FROM j LEFT JOIN policies q ON q.customer_tier = j.customer_tier AND q.priority = j.p""",
    ts="sla_due_at",
)
def _corrections(i: Inputs) -> DataFrame:
    fixed = lifecycle.apply_corrections(i.tickets, i.feedback, joins.sla_policies(i.spark))
    return fixed.select("id", "category", "category_source", "priority", "sla_due_at")


@query(
    "close_the_loop",
    bind("tickets", "vectors")
    + " SELECT v.ticket_id, t.status IN ('RESOLVED', 'CLOSED') AS is_resolved, t.status NOT IN ('RESOLVED', 'CLOSED') AS is_open FROM vectors v JOIN tickets t ON t.id = v.ticket_id",
)
def _loop(i: Inputs) -> DataFrame:
    return lifecycle.close_the_loop(i.tickets, i.vectors).select("ticket_id", "is_resolved", "is_open")


@query(
    "shed_low_value",
    bind("tickets", "jobs")
    + """ SELECT id, coalesce(id % 6 <> 0 AND priority = 'LOW' AND coalesce(CAST(escalation_risk AS DOUBLE), 0) < 0.2
  AND (SELECT count(*) FROM jobs WHERE type = 'DRAFT' AND status = 'PENDING') > 50, false) AS shed FROM tickets""",
)
def _shed(i: Inputs) -> DataFrame:
    asked = i.tickets.withColumn("instruction", F.when(F.col("id") % 6 == 0, F.lit("be brief")))
    return lifecycle.shed_low_value(asked, i.jobs, depth=50).select("id", "shed")


@query(
    "reuse_incident_draft",
    bind("tickets", "drafts", "clusters")
    + f""", o AS (SELECT d.id, d.body, d.ticket_id, d.created_at, t.cluster_id FROM drafts d JOIN tickets t ON t.id = d.ticket_id
  JOIN clusters c ON c.id = t.cluster_id AND c.is_incident WHERE d.status IN ('GENERATED', 'APPROVED', 'EDITED') AND d.reused_from_draft_id IS NULL
  AND d.created_at > {NOW} - INTERVAL 72 HOUR)
SELECT t.id AS ticket_id, arg_max(o.id, (o.created_at, o.id)) AS reused_from_draft_id, arg_max(o.body, (o.created_at, o.id)) AS body, 0.0 AS cost_usd
FROM tickets t JOIN o ON o.cluster_id = t.cluster_id AND o.ticket_id <> t.id GROUP BY 1""",
    num="cost_usd",
)
def _reuse(i: Inputs) -> DataFrame:
    copies = lifecycle.reuse_incident_draft(i.tickets, i.drafts, i.clusters, i.as_of, hours=72)
    return copies.select("ticket_id", "reused_from_draft_id", "body", "cost_usd")


@query(
    "sla_breaches_asof",
    bind("tickets")
    + f""" SELECT id, sla_due_at FROM tickets WHERE sla_due_at < {NOW} AND first_response_at IS NULL AND status NOT IN ('RESOLVED', 'CLOSED') AND NOT sla_breached""",
    ts="sla_due_at",
)
def _breaches(i: Inputs) -> DataFrame:
    return lifecycle.sla_breaches(i.tickets, i.as_of).select("id", "sla_due_at")


@query(
    "triage_result",
    bind("tickets", "clusters", "policies")
    + f""" SELECT t.id, {pick('t.id % 8', CATEGORIES)} AS category, {pick('t.id % 4', PRIORITIES)} AS priority,
  coalesce(CAST(t.escalation_risk AS DOUBLE), 0) AS escalation_risk, CASE WHEN coalesce(CAST(t.escalation_risk AS DOUBLE), 0) >= 0.4 THEN 'SENIOR' ELSE 'STANDARD' END AS queue,
  t.created_at + to_minutes(coalesce(p.minutes, 480)) AS sla_due_at, CASE WHEN t.status = 'NEW' THEN 'TRIAGED' ELSE t.status END AS status,
  CAST(floor(coalesce(CAST(t.escalation_risk AS DOUBLE), 0) * 100 + 0.5) AS INT) + CASE t.customer_tier WHEN 'ENTERPRISE' THEN 20 WHEN 'PRO' THEN 10 ELSE 0 END
    + CASE WHEN coalesce(c.is_incident, false) THEN 30 ELSE 0 END AS draft_priority, t.id % 50 < 30 AS needs_llm
FROM tickets t LEFT JOIN clusters c ON c.id = t.cluster_id LEFT JOIN policies p ON p.customer_tier = t.customer_tier AND p.priority = {pick('t.id % 4', PRIORITIES)}""",
    num="escalation_risk",
    ts="sla_due_at",
)
def _triage(i: Inputs) -> DataFrame:
    scores = i.tickets.select(
        "id",
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("id") % 8 + 1).cast("int")).alias("category"),
        F.round(F.lit(0.5) + F.col("id") % 50 / 100, 2).alias("category_conf"),
        F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), (F.col("id") % 4 + 1).cast("int")).alias("priority"),
        F.lit(0.9).alias("priority_conf"),
        F.coalesce(F.col("escalation_risk").cast("double"), F.lit(0.0)).alias("risk"),
        "triaged_at",
    )
    out = lifecycle.triage_result(i.tickets, scores, i.clusters, joins.sla_policies(i.spark))
    return out.select(
        "id", "category", "priority", "escalation_risk", "queue", "sla_due_at", "status", "draft_priority", "needs_llm"
    )


@query(
    "waiting_llm_timeout",
    bind("tickets")
    + f""", h AS (SELECT id, draft_state, (epoch_us({NOW}) - epoch_us(ingested_at)) // 3600000000 AS h FROM tickets)
SELECT id, CASE WHEN draft_state IN ('PENDING', 'WAITING_LLM') THEN CASE WHEN h >= 6 THEN 'SKIPPED' ELSE 'WAITING_LLM' END ELSE draft_state END AS draft_state, h >= 2 AS give_up_classify FROM h""",
)
def _waiting(i: Inputs) -> DataFrame:
    return lifecycle.waiting_timeout(i.tickets, i.as_of).select("id", "draft_state", "give_up_classify")


@query(
    "store_draft",
    bind("drafts")
    + """, n AS (SELECT id + 1 AS id, ticket_id, created_at + INTERVAL 1 DAY AS created_at FROM drafts WHERE status = 'EDITED'),
w AS (SELECT ticket_id, arg_max(id, (created_at, id)) AS newest FROM n GROUP BY 1),
e AS (SELECT id, ticket_id, status FROM drafts UNION ALL SELECT id, ticket_id, 'GENERATED' FROM n)
SELECT e.id, e.ticket_id, CASE WHEN w.newest IS NOT NULL AND e.id <> w.newest AND e.status = 'GENERATED' THEN 'SUPERSEDED' ELSE e.status END AS status FROM e LEFT JOIN w ON w.ticket_id = e.ticket_id""",
)
def _store(i: Inputs) -> DataFrame:
    return lifecycle.store_draft(i.tickets, i.drafts, _new_drafts(i))[1].select("id", "ticket_id", "status")


def _new_drafts(i: Inputs) -> DataFrame:
    """A second draft a day after every edited one."""
    return i.drafts.where(F.col("status") == "EDITED").selectExpr(
        "id + 1 AS id", "ticket_id", "'GENERATED' AS status", "body", "created_at + INTERVAL 1 DAY AS created_at"
    )


@query(
    "store_draft_tickets",
    bind("drafts", "tickets")
    + """, w AS (SELECT ticket_id, max(created_at + INTERVAL 1 DAY) AS new_at FROM drafts WHERE status = 'EDITED' GROUP BY 1)
SELECT t.id, CASE WHEN new_at IS NOT NULL AND t.status IN ('TRIAGED', 'DRAFTED', 'TRIAGE_FAILED') THEN 'DRAFTED' ELSE t.status END AS status,
  CASE WHEN new_at IS NOT NULL THEN 'READY' ELSE t.draft_state END AS draft_state, CASE WHEN new_at IS NOT NULL THEN new_at ELSE t.drafted_at END AS drafted_at FROM tickets t LEFT JOIN w ON w.ticket_id = t.id""",
    ts="drafted_at",
)
def _store_tickets(i: Inputs) -> DataFrame:
    tickets, _ = lifecycle.store_draft(i.tickets, i.drafts, _new_drafts(i))
    return tickets.select("id", "status", "draft_state", "drafted_at")


@query(
    "append_predictions",
    bind("predictions")
    + """, n AS (SELECT id + 1000000000 AS id, ticket_id, task, model_name, CASE WHEN ticket_id % 8 = 0 THEN '3' ELSE model_version END AS model_version, created_at FROM predictions),
l AS (SELECT id, ticket_id, task, model_name, model_version, created_at, 0 AS b FROM predictions UNION ALL SELECT *, 1 FROM n)
SELECT id, ticket_id, task, model_name, model_version FROM l QUALIFY row_number() OVER (PARTITION BY ticket_id, task, model_name, model_version ORDER BY b, created_at, id) = 1""",
)
def _append(i: Inputs) -> DataFrame:
    newer = F.when(F.col("ticket_id") % 8 == 0, F.lit("3")).otherwise(F.col("model_version"))
    new = i.predictions.withColumn("id", F.col("id") + 1_000_000_000).withColumn("model_version", newer)
    return lifecycle.append_predictions(i.predictions, new).select("id", "ticket_id", "task", "model_name", "model_version")
