"""Projections, joins, windows, top-k and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.functions import stemming
from deskstream.operators import joins, projection, quality, windows
from deskstream.plans.bindings import NOW, bind
from deskstream.plans.registry import query
from deskstream.schemas import CATEGORIES, LABEL_SOURCES, PRIORITIES, QUEUES
from deskstream.sources.bind import Inputs

OPEN = "status NOT IN ('RESOLVED', 'CLOSED')"


# ---------------------------------------------------------------- filters, pages
@query(
    "ticket_list_filter",
    bind("tickets", "clusters")
    + f""" SELECT t.id, t.queue, t.category, t.escalation_risk, coalesce(c.is_incident, false) AS is_incident
FROM tickets t LEFT JOIN clusters c ON c.id = t.cluster_id
WHERE t.{OPEN} AND t.product = 'web-app' AND t.escalation_risk >= CAST(0.02 AS FLOAT) AND c.is_incident""",
    num="escalation_risk",
)
def _list(i: Inputs) -> DataFrame:
    f = projection.TicketFilter(open=True, product="web-app", min_risk=0.02, incident=True)
    return projection.ticket_list_filter(i.tickets, i.clusters, f).select("id", "queue", "category", "escalation_risk", "is_incident")


_SEARCHED = "(SELECT id, subject, unnest(regexp_extract_all(lower(concat_ws(' ', subject, body, resolution)), '[a-z0-9]+')) AS term, generate_subscripts(regexp_extract_all(lower(concat_ws(' ', subject, body, resolution)), '[a-z0-9]+'), 1) AS pos FROM notes)"


@query(
    "text_search_filter",
    bind("notes")
    + f""", words AS {_SEARCHED}, {stemming.stem_ctes("words")},
known AS MATERIALIZED (SELECT term, stem FROM stems WHERE stem IN ('invoic', 'charg', 'lock', 'gdpr', 'sinc', 'updat')),
placed AS MATERIALIZED (SELECT id, pos, stem FROM words JOIN known USING (term)),
asked AS (SELECT id, max(CAST(stem = 'invoic' AS INT)) AS a, max(CAST(stem = 'charg' AS INT)) AS b, max(CAST(stem = 'gdpr' AS INT)) AS d FROM placed GROUP BY 1),
phrase AS (SELECT DISTINCT x.id FROM placed x JOIN placed y ON y.id = x.id AND y.pos = x.pos + 2 JOIN placed z ON z.id = x.id AND z.pos = x.pos + 4
  WHERE x.stem = 'lock' AND y.stem = 'sinc' AND z.stem = 'updat')
SELECT n.id FROM notes n LEFT JOIN asked USING (id) LEFT JOIN phrase p ON p.id = n.id
WHERE n.subject ILIKE '%the invoices charged or "locking out since the updates" -gdpr%' OR (a = 1 AND b = 1) OR (p.id IS NOT NULL AND coalesce(d, 0) = 0)""",
)
def _search(i: Inputs) -> DataFrame:
    from deskstream.operators.search import text_search_filter

    return text_search_filter(i.notes, 'the invoices charged or "locking out since the updates" -gdpr').select("id")


@query(
    "keyset_page",
    bind("tickets")
    + """ SELECT id, coalesce(escalation_risk, CAST(-1 AS FLOAT)) AS sort_val FROM tickets
WHERE (CAST(coalesce(escalation_risk, CAST(-1 AS FLOAT)) AS DOUBLE), id) < (0.25, 1000)
ORDER BY coalesce(escalation_risk, CAST(-1 AS FLOAT)) DESC, id DESC LIMIT 51""",
    num="sort_val",
)
def _page(i: Inputs) -> DataFrame:
    return projection.keyset_page(i.tickets, "risk", after=(0.25, 1000), limit=50).select("id", "sort_val")


@query(
    "page_cursor",
    bind("tickets")
    + """ SELECT id, rtrim(translate(to_base64(encode(concat(epoch_us(created_at), '|', id))), '+/', '-_'), '=') AS cursor FROM tickets""",
)
def _cursor(i: Inputs) -> DataFrame:
    key, _ = projection.sort_key("newest")
    return i.tickets.select("id", projection.page_cursor(key, F.col("id")).alias("cursor"))


@query(
    "sort_keys",
    bind("tickets")
    + """ SELECT id, coalesce(escalation_risk, CAST(-1 AS FLOAT)) AS risk_key, epoch_us(created_at) AS newest_key,
  coalesce(epoch_us(sla_due_at), 253402300799000000) AS sla_key FROM tickets""",
    num="risk_key",
)
def _sort_keys(i: Inputs) -> DataFrame:
    keys = {name: projection.sort_key(name)[0].alias(f"{name}_key") for name in ("risk", "newest", "sla")}
    return i.tickets.select("id", *keys.values())


@query("open_tickets", bind("tickets") + f" SELECT id, status FROM tickets WHERE {OPEN}")
def _open(i: Inputs) -> DataFrame:
    return projection.open_tickets(i.tickets).select("id", "status")


@query("live_only", bind("tickets") + " SELECT id, source FROM tickets WHERE source <> 'SEED'")
def _live(i: Inputs) -> DataFrame:
    return projection.live_only(i.tickets).select("id", "source")


@query(
    "null_safe_relabel",
    bind("tickets", "predictions")
    + """ SELECT p.id, p.label IS DISTINCT FROM t.category AS changes FROM predictions p JOIN tickets t ON t.id = p.ticket_id""",
)
def _relabel(i: Inputs) -> DataFrame:
    t = i.tickets.select(F.col("id").alias("ticket_id"), "category")
    return i.predictions.join(t, "ticket_id").select(
        "id", projection.null_safe_relabel(F.col("category"), F.col("label")).alias("changes")
    )


@query(
    "enum_domain_check",
    bind("feedback")
    + """ SELECT id, CASE WHEN rating IS NOT NULL AND rating NOT BETWEEN 1 AND 5 THEN 'rating must be 1..5'
  WHEN action = 'EDIT_APPROVE' AND length(coalesce(repeat('b', CAST(id % 20 AS INT)), '')) < 10 THEN 'finalBody is required (min 10 chars)'
  WHEN action = 'REJECT' AND (reject_reason IS NULL OR reject_reason NOT IN ('WRONG_INFO', 'NOT_GROUNDED', 'TONE', 'INCOMPLETE', 'OTHER')) THEN 'rejectReason is required' END AS error
FROM (SELECT * REPLACE (CASE WHEN id % 12 = 2 THEN NULL ELSE reject_reason END AS reject_reason, rating + CAST(id % 2 AS INT) AS rating) FROM feedback)""",
)
def _domain(i: Inputs) -> DataFrame:
    from deskstream.operators.ingest import enum_domain_error

    odd = i.feedback.selectExpr(
        "id", "action", "corrected_category", "corrected_priority", "rating + cast(id % 2 as int) AS rating",
        "CASE WHEN id % 12 = 2 THEN NULL ELSE reject_reason END AS reject_reason", "repeat('b', cast(id % 20 as int)) AS body",
    )
    error = enum_domain_error(
        F.col("corrected_category"), F.col("corrected_priority"), F.col("action"), F.col("reject_reason"), F.col("rating"), F.col("body")
    )
    return odd.select("id", error.alias("error"))


# ------------------------------------------------------------------------- joins
@query(
    "tickets_with_cluster",
    bind("tickets", "clusters")
    + """ SELECT t.id, t.cluster_id, c.size AS cluster_size, coalesce(c.is_incident, false) AS is_incident
FROM tickets t LEFT JOIN clusters c ON c.id = t.cluster_id""",
)
def _with_cluster(i: Inputs) -> DataFrame:
    return projection.tickets_with_cluster(i.tickets, i.clusters).select("id", "cluster_id", "cluster_size", "is_incident")


@query(
    "ticket_detail",
    bind("tickets", "customers", "agents")
    + """ SELECT t.id, c.external_id AS customer_external_id, a.display_name AS assigned_agent FROM tickets t
LEFT JOIN customers c ON c.id = t.customer_id LEFT JOIN agents a ON a.id = t.assigned_agent_id""",
)
def _detail(i: Inputs) -> DataFrame:
    return projection.ticket_detail(i.tickets, i.customers, i.agents).select("id", "customer_external_id", "assigned_agent")


@query(
    "cluster_members",
    bind("tickets")
    + """, t AS (SELECT id, cluster_id, created_at FROM tickets WHERE cluster_id IS NOT NULL)
SELECT a.id, b.id AS member_id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id DESC) AS INT) AS member_rank
FROM t a JOIN t b ON a.cluster_id = b.cluster_id AND a.id <> b.id
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id DESC) <= 25""",
)
def _members(i: Inputs) -> DataFrame:
    return joins.cluster_members(i.tickets)


@query(
    "draft_sources",
    bind("drafts", "tickets")
    + """ SELECT d.id AS draft_id, d.pos - 1 AS pos, d.source_id, t.subject, t.resolution
FROM (SELECT id, unnest(source_ids) AS source_id, generate_subscripts(source_ids, 1) AS pos FROM drafts WHERE source_ids IS NOT NULL) d
JOIN tickets t ON t.id = d.source_id""",
)
def _draft_sources(i: Inputs) -> DataFrame:
    return joins.draft_sources(i.drafts, i.tickets).select(
        "draft_id", F.col("pos").cast("bigint").alias("pos"), "source_id", "subject", "resolution"
    )


@query(
    "predictions_x_tickets",
    bind("predictions", "tickets")
    + " SELECT p.id, p.ticket_id, p.task, p.score FROM predictions p JOIN tickets t ON t.id = p.ticket_id WHERE t.source <> 'SEED'",
    num="score",
)
def _pxt(i: Inputs) -> DataFrame:
    return joins.predictions_x_tickets(i.predictions, i.tickets).select("id", "ticket_id", "task", "score")


@query(
    "feedback_x_drafts",
    bind("feedback", "drafts")
    + " SELECT f.id, f.draft_id, d.grounding, d.status AS draft_status FROM feedback f JOIN drafts d ON d.id = f.draft_id",
)
def _fxd(i: Inputs) -> DataFrame:
    return joins.feedback_x_drafts(i.feedback, i.drafts).select("id", "draft_id", "grounding", "draft_status")


@query(
    "stale_clusters",
    bind("clusters", "tickets")
    + f""" SELECT c.id, 'CLOSED' AS status, c.last_seen_at FROM clusters c WHERE c.status = 'ACTIVE'
AND c.last_seen_at < {NOW} - INTERVAL 6 HOUR
AND NOT EXISTS (SELECT 1 FROM tickets t WHERE t.cluster_id = c.id AND t.{OPEN} AND t.created_at >= c.last_seen_at)""",
    ts="last_seen_at",
)
def _stale(i: Inputs) -> DataFrame:
    """Openness is judged on the newest report, since every account here also has old open tickets."""
    newest = i.clusters.select(F.col("id").alias("cluster_id"), "last_seen_at")
    recent = i.tickets.join(newest, "cluster_id").where(F.col("created_at") >= F.col("last_seen_at"))
    return joins.stale_clusters(i.clusters, recent, i.as_of).select("id", "status", "last_seen_at")


@query(
    "cluster_overview",
    bind("clusters", "tickets")
    + f""" SELECT c.id, c.size, c.is_incident, (SELECT count(*) FROM tickets t WHERE t.cluster_id = c.id AND t.{OPEN}) AS open_tickets,
  (SELECT count(DISTINCT t.customer_id) FROM tickets t WHERE t.cluster_id = c.id) AS customers
FROM clusters c WHERE c.status = 'ACTIVE' ORDER BY c.is_incident DESC, c.last_seen_at DESC, c.id DESC LIMIT 100""",
)
def _overview(i: Inputs) -> DataFrame:
    return joins.cluster_overview(i.clusters, i.tickets).select("id", "size", "is_incident", "open_tickets", "customers")


@query(
    "sla_due",
    bind("tickets", "policies")
    + """ SELECT t.id, t.created_at + to_minutes(coalesce(p.minutes, 480)) AS sla_due_at
FROM tickets t LEFT JOIN policies p ON p.customer_tier = t.customer_tier AND p.priority = t.priority""",
    ts="sla_due_at",
)
def _sla_due(i: Inputs) -> DataFrame:
    return joins.sla_due(i.tickets, joins.sla_policies(i.spark)).select("id", "sla_due_at")


@query(
    "latest_correction",
    bind("feedback")
    + """ SELECT ticket_id, arg_max(corrected_category, id) FILTER (WHERE corrected_category IS NOT NULL) AS category,
  arg_max(corrected_priority, id) FILTER (WHERE corrected_priority IS NOT NULL) AS priority FROM feedback GROUP BY 1""",
)
def _correction(i: Inputs) -> DataFrame:
    from deskstream.operators.ingest import latest_correction

    return latest_correction(i.feedback)


@query(
    "llm_x_small_predictions",
    bind("predictions")
    + """ SELECT a.ticket_id AS ticket_uid, a.label AS llm_pred, b.label AS small_pred, b.score AS small_conf
FROM predictions a JOIN predictions b ON a.ticket_id = b.ticket_id
WHERE a.task = 'CATEGORY' AND a.model_name = 'zeroshot_llm' AND b.task = 'CATEGORY' AND b.model_name <> 'zeroshot_llm'""",
    num="small_conf",
)
def _two_sets(i: Inputs) -> DataFrame:
    p = i.predictions.where(F.col("task") == "CATEGORY")
    is_llm = F.col("model_name") == "zeroshot_llm"
    llm = p.where(is_llm).select(F.col("ticket_id").alias("ticket_uid"), F.col("label").alias("llm_pred"))
    small = p.where(~is_llm).select(
        F.col("ticket_id").alias("ticket_uid"), F.col("label").alias("small_pred"), F.col("score").alias("small_conf")
    )
    return joins.prior_answers(llm, small)


@query(
    "specs_x_text",
    "SELECT d.doc_id, l.quality, l.toxic, d.lang, md5(d.text) AS text_hash FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
)
def _specs(i: Inputs) -> DataFrame:
    joined = i.table("labels").join(i.table("documents"), "doc_id")
    return joined.select("doc_id", "quality", "toxic", "lang", F.md5("text").alias("text_hash"))


@query(
    "truth_join",
    bind("tickets", "labelled")
    + """ SELECT t.id, regexp_extract(t.external_id, '([^-]+)$', 1) AS ticket_uid, l.root_cause_id
FROM tickets t JOIN labelled l ON concat('T', l.ticket_id) = regexp_extract(t.external_id, '([^-]+)$', 1) WHERE t.external_id IS NOT NULL""",
)
def _truth(i: Inputs) -> DataFrame:
    truth = i.labelled.select(F.concat(F.lit("T"), F.col("ticket_id").cast("string")).alias("ticket_uid"), "root_cause_id")
    served = i.tickets.where(F.col("external_id").isNotNull())
    return joins.truth_join(served, truth).select("id", "ticket_uid", "root_cause_id")


_USABLE = "d.status IN ('GENERATED', 'APPROVED', 'EDITED') AND d.reused_from_draft_id IS NULL"


@query(
    "reusable_draft",
    bind("tickets", "drafts", "clusters")
    + f""", o AS (SELECT d.id, d.ticket_id, d.created_at, t.cluster_id FROM drafts d JOIN tickets t ON t.id = d.ticket_id
  JOIN clusters c ON c.id = t.cluster_id AND c.is_incident WHERE {_USABLE} AND d.created_at > {NOW} - INTERVAL 72 HOUR)
SELECT t.id AS ticket_id, arg_max(o.id, (o.created_at, o.id)) AS draft_id FROM tickets t JOIN o ON o.cluster_id = t.cluster_id AND o.ticket_id <> t.id GROUP BY 1""",
)
def _reusable(i: Inputs) -> DataFrame:
    return joins.reusable_draft(i.tickets, i.drafts, i.clusters, i.as_of, hours=72)


@query(
    "cluster_draft",
    bind("tickets", "drafts")
    + f""" SELECT t.cluster_id, arg_max(d.id, (d.created_at, d.id)) AS draft_id, max(d.created_at) AS created_at
FROM drafts d JOIN tickets t ON t.id = d.ticket_id WHERE {_USABLE} AND t.cluster_id IS NOT NULL GROUP BY 1""",
    ts="created_at",
)
def _cluster_draft(i: Inputs) -> DataFrame:
    return joins.cluster_draft(i.drafts, i.tickets)


@query(
    "tickets_exclusion_window",
    bind("labelled")
    + """, base AS (SELECT ticket_id AS id, created_at, concat('RC-', label % 5, '-', product) AS root_cause_id, incident_id FROM labelled),
w AS (SELECT incident_id, root_cause_id, min(created_at) AS a, max(created_at) AS b FROM base WHERE incident_id IS NOT NULL GROUP BY 1, 2)
SELECT id FROM base WHERE NOT (incident_id IS NULL AND EXISTS (SELECT 1 FROM w WHERE w.root_cause_id = base.root_cause_id
  AND base.created_at BETWEEN w.a - INTERVAL 6 HOUR AND w.b + INTERVAL 6 HOUR))""",
)
def _exclusion(i: Inputs) -> DataFrame:
    """Causes are folded to five per product so that background and incident rows share some."""
    cause = F.concat_ws("-", F.lit("RC"), (F.col("label") % 5).cast("string"), F.col("product"))
    base = i.labelled.select(F.col("ticket_id").alias("id"), "created_at", cause.alias("root_cause_id"), "incident_id")
    spans = base.where(F.col("incident_id").isNotNull()).groupBy("incident_id", "root_cause_id").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at")
    )
    return joins.tickets_exclusion_window(base, spans).select("id")


@query(
    "heldout_split",
    bind("labelled")
    + """, h AS (SELECT DISTINCT root_cause_id FROM labelled WHERE label IN (3, 7))
SELECT ticket_id AS id, 'train' AS part FROM labelled WHERE split = 'train' AND root_cause_id NOT IN (SELECT * FROM h)
UNION ALL SELECT ticket_id, 'test' FROM labelled WHERE root_cause_id IN (SELECT * FROM h)""",
)
def _heldout(i: Inputs) -> DataFrame:
    causes = i.labelled.where(F.col("label").isin(3, 7)).select("root_cause_id").distinct()
    train, test = joins.heldout_split(i.labelled, causes)
    part = lambda df, name: df.select(F.col("ticket_id").alias("id"), F.lit(name).alias("part"))
    return part(train, "train").unionByName(part(test, "test"))


# ----------------------------------------------------------------------- windows
@query(
    "prior_tickets_7d",
    bind("tickets")
    + """ SELECT id, CASE WHEN customer_id IS NULL THEN 0 ELSE n END AS prior_tickets_7d FROM (
  SELECT id, customer_id, count(*) OVER (PARTITION BY customer_id ORDER BY epoch_us(created_at) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS n FROM tickets)""",
)
def _prior(i: Inputs) -> DataFrame:
    return windows.prior_tickets(i.tickets.select("id", "customer_id", "created_at")).select("id", "prior_tickets_7d")


@query(
    "prior_tickets_7d_offline",
    bind("tickets")
    + """, s AS (SELECT id, customer_id, epoch_us(created_at) // 1000000 AS sec, row_number() OVER (PARTITION BY customer_id ORDER BY created_at, id) AS pos FROM tickets),
w AS (SELECT id, customer_id, pos, count(*) OVER (PARTITION BY customer_id ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 604801 PRECEDING) AS gone FROM s)
SELECT id, CASE WHEN customer_id IS NULL THEN 0 ELSE pos - 1 - gone END AS prior_tickets_7d FROM w""",
)
def _prior_offline(i: Inputs) -> DataFrame:
    return windows.prior_tickets_offline(i.tickets.select("id", "customer_id", "created_at")).select("id", "prior_tickets_7d")


@query(
    "incident_burst",
    bind("tickets")
    + """, m AS (SELECT id, cluster_id, created_at, coalesce('c' || customer_id, 't' || id) AS who FROM tickets WHERE cluster_id IS NOT NULL),
c AS (SELECT id, cluster_id, created_at,
  count(*) OVER (PARTITION BY cluster_id ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS live_tickets,
  count(DISTINCT who) OVER (PARTITION BY cluster_id ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS live_customers FROM m)
SELECT id, cluster_id, live_tickets, live_customers, live_tickets >= 3 AND live_customers >= 2 AS burst,
  min(CASE WHEN live_tickets >= 3 AND live_customers >= 2 THEN created_at END) OVER (PARTITION BY cluster_id) AS incident_flagged_at FROM c""",
    ts="incident_flagged_at",
)
def _burst(i: Inputs) -> DataFrame:
    members = i.tickets.where(F.col("cluster_id").isNotNull()).select("id", "cluster_id", "created_at", "customer_id")
    flagged = windows.incident_burst(members, minutes=24 * 60, min_tickets=3, min_customers=2)
    return flagged.select("id", "cluster_id", "live_tickets", "live_customers", "burst", "incident_flagged_at")


@query(
    "latest_prediction",
    bind("predictions")
    + " SELECT id, ticket_id, task, label, score FROM predictions QUALIFY row_number() OVER (PARTITION BY ticket_id, task ORDER BY created_at DESC, id DESC) = 1",
    num="score",
)
def _latest(i: Inputs) -> DataFrame:
    return windows.latest_prediction(i.predictions).select("id", "ticket_id", "task", "label", "score")


@query(
    "active_draft",
    bind("drafts")
    + """, r AS (SELECT id, ticket_id, status, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, id DESC) AS INT) AS rank FROM drafts WHERE status <> 'SUPERSEDED')
SELECT id, ticket_id, rank, coalesce(rank = min(CASE WHEN status <> 'SKIPPED' THEN rank END) OVER (PARTITION BY ticket_id), false) AS is_active FROM r WHERE rank <= 5""",
)
def _active(i: Inputs) -> DataFrame:
    return windows.active_drafts(i.drafts).select("id", "ticket_id", "rank", "is_active")


@query(
    "rank_legs",
    bind("predictions")
    + " SELECT id, ticket_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, id) - 1 AS INT) AS rank FROM predictions",
)
def _rank_legs(i: Inputs) -> DataFrame:
    return windows.rank_legs(i.predictions, "ticket_id", [F.col("score").desc(), F.col("id")]).select("id", "ticket_id", "rank")


@query(
    "diversify_by_cluster",
    bind("tickets")
    + """, h AS (SELECT product AS qid, id, cluster_id, row_number() OVER (PARTITION BY product ORDER BY escalation_risk DESC NULLS LAST, id) - 1 AS r FROM tickets),
f AS (SELECT qid, id, cluster_id, r FROM h QUALIFY cluster_id IS NULL OR row_number() OVER (PARTITION BY qid, cluster_id ORDER BY r) = 1)
SELECT qid, id, cluster_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY r) AS INT) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) <= 50""",
)
def _diversify(i: Inputs) -> DataFrame:
    hits = windows.rank_legs(i.tickets, "product", [F.col("escalation_risk").desc_nulls_last(), F.col("id")])
    hits = hits.select(F.col("product").alias("qid"), "id", "cluster_id", "rank")
    return windows.diversify_by_cluster(hits, k=50)


@query(
    "stratified_sample",
    bind("tickets")
    + " SELECT id, category FROM tickets WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(CAST(id AS VARCHAR)), id) <= 25",
)
def _sample(i: Inputs) -> DataFrame:
    return windows.stratified_sample(i.tickets.where(F.col("category").isNotNull()), "category", 25).select("id", "category")


@query(
    "rank_labels",
    bind("tickets")
    + """ SELECT category AS label, count(*) AS tickets, CAST(rank() OVER (ORDER BY count(*) DESC) AS INT) AS rank FROM tickets WHERE category IS NOT NULL GROUP BY 1""",
)
def _rank_labels(i: Inputs) -> DataFrame:
    counts = i.tickets.where(F.col("category").isNotNull()).groupBy(F.col("category").alias("label")).agg(F.count(F.lit(1)).alias("tickets"))
    return windows.rank_labels(counts)


@query(
    "popularity_rank_weight",
    bind("labelled")
    + """ SELECT category, root_cause_id, tickets, pow(row_number() OVER (PARTITION BY category ORDER BY tickets DESC, root_cause_id), -0.6) AS weight
FROM (SELECT product AS category, root_cause_id, count(*) AS tickets FROM labelled GROUP BY 1, 2)""",
    num="weight",
)
def _popularity(i: Inputs) -> DataFrame:
    causes = i.labelled.groupBy(F.col("product").alias("category"), "root_cause_id").agg(F.count(F.lit(1)).alias("tickets"))
    return windows.popularity_weight(causes)


# ------------------------------------------------------------------ sorts, top-k
@query(
    "top_risk_queue",
    bind("tickets")
    + " SELECT id, escalation_risk FROM tickets ORDER BY coalesce(escalation_risk, CAST(-1 AS FLOAT)) DESC, id DESC LIMIT 100",
    num="escalation_risk",
)
def _top_risk(i: Inputs) -> DataFrame:
    return projection.top_risk_queue(i.tickets, 100).select("id", "escalation_risk")


@query(
    "sla_queue",
    bind("tickets") + " SELECT id, sla_due_at FROM tickets ORDER BY sla_due_at ASC NULLS LAST, id LIMIT 100",
    ts="sla_due_at",
)
def _sla_queue(i: Inputs) -> DataFrame:
    return projection.sla_queue(i.tickets, 100).select("id", "sla_due_at")


@query(
    "recent_incidents",
    bind("clusters") + " SELECT id, size, first_seen_at FROM clusters WHERE is_incident ORDER BY first_seen_at DESC, id DESC LIMIT 50",
    ts="first_seen_at",
)
def _recent(i: Inputs) -> DataFrame:
    return joins.recent_incidents(i.clusters).select("id", "size", "first_seen_at")


@query(
    "cluster_list",
    bind("clusters") + " SELECT id, is_incident, last_seen_at FROM clusters ORDER BY is_incident DESC, last_seen_at DESC, id DESC LIMIT 100",
    ts="last_seen_at",
)
def _cluster_list(i: Inputs) -> DataFrame:
    return joins.cluster_list(i.clusters).select("id", "is_incident", "last_seen_at")


@query(
    "topk_per_query",
    bind("tickets")
    + """ SELECT product, id, CAST(row_number() OVER (PARTITION BY product ORDER BY escalation_risk DESC NULLS LAST, id) AS INT) AS rank FROM tickets
QUALIFY row_number() OVER (PARTITION BY product ORDER BY escalation_risk DESC NULLS LAST, id) <= 20""",
)
def _topk(i: Inputs) -> DataFrame:
    order = [F.col("escalation_risk").desc_nulls_last(), F.col("id")]
    return windows.topk_per_key(i.tickets, ["product"], order, 20).select("product", "id", "rank")


# ---------------------------------------------------------------- set operations
@query(
    "union_dedupe_by_id",
    bind("tickets") + f" SELECT id, status FROM tickets WHERE {OPEN} OR escalation_risk >= CAST(0.1 AS FLOAT)",
)
def _union(i: Inputs) -> DataFrame:
    opened = projection.open_tickets(i.tickets).select("id", "status")
    risky = i.tickets.where(F.col("escalation_risk") >= F.lit(0.1).cast("float")).select("id", "status")
    return joins.union_dedupe_by_id(opened, risky)


@query(
    "train_union",
    bind("labelled", "feedback")
    + """ SELECT ticket_id AS id, CAST(label AS VARCHAR) AS label FROM labelled WHERE split = 'train'
UNION ALL SELECT ticket_id, corrected_category FROM feedback WHERE corrected_category IS NOT NULL""",
)
def _train_union(i: Inputs) -> DataFrame:
    train = i.labelled.where(F.col("split") == "train").select(F.col("ticket_id").alias("id"), F.col("label").cast("string"))
    fixed = i.feedback.where(F.col("corrected_category").isNotNull())
    return train.unionByName(fixed.select(F.col("ticket_id").alias("id"), F.col("corrected_category").alias("label")))


@query(
    "augment_union",
    bind("labelled")
    + """ SELECT ticket_id AS id, CAST(label AS VARCHAR) AS label FROM labelled WHERE split = 'train'
UNION ALL SELECT * FROM (SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 300)""",
)
def _augment(i: Inputs) -> DataFrame:
    train = i.labelled.where(F.col("split") == "train").select(F.col("ticket_id").alias("id"), F.col("label").cast("string"))
    external = i.table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return joins.augment_union(train, external, n=300)


@query("except_ids", bind("tickets") + " SELECT id FROM tickets WHERE id NOT IN (SELECT doc_id FROM labels)")
def _except(i: Inputs) -> DataFrame:
    return joins.except_ids(i.tickets.select("id"), i.table("labels").select(F.col("doc_id").alias("id")))


@query(
    "label_union",
    bind("predictions")
    + """ SELECT label, count(*) FILTER (WHERE task = 'CATEGORY') AS n_first, count(*) FILTER (WHERE task = 'PRIORITY') AS n_second
FROM predictions WHERE label IS NOT NULL GROUP BY 1""",
)
def _label_union(i: Inputs) -> DataFrame:
    count = lambda task: i.predictions.where((F.col("task") == task) & F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )
    return joins.label_union(count("CATEGORY"), count("PRIORITY"))


@query(
    "event_log_union",
    bind("tickets", "clusters")
    + """ SELECT event, count(*) AS n, count(at_time) AS dated, count(product) AS with_product FROM (
SELECT 'ticket.created' AS event, created_at AS at_time, product FROM tickets UNION ALL
SELECT 'ticket.triaged', triaged_at, NULL FROM tickets WHERE triaged_at IS NOT NULL UNION ALL
SELECT 'ticket.drafted', drafted_at, NULL FROM tickets WHERE drafted_at IS NOT NULL UNION ALL
SELECT 'ticket.resolved', resolved_at, NULL FROM tickets WHERE resolved_at IS NOT NULL UNION ALL
SELECT 'ticket.updated', ingested_at, NULL FROM tickets WHERE version > 1 UNION ALL
SELECT 'sla.breached', sla_due_at, NULL FROM tickets WHERE sla_breached UNION ALL
SELECT 'cluster.updated', last_seen_at, product FROM clusters UNION ALL
SELECT 'incident.detected', incident_flagged_at, product FROM clusters WHERE is_incident) GROUP BY 1""",
)
def _events(i: Inputs) -> DataFrame:
    t, c = i.tickets, i.clusters

    def of(frame: DataFrame, event: str, at: str, *extra: str) -> DataFrame:
        return frame.select(F.lit(event).alias("event"), F.col("id").alias("entity_id"), F.col(at).alias("at"), *extra)

    log = joins.event_log_union(
        of(t, "ticket.created", "created_at", "product"),
        of(t.where("triaged_at IS NOT NULL"), "ticket.triaged", "triaged_at"),
        of(t.where("drafted_at IS NOT NULL"), "ticket.drafted", "drafted_at"),
        of(t.where("resolved_at IS NOT NULL"), "ticket.resolved", "resolved_at"),
        of(t.where("version > 1"), "ticket.updated", "ingested_at"),
        of(t.where("sla_breached"), "sla.breached", "sla_due_at"),
        of(c, "cluster.updated", "last_seen_at", "product"),
        of(c.where("is_incident"), "incident.detected", "incident_flagged_at", "product"),
    )
    return log.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.count("at").alias("dated"), F.count("product").alias("with_product")
    )


# ----------------------------------------------------------------- table quality
@query(
    "dq_domains",
    bind("tickets")
    + """ SELECT id, 'category' AS "column", category AS value FROM tickets WHERE category NOT IN ('BILLING', 'LOGIN_ACCESS', 'BUG')
UNION ALL SELECT id, 'priority', priority FROM tickets WHERE priority NOT IN ('LOW', 'MEDIUM', 'HIGH')""",
)
def _domains(i: Inputs) -> DataFrame:
    """Against narrower domains than the declared ones, so that there is something to find."""
    domains = {"category": CATEGORIES[:3], "priority": PRIORITIES[:3], "queue": QUEUES, "category_source": LABEL_SOURCES}
    return quality.domain_violations(i.tickets, domains)


@query(
    "dq_duplicate_predictions",
    bind("predictions")
    + " SELECT ticket_id, task, model_version, count(*) AS n FROM predictions GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def _dup_predictions(i: Inputs) -> DataFrame:
    """Without the model name in the key the two category models collide where their versions agree."""
    return quality.duplicate_keys(i.predictions, ["ticket_id", "task", "model_version"])


@query(
    "dq_single_active_draft",
    bind("drafts") + " SELECT ticket_id, count(*) AS n FROM drafts WHERE status = 'GENERATED' GROUP BY 1 HAVING count(*) > 1",
)
def _one_draft(i: Inputs) -> DataFrame:
    return quality.several_active_drafts(i.drafts)


@query(
    "dq_one_active_job",
    bind("jobs")
    + " SELECT ticket_id, type, count(*) AS n FROM jobs WHERE status IN ('PENDING', 'RUNNING') GROUP BY 1, 2 HAVING count(*) > 1",
)
def _one_job(i: Inputs) -> DataFrame:
    return quality.several_active_jobs(i.jobs)


@query(
    "dq_foreign_keys",
    bind("drafts")
    + """ SELECT id, reused_from_draft_id FROM drafts WHERE reused_from_draft_id IS NOT NULL
AND reused_from_draft_id NOT IN (SELECT id FROM drafts)""",
)
def _orphans(i: Inputs) -> DataFrame:
    return quality.orphans(i.drafts, i.drafts, "reused_from_draft_id").select("id", "reused_from_draft_id")


@query(
    "dq_nothing_lost",
    bind("uploads", "tickets")
    + """, s AS (SELECT DISTINCT concat('replay-', id % 5, '-T', id) AS external_id FROM uploads),
g AS (SELECT external_id, bool_and(status IN ('RESOLVED', 'CLOSED')) AS done FROM tickets WHERE external_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS sent, count(done) AS stored, count(*) FILTER (WHERE done) AS finished, count(*) - count(done) AS lost,
  count(*) = count(*) FILTER (WHERE done) AS complete FROM s LEFT JOIN g USING (external_id)""",
)
def _lost(i: Inputs) -> DataFrame:
    sent = i.uploads.selectExpr("concat('replay-', id % 5, '-T', id) AS external_id")
    return quality.nothing_lost(sent, i.tickets, ["RESOLVED", "CLOSED"])
