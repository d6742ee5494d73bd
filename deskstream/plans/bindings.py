"""The roles of :mod:`deskstream.sources.bind`, written again in DuckDB SQL for the oracles."""

from __future__ import annotations

from deskstream.schemas import CATEGORIES, PRIORITIES, SLA_MINUTES, TICKET_STATUSES
from deskstream.sources.bind import PHRASES

NOW = "(SELECT max(ts) FROM events)"
TIER3 = ["FREE", "PRO", "ENTERPRISE"]
PRODUCT_CASE = (
    "CASE event_type WHEN 'click' THEN 'web-app' WHEN 'view' THEN 'mobile-app' WHEN 'error' THEN 'api' "
    "WHEN 'purchase' THEN 'desktop-sync' ELSE 'admin-console' END"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(index: str, values: list[str]) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[CAST({index} AS INT) + 1]"


_SQL: dict[str, tuple[list[str], str]] = {
    "tickets": (
        [],
        f"""SELECT event_id AS id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('replay-', event_id % 5, '-T', event_id) END AS external_id,
  CASE WHEN event_id % 10 = 0 THEN 'SEED' WHEN event_id % 3 = 0 THEN 'CSV' ELSE 'API' END AS source,
  event_id % 20 AS ingest_batch_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS customer_id,
  {pick('user_id % 3', TIER3)} AS customer_tier,
  {PRODUCT_CASE} AS product,
  concat(event_type, ' issue from account ', user_id) AS subject,
  concat('Reported ', props) AS body,
  ts AS created_at, ts AS ingested_at,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts + to_seconds(10 + event_id * 7 % 240) END AS triaged_at,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + to_seconds(300 + event_id * 11 % 900) END AS drafted_at,
  {pick('event_id % 6', TICKET_STATUSES[:6])} AS status,
  {pick('event_id % 4', ['NONE', 'PENDING', 'READY', 'WAITING_LLM'])} AS draft_state,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE {pick('(event_id * 7 + user_id) % 8', CATEGORIES)} END AS category,
  CAST(0.5 + event_id % 50 / 100.0 AS FLOAT) AS category_conf,
  {pick('event_id % 3', ['MODEL', 'LLM', 'AGENT'])} AS category_source,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE {pick('(event_id + user_id) % 4', PRIORITIES)} END AS priority,
  CAST(0.6 + event_id % 40 / 100.0 AS FLOAT) AS priority_conf,
  'MODEL' AS priority_source,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(least(value / 500, 1) AS FLOAT) END AS escalation_risk,
  CASE WHEN event_id % 29 <> 0 AND value >= 200 THEN 'SENIOR' ELSE 'STANDARD' END AS queue,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS cluster_id,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE ts + to_hours(1 + event_id % 48) END AS sla_due_at,
  event_id % 9 = 0 AS sla_breached,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + to_minutes(event_id % 700) END AS first_response_at,
  CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_id % 6 END AS assigned_agent_id,
  CASE WHEN event_id % 6 >= 4 THEN concat('Reset ', event_type, ' for account ', user_id) END AS resolution,
  CASE WHEN event_id % 6 >= 4 THEN ts + to_hours(event_id % 48) END AS resolved_at,
  CAST(event_id % 3 AS INT) AS version
FROM events""",
    ),
    "clusters": (
        ["tickets"],
        f"""SELECT id, product, concat('Reports of account ', id) AS title, size, id % 4 = 0 AS is_incident,
  CASE WHEN id % 4 = 0 THEN first_seen_at + to_hours(1) END AS incident_flagged_at,
  {pick('id % 5', ['ACTIVE', 'ACTIVE', 'ACTIVE', 'CLOSED', 'MERGED'])} AS status, first_seen_at, last_seen_at
FROM (SELECT cluster_id AS id, min(product) AS product, count(*) AS size, min(created_at) AS first_seen_at,
        max(created_at) AS last_seen_at FROM tickets WHERE cluster_id IS NOT NULL GROUP BY 1)""",
    ),
    "cluster_mapping": (
        ["clusters"],
        "SELECT id AS cluster_id, id - id % 5 AS merged_into FROM clusters WHERE status = 'MERGED'",
    ),
    "customers": (
        [],
        f"SELECT c_custkey AS id, c_name AS external_id, c_mktsegment AS segment, {pick('c_custkey % 3', TIER3)} AS tier FROM customer",
    ),
    "agents": ([], "SELECT s_suppkey AS id, s_name AS display_name FROM supplier"),
    "uploads": (
        [],
        f"""SELECT event_id AS id, event_id AS arrival, event_id % 20 AS ingest_batch_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat(user_id, '-', event_type) END AS external_id,
  CASE WHEN event_id % 37 = 0 THEN '  ' WHEN event_id % 41 = 0 THEN repeat('x', 301) ELSE concat(' ', event_type, ' ') END AS subject,
  CASE WHEN event_id % 43 = 0 THEN NULL ELSE props END AS body,
  CASE event_type WHEN 'click' THEN 'web-app' WHEN 'view' THEN 'mobile-app' WHEN 'error' THEN 'api'
    WHEN 'purchase' THEN 'desktop-sync' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'nope' ELSE 'admin-console' END END AS product,
  CASE WHEN event_id % 47 = 0 THEN 'GOLD' ELSE {pick('(user_id + event_id) % 3', TIER3)} END AS customer_tier,
  CASE WHEN event_id % 53 = 0 THEN repeat('c', 101) ELSE concat('C-', user_id) END AS customer_ref,
  CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 61 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_raw,
  CASE WHEN event_id % 3 = 0 THEN concat('h', event_id) END AS header_key
FROM events""",
    ),
    "checked": (
        ["uploads"],
        """SELECT *, CASE
  WHEN subject IS NULL OR length(trim(subject)) = 0 THEN 'subject is required'
  WHEN length(subject) > 300 THEN 'subject exceeds 300 chars'
  WHEN body IS NULL OR length(trim(body)) = 0 THEN 'body is required'
  WHEN length(body) > 20000 THEN 'body exceeds 20000 chars'
  WHEN product IS NULL OR product NOT IN ('web-app', 'mobile-app', 'api', 'desktop-sync', 'admin-console')
    THEN 'product must be one of web-app, mobile-app, api, desktop-sync, admin-console'
  WHEN customer_tier IS NULL OR customer_tier NOT IN ('FREE', 'PRO', 'ENTERPRISE')
    THEN 'customerTier must be one of FREE, PRO, ENTERPRISE'
  WHEN length(customer_ref) > 100 THEN 'customerId too long' END AS error
FROM uploads""",
    ),
    "judged": (
        ["checked"],
        """SELECT *, CASE WHEN external_id IS NULL OR rn = 1 THEN 'CREATED' ELSE 'DUPLICATE' END AS outcome,
  CASE WHEN external_id IS NULL THEN id ELSE first_id END AS ticket_id
FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY arrival, id) AS rn,
        first_value(id) OVER (PARTITION BY external_id ORDER BY arrival, id) AS first_id
      FROM checked WHERE error IS NULL)""",
    ),
    "vectors": (
        ["tickets"],
        """SELECT t.id AS ticket_id, t.product, t.created_at, CAST(e.embedding AS DOUBLE[]) AS embedding, e.label
FROM tickets t JOIN embeddings e ON e.vec_id = t.id % (SELECT count(*) FROM embeddings)""",
    ),
    "labelled": (
        ["vectors"],
        """SELECT *, concat('RC-', label, '-', product) AS root_cause_id,
  CASE WHEN label % 5 = 0 THEN concat('INC-', label, '-', product, '-', epoch_us(created_at) // 21600000000) END AS incident_id,
  CASE WHEN day(created_at) <= 20 THEN 'train' WHEN day(created_at) <= 24 THEN 'val' ELSE 'test' END AS split
FROM vectors""",
    ),
    "notes": (
        [],
        f"""SELECT d.doc_id AS id, concat(d.source, ' ', d.lang) AS subject,
  concat(d.text, ' ', {pick('d.doc_id % 8', PHRASES)}) AS body, b.text AS resolution, d.lang, d.source, d.n_chars,
  {pick('d.doc_id % 8', CATEGORIES)} AS category, {pick('d.doc_id % 4', PRIORITIES)} AS priority,
  {pick('d.doc_id % 3', TIER3)} AS customer_tier,
  {pick('d.doc_id % 5', ['web-app', 'mobile-app', 'api', 'desktop-sync', 'admin-console'])} AS product,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id % 40000) AS created_at, l.quality, l.toxic
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "scored": (
        [],
        """SELECT l.doc_id AS id, l.quality AS y, l.toxic, round(d.n_chars / (d.n_chars + CAST(800 AS DOUBLE)), 3) AS p
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    ),
    "replies": (
        [],
        r"""SELECT a.conv_id * 1000 + a.turn AS id, a.conv_id, a.turn, regexp_replace(a.text, '[^\x00-\x7F]', '?', 'g') AS body,
  regexp_replace(b.text, '[^\x00-\x7F]', '?', 'g') AS final_body
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2
WHERE a.role = 'assistant' AND b.role = 'assistant'""",
    ),
    "predictions": (
        [],
        f"""SELECT event_id AS id, event_id - event_id % 4 AS ticket_id,
  {pick('event_id % 4', ['CATEGORY', 'CATEGORY', 'PRIORITY', 'ESCALATION'])} AS task,
  CASE WHEN event_id % 8 = 1 THEN 'zeroshot_llm' ELSE concat('emb_', event_id % 2) END AS model_name,
  CAST(1 + event_id % 2 AS VARCHAR) AS model_version,
  CASE event_id % 4 WHEN 2 THEN {pick('user_id % 4', PRIORITIES)} WHEN 3 THEN NULL
    ELSE {pick('(user_id + event_id) % 8', CATEGORIES)} END AS label,
  CAST(least(0.5 + value / 100, 0.99) AS FLOAT) AS score, props AS details, ts AS created_at
FROM events""",
    ),
    "drafts": (
        [],
        f"""SELECT event_id * 10 AS id, event_id - event_id % 2 AS ticket_id,
  {pick('event_id % 6', ['GENERATED', 'APPROVED', 'EDITED', 'REJECTED', 'SUPERSEDED', 'SKIPPED'])} AS status,
  concat('Draft about ', event_type, ' for ', user_id) AS body,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE concat('[{{"ticketId":', event_id % 97, ',"why":"same ', event_type, '"}}]') END AS citations,
  {pick('event_id % 3', ['STRONG', 'WEAK', 'NONE'])} AS grounding,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE '["When did this start?"]' END AS needs_info,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE [event_id % 97, event_id % 89] END AS source_ids,
  CASE WHEN event_id % 8 = 0 THEN event_id * 10 - 10 END AS reused_from_draft_id,
  CASE WHEN event_id % 8 = 0 THEN 'incident-reuse' WHEN event_id % 6 = 5 THEN NULL ELSE concat('m', event_id % 2) END AS model,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(100 + event_id % 400 AS INT) END AS input_tokens,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(20 + event_id % 90 AS INT) END AS output_tokens,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(200 + event_id % 3000 AS INT) END AS latency_ms,
  CASE WHEN event_id % 8 = 0 THEN CAST(0 AS DECIMAL(10,6)) ELSE CAST(round(value / 10000, 6) AS DECIMAL(10,6)) END AS cost_usd,
  ts + to_minutes(5) AS created_at
FROM events""",
    ),
    "feedback": (
        [],
        f"""SELECT event_id AS id, event_id - event_id % 2 AS ticket_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 10 END AS draft_id, event_id % 6 AS agent_id,
  {pick('event_id % 4', ['APPROVE', 'EDIT_APPROVE', 'REJECT', 'RELABEL'])} AS action,
  CASE WHEN event_id % 4 = 1 THEN CAST(least(value / 400, 1) AS FLOAT) WHEN event_id % 4 = 0 THEN CAST(0 AS FLOAT) END AS edit_ratio,
  CASE WHEN event_id % 4 = 2 THEN {pick('user_id % 5', ['WRONG_INFO', 'NOT_GROUNDED', 'TONE', 'INCOMPLETE', 'OTHER'])} END AS reject_reason,
  CASE WHEN event_id % 5 = 0 THEN {pick('user_id % 8', CATEGORIES)} END AS corrected_category,
  CASE WHEN event_id % 6 = 0 THEN {pick('user_id % 4', PRIORITIES)} END AS corrected_priority,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS INT) END AS rating,
  CAST(1000 + event_id % 9000 AS BIGINT) AS time_to_review_ms, ts + to_hours(1) AS created_at
FROM events""",
    ),
    "jobs": (
        [],
        """SELECT o_orderkey AS id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'TRIAGE' WHEN '2-HIGH' THEN 'DRAFT' ELSE 'LLM_CLASSIFY' END AS type,
  o_custkey AS ticket_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'DEAD' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'RUNNING' END AS status,
  CAST(floor(o_totalprice) % 130 AS INT) AS priority, o_orderdate AS run_after, o_orderdate AS created_at
FROM orders""",
    ),
    "policies": (
        [],
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{t}', '{p}', {m})" for t, p, m in SLA_MINUTES)
        + ") AS v(customer_tier, priority, minutes)",
    ),
    "reviews_once": (
        ["replies"],
        f"""SELECT id AS draft_id, conv_id % 6 AS agent_id,
  {pick('(conv_id + turn // 2) % 4', ['APPROVE', 'EDIT_APPROVE', 'REJECT', 'EDIT_APPROVE'])} AS action,
  CASE WHEN conv_id % 9 = 0 THEN ' short ' ELSE concat(' ', final_body, ' ') END AS final_body,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'TONE' END AS reject_reason,
  CAST(1 + conv_id % 6 AS INT) AS rating,
  TIMESTAMP '2024-01-02 00:00:00' + to_minutes(conv_id % 40000) + to_seconds(turn) AS reviewed_at
FROM replies""",
    ),
    "reviews": (
        ["reviews_once"],
        """SELECT * FROM reviews_once UNION ALL
SELECT * REPLACE ('APPROVE' AS action, reviewed_at + INTERVAL 1 HOUR AS reviewed_at) FROM reviews_once""",
    ),
    "review_drafts": (
        ["replies"],
        "SELECT id, conv_id AS ticket_id, body, CASE WHEN (conv_id + turn) % 7 = 3 THEN 'SUPERSEDED' ELSE 'GENERATED' END AS status FROM replies",
    ),
    "review_tickets": (
        [],
        f"""SELECT conv_id AS id, {pick('conv_id % 6', TICKET_STATUSES[:6])} AS status, 'PENDING' AS draft_state,
  CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id % 40000) END AS first_response_at,
  CASE WHEN conv_id % 3 = 0 THEN conv_id % 7 END AS assigned_agent_id, 1 AS version
FROM (SELECT DISTINCT conv_id FROM conversations)""",
    ),
    "accepted": (
        ["reviews", "review_drafts"],
        """SELECT f.draft_id, d.ticket_id, f.agent_id, f.action, f.reviewed_at,
  CASE f.action WHEN 'APPROVE' THEN d.body WHEN 'EDIT_APPROVE' THEN trim(f.final_body, chr(32) || chr(10) || chr(9) || chr(13)) END AS final_body,
  d.body AS draft_body
FROM (SELECT * FROM reviews WHERE (rating IS NULL OR rating BETWEEN 1 AND 5)
        AND NOT (action = 'EDIT_APPROVE' AND length(trim(final_body)) < 10)
        AND NOT (action = 'REJECT' AND reject_reason IS NULL)
      QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY reviewed_at, action) = 1) f
JOIN review_drafts d ON d.id = f.draft_id WHERE d.status = 'GENERATED'""",
    ),
    "multiclass": (
        ["tickets"],
        f"""SELECT id, product, category AS y, CASE WHEN id % 5 = 0 THEN {pick('(id + 3) % 8', CATEGORIES)} ELSE category END AS pred,
  CAST(category_conf AS DOUBLE) AS conf, {pick('id % 8', CATEGORIES)} AS llm_pred
FROM tickets WHERE category IS NOT NULL""",
    ),
}


def bind(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named roles and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _SQL[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS ({_SQL[name][1]})" for name in ordered)
