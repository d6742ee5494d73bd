"""Explicit schemas, enum domains and default parameters.

Nothing in this package infers a schema: every source is read with one of the
DDL strings below.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Enum domains and the service-level matrix.
# ---------------------------------------------------------------------------
TIERS = ["FREE", "PRO", "ENTERPRISE"]
PRODUCTS = ["web-app", "mobile-app", "api", "desktop-sync", "admin-console"]
PRIORITIES = ["LOW", "MEDIUM", "HIGH", "URGENT"]
CATEGORIES = [
    "BILLING",
    "LOGIN_ACCESS",
    "BUG",
    "FEATURE_REQUEST",
    "PERFORMANCE",
    "INTEGRATION",
    "ACCOUNT_MANAGEMENT",
    "DATA_PRIVACY",
]
TICKET_STATUSES = ["NEW", "TRIAGED", "DRAFTED", "IN_REVIEW", "RESOLVED", "CLOSED", "TRIAGE_FAILED"]
DRAFT_STATES = ["NONE", "PENDING", "READY", "SKIPPED", "FAILED", "WAITING_LLM"]
SOURCES = ["API", "CSV", "SEED"]
QUEUES = ["STANDARD", "SENIOR"]
LABEL_SOURCES = ["MODEL", "LLM", "AGENT"]
REVIEW_ACTIONS = ["APPROVE", "EDIT_APPROVE", "REJECT", "RELABEL"]
REJECT_REASONS = ["WRONG_INFO", "NOT_GROUNDED", "TONE", "INCOMPLETE", "OTHER"]
CLOSED_STATUSES = ["RESOLVED", "CLOSED"]

# tier, priority, first-response minutes
SLA_MINUTES = [
    ("FREE", "LOW", 2880),
    ("FREE", "MEDIUM", 1440),
    ("FREE", "HIGH", 720),
    ("FREE", "URGENT", 480),
    ("PRO", "LOW", 1440),
    ("PRO", "MEDIUM", 480),
    ("PRO", "HIGH", 240),
    ("PRO", "URGENT", 120),
    ("ENTERPRISE", "LOW", 480),
    ("ENTERPRISE", "MEDIUM", 240),
    ("ENTERPRISE", "HIGH", 60),
    ("ENTERPRISE", "URGENT", 15),
]
TRIAGE_PRIORITY = {"ENTERPRISE": 20, "PRO": 10, "FREE": 0}
TIER_ORDINAL = {"FREE": 0, "PRO": 1, "ENTERPRISE": 2}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Defaults:
    """Tuning constants that are part of the query semantics."""

    tau: float = 0.70
    window_hours: float = 3.0
    burst_minutes: float = 60.0
    burst_min_tickets: int = 5
    burst_min_customers: int = 3
    neighbours: int = 20
    retrieval_k: int = 5
    retrieval_leg: int = 20
    rrf_constant: int = 60
    query_terms: int = 14
    sla_default_minutes: int = 480
    senior_threshold: float = 0.4
    cascade_threshold: float = 0.80
    low_confidence: float = 0.8
    grounding_strong: float = 0.75
    grounding_weak: float = 0.55
    shed_depth: int = 200
    shed_risk: float = 0.2
    reuse_hours: float = 2.0
    draft_wait_hours: float = 6.0
    classify_wait_hours: float = 2.0
    cluster_idle_hours: float = 6.0
    near_duplicate: float = 0.97
    embedding_dim: int = 384
    price_in: float = 0.10
    price_out: float = 0.40


DEFAULTS = Defaults()

TICKET_SCHEMA = """
    id BIGINT, external_id STRING, source STRING, ingest_batch_id BIGINT, customer_id BIGINT,
    customer_tier STRING, product STRING, subject STRING, body STRING, content_hash STRING,
    created_at TIMESTAMP, ingested_at TIMESTAMP, triaged_at TIMESTAMP, drafted_at TIMESTAMP,
    status STRING, draft_state STRING, category STRING, category_conf FLOAT, category_source STRING,
    priority STRING, priority_conf FLOAT, priority_source STRING, escalation_risk FLOAT, queue STRING,
    cluster_id BIGINT, sla_due_at TIMESTAMP, sla_breached BOOLEAN, first_response_at TIMESTAMP,
    assigned_agent_id BIGINT, resolution STRING, resolved_at TIMESTAMP, version INT
"""
EMBEDDING_SCHEMA = """
    ticket_id BIGINT, model_version STRING, is_resolved BOOLEAN, is_open BOOLEAN, product STRING,
    created_at TIMESTAMP, embedding ARRAY<FLOAT>
"""
PREDICTION_SCHEMA = """
    id BIGINT, ticket_id BIGINT, task STRING, model_name STRING, model_version STRING, label STRING,
    score FLOAT, details STRING, latency_ms INT, created_at TIMESTAMP
"""
CLUSTER_SCHEMA = """
    id BIGINT, product STRING, title STRING, size INT, is_incident BOOLEAN, incident_flagged_at TIMESTAMP,
    status STRING, merged_into BIGINT, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP,
    canonical_ticket_id BIGINT
"""
LINK_SCHEMA = "ticket_id BIGINT, similar_id BIGINT, similarity FLOAT"
DRAFT_SCHEMA = """
    id BIGINT, ticket_id BIGINT, status STRING, body STRING, citations STRING, grounding STRING,
    llm_confidence FLOAT, needs_info STRING, sources STRING, reused_from_draft_id BIGINT,
    instruction STRING, model STRING, prompt_version STRING, input_tokens INT, output_tokens INT,
    latency_ms INT, cost_usd DECIMAL(10,6), error STRING, created_at TIMESTAMP
"""
FEEDBACK_SCHEMA = """
    id BIGINT, ticket_id BIGINT, draft_id BIGINT, agent_id BIGINT, action STRING, final_body STRING,
    edit_distance INT, edit_ratio FLOAT, reject_reason STRING, corrected_category STRING,
    corrected_priority STRING, rating SMALLINT, time_to_review_ms BIGINT, created_at TIMESTAMP
"""
JOB_SCHEMA = """
    id BIGINT, type STRING, ticket_id BIGINT, status STRING, priority INT, attempts INT,
    run_after TIMESTAMP, created_at TIMESTAMP
"""
UPLOAD_CSV_SCHEMA_FIELDS = [
    "subject",
    "body",
    "product",
    "customer_tier",
    "external_id",
    "created_at",
    "customer_id",
]
CITATION_SCHEMA = "ARRAY<STRUCT<ticketId: BIGINT, why: STRING>>"
SOURCE_SCHEMA = "ARRAY<STRUCT<id: BIGINT, subject: STRING, score: DOUBLE>>"
EVENT_LOG_SCHEMA = "event STRING, entity_id BIGINT, at TIMESTAMP, payload STRING"

# driver tables, as stored
TABLE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}
