"""State changes as table transforms: review, correction, drafts, triage, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskstream.functions import scoring, text
from deskstream.operators import ingest, joins
from deskstream.operators.windows import topk_per_key
from deskstream.schemas import DEFAULTS


def accepted_reviews(drafts: DataFrame, reviews: DataFrame) -> DataFrame:
    """The first valid review of every draft that is still GENERATED, with edit distance and ratio.

    ``reviews`` has draft_id, agent_id, action, final_body, reject_reason,
    corrected_category, corrected_priority, rating, time_to_review_ms, reviewed_at.
    """
    error = ingest.enum_domain_error(
        F.col("corrected_category"),
        F.col("corrected_priority"),
        F.col("action"),
        F.col("reject_reason"),
        F.col("rating"),
        F.col("final_body"),
    )
    valid = reviews.where(error.isNull() & F.col("action").isin("APPROVE", "EDIT_APPROVE", "REJECT"))
    first = topk_per_key(valid, ["draft_id"], [F.col("reviewed_at"), F.col("action")], 1).drop("rank")
    waiting = drafts.where(F.col("status") == "GENERATED").select(
        F.col("id").alias("draft_id"), "ticket_id", F.col("body").alias("draft_body")
    )
    joined = first.join(waiting, "draft_id")
    approve, edit = F.col("action") == "APPROVE", F.col("action") == "EDIT_APPROVE"
    body = F.when(approve, F.col("draft_body")).when(edit, text.strip_controls(F.col("final_body")))
    return joined.withColumn("final_body", body).withColumns(
        {
            "edit_distance": F.when(approve, F.lit(0)).when(edit, text.edit_distance(F.col("draft_body"), F.col("final_body"))),
            "edit_ratio": F.when(approve, F.lit(0.0)).when(edit, text.edit_ratio(F.col("draft_body"), F.col("final_body"))),
        }
    )


def apply_review(tickets: DataFrame, drafts: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tickets, drafts, feedback) after the reviews.

    When several drafts of a ticket were reviewed, resolving wins over rejecting and the
    earliest resolution stands; assignee and first response keep an earlier value.
    """
    accepted = accepted_reviews(drafts, reviews)
    feedback = accepted.select(
        "ticket_id", "draft_id", "agent_id", "action", "final_body", "edit_distance", "edit_ratio", "reject_reason",
        "corrected_category", "corrected_priority", "rating", "time_to_review_ms", F.col("reviewed_at").alias("created_at"),
    )
    outcome = (
        F.when(F.col("action") == "APPROVE", F.lit("APPROVED"))
        .when(F.col("action") == "EDIT_APPROVE", F.lit("EDITED"))
        .otherwise(F.lit("REJECTED"))
    )
    verdicts = accepted.select(F.col("draft_id").alias("id"), outcome.alias("_status"))
    new_drafts = drafts.join(verdicts, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")

    resolves = F.col("action") != "REJECT"
    when_resolved = F.when(resolves, F.struct("reviewed_at", "draft_id"))
    per_ticket = accepted.groupBy(F.col("ticket_id").alias("id")).agg(
        F.bool_or(resolves).alias("_resolved"),
        F.min(F.when(resolves, F.col("reviewed_at"))).alias("_at"),
        F.min_by("final_body", when_resolved).alias("_body"),
        F.min_by("agent_id", F.struct("reviewed_at", "draft_id")).alias("_agent"),
    )
    touched, resolved = F.col("_resolved").isNotNull(), F.coalesce("_resolved", F.lit(False))
    rejected = touched & ~resolved & (F.col("status") != "RESOLVED")
    new_tickets = tickets.join(per_ticket, "id", "left").withColumns(
        {
            "status": F.when(resolved, F.lit("RESOLVED")).when(rejected, F.lit("IN_REVIEW")).otherwise(F.col("status")),
            "resolution": F.when(resolved, F.col("_body")).otherwise(F.col("resolution")),
            "resolved_at": F.when(resolved, F.col("_at")).otherwise(F.col("resolved_at")),
            "first_response_at": F.when(resolved, F.coalesce("first_response_at", "_at")).otherwise(F.col("first_response_at")),
            "assigned_agent_id": F.when(resolved | rejected, F.coalesce("assigned_agent_id", "_agent")).otherwise(
                F.col("assigned_agent_id")
            ),
            "draft_state": F.when(resolved, F.lit("READY")).otherwise(F.col("draft_state")),
            "version": F.col("version") + F.when(resolved | rejected, F.lit(1)).otherwise(F.lit(0)),
        }
    )
    return new_tickets.drop("_resolved", "_at", "_body", "_agent"), new_drafts, feedback


def manual_resolve(tickets: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tickets, feedback): an agent's own reply resolves an open ticket; the first valid reply counts.

    ``replies`` has ticket_id, agent_id, body, replied_at.
    """
    body = text.strip_controls(F.col("body"))
    valid = replies.where(F.length(body) >= 10)
    first = topk_per_key(valid, ["ticket_id"], [F.col("replied_at"), F.col("body")], 1).select(
        F.col("ticket_id").alias("id"), F.col("agent_id").alias("_agent"), body.alias("_body"), F.col("replied_at").alias("_at")
    )
    joined = tickets.join(first, "id", "left")
    hit = F.col("_body").isNotNull() & scoring.is_open(F.col("status"))
    marked = joined.withColumn("_hit", hit)
    updated = marked.withColumns(
        {
            "status": F.when(F.col("_hit"), F.lit("RESOLVED")).otherwise(F.col("status")),
            "resolution": F.when(F.col("_hit"), F.col("_body")).otherwise(F.col("resolution")),
            "resolved_at": F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("resolved_at")),
            "first_response_at": F.when(F.col("_hit"), F.coalesce("first_response_at", "_at")).otherwise(F.col("first_response_at")),
            "assigned_agent_id": F.when(F.col("_hit"), F.coalesce("assigned_agent_id", "_agent")).otherwise(F.col("assigned_agent_id")),
            "draft_state": F.when(F.col("_hit"), F.lit("READY")).otherwise(F.col("draft_state")),
            "version": F.col("version") + F.when(F.col("_hit"), F.lit(1)).otherwise(F.lit(0)),
        }
    )
    feedback = marked.where("_hit").select(
        F.col("id").alias("ticket_id"),
        F.lit(None).cast("bigint").alias("draft_id"),
        F.col("_agent").alias("agent_id"),
        F.lit("EDIT_APPROVE").alias("action"),
        F.col("_body").alias("final_body"),
        F.length("_body").alias("edit_distance"),
        F.lit(1.0).alias("edit_ratio"),
        F.col("_at").alias("created_at"),
    )
    return updated.drop("_agent", "_body", "_at", "_hit"), feedback


def apply_corrections(tickets: DataFrame, feedback: DataFrame, policies: DataFrame) -> DataFrame:
    """Labels people corrected replace the current ones; a new priority moves the deadline."""
    fixes = ingest.latest_correction(feedback).select(
        F.col("ticket_id").alias("id"), F.col("category").alias("_c"), F.col("priority").alias("_p")
    )
    joined = tickets.join(fixes, "id", "left")
    new_c = F.col("_c").isNotNull() & ~F.col("category").eqNullSafe(F.col("_c"))
    new_p = F.col("_p").isNotNull() & ~F.col("priority").eqNullSafe(F.col("_p"))
    marked = joined.withColumns({"_nc": new_c, "_np": new_p, "_due": F.col("sla_due_at")})
    one = F.lit(1.0).cast("float")
    relabelled = marked.withColumns(
        {
            "category": F.when(F.col("_nc"), F.col("_c")).otherwise(F.col("category")),
            "category_source": F.when(F.col("_nc"), F.lit("AGENT")).otherwise(F.col("category_source")),
            "category_conf": F.when(F.col("_nc"), one).otherwise(F.col("category_conf")),
            "priority": F.when(F.col("_np"), F.col("_p")).otherwise(F.col("priority")),
            "priority_source": F.when(F.col("_np"), F.lit("AGENT")).otherwise(F.col("priority_source")),
            "priority_conf": F.when(F.col("_np"), one).otherwise(F.col("priority_conf")),
        }
    )
    dated = joins.sla_due(relabelled, policies)
    return dated.withColumn("sla_due_at", F.when(F.col("_np"), F.col("sla_due_at")).otherwise(F.col("_due"))).drop(
        "_c", "_p", "_nc", "_np", "_due"
    )


def close_the_loop(tickets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors with flags from the ticket state: resolved ones join the corpus and leave the candidates."""
    state = tickets.select(
        F.col("id").alias("ticket_id"),
        (~scoring.is_open(F.col("status"))).alias("is_resolved"),
        scoring.is_open(F.col("status")).alias("is_open"),
    )
    return vectors.drop("is_resolved", "is_open").join(state, "ticket_id")


def shed_low_value(
    tickets: DataFrame, jobs: DataFrame, depth: int = DEFAULTS.shed_depth, risk: float = DEFAULTS.shed_risk
) -> DataFrame:
    """Tickets with ``shed``: under a draft backlog, low-priority low-risk ones get no draft on their own.

    ``tickets`` has ``instruction`` (NULL unless an agent asked for a draft).
    """
    backlog = jobs.where((F.col("type") == "DRAFT") & (F.col("status") == "PENDING")).agg(
        F.count(F.lit(1)).alias("_backlog")
    )
    low = (
        F.col("instruction").isNull()
        & (F.col("priority") == "LOW")
        & (F.coalesce(F.col("escalation_risk").cast("double"), F.lit(0.0)) < risk)
    )
    joined = tickets.join(F.broadcast(backlog))  # one row
    return joined.withColumn("shed", F.coalesce(low & (F.col("_backlog") > depth), F.lit(False))).drop("_backlog")


def store_draft(tickets: DataFrame, drafts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tickets, drafts): add new drafts, supersede older GENERATED ones, move the ticket to DRAFTED."""
    every = drafts.unionByName(new, allowMissingColumns=True)
    fresh = new.select("ticket_id", F.col("id").alias("_new"), F.col("created_at").alias("_at"))
    newest = fresh.groupBy("ticket_id").agg(F.max_by("_new", F.struct("_at", "_new")).alias("_new"), F.max("_at").alias("_at"))
    joined = every.join(newest, "ticket_id", "left")
    old = F.col("_new").isNotNull() & (F.col("id") != F.col("_new")) & (F.col("status") == "GENERATED")
    stored = joined.withColumn("status", F.when(old, F.lit("SUPERSEDED")).otherwise(F.col("status"))).drop("_new", "_at")
    moved = tickets.join(newest.withColumnRenamed("ticket_id", "id"), "id", "left")
    hit = F.col("_new").isNotNull()
    advance = hit & F.col("status").isin("TRIAGED", "DRAFTED", "TRIAGE_FAILED")
    updated = moved.withColumns(
        {
            "status": F.when(advance, F.lit("DRAFTED")).otherwise(F.col("status")),
            "draft_state": F.when(hit, F.lit("READY")).otherwise(F.col("draft_state")),
            "drafted_at": F.when(hit, F.col("_at")).otherwise(F.col("drafted_at")),
            "version": F.col("version") + F.when(hit, F.lit(1)).otherwise(F.lit(0)),
        }
    )
    return updated.drop("_new", "_at"), stored


def reuse_incident_draft(
    tickets: DataFrame, drafts: DataFrame, clusters: DataFrame, as_of: Column, hours: float = DEFAULTS.reuse_hours
) -> DataFrame:
    """New draft rows: the incident's draft copied to its other tickets, at no cost.

    The copy gets the next id of its ticket's sequence, ``draft_id * 2 + 1`` of the source
    combined with the ticket, so ids come from the data.
    """
    match = joins.reusable_draft(tickets, drafts, clusters, as_of, hours).withColumnRenamed("draft_id", "reused_from_draft_id")
    source = drafts.select(
        F.col("id").alias("reused_from_draft_id"), "body", "citations", "grounding", "sources"
    )
    return match.join(source, "reused_from_draft_id").select(
        F.xxhash64("ticket_id", "reused_from_draft_id").alias("id"),
        "ticket_id",
        F.lit("GENERATED").alias("status"),
        "body",
        "citations",
        "grounding",
        "sources",
        "reused_from_draft_id",
        F.lit("incident-reuse").alias("model"),
        F.lit("reuse").alias("prompt_version"),
        F.lit(0).cast("decimal(10,6)").alias("cost_usd"),
        as_of.alias("created_at"),
    )


def sla_breaches(tickets: DataFrame, as_of: Column) -> DataFrame:
    """Tickets whose deadline passed by ``as_of`` without a first response while still open."""
    late = F.col("sla_due_at") < as_of
    return tickets.where(
        late & F.col("first_response_at").isNull() & scoring.is_open(F.col("status")) & ~F.coalesce("sla_breached", F.lit(False))
    ).withColumn("sla_breached", F.lit(True))


def triage_result(tickets: DataFrame, scores: DataFrame, clusters: DataFrame, policies: DataFrame) -> DataFrame:
    """The triaged ticket: labels, risk, queue, deadline and draft priority.

    ``scores`` has id, category, category_conf, priority, priority_conf, risk, triaged_at.
    """
    side = clusters.select(F.col("id").alias("cluster_id"), "is_incident")
    base = tickets.select("id", "customer_tier", "product", "created_at", "cluster_id", "status")
    scored = base.join(scores, "id").join(side, "cluster_id", "left")
    dated = joins.sla_due(scored, policies)
    return dated.select(
        "id",
        "category",
        F.col("category_conf").cast("float").alias("category_conf"),
        F.lit("MODEL").alias("category_source"),
        "priority",
        F.col("priority_conf").cast("float").alias("priority_conf"),
        F.lit("MODEL").alias("priority_source"),
        F.col("risk").cast("float").alias("escalation_risk"),
        scoring.route_queue(F.col("risk")).alias("queue"),
        "cluster_id",
        "sla_due_at",
        "triaged_at",
        F.when(F.col("status") == "NEW", F.lit("TRIAGED")).otherwise(F.col("status")).alias("status"),
        F.lit("PENDING").alias("draft_state"),
        scoring.draft_priority(F.col("risk"), F.col("customer_tier"), F.col("is_incident")).alias("draft_priority"),
        scoring.cascade_flag(F.col("category_conf")).alias("needs_llm"),
    )


def waiting_timeout(
    tickets: DataFrame,
    as_of: Column,
    draft_hours: float = DEFAULTS.draft_wait_hours,
    classify_hours: float = DEFAULTS.classify_wait_hours,
) -> DataFrame:
    """Give up waiting for the language model: drafts after 6 whole hours, classification after 2.

    Adds ``give_up_classify`` and moves overdue drafts to SKIPPED, the rest to WAITING_LLM.
    """
    hours = F.floor((F.unix_micros(as_of) - F.unix_micros("ingested_at")) / F.lit(3_600_000_000))
    pending = F.col("draft_state").isin("PENDING", "WAITING_LLM")
    state = (
        F.when(pending & (hours >= draft_hours), F.lit("SKIPPED"))
        .when(pending, F.lit("WAITING_LLM"))
        .otherwise(F.col("draft_state"))
    )
    return tickets.withColumn("give_up_classify", hours >= classify_hours).withColumn("draft_state", state)


def append_predictions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """History plus new rows; the first insert of (ticket, task, model, version) stays."""
    key = ["ticket_id", "task", "model_name", "model_version"]
    log = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    order = [F.col("_batch"), F.col("created_at"), F.col("id")]
    return topk_per_key(log, key, order, 1).drop("rank", "_batch")
