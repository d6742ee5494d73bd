"""Joins between tickets, clusters, drafts, feedback and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskstream.functions import scoring
from deskstream.operators.windows import ago, topk_per_key
from deskstream.schemas import DEFAULTS, SLA_MINUTES

USABLE_DRAFTS = ["GENERATED", "APPROVED", "EDITED"]
ANSWERED_BY_LLM = "zeroshot_llm"


def sla_policies(spark) -> DataFrame:
    return spark.createDataFrame(SLA_MINUTES, "customer_tier STRING, priority STRING, minutes INT")


def sla_due(tickets: DataFrame, policies: DataFrame, default: int = DEFAULTS.sla_default_minutes) -> DataFrame:
    """Add ``sla_due_at``: created_at plus the minutes of (tier, priority), or the default."""
    joined = tickets.drop("sla_due_at").join(F.broadcast(policies), ["customer_tier", "priority"], "left")  # 12 rows
    minutes = F.coalesce("minutes", F.lit(default))
    return joined.withColumn("sla_due_at", F.col("created_at") + F.make_dt_interval(mins=minutes)).drop("minutes")


def cluster_members(tickets: DataFrame, n: int = 25) -> DataFrame:
    """(id, member_id, member_rank): newest ``n`` other tickets of the ticket's cluster.

    Only the newest ``n + 1`` members of a cluster can be shown to anybody, so those are
    picked first and the self-join fans out by at most that many.
    """
    clustered = tickets.where(F.col("cluster_id").isNotNull())
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    shown = topk_per_key(clustered.select("cluster_id", "id", "created_at"), ["cluster_id"], newest, n + 1, "_r").select(
        "cluster_id", F.col("id").alias("member_id"), F.col("created_at").alias("member_at")
    )
    pairs = clustered.select("cluster_id", "id").join(shown, "cluster_id").where(F.col("id") != F.col("member_id"))
    ranked = topk_per_key(pairs, ["id"], [F.col("member_at").desc(), F.col("member_id").desc()], n, "member_rank")
    return ranked.select("id", "member_id", "member_rank")


def duplicates_of(links: DataFrame, tickets: DataFrame, n: int = 20) -> DataFrame:
    """Most similar linked tickets of each ticket."""
    best = topk_per_key(links, ["ticket_id"], [F.col("similarity").desc(), F.col("similar_id")], n)
    other = tickets.select(F.col("id").alias("similar_id"), "subject", "status", "created_at")
    return best.join(other, "similar_id")


def draft_sources(drafts: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row per source a draft was grounded on, with its resolution. ``sources`` is JSON text."""
    from deskstream.schemas import SOURCE_SCHEMA

    exploded = drafts.select(
        F.col("id").alias("draft_id"), F.posexplode(F.from_json("sources", SOURCE_SCHEMA)).alias("pos", "s")
    ).select("draft_id", "pos", F.col("s.id").alias("source_id"), F.col("s.score").alias("score"))
    fields = tickets.select(F.col("id").alias("source_id"), "subject", "resolution", "category")
    return exploded.join(fields, "source_id")


def predictions_x_tickets(predictions: DataFrame, tickets: DataFrame) -> DataFrame:
    """Predictions on live traffic."""
    live = tickets.where(F.col("source") != "SEED").select(F.col("id").alias("ticket_id"))
    return predictions.join(live, "ticket_id")


def feedback_x_drafts(feedback: DataFrame, drafts: DataFrame) -> DataFrame:
    side = drafts.select(F.col("id").alias("draft_id"), "grounding", F.col("status").alias("draft_status"))
    return feedback.join(side, "draft_id")


def stale_clusters(clusters: DataFrame, tickets: DataFrame, as_of: Column, idle_hours: float = DEFAULTS.cluster_idle_hours) -> DataFrame:
    """Active clusters without news for ``idle_hours`` and without an open ticket, now CLOSED."""
    idle = clusters.where(
        (F.col("status") == "ACTIVE")
        & (F.col("last_seen_at") < ago(as_of, int(idle_hours * 3_600_000_000)))
    )
    busy = tickets.where(scoring.is_open(F.col("status"))).select(F.col("cluster_id").alias("id"))
    return idle.join(busy, "id", "left_anti").withColumn("status", F.lit("CLOSED"))


def cluster_overview(clusters: DataFrame, tickets: DataFrame, status: str | None = "ACTIVE", incidents_only: bool = False, n: int = 100) -> DataFrame:
    """Clusters with open tickets and distinct customers; incidents first, newest first."""
    counts = tickets.where(F.col("cluster_id").isNotNull()).groupBy(F.col("cluster_id").alias("id")).agg(
        F.count_if(scoring.is_open(F.col("status"))).alias("open_tickets"),
        F.countDistinct("customer_id").alias("customers"),
    )
    wanted = clusters
    if status is not None:
        wanted = wanted.where(F.col("status") == status)
    if incidents_only:
        wanted = wanted.where("is_incident")
    joined = wanted.join(counts, "id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("open_tickets", "customers")}
    )
    return cluster_list(joined, n)


def cluster_list(clusters: DataFrame, n: int = 100) -> DataFrame:
    return clusters.orderBy(F.col("is_incident").desc(), F.col("last_seen_at").desc(), F.col("id").desc()).limit(n)


def recent_incidents(clusters: DataFrame, n: int = 50) -> DataFrame:
    return clusters.where("is_incident").orderBy(F.col("first_seen_at").desc(), F.col("id").desc()).limit(n)


def _usable(drafts: DataFrame) -> DataFrame:
    """Drafts somebody else may reuse: not rejected or superseded, and not a copy themselves."""
    return drafts.where(F.col("status").isin(USABLE_DRAFTS) & F.col("reused_from_draft_id").isNull())


def reusable_draft(
    tickets: DataFrame, drafts: DataFrame, clusters: DataFrame, as_of: Column, hours: float = DEFAULTS.reuse_hours
) -> DataFrame:
    """(ticket_id, draft_id): newest usable draft of another ticket of the same incident cluster.

    Per cluster only the newest drafts of two different tickets matter: the second one
    serves the ticket that wrote the first. No ticket meets every draft of its cluster.
    """
    incident = clusters.where("is_incident").select(F.col("id").alias("cluster_id"))
    clustered = tickets.join(incident, "cluster_id").select("id", "cluster_id")
    fresh = _usable(drafts).where(F.col("created_at") > ago(as_of, int(hours * 3_600_000_000)))
    owned = fresh.join(clustered.withColumnRenamed("id", "ticket_id"), "ticket_id")
    newest = F.struct("created_at", F.col("id"))
    per_ticket = owned.groupBy("cluster_id", "ticket_id").agg(F.max(newest).alias("d"))
    two = topk_per_key(per_ticket, ["cluster_id"], [F.col("d").desc()], 2, "_r")
    offered = two.groupBy("cluster_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("ticket_id"))).alias("owner"),
        F.max(F.when(F.col("_r") == 1, F.col("d.id"))).alias("first_draft"),
        F.max(F.when(F.col("_r") == 2, F.col("d.id"))).alias("second_draft"),
    )
    matched = clustered.join(offered, "cluster_id").select(
        F.col("id").alias("ticket_id"),
        F.when(F.col("id") == F.col("owner"), F.col("second_draft")).otherwise(F.col("first_draft")).alias("draft_id"),
    )
    return matched.where(F.col("draft_id").isNotNull())


def cluster_draft(drafts: DataFrame, tickets: DataFrame) -> DataFrame:
    """(cluster_id, draft_id, created_at): newest original usable draft of each cluster."""
    owner = tickets.where(F.col("cluster_id").isNotNull()).select(F.col("id").alias("ticket_id"), "cluster_id")
    return (
        _usable(drafts)
        .join(owner, "ticket_id")
        .groupBy("cluster_id")
        .agg(F.max(F.struct("created_at", F.col("id"))).alias("d"))
        .select("cluster_id", F.col("d.id").alias("draft_id"), F.col("d.created_at").alias("created_at"))
    )


def truth_join(served: DataFrame, truth: DataFrame, uid_pattern: str = r"([^-]+)$") -> DataFrame:
    """Served rows with their ground truth, matched by the uid inside the external id."""
    tagged = served.withColumn("ticket_uid", F.regexp_extract("external_id", uid_pattern, 1))
    return tagged.join(truth, "ticket_uid")


def tickets_exclusion_window(tickets: DataFrame, incidents: DataFrame, hours: float = 6.0) -> DataFrame:
    """Without background tickets of a root cause near an incident of that cause.

    ``incidents`` has root_cause_id, started_at, ended_at. Both sides carry hour slots, so
    the range condition is an equi-join with a residual filter.
    """
    slot_micros = 3_600_000_000
    span = F.lit(int(hours * slot_micros))
    barred = incidents.select(
        "root_cause_id",
        (F.unix_micros("started_at") - span).alias("_lo"),
        (F.unix_micros("ended_at") + span).alias("_hi"),
    ).withColumn(
        "_slot",
        F.explode(F.sequence(F.floor(F.col("_lo") / F.lit(slot_micros)), F.floor(F.col("_hi") / F.lit(slot_micros)))),
    )
    at = F.unix_micros(tickets["created_at"])
    near = (
        (tickets["root_cause_id"] == barred["root_cause_id"])
        & (F.floor(at / F.lit(slot_micros)) == barred["_slot"])
        & at.between(barred["_lo"], barred["_hi"])
    )
    background = tickets["incident_id"].isNull()
    return tickets.join(barred, near & background, "left_anti")


def heldout_split(tickets: DataFrame, causes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): causes in the list are kept out of training and form the test set."""
    train = tickets.where(F.col("split") == "train").join(causes, "root_cause_id", "left_anti")
    test = tickets.join(causes, "root_cause_id", "left_semi")
    return train, test


def prior_answers(llm: DataFrame, small: DataFrame) -> DataFrame:
    """Two prediction sets side by side, by ticket_uid."""
    return llm.join(small, "ticket_uid")


def union_dedupe_by_id(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both pages in one frame, one row per id (equal rows, so any of them)."""
    return first.unionByName(second).dropDuplicates(["id"])


def except_ids(rows: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(other.select(key), key, "left_anti")


def augment_union(train: DataFrame, external: DataFrame, n: int = 3000) -> DataFrame:
    """Train rows plus ``n`` external rows picked by hash."""
    picked = external.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n)
    return train.unionByName(picked)


def label_union(first: DataFrame, second: DataFrame, key: str = "label") -> DataFrame:
    """Counts of both frames per label, 0 where a side has none."""
    a = first.withColumnRenamed("n", "n_first")
    b = second.withColumnRenamed("n", "n_second")
    joined = a.join(b, key, "full_outer")
    return joined.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_first", "n_second")])


def event_log_union(*frames: DataFrame) -> DataFrame:
    """All event types in one log, missing columns NULL."""
    log = frames[0]
    for frame in frames[1:]:
        log = log.unionByName(frame, allowMissingColumns=True)
    return log
