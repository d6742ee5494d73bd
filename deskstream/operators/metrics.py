"""Dashboards' aggregates: volume, mix, draft quality, cost, latency, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskstream.functions import scoring
from deskstream.operators.windows import ago, exact_percentiles
from deskstream.schemas import DEFAULTS

MICROS_PER_DAY = 86_400_000_000
LLM_MODEL = "zeroshot_llm"
REUSE_MODEL = "incident-reuse"


def since(column: str, as_of: Column, days: int) -> Column:
    """Rows of the last ``days`` (clamped to 1..365) before ``as_of``."""
    days = max(1, min(days, 365))
    return F.col(column) >= ago(as_of, days * MICROS_PER_DAY)


def _live(tickets: DataFrame, as_of: Column, days: int) -> DataFrame:
    return tickets.where((F.col("source") != "SEED") & since("ingested_at", as_of, days))


def _day(column: str) -> Column:
    return F.date_format(F.date_trunc("day", column), "yyyy-MM-dd")


def metric_totals(tickets: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return _live(tickets, as_of, days).agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(~scoring.is_open(F.col("status"))).alias("resolved"),
        F.count_if(F.col("queue") == "SENIOR").alias("senior_queue"),
        F.count_if("sla_breached").alias("sla_breached"),
        F.coalesce(F.avg(F.col("escalation_risk").cast("double")), F.lit(0.0)).alias("avg_risk"),
    )


def volume_by_day(tickets: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return _live(tickets, as_of, days).groupBy(_day("ingested_at").alias("day")).agg(F.count(F.lit(1)).alias("tickets"))


def label_mix(tickets: DataFrame, as_of: Column, days: int, column: str, missing: str) -> DataFrame:
    label = F.coalesce(column, F.lit(missing)).alias(column)
    return _live(tickets, as_of, days).groupBy(label).agg(F.count(F.lit(1)).alias("tickets"))


def category_mix(tickets: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return label_mix(tickets, as_of, days, "category", "UNCLASSIFIED")


def priority_mix(tickets: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return label_mix(tickets, as_of, days, "priority", "UNSET")


def risk_histogram(tickets: DataFrame, as_of: Column, days: int = 7, buckets: int = 10) -> DataFrame:
    """Counts per risk bucket, imported history included; risk 1.0 falls into bucket ``buckets + 1``."""
    rows = tickets.where(since("ingested_at", as_of, days) & F.col("escalation_risk").isNotNull())
    bucket = F.width_bucket(F.col("escalation_risk").cast("double"), F.lit(0.0), F.lit(1.0), F.lit(buckets))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("tickets"))


def draft_outcomes(feedback: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Review outcomes in one row; the rates are NULL when nothing was reviewed."""
    drafted = F.col("draft_id").isNotNull()
    edited = (F.col("action") == "EDIT_APPROVE") & drafted
    counted = feedback.where(since("created_at", as_of, days)).agg(
        F.count_if(F.col("action") == "APPROVE").alias("approved"),
        F.count_if(edited).alias("edited"),
        F.count_if(F.col("action") == "REJECT").alias("rejected"),
        F.count_if((F.col("action") == "EDIT_APPROVE") & ~drafted).alias("manual"),
        F.coalesce(F.avg(F.when(edited, F.col("edit_ratio").cast("double"))), F.lit(0.0)).alias("mean_edit_ratio"),
        F.coalesce(F.avg("time_to_review_ms"), F.lit(0.0)).alias("avg_review_ms"),
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"),
    )
    reviewed = F.col("approved") + F.col("edited") + F.col("rejected")
    some = F.nullif(reviewed, F.lit(0))
    return counted.withColumns(
        {
            "reviewed": reviewed,
            "approval_rate": (F.col("approved") + F.col("edited")) / some,
            "approved_as_is_rate": F.col("approved") / some,
        }
    )


def reject_reasons(feedback: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    rows = feedback.where((F.col("action") == "REJECT") & since("created_at", as_of, days))
    return rows.groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def approval_by_grounding(feedback: DataFrame, drafts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    from deskstream.operators.joins import feedback_x_drafts

    joined = feedback_x_drafts(feedback.where(since("created_at", as_of, days)), drafts)
    three = lambda c: F.round(c.cast("decimal(20,10)"), 3)
    return joined.groupBy("grounding").agg(
        F.count(F.lit(1)).alias("reviewed"),
        three(F.count_if(F.col("action").isin("APPROVE", "EDIT_APPROVE")) / F.count(F.lit(1))).alias("approval_rate"),
        three(F.coalesce(F.avg(F.col("edit_ratio").cast("double")), F.lit(0.0))).alias("mean_edit_ratio"),
    )


def draft_status_counts(drafts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return drafts.where(since("created_at", as_of, days)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def llm_usage(drafts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    original = F.col("reused_from_draft_id").isNull() & F.col("model").isNotNull() & (F.col("model") != REUSE_MODEL)
    return drafts.where(since("created_at", as_of, days)).agg(
        F.count_if(original).alias("draft_calls"),
        F.count_if(F.col("reused_from_draft_id").isNotNull()).alias("reused_drafts"),
        F.coalesce(F.sum("cost_usd"), F.lit(0).cast("decimal(20,6)")).alias("draft_cost_usd"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_draft_latency_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def llm_classified_share(tickets: DataFrame, predictions: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Share of categorised live tickets the language model labelled, and its calls."""
    share = _live(tickets, as_of, days).where(F.col("category").isNotNull()).agg(
        F.coalesce(F.avg((F.col("category_source") == "LLM").cast("int")), F.lit(0.0)).alias("llm_classified_share")
    )
    calls = predictions.where((F.col("model_name") == LLM_MODEL) & since("created_at", as_of, days)).agg(
        F.count(F.lit(1)).alias("classify_calls")
    )
    return share.join(F.broadcast(calls))  # one row each


def cost_by_day(drafts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    rows = drafts.where(since("created_at", as_of, days) & (F.col("cost_usd") > 0))
    return rows.groupBy(_day("created_at").alias("day")).agg(
        F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("calls")
    )


def label_corrections(feedback: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return feedback.where(since("created_at", as_of, days)).agg(
        F.count("corrected_category").alias("category_corrections"),
        F.count("corrected_priority").alias("priority_corrections"),
    )


def latency_percentiles(tickets: DataFrame, end: str, name: str, as_of: Column, days: int = 7) -> DataFrame:
    """Interpolated p50 and p95 of the seconds from ingest to ``end``, live tickets only."""
    rows = _live(tickets, as_of, days).where(F.col(end).isNotNull())
    seconds = (F.unix_micros(end) - F.unix_micros("ingested_at")) / F.lit(1e6)
    return exact_percentiles(rows.select(seconds.alias("s")), "s", [0.5, 0.95], [f"{name}_p50", f"{name}_p95"])


def queue_counts(tickets: DataFrame) -> DataFrame:
    is_open = scoring.is_open(F.col("status"))
    return tickets.groupBy("queue").agg(
        F.count_if(is_open).alias("open"),
        F.count_if(F.col("status") == "DRAFTED").alias("awaiting_review"),
        F.count_if(F.col("sla_breached") & is_open).alias("breached"),
    )


def active_incidents(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count_if(F.col("is_incident") & (F.col("status") == "ACTIVE")).alias("active_incidents"))


def jobs_depth(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") != "DONE").groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


def ready_jobs(jobs: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Per type, the next ``n`` pending jobs that are due: highest priority first, then oldest id."""
    from deskstream.operators.windows import topk_per_key

    due = jobs.where((F.col("status") == "PENDING") & (F.col("run_after") <= as_of))
    return topk_per_key(due, ["type"], [F.col("priority").desc(), F.col("id")], n)


# ------------------------------------------------------------------------- drift
def drift_rows(predictions: DataFrame, tickets: DataFrame, as_of: Column) -> DataFrame:
    """Live category predictions with ``period``: recent (7 days) or baseline (the 30 before)."""
    from deskstream.operators.joins import predictions_x_tickets

    day = MICROS_PER_DAY
    period = F.when(F.col("created_at") >= ago(as_of, 7 * day), F.lit("recent")).otherwise(F.lit("baseline"))
    inside = (F.col("created_at") >= ago(as_of, 37 * day)) & (F.col("created_at") < as_of)  # the column itself, so that the bound reaches the scan
    wanted = predictions.where(inside & (F.col("task") == "CATEGORY") & (F.col("model_name") != LLM_MODEL))
    return predictions_x_tickets(wanted.withColumn("period", period), tickets)


def drift_window(predictions: DataFrame, tickets: DataFrame, as_of: Column, low: float = DEFAULTS.low_confidence) -> DataFrame:
    """Per period: rows, share below ``low`` (compared as float, like the stored score) and mean score."""
    low_f = F.lit(low).cast("float")
    return drift_rows(predictions, tickets, as_of).groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("score") < low_f).cast("int")).alias("low_share"),
        F.avg(F.col("score").cast("double")).alias("mean_conf"),
    )


def category_shift(predictions: DataFrame, tickets: DataFrame, as_of: Column) -> DataFrame:
    """Total variation distance between the label mixes of the two periods, one row."""
    counts = drift_rows(predictions, tickets, as_of).groupBy("label").agg(
        F.count_if(F.col("period") == "recent").alias("r"), F.count_if(F.col("period") == "baseline").alias("b")
    )
    totals = counts.agg(F.sum("r").alias("tr"), F.sum("b").alias("tb"))
    share = lambda n, total: F.coalesce(F.col(n) / F.nullif(F.col(total), F.lit(0)), F.lit(0.0))
    return counts.join(F.broadcast(totals)).agg(  # one row by construction
        F.coalesce(F.sum(F.abs(share("r", "tr") - share("b", "tb"))) / 2, F.lit(0.0)).alias("category_shift")
    )


def drift_alert(predictions: DataFrame, tickets: DataFrame, as_of: Column, min_n: int = 30) -> DataFrame:
    """Both windows, the shift and the reasons for an alert, one row."""
    windows = drift_window(predictions, tickets, as_of)
    pick = lambda period, name: F.coalesce(
        F.max(F.when(F.col("period") == period, F.col(name))), F.lit(0)
    ).alias(f"{period}_{name}")
    wide = windows.agg(*[pick(p, n) for p in ("recent", "baseline") for n in ("n", "low_share", "mean_conf")])
    joined = wide.join(F.broadcast(category_shift(predictions, tickets, as_of)))  # one row each
    enough = (F.col("recent_n") >= min_n) & (F.col("baseline_n") >= min_n)
    lower = (F.col("recent_low_share") > 0.05) & (F.col("recent_low_share") > 2 * F.col("baseline_low_share"))
    shifted = F.col("category_shift") > 0.2
    reasons = F.array_compact(
        F.array(
            F.when(
                enough & lower,
                F.format_string(
                    "share of low-confidence tickets is %.0f%% vs %.0f%% baseline",
                    F.col("recent_low_share") * 100,
                    F.col("baseline_low_share") * 100,
                ),
            ),
            F.when(
                enough & shifted, F.format_string("category mix shifted (total variation %.2f)", F.col("category_shift"))
            ),
        )
    )
    return joined.withColumns({"enough_data": enough, "reasons": reasons}).withColumn("alert", F.size("reasons") > 0)


# ------------------------------------------------------------------ other counts
def cluster_timeline(tickets: DataFrame) -> DataFrame:
    minute = F.date_trunc("minute", "created_at").alias("minute")
    return tickets.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id", minute).agg(
        F.count(F.lit(1)).alias("tickets")
    )


def distinct_customers(tickets: DataFrame) -> DataFrame:
    """Reporters per cluster; a ticket without a customer counts as its own."""
    who = F.coalesce(
        F.concat(F.lit("c"), F.col("customer_id").cast("string")), F.concat(F.lit("t"), F.col("id").cast("string"))
    )
    return tickets.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.countDistinct(who).alias("customers")
    )


def dataset_card(tickets: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return tickets.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def escalated_by_split(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("split").agg(
        F.round(F.avg(F.col("escalated").cast("int")), 3).alias("escalated_rate"),
        F.countDistinct("incident_id").alias("incidents"),
        F.countDistinct("root_cause_id").alias("root_causes"),
    )


def llm_usage_by_model(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("model").isNotNull()).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def state_matrix(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("status", "draft_state").agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(tickets: DataFrame, row: str, label: str, values: list[str]) -> DataFrame:
    """One column of counts per label; the labels are given, so no extra pass finds them."""
    return tickets.groupBy(row).pivot(label, values).agg(F.count(F.lit(1))).na.fill(0)
