"""Ingest: validation, idempotent insert, history import, exports, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskstream.functions import text
from deskstream.schemas import CATEGORIES, PRODUCTS, TIERS


def parse_created_at(raw: Column, ingest_at: Column | None = None) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` or ISO 8601, UTC without a zone; blank takes ``ingest_at``.

    An unparsable value gives NULL (see :func:`created_at_error`).
    """
    parsed = F.try_to_timestamp(F.regexp_replace(raw, " ", "T"))
    if ingest_at is None:
        return parsed
    return F.when(raw.isNull(), ingest_at).otherwise(parsed)


def created_at_error(raw: Column) -> Column:
    bad = raw.isNotNull() & F.try_to_timestamp(F.regexp_replace(raw, " ", "T")).isNull()
    return F.when(bad, F.lit("created_at is not a timestamp"))


def _blank(value: Column) -> Column:
    """Missing, or nothing but Unicode white space."""
    return value.isNull() | F.rlike(value, F.lit(r"^\p{javaWhitespace}*$"))


def validation_error(subject: Column, body: Column, product: Column, tier: Column, customer_id: Column) -> Column:
    """Reason of the first failed rule, NULL for a valid row."""
    rules = [
        (_blank(subject), "subject is required"),
        (F.length(subject) > 300, "subject exceeds 300 chars"),
        (_blank(body), "body is required"),
        (F.length(body) > 20000, "body exceeds 20000 chars"),
        (product.isNull() | ~product.isin(PRODUCTS), "product must be one of " + ", ".join(PRODUCTS)),
        (tier.isNull() | ~tier.isin(TIERS), "customerTier must be one of " + ", ".join(TIERS)),
        (F.length(customer_id) > 100, "customerId too long"),
    ]
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in rules])


def validate_rows(rows: DataFrame) -> DataFrame:
    """Add ``error``: why the row cannot become a ticket."""
    return rows.withColumn(
        "error",
        validation_error(
            F.col("subject"),
            F.col("body"),
            F.col("product"),
            F.col("customer_tier"),
            F.col("customer_ref").cast("string"),
        ),
    )


def idempotency_key(external_id: Column, header_key: Column) -> Column:
    return F.coalesce(external_id, F.concat(F.lit("idem:"), header_key))


def content_hash(subject: Column, body: Column) -> Column:
    """SHA-256 over the untrimmed subject and body."""
    return F.sha2(F.concat(subject, F.lit("\n"), body), 256)


def idempotent_insert(new: DataFrame, existing: DataFrame | None = None, key: str = "external_id") -> DataFrame:
    """Add ``outcome`` and ``ticket_id``: the first arrival of a key wins, later ones are duplicates of it.

    ``new`` carries ``id`` (the id a created row would take) and ``arrival`` (total order).
    The winner per key is a map-side combined minimum, so a key that holds a large share
    of the rows costs one partial aggregate per task; rows without a key skip the join.
    """
    keyed, free = new.where(F.col(key).isNotNull()), new.where(F.col(key).isNull())
    winners = keyed.groupBy(key).agg(F.min_by("id", F.struct("arrival", "id")).alias("_winner"))
    if existing is not None:
        known = existing.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("_known"))
        winners = winners.join(known, key, "left").select(key, F.coalesce("_known", "_winner").alias("_winner"))
    judged = keyed.join(winners, key).select(
        *new.columns,
        F.when(F.col("_winner") == F.col("id"), F.lit("CREATED")).otherwise(F.lit("DUPLICATE")).alias("outcome"),
        F.col("_winner").alias("ticket_id"),
    )
    fresh = free.select(*new.columns, F.lit("CREATED").alias("outcome"), F.col("id").alias("ticket_id"))
    return judged.unionByName(fresh)


def ingest_batch_summary(judged: DataFrame, batch: str = "ingest_batch_id") -> DataFrame:
    """Exact counts per upload; a rejected row has ``error``, a duplicate has outcome DUPLICATE."""
    ok = F.col("error").isNull()
    return judged.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok & (F.col("outcome") == "CREATED")).alias("accepted"),
        F.count_if(ok & (F.col("outcome") == "DUPLICATE")).alias("duplicates"),
        F.count_if(~ok).alias("rejected"),
        F.lit("DONE").alias("status"),
    )


def ingest_rows(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Validate, then insert the valid rows idempotently; every input row comes back with its outcome."""
    checked = validate_rows(rows)
    good = idempotent_insert(checked.where(F.col("error").isNull()), existing)
    bad = checked.where(F.col("error").isNotNull()).select(
        *checked.columns, F.lit("REJECTED").alias("outcome"), F.lit(None).cast("bigint").alias("ticket_id")
    )
    return good.unionByName(bad)


def customer_upsert(rows: DataFrame) -> DataFrame:
    """One row per customer of the valid rows; the tier of the last arrival wins, blank references are no customers."""
    valid = validate_rows(rows).where(F.col("error").isNull() & ~_blank(F.col("customer_ref")))
    return valid.groupBy(F.col("customer_ref").alias("external_id")).agg(
        F.max_by("customer_tier", F.struct("arrival", "id")).alias("tier")
    )


def reject_report(rejects: DataFrame, limit: int = 100) -> DataFrame:
    """First errors of an upload by file line; the header is line 1."""
    return (
        rejects.where(F.col("error").isNotNull())
        .select((F.col("record") + 1).alias("row"), "error")
        .orderBy("row")
        .limit(limit)
    )


def history_import(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved tickets and their vectors from a history frame, with imported / skipped counts."""
    complete = (
        (F.size("embedding") == dim)
        & F.col("resolution").isNotNull()
        & F.col("subject").isNotNull()
        & F.col("body").isNotNull()
        & F.col("product").isin(PRODUCTS)
        & F.col("customer_tier").isin(TIERS)
    )
    judged = rows.withColumn("_ok", F.coalesce(complete, F.lit(False)))
    kept = idempotent_insert(judged.where("_ok").drop("_ok")).where(F.col("outcome") == "CREATED")
    labelled = {"category": F.col("category"), "priority": F.col("priority")}
    tickets = kept.select(
        "id",
        "external_id",
        F.lit("SEED").alias("source"),
        "customer_tier",
        "product",
        "subject",
        "body",
        "resolution",
        "created_at",
        (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"),
        F.lit("RESOLVED").alias("status"),
        *[column.alias(name) for name, column in labelled.items()],
        F.lit(1.0).cast("float").alias("category_conf"),
        F.lit("AGENT").alias("category_source"),
        F.lit(1.0).cast("float").alias("priority_conf"),
        F.lit("AGENT").alias("priority_source"),
    )
    vectors = kept.select(
        F.col("id").alias("ticket_id"),
        F.lit(True).alias("is_resolved"),
        F.lit(False).alias("is_open"),
        "product",
        "created_at",
        "embedding",
    )
    # a repeated external id is left out like an invalid row, so the two counts add up to the input
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counts = kept.agg(F.count(F.lit(1)).alias("imported")).join(total).select(
        "imported", (F.col("total") - F.col("imported")).alias("skipped")
    )
    return tickets, vectors, counts


def latest_correction(feedback: DataFrame) -> DataFrame:
    """Newest non-null corrected label per ticket, each field on its own."""
    newest = F.struct("created_at", "id")
    pick = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), newest))
    return feedback.groupBy("ticket_id").agg(
        pick("corrected_category").alias("category"), pick("corrected_priority").alias("priority")
    )


def export_training(tickets: DataFrame, feedback: DataFrame, since: Column) -> DataFrame:
    """One JSON line per labelled live ticket since ``since``, with the newest corrections."""
    fixes = latest_correction(feedback).select(
        F.col("ticket_id").alias("id"),
        F.col("category").alias("corrected_category"),
        F.col("priority").alias("corrected_priority"),
    )
    rows = tickets.where(
        (F.col("source") != "SEED") & F.col("category").isNotNull() & (F.col("created_at") >= since)
    ).join(fixes, "id", "left")
    fields = ["id", "subject", "body", "category", "category_source", "priority", "corrected_category", "corrected_priority"]
    return rows.select("id", F.to_json(F.struct(*fields)).alias("line"))


HISTORY_COLUMNS = [
    "ticket_uid", "created_at", "customer_id", "customer_tier", "product", "subject", "body", "resolution",
    "category", "priority", "root_cause_id",
]
STREAM_COLUMNS = ["ticket_uid", "created_at", "customer_id", "customer_tier", "product", "subject", "body"]


def stream_columns(tickets: DataFrame) -> DataFrame:
    """What a live feed carries: no labels, no outcome."""
    return tickets.select(*STREAM_COLUMNS)


def export_history(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("split").isin("train", "val")).select(*HISTORY_COLUMNS)


def export_stream(tickets: DataFrame) -> DataFrame:
    """Test rows by time; a range shuffle, so the written files are globally ordered."""
    return stream_columns(tickets.where(F.col("split") == "test")).orderBy("created_at", "ticket_uid")


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("header", True).csv(path)


def write_by_split(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").partitionBy("split").parquet(path)


def replay_shift(tickets: DataFrame, now: Column) -> DataFrame:
    """Shift all times so that the newest row happens ``now``."""
    newest = tickets.agg(F.max("created_at").alias("_newest"))
    shifted = tickets.join(F.broadcast(newest))  # one row by construction
    gap = F.unix_micros(now) - F.unix_micros("_newest")
    return shifted.withColumn("created_at", F.timestamp_micros(F.unix_micros("created_at") + gap)).drop("_newest")


def reset_live(tickets: DataFrame, dependents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Only the seed history and what hangs on it."""
    seed = tickets.where(F.col("source") == "SEED")
    ids = seed.select(F.col("id").alias("ticket_id"))
    kept = {name: frame.join(ids, "ticket_id", "left_semi") for name, frame in dependents.items()}
    return {"tickets": seed, **kept}


def external_prepare(rows: DataFrame) -> DataFrame:
    """Trim, keep one row per text and split 70 / 15 / 15 inside every category.

    Exact positions inside a category come from bucketed ranks (see
    :func:`deskstream.operators.windows.ranked_in_group`), so no category is sorted by one task.
    """
    from deskstream.operators.windows import ranked_in_group

    trimmed = rows.withColumn("text", text.strip_controls(F.col("text")))
    unique = trimmed.groupBy("text").agg(F.min_by(F.struct("category", "intent"), "row").alias("_r"))
    unique = unique.select("text", "_r.category", "_r.intent", F.md5("text").alias("_h"))
    ranked = ranked_in_group(unique, ["category"], "_h", ["text"])
    cut = lambda share: F.floor(F.col("group_size") * F.lit(share))
    return ranked.select(
        "text",
        "category",
        "intent",
        F.when(F.col("position") <= cut(0.70), F.lit("train"))
        .when(F.col("position") <= cut(0.85), F.lit("val"))
        .otherwise(F.lit("test"))
        .alias("split"),
    )


# External intents that have a category here.
INTENT_CATEGORIES = [
    ("check_invoice", "BILLING"),
    ("get_invoice", "BILLING"),
    ("payment_issue", "BILLING"),
    ("check_payment_methods", "BILLING"),
    ("get_refund", "BILLING"),
    ("check_refund_policy", "BILLING"),
    ("track_refund", "BILLING"),
    ("check_cancellation_fee", "BILLING"),
    ("recover_password", "LOGIN_ACCESS"),
    ("registration_problems", "LOGIN_ACCESS"),
    ("create_account", "ACCOUNT_MANAGEMENT"),
    ("delete_account", "ACCOUNT_MANAGEMENT"),
    ("edit_account", "ACCOUNT_MANAGEMENT"),
    ("switch_account", "ACCOUNT_MANAGEMENT"),
]


def intent_label_map(rows: DataFrame) -> DataFrame:
    """Keep rows whose intent is mapped and give them our category."""
    table = rows.sparkSession.createDataFrame(INTENT_CATEGORIES, "intent STRING, category STRING")
    return rows.drop("category").join(F.broadcast(table), "intent")  # fixed 14 rows


def assign_batches(tickets: DataFrame, size: int = 10) -> DataFrame:
    """Chunk rows per incident, else per split, so that a batch never crosses either."""
    from deskstream.operators.windows import ranked_in_group

    grouped = tickets.withColumn(
        "batch_group", F.coalesce(F.col("incident_id"), F.concat(F.lit("split:"), F.col("split")))
    ).withColumn("_h", F.md5(F.col("id").cast("string")))
    ranked = ranked_in_group(grouped, ["batch_group"], "_h", ["id"])
    batch = F.concat_ws("#", "batch_group", F.floor((F.col("position") - 1) / size).cast("string"))
    return ranked.withColumn("batch_id", batch).drop("_h", "position", "group_size")


def enum_domain_error(
    category: Column, priority: Column, action: Column, reason: Column, rating: Column, body: Column
) -> Column:
    """First broken rule of a review, NULL for a valid one."""
    from deskstream.schemas import PRIORITIES, REJECT_REASONS

    short = F.length(text.strip_controls(F.coalesce(body, F.lit("")))) < 10
    rules = [
        (category.isNotNull() & ~category.isin(CATEGORIES), "unknown category"),
        (priority.isNotNull() & ~priority.isin(PRIORITIES), "unknown priority"),
        (rating.isNotNull() & ~rating.between(1, 5), "rating must be 1..5"),
        ((action == "EDIT_APPROVE") & short, "finalBody is required (min 10 chars)"),
        ((action == "REJECT") & (reason.isNull() | ~reason.isin(REJECT_REASONS)), "rejectReason is required"),
    ]
    return F.coalesce(*[F.when(condition, F.lit(message)) for condition, message in rules])


