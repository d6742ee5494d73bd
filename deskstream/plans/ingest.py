"""Ingest, exports and replay over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.operators import ingest as op
from deskstream.plans.bindings import NOW, bind
from deskstream.plans.registry import query
from deskstream.session import scratch_path
from deskstream.sources import files
from deskstream.sources.bind import Inputs


@query(
    "scan_tickets_parquet",
    "SELECT vec_id, label, len(embedding) AS dim, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS norm2 FROM embeddings",
    num="norm2",
)
def _scan(i: Inputs) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return i.table("embeddings").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"), squares.alias("norm2"))


@query(
    "parse_created_at",
    bind("uploads")
    + f""" SELECT id, CASE WHEN created_raw IS NULL THEN {NOW} ELSE try_cast(created_raw AS TIMESTAMP) END AS created_at,
  created_raw IS NOT NULL AND try_cast(created_raw AS TIMESTAMP) IS NULL AS rejected FROM uploads""",
    ts="created_at",
)
def _parse(i: Inputs) -> DataFrame:
    raw = F.col("created_raw")
    return i.uploads.select(
        "id",
        op.parse_created_at(raw, i.as_of).alias("created_at"),
        op.created_at_error(raw).isNotNull().alias("rejected"),
    )


@query("validate_rows", bind("checked") + " SELECT id, error FROM checked")
def _validate(i: Inputs) -> DataFrame:
    return op.validate_rows(i.uploads).select("id", "error")


_SUMMARY = """ SELECT ingest_batch_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'CREATED') AS accepted,
  count(*) FILTER (WHERE outcome = 'DUPLICATE') AS duplicates, count(*) FILTER (WHERE error IS NOT NULL) AS rejected, 'DONE' AS status
FROM (SELECT ingest_batch_id, error, outcome FROM judged UNION ALL
      SELECT ingest_batch_id, error, NULL FROM checked WHERE error IS NOT NULL) GROUP BY 1"""


@query("ingest_batch_summary", bind("judged") + _SUMMARY)
def _summary(i: Inputs) -> DataFrame:
    return op.ingest_batch_summary(op.ingest_rows(i.uploads))


@query(
    "batch_ingest",
    bind("judged")
    + """ SELECT outcome, count(*) AS n FROM (SELECT outcome FROM judged UNION ALL SELECT 'REJECTED' FROM checked WHERE error IS NOT NULL) GROUP BY 1""",
)
def _batch(i: Inputs) -> DataFrame:
    """Through JSON files: written from the uploads, read back with the declared batch schema."""
    path = scratch_path(i.spark, "batch")
    shaped = i.uploads.select(
        "id",
        F.to_json(
            F.struct(
                F.col("external_id").alias("externalId"), "subject", "body", "product",
                F.col("customer_tier").alias("customerTier"), F.col("customer_ref").alias("customerId"),
                F.col("created_raw").alias("createdAt"),
            )
        ).alias("value"),
    )
    shaped.select("value").write.text(path)
    rows = files.batch_ingest(i.spark, path)
    # arrival order only decides which copy of a key is the first, not how many there are
    numbered = rows.withColumn("id", F.monotonically_increasing_id()).withColumn("arrival", F.col("id"))
    return op.ingest_rows(numbered).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("idempotent_insert", bind("judged") + " SELECT id, outcome, ticket_id FROM judged")
def _insert(i: Inputs) -> DataFrame:
    good = op.validate_rows(i.uploads).where(F.col("error").isNull())
    return op.idempotent_insert(good).select("id", "outcome", "ticket_id")


@query(
    "idempotency_key",
    bind("uploads")
    + " SELECT id, CASE WHEN external_id IS NOT NULL THEN external_id WHEN header_key IS NOT NULL THEN 'idem:' || header_key END AS key FROM uploads",
)
def _idem(i: Inputs) -> DataFrame:
    return i.uploads.select("id", op.idempotency_key(F.col("external_id"), F.col("header_key")).alias("key"))


@query(
    "customer_upsert",
    bind("checked")
    + " SELECT customer_ref AS external_id, arg_max(customer_tier, id) AS tier FROM checked WHERE error IS NULL AND length(trim(customer_ref)) > 0 GROUP BY 1",
)
def _upsert(i: Inputs) -> DataFrame:
    return op.customer_upsert(i.uploads)


@query("content_hash", bind("notes") + " SELECT id, sha256(subject || chr(10) || body) AS content_hash FROM notes")
def _hash(i: Inputs) -> DataFrame:
    return i.notes.select("id", op.content_hash(F.col("subject"), F.col("body")).alias("content_hash"))


@query(
    "triage_priority",
    bind("tickets")
    + " SELECT id, CASE customer_tier WHEN 'ENTERPRISE' THEN 20 WHEN 'PRO' THEN 10 ELSE 0 END AS priority FROM tickets",
)
def _triage_priority(i: Inputs) -> DataFrame:
    from deskstream.functions.scoring import triage_priority

    return i.tickets.select("id", triage_priority(F.col("customer_tier")).alias("priority"))


def _history(i: Inputs) -> DataFrame:
    vectors = i.vectors.select(F.col("ticket_id").alias("id"), "embedding")
    return i.tickets.withColumn("arrival", F.col("id")).join(vectors, "id")


@query(
    "history_import",
    bind("tickets")
    + """ SELECT id, external_id, 'SEED' AS source, product, created_at, created_at + INTERVAL 1 HOUR AS resolved_at,
  'RESOLVED' AS status, category, 'AGENT' AS category_source FROM tickets WHERE resolution IS NOT NULL""",
    ts="created_at resolved_at",
)
def _history_import(i: Inputs) -> DataFrame:
    tickets, _, _ = op.history_import(_history(i), dim=64)
    return tickets.select(
        "id", "external_id", "source", "product", "created_at", "resolved_at", "status", "category", "category_source"
    )


@query(
    "history_import_counts",
    bind("tickets")
    + " SELECT count(*) FILTER (WHERE resolution IS NOT NULL) AS imported, count(*) FILTER (WHERE resolution IS NULL) AS skipped FROM tickets",
)
def _history_counts(i: Inputs) -> DataFrame:
    return op.history_import(_history(i), dim=64)[2]


_FIXES = """fixes AS (SELECT ticket_id, arg_max(corrected_category, id) FILTER (WHERE corrected_category IS NOT NULL) AS fix_c,
  arg_max(corrected_priority, id) FILTER (WHERE corrected_priority IS NOT NULL) AS fix_p FROM feedback GROUP BY 1)"""


@query(
    "export_training_ndjson",
    bind("tickets", "feedback")
    + f""", {_FIXES} SELECT id, concat('{{"id":', id, ',"subject":"', subject, '","body":"', replace(body, '"', '\\"'), '","category":"', category,
 '","category_source":"', category_source, '"', CASE WHEN priority IS NULL THEN '' ELSE concat(',"priority":"', priority, '"') END,
 CASE WHEN fix_c IS NULL THEN '' ELSE concat(',"corrected_category":"', fix_c, '"') END,
 CASE WHEN fix_p IS NULL THEN '' ELSE concat(',"corrected_priority":"', fix_p, '"') END, '}}') AS line
FROM tickets LEFT JOIN fixes ON ticket_id = id
WHERE source <> 'SEED' AND category IS NOT NULL AND created_at >= TIMESTAMP '2024-01-10 00:00:00'""",
)
def _export(i: Inputs) -> DataFrame:
    return op.export_training(i.tickets, i.feedback, F.lit("2024-01-10 00:00:00").cast("timestamp"))


def _dataset(i: Inputs) -> DataFrame:
    extra = i.labelled.select(F.col("ticket_id").alias("id"), "split", "root_cause_id")
    return i.tickets.join(extra, "id").withColumn("ticket_uid", F.concat(F.lit("T"), F.col("id").cast("string")))


@query(
    "export_history_csv",
    bind("labelled") + " SELECT concat('T', ticket_id) AS ticket_uid, product, root_cause_id FROM labelled WHERE split IN ('train', 'val')",
)
def _export_history(i: Inputs) -> DataFrame:
    """Written as CSV and read back by uid."""
    path = scratch_path(i.spark, "history")
    op.write_csv(op.export_history(_dataset(i)), path)
    schema = ", ".join(f"{c} STRING" for c in op.HISTORY_COLUMNS)
    return i.spark.read.schema(schema).option("header", True).csv(path).select("ticket_uid", "product", "root_cause_id")


@query(
    "export_stream_csv",
    bind("labelled") + " SELECT concat('T', ticket_id) AS ticket_uid, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, product FROM labelled WHERE split = 'test'",
)
def _export_stream(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stream")
    op.write_csv(op.export_stream(_dataset(i)), path)
    schema = ", ".join(f"{c} STRING" for c in op.STREAM_COLUMNS)
    return i.spark.read.schema(schema).option("header", True).csv(path).select("ticket_uid", "created_at", "product")


@query("partitioned_write", bind("labelled") + " SELECT split, count(*) AS n FROM labelled GROUP BY 1")
def _partitioned(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "split")
    op.write_by_split(_dataset(i).select("id", "ticket_uid", "split"), path)
    back = i.spark.read.schema("id BIGINT, ticket_uid STRING, split STRING").parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "replay_shift",
    bind("tickets")
    + """ SELECT id, created_at + (TIMESTAMP '2025-06-01 12:00:00' - (SELECT max(created_at) FROM tickets)) AS created_at FROM tickets""",
    ts="created_at",
)
def _shift(i: Inputs) -> DataFrame:
    return op.replay_shift(i.tickets, F.lit("2025-06-01 12:00:00").cast("timestamp")).select("id", "created_at")


@query(
    "reset_live",
    bind("tickets", "predictions")
    + """ SELECT p.id, p.ticket_id FROM predictions p WHERE p.ticket_id IN (SELECT id FROM tickets WHERE source = 'SEED')""",
)
def _reset(i: Inputs) -> DataFrame:
    return op.reset_live(i.tickets, {"predictions": i.predictions})["predictions"].select("id", "ticket_id")


def _external(i: Inputs) -> DataFrame:
    intents = [name for name, _ in op.INTENT_CATEGORIES] + ["track_order", "delivery_period"]
    table = F.array(*[F.lit(x) for x in intents])
    return i.table("documents").select(
        F.col("doc_id").alias("row"),
        "text",
        F.col("lang").alias("category"),
        F.element_at(table, (F.col("doc_id") % len(intents) + 1).cast("int")).alias("intent"),
    )


@query(
    "bitext_prepare",
    """WITH t AS (SELECT doc_id AS row_, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) AS text, lang FROM documents),
u AS (SELECT text, arg_min(lang, row_) AS category FROM t GROUP BY 1),
r AS (SELECT text, category, row_number() OVER (PARTITION BY category ORDER BY md5(text), text) AS position,
        count(*) OVER (PARTITION BY category) AS n FROM u)
SELECT md5(text) AS text_hash, category, CASE WHEN position <= floor(n * 0.70::DOUBLE) THEN 'train'
  WHEN position <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def _external_prepare(i: Inputs) -> DataFrame:
    return op.external_prepare(_external(i)).select(F.md5("text").alias("text_hash"), "category", "split")


@query(
    "intent_label_map",
    "WITH e AS (SELECT doc_id AS row_, (["
    + ", ".join(f"'{c}'" for _, c in op.INTENT_CATEGORIES)
    + ", NULL, NULL])[CAST(doc_id % 16 AS INT) + 1] AS category FROM documents) SELECT row_ AS row_id, category FROM e WHERE category IS NOT NULL",
)
def _intents(i: Inputs) -> DataFrame:
    return op.intent_label_map(_external(i)).select(F.col("row").alias("row_id"), "category")


@query(
    "assign_batches",
    bind("labelled")
    + """, g AS (SELECT ticket_id AS id, coalesce(incident_id, 'split:' || split) AS batch_group FROM labelled),
r AS (SELECT id, batch_group, row_number() OVER (PARTITION BY batch_group ORDER BY md5(CAST(id AS VARCHAR)), id) AS position FROM g)
SELECT id, concat(batch_group, '#', (position - 1) // 10) AS batch_id FROM r""",
)
def _batches(i: Inputs) -> DataFrame:
    return op.assign_batches(i.labelled.withColumnRenamed("ticket_id", "id")).select("id", "batch_id")


@query(
    "ingest_csv",
    bind("checked")
    + """, j AS (SELECT coalesce(error, CASE WHEN created_raw = 'yesterday' THEN 'created_at is not a timestamp' END) AS error, product FROM checked)
SELECT error, CASE WHEN error IS NULL THEN product END AS product, count(*) AS n FROM j GROUP BY 1, 2""",
)
def _csv(i: Inputs) -> DataFrame:
    """Uploads written as CSV in two column orders, parsed and judged; good and rejected rows with their reason."""
    path = scratch_path(i.spark, "upload")
    columns = {
        "Subject": "subject", "BODY": "body", "product": "product", "customer_tier": "customer_tier",
        "ticket_uid": "external_id", "created_at": "created_raw", "customer_id": "customer_ref",
    }
    for part, names in enumerate((list(columns), list(reversed(columns)))):
        op.write_csv(i.uploads.where(F.col("id") % 2 == part).select(*[F.col(columns[n]).alias(n) for n in names]), f"{path}/{part}")
    good, rejects = files.ingest_csv(i.spark, f"{path}/*", i.as_of)
    kept = good.select(F.lit(None).cast("string").alias("error"), "product")
    return kept.unionByName(rejects.select("error", F.lit(None).cast("string").alias("product"))).groupBy("error", "product").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "reject_report",
    bind("checked") + ' SELECT id + 1 AS "row", error FROM checked WHERE error IS NOT NULL ORDER BY id LIMIT 100',
)
def _report(i: Inputs) -> DataFrame:
    return op.reject_report(op.validate_rows(i.uploads).withColumn("record", F.col("id")))


@query("stream_columns", bind("tickets") + " SELECT concat('T', id) AS ticket_uid, created_at, customer_id, customer_tier, product, subject, body FROM tickets", ts="created_at")
def _stream_columns(i: Inputs) -> DataFrame:
    return op.stream_columns(i.tickets.withColumn("ticket_uid", F.concat(F.lit("T"), F.col("id").cast("string"))))
