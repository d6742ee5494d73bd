"""The driver tables in the roles of the ticket domain.

``Inputs`` derives every ticket-shaped frame from the given tables: an event is a ticket,
an embedding its vector, a document its text, a conversation its drafts and edits. All
rows take part; arithmetic on ids only chooses labels and states, it never filters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskstream.schemas import CATEGORIES, PRIORITIES, TICKET_STATUSES
from deskstream.session import pin_session
from deskstream.sources.files import read_table, spread


def _pick(index: str, values: list[str]) -> str:
    """SQL for the value at a 0-based index expression."""
    return f"elt(cast({index} as int) + 1, {', '.join(repr(v) for v in values)})"


# Phrases appended to document texts, so that every text signal occurs.
PHRASES = [
    "Everyone is locked out since your update, error 403, please fix by 5pm today!",
    "We cannot export my data, is this a GDPR breach? My lawyer will ask.",
    "The invoice charge looks wrong, refund it or we cancel our subscription.",
    "Sync is slow!! The API times out with GW-504.1, mail ops.team@example.com or +49 151 2345 6789.",
    "Would be great to have a feature for workspace roles.",
    "Card 4111 1111 1111 1111 was charged, key sk_live1234567890abcdef, iban DE44500105175407324931.",
    "Production went down right before the board meeting tomorrow.",
    "thanks, no rush.",
]


# Valences of words, the same that the ``sentiment_lexicon`` query and its oracle use.
LEXICON = [("wrong", -2.0), ("slow", -1.5), ("breach", -2.5), ("great", 3.0), ("thanks", 2.0), ("please", 1.0)]


class Inputs:
    """Lazily bound frames over one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        pin_session(spark)
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)

    # ---------------------------------------------------------------- scalars
    @cached_property
    def as_of(self) -> Column:
        """The reference time of every time-dependent query: the newest event."""
        newest = self.table("events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("m")).first()["m"]
        return F.timestamp_micros(F.lit(newest))

    @cached_property
    def vector_count(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def benchmark_count(self) -> int:
        return self.table("benchmark").count()

    # ---------------------------------------------------------------- tickets
    @cached_property
    def tickets(self) -> DataFrame:
        """Events as tickets: event_type is the product, user_id the customer."""
        e = self.table("events").select("*", F.col("ts").cast("timestamp").alias("at"))
        return e.selectExpr(
            "event_id AS id",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('replay-', event_id % 5, '-T', event_id) END AS external_id",
            "CASE WHEN event_id % 10 = 0 THEN 'SEED' WHEN event_id % 3 = 0 THEN 'CSV' ELSE 'API' END AS source",
            "event_id % 20 AS ingest_batch_id",
            "CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS customer_id",
            f"{_pick('user_id % 3', ['FREE', 'PRO', 'ENTERPRISE'])} AS customer_tier",
            "CASE event_type WHEN 'click' THEN 'web-app' WHEN 'view' THEN 'mobile-app' WHEN 'error' THEN 'api' "
            "WHEN 'purchase' THEN 'desktop-sync' ELSE 'admin-console' END AS product",
            "concat(event_type, ' issue from account ', user_id) AS subject",
            "concat('Reported ', props) AS body",
            "at AS created_at",
            "at AS ingested_at",
            "CASE WHEN event_id % 17 = 0 THEN NULL ELSE at + make_dt_interval(0, 0, 0, 10 + event_id * 7 % 240) END AS triaged_at",
            "CASE WHEN event_id % 5 = 0 THEN NULL ELSE at + make_dt_interval(0, 0, 0, 300 + event_id * 11 % 900) END AS drafted_at",
            f"{_pick('event_id % 6', TICKET_STATUSES[:6])} AS status",
            f"{_pick('event_id % 4', ['NONE', 'PENDING', 'READY', 'WAITING_LLM'])} AS draft_state",
            f"CASE WHEN event_id % 19 = 0 THEN NULL ELSE {_pick('(event_id * 7 + user_id) % 8', CATEGORIES)} END AS category",
            "cast(0.5 + event_id % 50 / 100.0 AS float) AS category_conf",
            f"{_pick('event_id % 3', ['MODEL', 'LLM', 'AGENT'])} AS category_source",
            f"CASE WHEN event_id % 23 = 0 THEN NULL ELSE {_pick('(event_id + user_id) % 4', PRIORITIES)} END AS priority",
            "cast(0.6 + event_id % 40 / 100.0 AS float) AS priority_conf",
            "'MODEL' AS priority_source",
            "CASE WHEN event_id % 29 = 0 THEN NULL ELSE cast(least(value / 500, 1) AS float) END AS escalation_risk",
            "CASE WHEN event_id % 29 <> 0 AND value >= 200 THEN 'SENIOR' ELSE 'STANDARD' END AS queue",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS cluster_id",
            "CASE WHEN event_id % 31 = 0 THEN NULL ELSE at + make_dt_interval(0, 1 + event_id % 48) END AS sla_due_at",
            "event_id % 9 = 0 AS sla_breached",
            "CASE WHEN event_id % 4 = 0 THEN NULL ELSE at + make_dt_interval(0, 0, event_id % 700) END AS first_response_at",
            "CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_id % 6 END AS assigned_agent_id",
            "CASE WHEN event_id % 6 >= 4 THEN concat('Reset ', event_type, ' for account ', user_id) END AS resolution",
            "CASE WHEN event_id % 6 >= 4 THEN at + make_dt_interval(0, event_id % 48) END AS resolved_at",
            "cast(event_id % 3 AS int) AS version",
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """One cluster per account that has clustered tickets."""
        folded = self.tickets.where(F.col("cluster_id").isNotNull()).groupBy(F.col("cluster_id").alias("id")).agg(
            F.min("product").alias("product"),
            F.count(F.lit(1)).alias("size"),
            F.min("created_at").alias("first_seen_at"),
            F.max("created_at").alias("last_seen_at"),
        )
        return folded.selectExpr(
            "id",
            "product",
            "concat('Reports of account ', id) AS title",
            "size",
            "id % 4 = 0 AS is_incident",
            "CASE WHEN id % 4 = 0 THEN first_seen_at + make_dt_interval(0, 1) END AS incident_flagged_at",
            f"{_pick('id % 5', ['ACTIVE', 'ACTIVE', 'ACTIVE', 'CLOSED', 'MERGED'])} AS status",
            "first_seen_at",
            "last_seen_at",
        )

    @cached_property
    def cluster_mapping(self) -> DataFrame:
        """(cluster_id, merged_into): every MERGED cluster points to a smaller one."""
        return self.clusters.where("status = 'MERGED'").selectExpr("id AS cluster_id", "id - id % 5 AS merged_into")

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS id", "c_name AS external_id", "c_mktsegment AS segment", f"{_pick('c_custkey % 3', ['FREE', 'PRO', 'ENTERPRISE'])} AS tier"
        )

    @cached_property
    def agents(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey AS id", "s_name AS display_name")

    @cached_property
    def uploads(self) -> DataFrame:
        """Events as raw upload rows: repeated keys, blank and invalid fields."""
        e = self.table("events").select("*", F.col("ts").cast("timestamp").alias("at"))
        return e.selectExpr(
            "event_id AS id",
            "event_id AS arrival",
            "event_id % 20 AS ingest_batch_id",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat(user_id, '-', event_type) END AS external_id",
            "CASE WHEN event_id % 37 = 0 THEN '  ' WHEN event_id % 41 = 0 THEN repeat('x', 301) ELSE concat(' ', event_type, ' ') END AS subject",
            "CASE WHEN event_id % 43 = 0 THEN NULL ELSE props END AS body",
            "CASE event_type WHEN 'click' THEN 'web-app' WHEN 'view' THEN 'mobile-app' WHEN 'error' THEN 'api' "
            "WHEN 'purchase' THEN 'desktop-sync' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'nope' ELSE 'admin-console' END END AS product",
            "CASE WHEN event_id % 47 = 0 THEN 'GOLD' ELSE elt(cast((user_id + event_id) % 3 AS int) + 1, 'FREE', 'PRO', 'ENTERPRISE') END AS customer_tier",
            "CASE WHEN event_id % 53 = 0 THEN repeat('c', 101) ELSE concat('C-', user_id) END AS customer_ref",
            "CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 61 = 0 THEN 'yesterday' "
            "ELSE date_format(at, 'yyyy-MM-dd HH:mm:ss') END AS created_raw",
            "CASE WHEN event_id % 3 = 0 THEN concat('h', event_id) END AS header_key",
        )

    # ---------------------------------------------------------------- vectors
    @cached_property
    def vectors(self) -> DataFrame:
        """(ticket_id, product, created_at, embedding, label): events share the given vectors."""
        n = self.vector_count
        side = self.table("embeddings")
        keyed = self.tickets.select(
            F.col("id").alias("ticket_id"), "product", "created_at", (F.col("id") % n).alias("vec_id")
        )
        return keyed.join(side, "vec_id").select("ticket_id", "product", "created_at", "embedding", "label")

    @cached_property
    def labelled(self) -> DataFrame:
        """Vectors with a split, a root cause (label and product) and incident ids for one cause in five."""
        cause = F.concat_ws("-", F.lit("RC"), F.col("label").cast("string"), F.col("product"))
        hours = F.floor(F.unix_micros("created_at") / F.lit(6 * 3_600_000_000))
        return self.vectors.withColumns(
            {
                "root_cause_id": cause,
                "incident_id": F.when(
                    F.col("label") % 5 == 0, F.concat_ws("-", F.lit("INC"), F.col("label").cast("string"), F.col("product"), hours.cast("string"))
                ),
                "split": F.when(F.dayofmonth("created_at") <= 20, F.lit("train"))
                .when(F.dayofmonth("created_at") <= 24, F.lit("val"))
                .otherwise(F.lit("test")),
            }
        )

    # ----------------------------------------------------------------- texts
    @cached_property
    def notes(self) -> DataFrame:
        """Documents as tickets with text; the resolution comes from the benchmark passages."""
        m = self.benchmark_count
        docs = spread(self.table("documents"), "doc_id").withColumn("item_id", F.col("doc_id") % m)
        answers = self.table("benchmark").select("item_id", F.col("text").alias("resolution"))
        joined = docs.join(answers, "item_id").join(self.table("labels"), "doc_id", "left")
        return joined.selectExpr(
            "doc_id AS id",
            "concat(source, ' ', lang) AS subject",
            f"concat(text, ' ', {_pick('doc_id % 8', PHRASES)}) AS body",
            "resolution",
            "lang",
            "source",
            "n_chars",
            f"{_pick('doc_id % 8', CATEGORIES)} AS category",
            f"{_pick('doc_id % 4', PRIORITIES)} AS priority",
            f"{_pick('doc_id % 3', ['FREE', 'PRO', 'ENTERPRISE'])} AS customer_tier",
            "elt(cast(doc_id % 5 as int) + 1, 'web-app', 'mobile-app', 'api', 'desktop-sync', 'admin-console') AS product",
            "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 40000 as int)) AS created_at",
            "quality",
            "toxic",
        )

    @cached_property
    def lexicon(self) -> DataFrame:
        """(term, valence): the few words that carry a mood."""
        return self.spark.createDataFrame(LEXICON, "term STRING, valence DOUBLE")

    @cached_property
    def scored(self) -> DataFrame:
        """Judged documents with a score: y = quality, p from the length of the text."""
        joined = self.table("labels").join(self.table("documents").select("doc_id", "n_chars"), "doc_id")
        return joined.selectExpr("doc_id AS id", "quality AS y", "toxic", "round(n_chars / (n_chars + 800.0D), 3) AS p")

    @cached_property
    def replies(self) -> DataFrame:
        """Consecutive assistant turns as (draft, final) texts; other than ASCII characters become ``?``."""
        ascii_text = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
        turns = self.table("conversations").where(F.col("role") == "assistant").withColumn("text", ascii_text)
        later = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("final_body"))
        return turns.join(later, ["conv_id", "turn"]).selectExpr(
            "conv_id * 1000 + turn AS id", "conv_id", "turn", "text AS body", "final_body"
        )

    # ---------------------------------------------------------------- history
    @cached_property
    def predictions(self) -> DataFrame:
        """Four predictions per ticket id block: two category models, priority, escalation."""
        e = self.table("events").select("*", F.col("ts").cast("timestamp").alias("at"))
        return e.selectExpr(
            "event_id AS id",
            "event_id - event_id % 4 AS ticket_id",
            f"{_pick('event_id % 4', ['CATEGORY', 'CATEGORY', 'PRIORITY', 'ESCALATION'])} AS task",
            "CASE WHEN event_id % 8 = 1 THEN 'zeroshot_llm' ELSE concat('emb_', event_id % 2) END AS model_name",
            "cast(1 + event_id % 2 AS string) AS model_version",
            f"CASE event_id % 4 WHEN 2 THEN {_pick('user_id % 4', PRIORITIES)} WHEN 3 THEN NULL "
            f"ELSE {_pick('(user_id + event_id) % 8', CATEGORIES)} END AS label",
            "cast(least(0.5 + value / 100, 0.99) AS float) AS score",
            "props AS details",
            "at AS created_at",
        )

    @cached_property
    def drafts(self) -> DataFrame:
        """Two drafts per pair of tickets."""
        e = self.table("events").select("*", F.col("ts").cast("timestamp").alias("at"))
        return e.selectExpr(
            "event_id * 10 AS id",
            "event_id - event_id % 2 AS ticket_id",
            f"{_pick('event_id % 6', ['GENERATED', 'APPROVED', 'EDITED', 'REJECTED', 'SUPERSEDED', 'SKIPPED'])} AS status",
            "concat('Draft about ', event_type, ' for ', user_id) AS body",
            "CASE WHEN event_id % 6 = 5 THEN NULL ELSE concat('[{\"ticketId\":', event_id % 97, ',\"why\":\"same ', event_type, '\"}]') END AS citations",
            f"{_pick('event_id % 3', ['STRONG', 'WEAK', 'NONE'])} AS grounding",
            "CASE WHEN event_id % 6 = 5 THEN NULL ELSE '[\"When did this start?\"]' END AS needs_info",
            "CASE WHEN event_id % 6 = 5 THEN NULL ELSE concat('[{\"id\":', event_id % 97, ',\"subject\":\"a\",\"score\":0.5},{\"id\":', "
            "event_id % 89, ',\"subject\":\"b\",\"score\":0.25}]') END AS sources",
            "CASE WHEN event_id % 8 = 0 THEN event_id * 10 - 10 END AS reused_from_draft_id",
            "CASE WHEN event_id % 8 = 0 THEN 'incident-reuse' WHEN event_id % 6 = 5 THEN NULL ELSE concat('m', event_id % 2) END AS model",
            "CASE WHEN event_id % 6 = 5 THEN NULL ELSE cast(100 + event_id % 400 AS int) END AS input_tokens",
            "CASE WHEN event_id % 6 = 5 THEN NULL ELSE cast(20 + event_id % 90 AS int) END AS output_tokens",
            "CASE WHEN event_id % 6 = 5 THEN NULL ELSE cast(200 + event_id % 3000 AS int) END AS latency_ms",
            "CASE WHEN event_id % 8 = 0 THEN cast(0 AS decimal(10,6)) ELSE cast(round(value / 10000, 6) AS decimal(10,6)) END AS cost_usd",
            "at + make_dt_interval(0, 0, 5) AS created_at",
        )

    @cached_property
    def feedback(self) -> DataFrame:
        e = self.table("events").select("*", F.col("ts").cast("timestamp").alias("at"))
        return e.selectExpr(
            "event_id AS id",
            "event_id - event_id % 2 AS ticket_id",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 10 END AS draft_id",
            "event_id % 6 AS agent_id",
            f"{_pick('event_id % 4', ['APPROVE', 'EDIT_APPROVE', 'REJECT', 'RELABEL'])} AS action",
            "CASE WHEN event_id % 4 = 1 THEN cast(least(value / 400, 1) AS float) WHEN event_id % 4 = 0 THEN cast(0 AS float) END AS edit_ratio",
            f"CASE WHEN event_id % 4 = 2 THEN {_pick('user_id % 5', ['WRONG_INFO', 'NOT_GROUNDED', 'TONE', 'INCOMPLETE', 'OTHER'])} END AS reject_reason",
            f"CASE WHEN event_id % 5 = 0 THEN {_pick('user_id % 8', CATEGORIES)} END AS corrected_category",
            f"CASE WHEN event_id % 6 = 0 THEN {_pick('user_id % 4', PRIORITIES)} END AS corrected_priority",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(1 + event_id % 5 AS int) END AS rating",
            "cast(1000 + event_id % 9000 AS bigint) AS time_to_review_ms",
            "at + make_dt_interval(0, 1) AS created_at",
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """Orders as work items."""
        return self.table("orders").selectExpr(
            "o_orderkey AS id",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'TRIAGE' WHEN '2-HIGH' THEN 'DRAFT' ELSE 'LLM_CLASSIFY' END AS type",
            "o_custkey AS ticket_id",
            "CASE WHEN o_orderkey % 11 = 0 THEN 'DEAD' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'RUNNING' END AS status",
            "cast(floor(o_totalprice) % 130 AS int) AS priority",
            "cast(o_orderdate AS timestamp) AS run_after",
            "cast(o_orderdate AS timestamp) AS created_at",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """Reviews of the conversation drafts, some of them invalid, some drafts reviewed twice."""
        r = self.replies
        once = r.selectExpr(
            "id AS draft_id",
            "conv_id % 6 AS agent_id",
            f"{_pick('(conv_id + turn div 2) % 4', ['APPROVE', 'EDIT_APPROVE', 'REJECT', 'EDIT_APPROVE'])} AS action",
            "CASE WHEN conv_id % 9 = 0 THEN ' short ' ELSE concat(' ', final_body, ' ') END AS final_body",
            "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'TONE' END AS reject_reason",
            f"CASE WHEN conv_id % 3 = 0 THEN {_pick('conv_id % 8', CATEGORIES)} END AS corrected_category",
            f"CASE WHEN conv_id % 4 = 0 THEN {_pick('conv_id % 4', PRIORITIES)} END AS corrected_priority",
            "cast(1 + conv_id % 6 AS int) AS rating",
            "cast(1000 * turn AS bigint) AS time_to_review_ms",
            "timestamp'2024-01-02 00:00:00' + make_dt_interval(0, 0, cast(conv_id % 40000 as int), cast(turn as int)) AS reviewed_at",
        )
        again = once.withColumns(
            {"action": F.lit("APPROVE"), "reviewed_at": F.col("reviewed_at") + F.expr("INTERVAL 1 HOUR")}
        )
        return once.unionByName(again)

    @cached_property
    def review_drafts(self) -> DataFrame:
        """Drafts the reviews are about: one per pair of assistant turns, its conversation is the ticket."""
        return self.replies.selectExpr(
            "id", "conv_id AS ticket_id", "body", "CASE WHEN (conv_id + turn) % 7 = 3 THEN 'SUPERSEDED' ELSE 'GENERATED' END AS status"
        )

    @cached_property
    def review_tickets(self) -> DataFrame:
        """One ticket per conversation."""
        start = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 40000 as int))"
        return self.table("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("turns")).selectExpr(
            "id",
            f"{_pick('id % 6', TICKET_STATUSES[:6])} AS status",
            "'PENDING' AS draft_state",
            "cast(NULL AS string) AS resolution",
            "cast(NULL AS timestamp) AS resolved_at",
            f"CASE WHEN id % 2 = 0 THEN {start} END AS first_response_at",
            "CASE WHEN id % 3 = 0 THEN id % 7 END AS assigned_agent_id",
            "cast(1 AS int) AS version",
        )

    @cached_property
    def multiclass(self) -> DataFrame:
        """Categorised tickets with a prediction that errs on every fifth one, and a second model's answer."""
        return self.tickets.where(F.col("category").isNotNull()).selectExpr(
            "id",
            "product",
            "category AS y",
            f"CASE WHEN id % 5 = 0 THEN {_pick('(id + 3) % 8', CATEGORIES)} ELSE category END AS pred",
            "cast(category_conf AS double) AS conf",
            f"{_pick('id % 8', CATEGORIES)} AS llm_pred",
        )
