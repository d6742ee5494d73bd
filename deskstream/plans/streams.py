"""Streaming operators over the events table, drained and returned as tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.operators import ingest, joins
from deskstream.plans.bindings import bind
from deskstream.plans.registry import query
from deskstream.plans.similarity import BURST_MINUTES, MIN_CUSTOMERS, MIN_TICKETS, TAU, WINDOW_HOURS
from deskstream.session import scratch_path
from deskstream.sources.bind import Inputs
from deskstream.sources.files import stream_table
from deskstream.streaming import operators as op


class StreamInputs(Inputs):
    """The same roles with the events table as a stream."""

    def __init__(self, batch: Inputs):
        super().__init__(batch.spark, batch.directory)
        self._batch = batch

    def table(self, name: str) -> DataFrame:
        return stream_table(self.spark, self.directory, name) if name == "events" else super().table(name)

    @cached_property
    def as_of(self):
        return self._batch.as_of

    @cached_property
    def clusters(self) -> DataFrame:
        return self._batch.clusters


_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "stream_ingest",
    bind("judged")
    + """, timed AS (SELECT *, coalesce(try_cast(created_raw AS TIMESTAMP), TIMESTAMP '2024-01-31 00:00:00') AS stamp FROM checked WHERE error IS NULL)
SELECT external_id, arg_min(id, (stamp, arrival, id)) AS id, min(stamp) AS created_at FROM timed WHERE external_id IS NOT NULL GROUP BY 1
HAVING epoch_ms(min(stamp)) < (SELECT epoch_ms(max(stamp) - INTERVAL 10 MINUTE) FROM timed WHERE external_id IS NOT NULL)
UNION ALL SELECT NULL, id, stamp FROM timed WHERE external_id IS NULL""",
    ts="created_at",
)
def _ingest(i: Inputs) -> DataFrame:
    rows = StreamInputs(i).uploads
    timed = rows.withColumn("created_at", F.coalesce(ingest.parse_created_at(F.col("created_raw")), F.lit("2024-01-31").cast("timestamp")))
    return op.drain(op.stream_ingest(timed).select("external_id", "id", "created_at"), "ingest")


@query(
    "stream_volume",
    bind("tickets")
    + f" SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, product, count(*) AS tickets FROM tickets GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, any_value(created_at)) + INTERVAL 1 HOUR <= {_MARK}",
    ts="window_start",
)
def _volume(i: Inputs) -> DataFrame:
    return op.drain(op.stream_volume(StreamInputs(i).tickets, "1 hour"), "volume")


@query(
    "stream_burst",
    bind("tickets")
    + f""", each AS (SELECT product, coalesce(CAST(customer_id AS VARCHAR), concat('t', id)) AS who,
    unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, created_at) - INTERVAL 59 MINUTE, time_bucket(INTERVAL 1 MINUTE, created_at), INTERVAL 1 MINUTE)) AS window_start FROM tickets)
SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, product, count(*) AS tickets, count(DISTINCT who) AS customers FROM each
WHERE window_start + INTERVAL 60 MINUTE <= {_MARK} GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND count(DISTINCT who) >= 4""",
    ts="window_start window_end",
)
def _burst(i: Inputs) -> DataFrame:
    return op.drain(op.stream_burst(StreamInputs(i).tickets, "60 minutes", "1 minute", min_tickets=5, min_customers=4), "burst")


@query(
    "stream_sessions",
    bind("tickets")
    + f""", g AS (SELECT product, created_at, CASE WHEN created_at > lag(created_at) OVER w + INTERVAL 30 MINUTE OR lag(created_at) OVER w IS NULL THEN 1 ELSE 0 END AS s
  FROM tickets WINDOW w AS (PARTITION BY product ORDER BY created_at)),
n AS (SELECT *, sum(s) OVER (PARTITION BY product ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(created_at) AS session_start, max(created_at) + INTERVAL 30 MINUTE AS session_end, product, count(*) AS tickets FROM n GROUP BY product, k
HAVING max(created_at) + INTERVAL 30 MINUTE <= {_MARK}""",
    ts="session_start session_end",
)
def _sessions(i: Inputs) -> DataFrame:
    return op.drain(op.stream_sessions(StreamInputs(i).tickets, "30 minutes"), "sessions")


def _cluster_events(i: Inputs) -> DataFrame:
    s = StreamInputs(i)
    vectors = s.vectors.join(i.tickets.select(F.col("id").alias("ticket_id"), "customer_id"), "ticket_id")
    events = op.stream_dedup_clusters(
        vectors, TAU, WINDOW_HOURS, BURST_MINUTES, MIN_TICKETS, MIN_CUSTOMERS, idle_hours=48
    )
    return op.drain(events, "clusters")


@query("stream_dedup_clusters")
def _dedup(i: Inputs) -> DataFrame:
    return _cluster_events(i).groupBy("event", "product").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("stream_close_clusters")
def _close(i: Inputs) -> DataFrame:
    return op.stream_close_clusters(_cluster_events(i)).select("product", "cluster_id", "at", "size")


@query(
    "stream_sla_breach",
    bind("tickets")
    + """, m AS (SELECT max(greatest(created_at, coalesce(first_response_at, created_at))) - INTERVAL 10 MINUTE AS mark FROM tickets)
SELECT id AS ticket_id, sla_due_at AS breached_at FROM tickets, m WHERE sla_due_at IS NOT NULL AND (first_response_at IS NULL OR first_response_at > sla_due_at) AND epoch_ms(sla_due_at) < epoch_ms(mark)""",
    ts="breached_at",
)
def _breach(i: Inputs) -> DataFrame:
    tickets = StreamInputs(i).tickets
    responses = tickets.where(F.col("first_response_at").isNotNull()).select(
        F.col("id").alias("ticket_id"), F.col("first_response_at").alias("responded_at")
    )
    return op.drain(op.stream_sla_breach(tickets, responses), "breach")


_HOUR = "TIMESTAMP '2024-01-30 00:00:00'"


@query(
    "stream_drift",
    bind("predictions")
    + f""", d AS (SELECT label, score, CASE WHEN created_at >= {_HOUR} - INTERVAL 7 DAY AND created_at < {_HOUR} THEN 'recent'
  WHEN created_at >= {_HOUR} - INTERVAL 37 DAY AND created_at < {_HOUR} - INTERVAL 7 DAY THEN 'baseline' END AS period FROM predictions WHERE task = 'CATEGORY' AND model_name <> 'zeroshot_llm'),
l AS (SELECT label, count(*) FILTER (WHERE period = 'recent') AS r, count(*) FILTER (WHERE period = 'baseline') AS b FROM d GROUP BY 1),
w AS (SELECT period, count(*) AS n, avg(CAST(score < CAST(0.8 AS FLOAT) AS INT)) AS low FROM d WHERE period IS NOT NULL GROUP BY 1)
SELECT (SELECT CAST(sum(r) AS BIGINT) FROM l) AS recent_n, (SELECT low FROM w WHERE period = 'recent') AS recent_low_share, (SELECT CAST(sum(b) AS BIGINT) FROM l) AS baseline_n,
  (SELECT low FROM w WHERE period = 'baseline') AS baseline_low_share, (SELECT sum(abs(r / (SELECT sum(r) FROM l) - b / (SELECT sum(b) FROM l))) / 2 FROM l) AS category_shift""",
    num="recent_low_share baseline_low_share category_shift",
)
def _drift(i: Inputs) -> DataFrame:
    wanted = StreamInputs(i).predictions.where((F.col("task") == "CATEGORY") & (F.col("model_name") != "zeroshot_llm"))
    return op.drift_from_hours(op.stream_drift(wanted), F.lit("2024-01-30 00:00:00").cast("timestamp"))


@query(
    "stream_enrich",
    bind("tickets", "clusters", "policies")
    + """ SELECT t.id, t.created_at + to_minutes(coalesce(p.minutes, 480)) AS sla_due_at, c.size AS cluster_size, coalesce(c.is_incident, false) AS is_incident
FROM tickets t LEFT JOIN policies p ON p.customer_tier = t.customer_tier AND p.priority = t.priority LEFT JOIN clusters c ON c.id = t.cluster_id""",
    ts="sla_due_at",
)
def _enrich(i: Inputs) -> DataFrame:
    s = StreamInputs(i)
    enriched = op.stream_enrich(s.tickets, joins.sla_policies(i.spark), s.clusters)
    return op.drain(enriched.select("id", "sla_due_at", "cluster_size", "is_incident"), "enrich")


@query(
    "stream_ticket_x_feedback",
    bind("tickets", "feedback")
    + """, m AS (SELECT least((SELECT max(created_at) FROM tickets), (SELECT max(created_at) FROM feedback)) - INTERVAL 10 MINUTE AS mark),
j AS (SELECT t.id AS ticket_id, t.status, t.created_at, f.action FROM tickets t LEFT JOIN feedback f ON f.ticket_id = t.id AND f.created_at >= t.created_at AND f.created_at <= t.created_at + INTERVAL 1 DAY)
SELECT ticket_id, action, CASE WHEN action IN ('APPROVE', 'EDIT_APPROVE') THEN 'RESOLVED' WHEN action = 'REJECT' THEN 'IN_REVIEW' ELSE status END AS status
FROM j, m WHERE action IS NOT NULL OR created_at + INTERVAL 1 DAY < mark""",
)
def _feedback(i: Inputs) -> DataFrame:
    s = StreamInputs(i)
    joined = op.stream_ticket_x_feedback(s.tickets, s.feedback)
    return op.drain(joined.select("ticket_id", "action", "status"), "review")


@query("stream_event_sink", bind("tickets") + " SELECT product, count(*) AS n FROM tickets GROUP BY 1")
def _sink(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "events")
    op.stream_event_sink(StreamInputs(i).tickets.select("id", "product", "created_at"), path)
    back = i.spark.read.schema("id BIGINT, product STRING, created_at TIMESTAMP, batch INT").parquet(path)
    return back.groupBy("product").agg(F.count(F.lit(1)).alias("n"))


@query("stream_score")
def _score(i: Inputs) -> DataFrame:
    """A model fitted on the vector table scores the tickets as they arrive."""
    train = i.table("embeddings").select(
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), (F.col("label") >= 5).cast("double").alias("y")
    )
    model = LogisticRegression(labelCol="y", maxIter=10).fit(train)
    arriving = StreamInputs(i).vectors.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    scored = op.stream_score(arriving, model).select("ticket_id", "product", "risk", "queue")
    return op.drain(scored, "score")


@query(
    "stream_triage_latency",
    bind("tickets")
    + """ SELECT quantile_cont((epoch_us(triaged_at) - epoch_us(ingested_at)) / 1e6, 0.5) AS triage_p50, quantile_cont((epoch_us(triaged_at) - epoch_us(ingested_at)) / 1e6, 0.95) AS triage_p95
FROM tickets WHERE triaged_at IS NOT NULL""",
    num="triage_p50 triage_p95",
)
def _latency(i: Inputs) -> DataFrame:
    return op.stream_triage_latency(StreamInputs(i).tickets).select("triage_p50", "triage_p95")


@query(
    "stream_pipeline_latency",
    bind("tickets")
    + """ SELECT quantile_cont(epoch_us(triaged_at) - epoch_us(ingested_at), 0.5) / 1e6 AS triage_p50, quantile_cont(epoch_us(triaged_at) - epoch_us(ingested_at), 0.95) / 1e6 AS triage_p95,
  quantile_cont(epoch_us(drafted_at) - epoch_us(ingested_at), 0.5) / 1e6 AS draft_p50, quantile_cont(epoch_us(drafted_at) - epoch_us(ingested_at), 0.95) / 1e6 AS draft_p95 FROM tickets""",
    num="triage_p50 triage_p95 draft_p50 draft_p95",
)
def _pipeline_latency(i: Inputs) -> DataFrame:
    return op.stream_pipeline_latency(StreamInputs(i).tickets)


@query("replay_stream", bind("tickets") + " SELECT id, product, created_at FROM tickets", ts="created_at")
def _replay(i: Inputs) -> DataFrame:
    """History replayed in four or so micro-batches; every row arrives once."""
    rows = i.tickets.select("id", "product", "created_at")
    quarter = max(1, rows.count() // 4)
    return op.drain(op.replay_stream(rows, quarter), "replayed")
