"""Duplicate pairs, clusters and incidents over the driver tables.

The driver vectors are weakly similar, so the thresholds are bound per scale to the values
the fixtures measured; the reference defaults stay the defaults of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.operators import blockjoin, evaluate, graph
from deskstream.plans.bindings import bind
from deskstream.plans.registry import query
from deskstream.session import cut_lineage
from deskstream.sources.bind import Inputs

TAU, WINDOW_HOURS = 0.35, 24.0
BURST_MINUTES, MIN_TICKETS, MIN_CUSTOMERS = 24 * 60, 3, 2
SETTINGS_TAU, SETTINGS_HOURS = (0.35, 0.40), (24.0,)  # tried by the incident sweep

# products once per pair of distinct vectors: tickets share the given vectors by id
PAIRS = f""", sims AS MATERIALIZED (SELECT a.vec_id AS va, b.vec_id AS vb, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
  FROM embeddings a JOIN embeddings b ON round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) >= {TAU}),
placed AS MATERIALIZED (SELECT ticket_id, product, created_at, ticket_id % (SELECT count(*) FROM embeddings) AS vec_id FROM vectors),
near AS MATERIALIZED (SELECT a.ticket_id, a.product, a.created_at, s.vb, s.similarity FROM placed a JOIN sims s ON s.va = a.vec_id),
pairs AS MATERIALIZED (SELECT a.ticket_id, b.ticket_id AS similar_id, a.similarity
  FROM near a JOIN placed b ON b.vec_id = a.vb AND b.product = a.product
  WHERE b.created_at >= a.created_at - INTERVAL 24 HOUR AND b.created_at <= a.created_at
    AND (b.created_at < a.created_at OR b.ticket_id < a.ticket_id) AND a.ticket_id <> b.ticket_id)"""
LINKS = """, links AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY similarity DESC, similar_id) <= 20)"""
COMPONENTS = """, e AS (SELECT ticket_id AS u, similar_id AS v FROM links UNION SELECT similar_id, ticket_id FROM links),
walk AS (SELECT DISTINCT u AS id, u AS root FROM e UNION SELECT e.v, walk.root FROM walk JOIN e ON e.u = walk.id WHERE walk.root < e.v),
comp AS (SELECT id, min(root) AS component FROM walk GROUP BY 1)"""


def links_of(i: Inputs, tau: float = TAU, window_hours: float = WINDOW_HOURS) -> DataFrame:
    return blockjoin.duplicate_links(i.vectors, tau, window_hours)


@query("duplicate_pairs", bind("vectors") + PAIRS + " SELECT * FROM pairs", num="similarity", digits=9)
def _pairs(i: Inputs) -> DataFrame:
    return blockjoin.duplicate_pairs(i.vectors, TAU, WINDOW_HOURS)


@query("duplicate_links", bind("vectors") + PAIRS + LINKS + " SELECT * FROM links", num="similarity", digits=9)
def _links(i: Inputs) -> DataFrame:
    return links_of(i)


@query(
    "duplicates_of",
    bind("vectors")
    + PAIRS
    + LINKS
    + """ SELECT l.ticket_id, l.similar_id, t.subject, t.status, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY similarity DESC, similar_id) AS INT) AS rank
FROM links l JOIN tickets t ON t.id = l.similar_id""",
)
def _duplicates_of(i: Inputs) -> DataFrame:
    from deskstream.operators.joins import duplicates_of

    return duplicates_of(links_of(i), i.tickets).select("ticket_id", "similar_id", "subject", "status", "rank")


@query(
    "similar_recent",
    bind("vectors")
    + PAIRS
    + " SELECT v.ticket_id, coalesce(n, 0) AS similar_recent FROM vectors v LEFT JOIN (SELECT ticket_id, count(*) AS n FROM pairs GROUP BY 1) p ON p.ticket_id = v.ticket_id",
)
def _similar(i: Inputs) -> DataFrame:
    return blockjoin.similar_recent(i.vectors, TAU, WINDOW_HOURS)


@query(
    "connected_components",
    bind("vectors", recursive=True) + PAIRS + LINKS + COMPONENTS + " SELECT id, component FROM comp",
)
def _components(i: Inputs) -> DataFrame:
    return graph.connected_components(links_of(i))


_MEMBERS = """, m AS (SELECT t.id, t.product, t.subject, t.created_at, t.customer_id, c.component AS cluster_id FROM tickets t JOIN comp c ON c.id = t.id)"""


def members_of(i: Inputs, tau: float = TAU, window_hours: float = WINDOW_HOURS) -> tuple[DataFrame, DataFrame]:
    """(clusters, members); members is cut because both it and its aggregates are used."""
    tickets = i.tickets.select("id", "product", "subject", "created_at", "customer_id")
    components = graph.connected_components(links_of(i, tau, window_hours))
    members = cut_lineage(tickets.join(components.withColumnRenamed("component", "cluster_id"), "id"))
    return graph.cluster_stats(members), members


@query(
    "duplicate_clusters",
    bind("vectors", recursive=True)
    + PAIRS
    + LINKS
    + COMPONENTS
    + _MEMBERS
    + """ SELECT cluster_id, min(product) AS product, count(*) AS size, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at,
  arg_min(id, (created_at, id)) AS canonical_ticket_id, arg_min(subject, (created_at, id)) AS title FROM m GROUP BY 1""",
    ts="first_seen_at last_seen_at",
)
def _clusters(i: Inputs) -> DataFrame:
    return members_of(i)[0]


_BURST = f""", b AS (SELECT id, cluster_id, created_at, count(*) OVER w AS n, count(DISTINCT coalesce('c' || customer_id, 't' || id)) OVER w AS who FROM m
  WINDOW w AS (PARTITION BY cluster_id ORDER BY created_at RANGE BETWEEN INTERVAL {BURST_MINUTES} MINUTE PRECEDING AND CURRENT ROW)),
inc AS (SELECT cluster_id, min(created_at) FILTER (WHERE n >= {MIN_TICKETS} AND who >= {MIN_CUSTOMERS}) AS incident_flagged_at, max(n) AS peak_tickets, max(who) AS peak_customers FROM b GROUP BY 1)"""


def incidents_of(i: Inputs, tau: float = TAU, window_hours: float = WINDOW_HOURS) -> DataFrame:
    clusters, members = members_of(i, tau, window_hours)
    return graph.incidents(members, clusters, BURST_MINUTES, MIN_TICKETS, MIN_CUSTOMERS)


@query(
    "incident_clusters",
    bind("vectors", recursive=True)
    + PAIRS
    + LINKS
    + COMPONENTS
    + _MEMBERS
    + _BURST
    + """ SELECT cluster_id, count(*) AS size, any_value(incident_flagged_at) AS incident_flagged_at, any_value(peak_tickets) AS peak_tickets,
  any_value(peak_customers) AS peak_customers, any_value(incident_flagged_at) IS NOT NULL AS is_incident FROM m JOIN inc USING (cluster_id) GROUP BY 1""",
    ts="incident_flagged_at",
)
def _incidents(i: Inputs) -> DataFrame:
    return incidents_of(i).select("cluster_id", "size", "incident_flagged_at", "peak_tickets", "peak_customers", "is_incident")


def replay_of(i: Inputs) -> DataFrame:
    links = cut_lineage(links_of(i))
    components = graph.connected_components(links)
    tickets = i.tickets.select("id", "created_at", "customer_id")
    return graph.incident_replay(tickets, links, components, WINDOW_HOURS, BURST_MINUTES, MIN_TICKETS, MIN_CUSTOMERS)


@query("incident_replay")
def _replay(i: Inputs) -> DataFrame:
    return replay_of(i)


@query("alarm_suppression")
def _suppression(i: Inputs) -> DataFrame:
    """Alarms with and without suppression: every arrival at a burst, and whether cover 0.5 lets its alarm through."""
    links = cut_lineage(links_of(i))
    components = graph.connected_components(links)
    tickets = i.tickets.select("id", "created_at", "customer_id")
    return graph.alarm_suppression(tickets, links, components, WINDOW_HOURS, BURST_MINUTES, MIN_TICKETS, MIN_CUSTOMERS)


@query("alarm_overlap")
def _overlap(i: Inputs) -> DataFrame:
    truth = i.labelled.select(F.col("ticket_id").alias("id"), "incident_id")
    return graph.alarm_overlap(replay_of(i), truth, min_overlap=2)


@query("incident_eval")
def _incident_eval(i: Inputs) -> DataFrame:
    """Threshold and window are chosen on the days of training and validation, then judged on the test days and on all days."""
    truth = i.labelled.select(F.col("ticket_id").alias("id"), "created_at", "incident_id")
    tickets = i.tickets.select("id", "created_at", "customer_id")
    tuning = F.dayofmonth("created_at") <= 24  # the days of train and val in ``labelled``
    return evaluate.incident_periods(
        i.vectors, tickets, truth, tuning, SETTINGS_TAU, SETTINGS_HOURS, BURST_MINUTES, MIN_TICKETS, MIN_CUSTOMERS, min_overlap=2
    )


@query("near_dup_removal")
def _near_dup(i: Inputs) -> DataFrame:
    rows = i.labelled.select(F.col("ticket_id").alias("id"), "split", "incident_id", "embedding")
    return graph.near_dup_removal(rows, threshold=0.40).select("id", "split")


@query(
    "near_dup_pairs",
    bind("labelled")
    + """, d AS (SELECT ticket_id AS id, split, embedding FROM labelled WHERE incident_id IS NULL QUALIFY row_number() OVER (PARTITION BY split, label, embedding ORDER BY ticket_id) = 1)
SELECT a.id AS first_id, b.id AS second_id FROM d a JOIN d b ON a.split = b.split AND a.id < b.id WHERE round(list_inner_product(a.embedding, b.embedding), 9) > 0.40""",
)
def _near_pairs(i: Inputs) -> DataFrame:
    return blockjoin.similar_above(_representatives(i), F.col("split"), 0.40)


def _representatives(i: Inputs) -> DataFrame:
    """The first of the rows that share split, label and vector. Rows of two labels may have equal vectors: they are a pair."""
    background = i.labelled.where(F.col("incident_id").isNull())
    return background.groupBy("split", "label", "embedding").agg(F.min("ticket_id").alias("id"))


@query(
    "near_dup_members",
    bind("labelled")
    + " SELECT ticket_id AS id, split, min(ticket_id) OVER (PARTITION BY split, label, embedding) AS first_id FROM labelled WHERE incident_id IS NULL",
)
def _near_members(i: Inputs) -> DataFrame:
    """Every row with the row that stands for it in ``near_dup_pairs``: copies have all pairs of that row, and each other."""
    rows = i.labelled.where(F.col("incident_id").isNull()).select(F.col("ticket_id").alias("id"), "split", "label", "embedding")
    firsts = _representatives(i).withColumnsRenamed({"id": "first_id", "split": "_s", "label": "_l", "embedding": "_e"})
    same = F.col("split").eqNullSafe(F.col("_s")) & F.col("label").eqNullSafe(F.col("_l")) & (F.col("embedding") == F.col("_e"))
    return rows.join(firsts, same).select("id", "split", "first_id")


_SWEEP = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]  # nine, as the default, at the similarities of these vectors


@query(
    "dedup_threshold_sweep",
    bind("labelled")
    + f""", sims AS MATERIALIZED (SELECT a.vec_id AS va, b.vec_id AS vb, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s
  FROM embeddings a CROSS JOIN embeddings b),
l AS MATERIALIZED (SELECT ticket_id, product, created_at, incident_id, root_cause_id, ticket_id % (SELECT count(*) FROM embeddings) AS vec_id FROM labelled),
p AS (SELECT s, a.incident_id IS NOT NULL AND a.incident_id = b.incident_id AS inc, a.root_cause_id = b.root_cause_id AS rc
  FROM l a JOIN l b ON a.product = b.product AND b.created_at >= a.created_at - INTERVAL 72 HOUR AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.ticket_id < a.ticket_id))
  JOIN sims ON va = a.vec_id AND vb = b.vec_id),
t AS (SELECT unnest({_SWEEP})::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE s >= threshold) AS pairs, count(*) FILTER (WHERE s >= threshold AND inc) AS tp, count(*) FILTER (WHERE s >= threshold AND coalesce(rc, false)) AS rc, count(*) FILTER (WHERE s >= {_SWEEP[0]} AND inc) AS pos FROM p, t GROUP BY 1),
m AS (SELECT threshold, tp / greatest(pairs, 1) AS incident_precision, tp / greatest(pos, 1) AS incident_recall, rc / greatest(pairs, 1) AS same_root_cause_precision, pairs FROM c)
SELECT *, 2 * incident_precision * incident_recall / greatest(incident_precision + incident_recall, 1e-9) AS incident_f1 FROM m""",
    num="threshold incident_precision incident_recall same_root_cause_precision incident_f1",
)
def _dedup_sweep(i: Inputs) -> DataFrame:
    return evaluate.dedup_threshold_sweep(i.labelled, _SWEEP).drop("best")


@query(
    "cluster_eval",
    bind("tickets", "labelled")
    + """, m AS (SELECT id, cluster_id FROM tickets WHERE cluster_id IS NOT NULL), t AS (SELECT ticket_id AS id, incident_id FROM labelled WHERE incident_id IS NOT NULL),
x AS (SELECT incident_id, cluster_id, count(*) AS n FROM t LEFT JOIN m USING (id) GROUP BY 1, 2),
g AS (SELECT incident_id, arg_max(cluster_id, (n, -cluster_id)) FILTER (WHERE cluster_id IS NOT NULL) AS cluster_id, max(n) FILTER (WHERE cluster_id IS NOT NULL) AS hits, sum(n) AS reports FROM x GROUP BY 1),
s AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY 1)
SELECT incident_id, g.cluster_id, coalesce(hits, 0) / reports AS member_recall, hits / size AS purity, coalesce(g.cluster_id % 4 = 0, false) AS flagged FROM g LEFT JOIN s ON s.cluster_id = g.cluster_id""",
    num="member_recall purity",
)
def _cluster_eval(i: Inputs) -> DataFrame:
    members = i.tickets.where(F.col("cluster_id").isNotNull()).select("id", "cluster_id")
    clusters = i.clusters.select(F.col("id").alias("cluster_id"), "is_incident")
    truth = i.labelled.select(F.col("ticket_id").alias("id"), "incident_id")
    return evaluate.cluster_eval(members, clusters, truth)


@query(
    "false_flags",
    bind("tickets", "labelled")
    + """, f AS (SELECT t.cluster_id, avg(CAST(l.incident_id IS NULL AS INT)) AS outside FROM tickets t JOIN labelled l ON l.ticket_id = t.id
  WHERE t.cluster_id % 4 = 0 GROUP BY 1) SELECT count(*) FILTER (WHERE outside > 0.5) AS false_flags, count(*) AS flagged_clusters FROM f""",
)
def _false_flags(i: Inputs) -> DataFrame:
    members = i.tickets.where(F.col("cluster_id").isNotNull()).select("id", "cluster_id")
    clusters = i.clusters.select(F.col("id").alias("cluster_id"), "is_incident")
    truth = i.labelled.select(F.col("ticket_id").alias("id"), "incident_id")
    return evaluate.false_flags(members, clusters, truth)


@query("incident_sweep")
def _incident_sweep(i: Inputs) -> DataFrame:
    truth = i.labelled.select(F.col("ticket_id").alias("id"), "created_at", "incident_id")
    tickets = i.tickets.select("id", "created_at", "customer_id")
    return evaluate.incident_sweep(
        i.vectors, tickets, truth, SETTINGS_TAU, SETTINGS_HOURS, BURST_MINUTES, MIN_TICKETS, MIN_CUSTOMERS, min_overlap=2
    )
