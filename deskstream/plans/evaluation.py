"""Evaluation metrics over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.operators import evaluate
from deskstream.plans.bindings import bind
from deskstream.plans.registry import query
from deskstream.schemas import PRIORITIES
from deskstream.sources.bind import Inputs


def report_sql(source: str, by: str = "") -> str:
    """CTEs ``rep`` (per class) for a relation with y and pred."""
    b = f"{by}, " if by else ""
    join = f" AND s.{by} = p.{by}" if by else ""
    pick = f"coalesce(s.{by}, p.{by}) AS {by}, " if by else ""
    return f"""sup AS (SELECT {b}y AS label, count(*) AS support, count(*) FILTER (WHERE y = pred) AS hits FROM {source} WHERE y IS NOT NULL GROUP BY ALL),
prd AS (SELECT {b}pred AS label, count(*) AS predicted FROM {source} WHERE pred IS NOT NULL GROUP BY ALL),
rep AS (SELECT {pick}coalesce(s.label, p.label) AS label, CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE coalesce(hits, 0) / predicted END AS precision,
  CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE hits / support END AS recall, 2 * coalesce(hits, 0) / (coalesce(support, 0) + coalesce(predicted, 0)) AS f1,
  coalesce(support, 0) AS support, coalesce(hits, 0) AS hits FROM sup s FULL JOIN prd p ON s.label = p.label{join})"""


@query(
    "classification_report",
    bind("multiclass") + ", " + report_sql("multiclass") + " SELECT label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM rep",
    num="precision recall f1",
)
def _report(i: Inputs) -> DataFrame:
    return evaluate.classification_report(i.multiclass).drop("hits")


@query(
    "classification_summary",
    bind("multiclass")
    + ", "
    + report_sql("multiclass", "product")
    + " SELECT product, avg(f1) AS macro_f1, sum(hits) / sum(support) AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM rep GROUP BY 1",
    num="macro_f1 accuracy",
)
def _summary(i: Inputs) -> DataFrame:
    return evaluate.classification_summary(i.multiclass, by=["product"])


@query("confusion_matrix", bind("multiclass") + " SELECT y, pred, count(*) AS n FROM multiclass GROUP BY 1, 2")
def _confusion(i: Inputs) -> DataFrame:
    return evaluate.confusion(i.multiclass)


_BINS = ", b AS (SELECT y, p, CAST(greatest(least(floor(p * 10), 9), 0) AS INT) AS bin FROM {src}), r AS (SELECT bin, avg(p) AS mean_pred, avg(y) AS frac_pos, count(*) AS n FROM b GROUP BY 1)"


@query("ece_binary", bind("scored") + _BINS.format(src="scored") + " SELECT sum(abs(frac_pos - mean_pred) * n) / sum(n) AS ece FROM r", num="ece")
def _ece(i: Inputs) -> DataFrame:
    return evaluate.ece_binary(i.scored)


@query(
    "ece_multiclass",
    bind("multiclass")
    + ", j AS (SELECT CAST(y = pred AS INT) AS y, conf AS p FROM multiclass)"
    + _BINS.format(src="j")
    + " SELECT sum(abs(frac_pos - mean_pred) * n) / sum(n) AS ece FROM r",
    num="ece",
)
def _ece_multi(i: Inputs) -> DataFrame:
    return evaluate.ece_multiclass(i.multiclass)


@query("reliability_curve", bind("scored") + _BINS.format(src="scored") + " SELECT * FROM r", num="mean_pred frac_pos")
def _reliability(i: Inputs) -> DataFrame:
    return evaluate.reliability_curve(i.scored)


@query(
    "roc_auc",
    bind("scored")
    + """, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM scored)
SELECT (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS roc_auc FROM r""",
    num="roc_auc",
)
def _auc(i: Inputs) -> DataFrame:
    return evaluate.roc_auc(i.scored)


@query(
    "pr_auc",
    bind("scored")
    + """, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT sum(pos / (SELECT sum(y) FROM scored) * (tp / k)) AS pr_auc FROM c""",
    num="pr_auc",
)
def _prauc(i: Inputs) -> DataFrame:
    return evaluate.pr_auc(i.scored)


@query("brier", bind("scored") + " SELECT avg(pow(p - y, 2)) AS brier FROM scored", num="brier")
def _brier(i: Inputs) -> DataFrame:
    return evaluate.brier(i.scored)


@query(
    "routing_table",
    bind("scored")
    + """ SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE p >= t) / count(*) AS routed_share, avg(y) FILTER (WHERE p >= t) AS precision,
  coalesce(sum(y) FILTER (WHERE p >= t), 0) / greatest(sum(y), 1) AS recall FROM scored, (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS t) GROUP BY t""",
    num="threshold routed_share precision recall",
)
def _routing(i: Inputs) -> DataFrame:
    return evaluate.routing_table(i.scored)


def _prioritised(i: Inputs) -> DataFrame:
    p = F.array(*[F.lit(x) for x in PRIORITIES])
    level = F.array_position(p, F.col("priority"))
    shift = F.when(F.col("id") % 5 == 0, -2).when(F.col("id") % 3 == 0, 1).otherwise(0)
    pred = F.element_at(p, F.least(F.greatest(level + shift, F.lit(1)), F.lit(4)).cast("int"))
    return i.tickets.where(F.col("priority").isNotNull()).select("id", F.col("priority").alias("y"), pred.alias("pred"))


_PRIO = """, l AS (SELECT id, priority AS y, list_position(['LOW', 'MEDIUM', 'HIGH', 'URGENT'], priority) AS k,
  CASE WHEN id % 5 = 0 THEN -2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS d FROM tickets WHERE priority IS NOT NULL),
q AS (SELECT id, y, k, least(greatest(k + d, 1), 4) AS pk, (['LOW', 'MEDIUM', 'HIGH', 'URGENT'])[least(greatest(k + d, 1), 4)] AS pred FROM l)"""


@query(
    "urgent_metrics",
    bind("tickets")
    + _PRIO
    + ", "
    + report_sql("q")
    + """ SELECT (SELECT count(*) FILTER (WHERE y = 'URGENT' AND pred = 'URGENT') / greatest(count(*) FILTER (WHERE y = 'URGENT'), 1) FROM q) AS urgent_recall,
 (SELECT count(*) FILTER (WHERE y = 'URGENT' AND pred = 'URGENT') / greatest(count(*) FILTER (WHERE pred = 'URGENT'), 1) FROM q) AS urgent_precision,
 (SELECT avg(CAST(k - pk >= 2 AS INT)) FROM q) AS under_prioritized_2plus, avg(f1) AS macro_f1, sum(hits) / sum(support) AS accuracy FROM rep""",
    num="urgent_recall urgent_precision under_prioritized_2plus macro_f1 accuracy",
)
def _urgent(i: Inputs) -> DataFrame:
    return evaluate.urgent_metrics(_prioritised(i), PRIORITIES)


@query(
    "urgent_weight_sweep",
    bind("tickets")
    + """, b AS (SELECT greatest((1 + (id * 3) % 11), (1 + (id * 4) % 11), (1 + (id * 5) % 11)) / 44.0::DOUBLE AS o, (1 + (id * 6) % 11) / 44.0::DOUBLE AS p
  FROM tickets WHERE priority = 'URGENT'),
w AS (SELECT unnest(range(0, 21)) * 0.25::DOUBLE + 1 AS weight),
s AS (SELECT weight, count(*) FILTER (WHERE p * weight > o) / greatest(count(*), 1) AS urgent_recall FROM b, w GROUP BY 1)
SELECT weight, urgent_recall, weight = coalesce((SELECT min(weight) FROM s WHERE urgent_recall >= 0.6), 1.0) AS chosen FROM s""",
    num="weight urgent_recall",
)
def _sweep(i: Inputs) -> DataFrame:
    probs = F.array(*[F.expr(f"(1 + (id * {k + 3}) % 11) / 44.0D") for k in range(4)])
    rows = i.tickets.where(F.col("priority").isNotNull()).select(F.col("priority").alias("y"), probs.alias("probs"))
    return evaluate.urgent_weight_sweep(rows, PRIORITIES, target=0.6)


def _two_models(i: Inputs) -> DataFrame:
    usage = i.drafts.select((F.col("id") / 10).cast("bigint").alias("id"), F.col("cost_usd"), "latency_ms")
    return i.multiclass.join(usage, "id").select(
        "y", F.col("pred").alias("small_pred"), F.col("conf").alias("small_conf"), "llm_pred", "cost_usd", "latency_ms"
    )


@query(
    "cascade_table",
    bind("multiclass", "drafts")
    + """, d AS (SELECT m.y, m.pred AS small_pred, m.conf, m.llm_pred, d.cost_usd, d.latency_ms FROM multiclass m JOIN drafts d ON d.id = m.id * 10),
t AS (SELECT unnest([0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.01])::DOUBLE AS tau),
x AS (SELECT tau, y, CASE WHEN conf < tau THEN llm_pred ELSE small_pred END AS pred, conf < tau AS asked FROM d, t), """
    + report_sql("x", "tau")
    + """, a AS (SELECT tau, avg(f1) AS macro_f1, sum(hits) / sum(support) AS accuracy FROM rep GROUP BY 1), s AS (SELECT tau, avg(CAST(asked AS INT)) AS llm_share FROM x GROUP BY 1)
SELECT a.tau, llm_share, macro_f1, accuracy, llm_share * (SELECT avg(CAST(cost_usd AS DOUBLE)) FROM d) * 1000 AS cost_per_1k_usd,
  14.9 + llm_share * (SELECT avg(latency_ms) FROM d) AS mean_latency_ms FROM a JOIN s ON s.tau = a.tau""",
    num="tau llm_share macro_f1 accuracy cost_per_1k_usd mean_latency_ms",
)
def _cascade(i: Inputs) -> DataFrame:
    return evaluate.cascade_table(_two_models(i), small_latency_ms=14.9)


@query(
    "confidence_informative",
    bind("multiclass")
    + """ SELECT avg(CAST(y = pred AS INT)) FILTER (WHERE conf < 0.6) AS acc_below, count(*) FILTER (WHERE conf < 0.6) AS n_below,
  avg(CAST(y = pred AS INT)) FILTER (WHERE conf >= 0.6) AS acc_at_or_above, count(*) FILTER (WHERE conf >= 0.6) AS n_at_or_above FROM multiclass""",
    num="acc_below acc_at_or_above",
)
def _informative(i: Inputs) -> DataFrame:
    return evaluate.confidence_informative(i.multiclass)


@query(
    "served_quality",
    bind("multiclass", "tickets")
    + """, s AS (SELECT m.y, m.pred, t.category, t.category_source, t.queue, CAST(t.sla_breached AS INT) AS e FROM multiclass m JOIN tickets t ON t.id = m.id), """
    + report_sql("s")
    + """ SELECT (SELECT count(*) FROM s) AS tickets, (SELECT avg(CAST(category = y AS INT)) FROM s) AS served_accuracy, (SELECT avg(CAST(category_source = 'LLM' AS INT)) FROM s) AS llm_share,
  (SELECT avg(CAST(queue = 'SENIOR' AS INT)) FROM s) AS senior_share, (SELECT avg(e) FILTER (WHERE queue = 'SENIOR') FROM s) AS senior_precision,
  (SELECT sum(e) FILTER (WHERE queue = 'SENIOR') / greatest(sum(e), 1) FROM s) AS senior_recall, (SELECT avg(e) FROM s) AS base_rate,
  avg(f1) AS model_macro_f1, sum(hits) / sum(support) AS model_accuracy FROM rep""",
    num="served_accuracy llm_share senior_share senior_precision senior_recall base_rate model_macro_f1 model_accuracy",
)
def _served(i: Inputs) -> DataFrame:
    served = i.tickets.select("id", "category", "category_source", "queue", F.col("sla_breached").alias("escalated"))
    joined = i.multiclass.select("id", F.col("y").alias("true_category"), F.col("pred").alias("model_category")).join(served, "id")
    return evaluate.served_quality(joined)


@query(
    "citation_precision",
    bind("drafts", "tickets")
    + """, d AS (SELECT d.id, t.product AS true_cause, d.source_ids FROM drafts d JOIN tickets t ON t.id = d.ticket_id WHERE d.source_ids IS NOT NULL),
s AS (SELECT d.id, d.true_cause, unnest(source_ids) AS sid, generate_subscripts(source_ids, 1) - 1 AS pos, source_ids[1] AS cited FROM d),
f AS (SELECT s.id, min(CASE WHEN t.product = s.true_cause THEN pos END) AS first, min(CAST(pos = 0 AND t.product = s.true_cause AS INT)) AS x FROM s LEFT JOIN tickets t ON t.id = s.sid GROUP BY 1)
SELECT count(*) AS drafts, avg(CAST(coalesce(first, 99) < 1 AS INT)) AS hit_at_1, avg(CAST(coalesce(first, 99) < 5 AS INT)) AS hit_at_5, avg(coalesce(1 / (first + 1), 0)) AS mrr,
  (SELECT avg(CAST(coalesce(t.product = s.true_cause, false) AS INT)) FROM s LEFT JOIN tickets t ON t.id = s.sid WHERE pos = 0) AS citation_precision,
  (SELECT count(*) FROM s WHERE pos = 0) AS citations FROM f""",
    num="hit_at_1 hit_at_5 mrr citation_precision",
)
def _citations(i: Inputs) -> DataFrame:
    from deskstream.operators.projection import json_fields

    parsed = json_fields(i.drafts).where(F.col("sources").isNotNull())
    ids = lambda c, f: F.transform(c, lambda s: s[f])
    # every draft row is evaluated on its own, so its id plays the ticket
    owner = parsed.select(
        F.col("id").alias("ticket_id"), F.col("ticket_id").alias("_t"), ids("sources", "id").alias("source_ids"), ids("citations", "ticketId").alias("cited_ids")
    )
    causes = i.tickets.select(F.col("id").alias("source_id"), F.col("product").alias("cause"))
    truth = owner.select("ticket_id", "_t").join(
        i.tickets.select(F.col("id").alias("_t"), F.col("product").alias("true_cause")), "_t"
    )
    return evaluate.citation_precision(owner.drop("_t"), causes, truth.drop("_t"))




@query(
    "promotion_gate",
    bind("multiclass")
    + f""", cur AS (SELECT y, pred FROM multiclass), cand AS (SELECT y, CASE WHEN id % 25 = 0 THEN pred ELSE y END AS pred FROM multiclass),
{report_sql('cur').replace('sup AS', 'sup1 AS').replace('prd AS', 'prd1 AS').replace('rep AS', 'rep1 AS').replace('FROM sup s', 'FROM sup1 s').replace('JOIN prd p', 'JOIN prd1 p')},
{report_sql('cand')},
o AS (SELECT avg(a.f1) AS current_macro_f1, avg(b.f1) AS candidate_macro_f1, max(coalesce(a.f1, 0) - coalesce(b.f1, 0)) AS worst_class_drop FROM rep1 a FULL JOIN rep b ON a.label = b.label)
SELECT *, candidate_macro_f1 >= current_macro_f1 - 0.005 AND worst_class_drop <= 0.03 AS promote FROM o""",
    num="current_macro_f1 candidate_macro_f1 worst_class_drop",
)
def _gate(i: Inputs) -> DataFrame:
    better = i.multiclass.withColumn("pred", F.when(F.col("id") % 25 == 0, F.col("pred")).otherwise(F.col("y")))
    return evaluate.promotion_gate(evaluate.classification_report(i.multiclass), evaluate.classification_report(better))


@query(
    "augmentation_gate",
    bind("multiclass")
    + f""", cur AS (SELECT y, pred FROM multiclass), cand AS (SELECT y, CASE WHEN id % 25 = 0 THEN pred ELSE y END AS pred FROM multiclass),
{report_sql('cur').replace('sup AS', 'sup1 AS').replace('prd AS', 'prd1 AS').replace('rep AS', 'rep1 AS').replace('FROM sup s', 'FROM sup1 s').replace('JOIN prd p', 'JOIN prd1 p')},
{report_sql('cand')}, o AS (SELECT (SELECT avg(f1) FROM rep1) AS base_macro_f1, (SELECT avg(f1) FROM rep) AS augmented_macro_f1)
SELECT *, augmented_macro_f1 - base_macro_f1 > 0.002 AS keep FROM o""",
    num="base_macro_f1 augmented_macro_f1",
)
def _augment(i: Inputs) -> DataFrame:
    better = i.multiclass.withColumn("pred", F.when(F.col("id") % 25 == 0, F.col("pred")).otherwise(F.col("y")))
    return evaluate.augmentation_gate(evaluate.classification_summary(i.multiclass), evaluate.classification_summary(better))


@query(
    "retrain_candidates",
    bind("tickets")
    + """ SELECT id, category, CASE WHEN CAST('0x' || left(md5(CAST(id AS VARCHAR)), 8) AS BIGINT) < CAST(floor(0.2 * 4294967296) AS BIGINT) THEN 'probe' ELSE 'train' END AS part
FROM tickets WHERE category_source = 'AGENT' AND (SELECT count(*) FROM tickets WHERE category_source = 'AGENT') >= 20""",
)
def _retrain(i: Inputs) -> DataFrame:
    return evaluate.retrain_candidates(i.tickets).select("id", "category", "part")


def _contributions(i: Inputs) -> DataFrame:
    """A linear model over five ticket features: weight times value."""
    values = {
        "tier": F.col("version").cast("double") - 1,
        "hour": F.hour("created_at") / 24.0,
        "emb_pc0": F.coalesce(F.col("escalation_risk").cast("double"), F.lit(0.0)) - 0.1,
        "emb_pc1": F.col("category_conf").cast("double") - 0.75,
        "sig_legal": (F.col("id") % 3).cast("double"),
    }
    weights = {"tier": 0.4, "hour": -0.9, "emb_pc0": 1.5, "emb_pc1": -0.7, "sig_legal": 0.15}
    items = [F.struct(F.lit(n).alias("feature"), (v * weights[n]).alias("value")) for n, v in values.items()]
    return i.tickets.select("id", F.array(*items).alias("contributions"))


_CONTRIB = """, f AS (SELECT id, version - 1.0 AS tier, hour(created_at) / 24.0::DOUBLE AS hr, coalesce(CAST(escalation_risk AS DOUBLE), 0) - 0.1 AS e0,
  CAST(category_conf AS DOUBLE) - 0.75 AS e1, id % 3 AS legal FROM tickets),
c AS (SELECT id, 'tier' AS feature, tier * 0.4 AS v FROM f UNION ALL SELECT id, 'hour', hr * -0.9 FROM f
  UNION ALL SELECT id, 'sig_legal', legal * 0.15 FROM f UNION ALL SELECT id, {emb}"""


@query(
    "top_factors",
    bind("tickets")
    + _CONTRIB.format(emb="'text_embedding', e0 * 1.5 + e1 * -0.7 FROM f)")
    + """ SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY round(abs(v), 9) DESC, feature) - 1 AS INT) AS pos, feature, v AS contribution FROM c
QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(abs(v), 9) DESC, feature) <= 3""",
    num="contribution", digits=9,
)
def _top(i: Inputs) -> DataFrame:
    from deskstream.functions.scoring import top_factors

    factors = top_factors(F.col("contributions"), digits=9)
    return _contributions(i).select("id", F.posexplode(factors).alias("pos", "f")).select("id", "pos", "f.*")


@query(
    "global_importance",
    bind("tickets")
    + _CONTRIB.format(emb="'emb_pc0', e0 * 1.5 FROM f UNION ALL SELECT id, 'emb_pc1', e1 * -0.7 FROM f)")
    + " SELECT feature, avg(abs(v)) AS mean_abs FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    num="mean_abs",
)
def _importance(i: Inputs) -> DataFrame:
    from deskstream.operators.modelling import global_importance

    return global_importance(_contributions(i))
