"""Evaluation: classification, calibration, ranking, cascade, incidents, gates.

All of it is aggregation over prediction tables. Rank statistics collapse equal scores
first and rank the distinct ones in equal-depth buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskstream.operators.windows import bucket_by_bounds, bucketed_running, quantile_bounds


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


# ------------------------------------------------------------- classification
def confusion(rows: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(rows: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class (the union of true and predicted labels)."""
    by = by or []
    cells = confusion(rows, y, pred, by)
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("hits")),
            )
        ).alias("s"),
    )
    summed = sides.where(F.col("s.label").isNotNull()).groupBy(*by, F.col("s.label").alias("label")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")]
    )
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return summed.select(
        *by,
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hits",
    )


def classification_summary(rows: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Macro F1, accuracy and row count."""
    report = classification_report(rows, y, pred, by)
    aggregates = [
        F.avg("f1").alias("macro_f1"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n"),
    ]
    return report.groupBy(*by).agg(*aggregates) if by else report.agg(*aggregates)


# ---------------------------------------------------------------- calibration
def _bin(p: Column, bins: int) -> Column:
    """Equal-width bin of a probability, both ends included."""
    return F.greatest(F.least(F.floor(p * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def reliability_curve(rows: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    return rows.groupBy(_bin(F.col(p), bins).alias("bin")).agg(
        F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("frac_pos"), F.count(F.lit(1)).alias("n")
    )


def ece_binary(rows: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Expected calibration error, one row."""
    gap = F.abs(F.col("frac_pos") - F.col("mean_pred")) * F.col("n")
    return reliability_curve(rows, y, p, bins).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def ece_multiclass(rows: DataFrame, y: str = "y", pred: str = "pred", conf: str = "conf", bins: int = 10) -> DataFrame:
    """Calibration of the top probability against being right."""
    judged = rows.select((F.col(y) == F.col(pred)).cast("int").alias("y"), F.col(conf).cast("double").alias("p"))
    return ece_binary(judged, "y", "p", bins)


def brier(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))


def _by_score(rows: DataFrame, y: str, p: str) -> DataFrame:
    """(p, pos, neg, pos_upto, neg_upto) per distinct score, cumulative from the lowest."""
    scores = rows.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    scores = scores.select("p", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    bounds = quantile_bounds(scores, "p")
    placed = scores.withColumn("_b", bucket_by_bounds(F.col("p"), bounds))
    return bucketed_running(placed, [], "_b", ["p"], {"pos_upto": "pos", "neg_upto": "neg"}).drop("_b")


def roc_auc(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    ranked = _by_score(rows, y, p)
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2)
    return ranked.agg((F.sum(won) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))


def pr_auc(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall it adds."""
    ranked = _by_score(rows, y, p)
    total = ranked.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = ranked.join(F.broadcast(total))  # one row by construction
    above_pos = F.col("all_pos") - F.col("pos_upto") + F.col("pos")
    above_neg = F.col("all_neg") - F.col("neg_upto") + F.col("neg")
    part = F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * (above_pos / (above_pos + above_neg))
    return joined.agg(F.sum(part).alias("pr_auc"))


# -------------------------------------------------------------------- routing
def _values(rows: DataFrame, values: list[float], name: str) -> DataFrame:
    """Every row once per constant; the constants are a literal array, so nothing is shuffled or joined."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


ROUTING_THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
CASCADE_TAUS = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.01]
URGENT_WEIGHTS = [1.0 + 0.25 * i for i in range(21)]


def routing_table(rows: DataFrame, y: str = "y", p: str = "p", thresholds: list[float] | None = None) -> DataFrame:
    """Share routed, precision (NULL if nothing) and recall per threshold, from one pass over the rows."""
    cuts = thresholds or ROUTING_THRESHOLDS
    columns = [F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")]
    for i, cut in enumerate(cuts):
        chosen = F.col(p) >= F.lit(cut)
        columns += [F.count_if(chosen).alias(f"s{i}"), F.sum(F.when(chosen, F.col(y).cast("bigint")).otherwise(0)).alias(f"h{i}")]
    one = rows.agg(*columns)
    lines = [
        F.struct(
            F.lit(cut).alias("threshold"),
            (F.col(f"s{i}") / F.col("n")).alias("routed_share"),
            (F.col(f"h{i}") / F.nullif(F.col(f"s{i}"), F.lit(0))).alias("precision"),
            (F.col(f"h{i}") / F.greatest(F.col("pos"), F.lit(1))).alias("recall"),
        )
        for i, cut in enumerate(cuts)
    ]
    return one.select(F.inline(F.array(*lines)))


def urgent_metrics(rows: DataFrame, levels: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Recall and precision of the top level, share under-prioritised by two or more, macro F1, accuracy."""
    order = F.array(*[F.lit(x) for x in levels])
    top = levels[-1]
    cells = confusion(rows, y, pred)
    level = lambda c: F.array_position(order, F.col(c))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    both = (F.col("y") == top) & (F.col("pred") == top)
    one = cells.agg(
        (n(both) / F.greatest(n(F.col("y") == top), F.lit(1))).alias("urgent_recall"),
        (n(both) / F.greatest(n(F.col("pred") == top), F.lit(1))).alias("urgent_precision"),
        (n(level("y") - level("pred") >= 2) / F.sum("n")).alias("under_prioritized_2plus"),
    )
    summary = classification_summary(rows, y, pred).select("macro_f1", "accuracy")
    return one.join(F.broadcast(summary))  # one row each


def urgent_weight_sweep(rows: DataFrame, classes: list[str], target: float = 0.90, weights: list[float] | None = None) -> DataFrame:
    """Recall of the last class per weight on its probability; ``chosen`` marks the smallest one reaching ``target``.

    ``rows`` has y and probs (aligned with ``classes``). Reweighting does not need the
    normalisation to find the winner. When no weight reaches the target, 1.0 is chosen.
    """
    last = len(classes) - 1
    best_other = F.array_max(F.slice("probs", 1, last))
    urgent = F.col("y") == classes[last]
    needed = rows.select(urgent.alias("u"), best_other.alias("o"), F.element_at("probs", last + 1).alias("p")).where("u")
    weights = weights or URGENT_WEIGHTS
    one = needed.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("p") * w > F.col("o")).alias(f"w{i}") for i, w in enumerate(weights)],
    )
    lines = [
        F.struct(F.lit(w).alias("weight"), (F.col(f"w{i}") / F.greatest(F.col("n"), F.lit(1))).alias("urgent_recall"))
        for i, w in enumerate(weights)
    ]
    table = one.select(F.array(*lines).alias("t"))
    reached = F.array_min(F.transform(F.filter("t", lambda r: r["urgent_recall"] >= target), lambda r: r["weight"]))
    return table.select(F.inline("t"), F.coalesce(reached, F.lit(1.0)).alias("_w")).select(
        "weight", "urgent_recall", (F.col("weight") == F.col("_w")).alias("chosen")
    )


# -------------------------------------------------------------------- cascade
def cascade_table(rows: DataFrame, small_latency_ms: float, taus: list[float] | None = None) -> DataFrame:
    """Per threshold: share sent to the language model, accuracy, macro F1, cost per 1k, mean latency.

    ``rows`` has y, small_pred, small_conf, llm_pred, cost_usd, latency_ms. The rows are
    counted once per (confidence band, labels); thresholds only recombine those counts.
    """
    taus = sorted(taus or CASCADE_TAUS)
    band = sum((F.col("small_conf") >= F.lit(t)).cast("int") for t in taus)  # taus below or at the confidence
    cells = rows.groupBy(band.alias("band"), "y", "small_pred", "llm_pred").agg(F.count(F.lit(1)).alias("n"))
    cost = rows.agg(
        F.avg(F.col("cost_usd").cast("double")).alias("mean_cost"), F.avg("latency_ms").alias("mean_llm_ms")
    )
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(i).alias("i")) for i, t in enumerate(taus)]))
    spread = cells.select("*", at.alias("t"))
    asks = F.col("band") <= F.col("t.i")
    judged = spread.select(
        F.col("t.tau").alias("tau"),
        "y",
        F.when(asks, F.col("llm_pred")).otherwise(F.col("small_pred")).alias("pred"),
        F.when(asks, F.col("n")).otherwise(F.lit(0)).alias("asked"),
        "n",
    )
    merged = judged.groupBy("tau", "y", "pred").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    per_class = merged.select(
        "tau",
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
            )
        ).alias("s"),
        F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("h"),
        "asked",
    )
    labels = per_class.groupBy("tau", F.col("s.label").alias("label")).agg(
        F.sum("s.support").alias("support"),
        F.sum("s.predicted").alias("predicted"),
        (F.sum("h") / 2).alias("hits"),  # a hit shows up on both sides of its own label
        (F.sum("asked") / 2).alias("asked"),
    )
    f1 = _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    table = labels.groupBy("tau").agg(
        (F.sum("asked") / F.sum("support")).alias("llm_share"),
        F.avg(f1).alias("macro_f1"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
    )
    share = F.col("llm_share")
    return table.join(F.broadcast(cost)).select(  # one row
        "tau",
        "llm_share",
        "macro_f1",
        "accuracy",
        (share * F.col("mean_cost") * 1000).alias("cost_per_1k_usd"),
        (F.lit(small_latency_ms) + share * F.col("mean_llm_ms")).alias("mean_latency_ms"),
    )


def confidence_informative(rows: DataFrame, cut: float = 0.6, y: str = "y", pred: str = "pred", conf: str = "conf") -> DataFrame:
    right = (F.col(y) == F.col(pred)).cast("int")
    below = F.col(conf) < cut
    return rows.agg(
        F.avg(F.when(below, right)).alias("acc_below"),
        F.count_if(below).alias("n_below"),
        F.avg(F.when(~below, right)).alias("acc_at_or_above"),
        F.count_if(~below).alias("n_at_or_above"),
    )


# ------------------------------------------------------------------- similarity
DEDUP_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]


def dedup_threshold_sweep(vectors: DataFrame, thresholds: list[float] | None = None, window_hours: float = 72.0) -> DataFrame:
    """Precision, recall and F1 of "same incident" per threshold; ``best`` marks the highest F1.

    Positives are the same-incident pairs at or above the lowest threshold.
    """
    from deskstream.operators.blockjoin import pair_histogram

    cuts = sorted(thresholds or DEDUP_THRESHOLDS)
    counts = pair_histogram(vectors, cuts, window_hours)
    positives = counts.where(F.col("threshold") == cuts[0]).select(F.col("same_incident").alias("positives"))
    some = F.greatest(F.col("pairs"), F.lit(1))
    table = counts.join(F.broadcast(positives)).select(  # one row
        "threshold",
        (F.col("same_incident") / some).alias("incident_precision"),
        (F.col("same_incident") / F.greatest(F.col("positives"), F.lit(1))).alias("incident_recall"),
        (F.col("same_cause") / some).alias("same_root_cause_precision"),
        "pairs",
    )
    p, r = F.col("incident_precision"), F.col("incident_recall")
    scored = table.withColumn("incident_f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))
    top = scored.agg(F.max_by("threshold", F.struct("incident_f1", -F.col("threshold"))).alias("_best"))
    return scored.join(F.broadcast(top)).withColumn("best", F.col("threshold") == F.col("_best")).drop("_best")


def retrieval_metrics(ranked: DataFrame, query_truth: DataFrame, corpus_truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """recall@k and MRR per method over queries that have a relevant document at all.

    ``ranked`` is (method, qid, id, rank from 0), the truths are (qid, label) and (id, label).
    """
    known = corpus_truth.select("label").distinct()
    queries = query_truth.join(known, "label", "left_semi")
    hits = (
        ranked.join(corpus_truth.withColumnRenamed("label", "_d"), "id")
        .join(queries, "qid")
        .where(F.col("_d") == F.col("label"))
        .groupBy("method", "qid")
        .agg(F.min("rank").alias("first"))
    )
    total = queries.agg(F.count(F.lit(1)).alias("queries"))
    aggregates = [F.count_if(F.col("first") < k).alias(f"_h{k}") for k in ks]
    summed = hits.groupBy("method").agg(*aggregates, F.sum(1 / (F.col("first") + 1)).alias("_rr"))
    return summed.join(F.broadcast(total)).select(  # one row
        "method",
        *[(F.col(f"_h{k}") / F.col("queries")).alias(f"recall_at_{k}") for k in ks],
        (F.col("_rr") / F.col("queries")).alias("mrr"),
        "queries",
    )


# --------------------------------------------------------------------- incidents
def incident_eval(alarms: DataFrame, truth: DataFrame, min_overlap: int = 5, span_days: Column | None = None) -> DataFrame:
    """Recall, delay, tickets before the alarm, false alarms and purity, one row.

    ``alarms`` is (ticket_id, alarm_at, members), ``truth`` is (id, created_at, incident_id).
    """
    flat = alarms.select(F.col("ticket_id").alias("alarm"), "alarm_at", F.explode("members").alias("id"))
    labelled = flat.join(truth.select("id", "incident_id"), "id")
    mix = labelled.groupBy("alarm", "alarm_at", F.coalesce("incident_id", F.lit("none")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_alarm = mix.groupBy("alarm").agg(
        F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("top"), F.sum("n").alias("size")
    )
    purity = F.col("top") / F.col("size")
    alarm_stats = per_alarm.agg(
        F.count(F.lit(1)).alias("alarms"),
        F.count_if((F.col("major") == "none") | (purity < 0.5)).alias("false_alarms"),
        F.avg(purity).alias("mean_alarm_purity"),
    )
    reports = truth.where(F.col("incident_id").isNotNull())
    starts = reports.groupBy("incident_id").agg(F.min("created_at").alias("first_at"))
    hits = (
        mix.where((F.col("label") != "none") & (F.col("n") >= min_overlap))
        .groupBy(F.col("label").alias("incident_id"))
        .agg(F.min("alarm_at").alias("flagged_at"))
    )
    detected = starts.join(hits, "incident_id", "left")
    before = (
        reports.join(hits, "incident_id")
        .where(F.col("created_at") <= F.col("flagged_at"))
        .groupBy("incident_id")
        .agg(F.count(F.lit(1)).alias("before"))
    )
    delay = (F.unix_micros("flagged_at") - F.unix_micros("first_at")) / F.lit(60e6)
    incident_stats = detected.join(before, "incident_id", "left").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count("flagged_at").alias("detected"),
        (F.count("flagged_at") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"),
        F.median(delay).alias("median_delay_min"),  # one value per incident, not per ticket
        F.median("before").alias("median_tickets_before_alarm"),
    )
    days = truth.agg(
        F.greatest(
            F.floor((F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / F.lit(86_400_000_000)),
            F.lit(1),
        ).alias("days")
    )
    joined = incident_stats.join(F.broadcast(alarm_stats)).join(F.broadcast(days))  # one row each
    return joined.withColumn("false_alarms_per_week", F.col("false_alarms") / F.col("days") * 7).drop("days")


def incident_sweep(
    vectors: DataFrame,
    tickets: DataFrame,
    truth: DataFrame,
    taus: tuple[float, ...] = (0.55, 0.6, 0.65, 0.7, 0.75, 0.8),
    windows_h: tuple[float, ...] = (3.0, 72.0),
    burst_minutes: float = 60.0,
    min_tickets: int = 5,
    min_customers: int = 3,
    min_overlap: int = 5,
) -> DataFrame:
    """:func:`incident_eval` per (tau, window) with the chosen setting marked.

    The best 20 links per ticket are found once per window at the lowest threshold; a
    higher threshold only cuts that ranked list further down.
    """
    from deskstream.operators import blockjoin, graph
    from deskstream.operators.windows import topk_per_key
    from deskstream.session import cut_lineage

    rows = None
    for hours in windows_h:
        pairs = cut_lineage(blockjoin.duplicate_pairs(vectors, min(taus), hours, 20))
        for tau in taus:
            best = [F.col("similarity").desc(), F.col("similar_id")]
            links = topk_per_key(pairs.where(F.col("similarity") >= tau), ["ticket_id"], best, 20).drop("rank")
            components = cut_lineage(graph.connected_components(links))
            alarms = graph.incident_replay(tickets, links, components, hours, burst_minutes, min_tickets, min_customers)
            one = incident_eval(alarms, truth, min_overlap).withColumns({"tau": F.lit(tau), "window_h": F.lit(hours)})
            rows = one if rows is None else rows.unionByName(one)
    return choose_incident_setting(cut_lineage(rows))


def incident_periods(
    vectors: DataFrame, tickets: DataFrame, truth: DataFrame, tuning: Column, taus: tuple[float, ...], windows_h: tuple[float, ...],
    burst_minutes: float = 60.0, min_tickets: int = 5, min_customers: int = 3, min_overlap: int = 5,
) -> DataFrame:
    """:func:`incident_eval` of the test period and of all days, at the setting chosen on the days before.

    ``tuning`` tells by created_at, which all three frames have, whether a row belongs to the days on which the setting is chosen.
    A period is replayed by itself: no link, cluster or alarm crosses its bounds.
    """
    from deskstream.operators import blockjoin, graph
    from deskstream.session import cut_lineage

    burst = (burst_minutes, min_tickets, min_customers)
    before = [frame.where(tuning) for frame in (vectors, tickets, truth)]
    sweep = incident_sweep(*before, taus, windows_h, *burst, min_overlap)
    chosen = sweep.where("chosen").first()
    tau, hours = (chosen["tau"], chosen["window_h"]) if chosen else (taus[0], windows_h[0])  # no tickets at all before
    rows = None
    for period, inside in (("test", ~tuning), ("full", F.lit(True))):
        links = cut_lineage(blockjoin.duplicate_links(vectors.where(inside), tau, hours))
        components = graph.connected_components(links)
        alarms = graph.incident_replay(tickets.where(inside), links, components, hours, *burst)
        one = incident_eval(alarms, truth.where(inside), min_overlap)
        one = one.withColumns({"period": F.lit(period), "tau": F.lit(tau), "window_h": F.lit(hours)})
        rows = one if rows is None else rows.unionByName(one)
    return rows


def choose_incident_setting(sweep: DataFrame, max_false_per_week: float = 1.0) -> DataFrame:
    """The sweep with ``chosen``: best recall, then shortest delay, among settings quiet enough (or all)."""
    quiet = sweep.agg(F.bool_or(F.col("false_alarms_per_week") <= max_false_per_week).alias("_any"))
    ok = ~F.col("_any") | (F.col("false_alarms_per_week") <= max_false_per_week)
    key = F.struct("recall", -F.coalesce("median_delay_min", F.lit(1e9)), -F.col("window_h"), -F.col("tau"))
    joined = sweep.join(F.broadcast(quiet))  # one row
    best = joined.agg(F.max_by(F.struct("tau", "window_h"), F.when(ok, key)).alias("_best"))
    return joined.join(F.broadcast(best)).withColumn("chosen", F.struct("tau", "window_h") == F.col("_best")).drop("_any", "_best")


def cluster_eval(members: DataFrame, clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """Per true incident: its main cluster, member recall, purity and whether that cluster was flagged.

    ``members`` is (id, cluster_id), ``clusters`` (cluster_id, is_incident), ``truth`` (id, incident_id).
    """
    labelled = truth.join(members, "id", "left")
    reports = labelled.where(F.col("incident_id").isNotNull())
    cells = reports.groupBy("incident_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    clustered = F.col("cluster_id").isNotNull()
    main = cells.groupBy("incident_id").agg(
        F.max_by("cluster_id", F.when(clustered, F.struct(F.col("n"), -F.col("cluster_id")))).alias("cluster_id"),
        F.max(F.when(clustered, F.col("n"))).alias("hits"),
        F.sum("n").alias("reports"),
    )
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    joined = main.join(sizes, "cluster_id", "left").join(clusters.select("cluster_id", "is_incident"), "cluster_id", "left")
    return joined.select(
        "incident_id",
        "cluster_id",
        (F.coalesce("hits", F.lit(0)) / F.col("reports")).alias("member_recall"),
        (F.col("hits") / F.col("size")).alias("purity"),
        F.coalesce("is_incident", F.lit(False)).alias("flagged"),
    )


def false_flags(members: DataFrame, clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """Flagged clusters most of whose members belong to no true incident, one row."""
    flagged = members.join(clusters.where("is_incident").select("cluster_id"), "cluster_id").join(truth, "id")
    share = flagged.groupBy("cluster_id").agg(F.avg(F.col("incident_id").isNull().cast("int")).alias("outside"))
    return share.agg(F.count_if(F.col("outside") > 0.5).alias("false_flags"), F.count(F.lit(1)).alias("flagged_clusters"))


def citation_precision(drafts: DataFrame, causes: DataFrame, ticket_causes: DataFrame) -> DataFrame:
    """hit@1, hit@5 and MRR of draft sources, share of citations with the true cause, one row.

    ``drafts`` is (ticket_id, source_ids, cited_ids), ``causes`` (source_id, cause),
    ``ticket_causes`` (ticket_id, true_cause).
    """
    with_truth = drafts.where(F.size("source_ids") > 0).join(ticket_causes, "ticket_id")
    sources = (
        with_truth.select("ticket_id", "true_cause", F.posexplode("source_ids").alias("pos", "source_id"))
        .join(causes, "source_id", "left")
        .groupBy("ticket_id")
        .agg(F.min(F.when(F.col("cause") == F.col("true_cause"), F.col("pos"))).alias("first"))
    )
    ranks = sources.agg(
        F.count(F.lit(1)).alias("drafts"),
        F.avg((F.coalesce("first", F.lit(99)) < 1).cast("int")).alias("hit_at_1"),
        F.avg((F.coalesce("first", F.lit(99)) < 5).cast("int")).alias("hit_at_5"),
        F.avg(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))).alias("mrr"),
    )
    cited = (
        with_truth.select("true_cause", F.explode("cited_ids").alias("source_id"))
        .join(causes, "source_id", "left")
        .agg(
            F.avg(F.coalesce(F.col("cause") == F.col("true_cause"), F.lit(False)).cast("int")).alias("citation_precision"),
            F.count(F.lit(1)).alias("citations"),
        )
    )
    return ranks.join(F.broadcast(cited))  # one row each


def served_quality(served: DataFrame) -> DataFrame:
    """Model and served label quality plus senior routing, one row.

    ``served`` has true_category, model_category, category, category_source, queue, escalated.
    """
    model = classification_summary(served.where(F.col("model_category").isNotNull()), "true_category", "model_category")
    senior = F.col("queue") == "SENIOR"
    hit = F.col("escalated").cast("int")
    rest = served.agg(
        F.count(F.lit(1)).alias("tickets"),
        F.avg(F.coalesce(F.col("category") == F.col("true_category"), F.lit(False)).cast("int")).alias("served_accuracy"),
        F.avg(F.coalesce(F.col("category_source") == "LLM", F.lit(False)).cast("int")).alias("llm_share"),
        F.avg(senior.cast("int")).alias("senior_share"),
        F.avg(F.when(senior, hit)).alias("senior_precision"),
        (F.sum(F.when(senior, hit).otherwise(0)) / F.greatest(F.sum(hit), F.lit(1))).alias("senior_recall"),
        F.avg(hit).alias("base_rate"),
    )
    named = model.select(F.col("macro_f1").alias("model_macro_f1"), F.col("accuracy").alias("model_accuracy"))
    return rest.join(F.broadcast(named))  # one row each


# ------------------------------------------------------------------------- gates
def promotion_gate(current: DataFrame, candidate: DataFrame, macro: float = 0.005, worst: float = 0.03) -> DataFrame:
    """Promote when macro F1 does not fall by more than ``macro`` and no class by more than ``worst``.

    Both are classification reports.
    """
    a = current.select("label", F.col("f1").alias("f1_current"))
    b = candidate.select("label", F.col("f1").alias("f1_candidate"))
    one = a.join(b, "label", "full_outer").agg(
        F.avg("f1_current").alias("current_macro_f1"),
        F.avg("f1_candidate").alias("candidate_macro_f1"),
        F.max(F.coalesce("f1_current", F.lit(0.0)) - F.coalesce("f1_candidate", F.lit(0.0))).alias("worst_class_drop"),
    )
    passes = (F.col("candidate_macro_f1") >= F.col("current_macro_f1") - macro) & (F.col("worst_class_drop") <= worst)
    return one.withColumn("promote", passes)


def augmentation_gate(base: DataFrame, augmented: DataFrame, gain: float = 0.002) -> DataFrame:
    """Keep the extra rows only for a real gain in macro F1; both are one-row summaries."""
    a = base.select(F.col("macro_f1").alias("base_macro_f1"))
    b = augmented.select(F.col("macro_f1").alias("augmented_macro_f1"))
    joined = a.join(F.broadcast(b))  # one row each
    return joined.withColumn("keep", F.col("augmented_macro_f1") - F.col("base_macro_f1") > gain)


def retrain_candidates(tickets: DataFrame, holdout: float = 0.2, min_new: int = 20) -> DataFrame:
    """Agent-labelled rows, unique by id, with ``part`` = train or probe by hash.

    With fewer than ``min_new`` rows nothing is worth retraining and the result is empty.
    """
    labelled = tickets.where(F.col("category_source") == "AGENT").dropDuplicates(["id"])
    enough = labelled.agg((F.count(F.lit(1)) >= min_new).alias("_enough"))
    word = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint")
    probe = word < F.lit(int(holdout * 2**32))
    kept = labelled.join(F.broadcast(enough)).where("_enough").drop("_enough")  # one row
    return kept.withColumn("part", F.when(probe, F.lit("probe")).otherwise(F.lit("train")))
