from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from deskstream.operators import evaluate, joins, lifecycle, metrics, projection

T0 = dt.datetime(2024, 3, 1)


def test_enterprise_urgent_is_due_in_15_minutes(spark):
    rows = [(1, "ENTERPRISE", "URGENT", T0), (2, "PRO", None, T0)]
    frame = spark.createDataFrame(rows, "id BIGINT, customer_tier STRING, priority STRING, created_at TIMESTAMP")
    due = {r["id"]: r["sla_due_at"] for r in joins.sla_due(frame, joins.sla_policies(spark)).collect()}
    assert due == {1: T0 + dt.timedelta(minutes=15), 2: T0 + dt.timedelta(minutes=480)}


REVIEW = (
    "draft_id BIGINT, agent_id BIGINT, action STRING, final_body STRING, reject_reason STRING, corrected_category STRING, "
    "corrected_priority STRING, rating INT, time_to_review_ms BIGINT, reviewed_at TIMESTAMP"
)


def test_review_rules(spark):
    drafts = spark.createDataFrame(
        [(k, k, "a generated kitten", "GENERATED") for k in (1, 2, 3, 4)], "id BIGINT, ticket_id BIGINT, body STRING, status STRING"
    )
    at = lambda m: T0 + dt.timedelta(minutes=m)
    reviews = spark.createDataFrame(
        [
            (1, 9, "REJECT", None, None, None, None, None, 10, at(1)),
            (2, 9, "EDIT_APPROVE", "short", None, None, None, None, 10, at(1)),
            (3, 9, "APPROVE", None, None, None, None, 5, 10, at(1)),
            (3, 8, "REJECT", None, "TONE", None, None, None, 10, at(2)),
            (4, 8, "EDIT_APPROVE", "  a generated sitting ", None, None, None, None, 10, at(2)),
        ],
        REVIEW,
    )
    tickets = spark.createDataFrame(
        [(k, "DRAFTED", "PENDING", None, None, None, 7 if k == 4 else None, 1) for k in (1, 2, 3, 4)],
        "id BIGINT, status STRING, draft_state STRING, resolution STRING, resolved_at TIMESTAMP, first_response_at TIMESTAMP, assigned_agent_id BIGINT, version INT",
    )
    after, new_drafts, feedback = lifecycle.apply_review(tickets, drafts, reviews)
    state = {r["id"]: (r["status"], r["assigned_agent_id"]) for r in after.collect()}
    assert state == {1: ("DRAFTED", None), 2: ("DRAFTED", None), 3: ("RESOLVED", 9), 4: ("RESOLVED", 7)}
    assert {r["id"]: r["status"] for r in new_drafts.collect()} == {1: "GENERATED", 2: "GENERATED", 3: "APPROVED", 4: "EDITED"}
    rows = {r["draft_id"]: r for r in feedback.collect()}
    assert rows[3]["edit_distance"] == 0 and rows[4]["final_body"] == "a generated sitting" and rows[4]["edit_distance"] == 3


def test_keyset_paging_sees_every_ticket_once(spark):
    frame = spark.createDataFrame([(k, float(k % 4) / 4 if k % 5 else None) for k in range(25)], "id BIGINT, escalation_risk FLOAT")
    after, seen, risks = None, [], []
    while True:
        rows = projection.keyset_page(frame, "risk", after, 10).collect()
        page = rows[:10]
        seen += [r["id"] for r in page]
        risks += [r["sort_val"] for r in page]
        if len(rows) <= 10:
            break
        after = (page[-1]["sort_val"], page[-1]["id"])
    assert sorted(seen) == list(range(25)) and len(set(seen)) == 25 and risks == sorted(risks, reverse=True)


def predictions(spark, rows):
    frame = spark.createDataFrame(rows, "id BIGINT, score FLOAT, created_at TIMESTAMP")
    return frame.selectExpr("id", "id AS ticket_id", "'CATEGORY' AS task", "'emb' AS model_name", "'BUG' AS label", "score", "created_at")


def test_drift_alert_and_quiet(spark):
    rows = [(k, 0.95, T0 - dt.timedelta(days=20)) for k in range(35)] + [(100 + k, 0.55, T0 - dt.timedelta(days=1)) for k in range(35)]
    p = predictions(spark, rows)
    t = p.select("id", F.lit("API").alias("source"))
    now = F.lit(str(T0)).cast("timestamp")
    out = metrics.drift_alert(p, t, now).first()
    assert out["alert"] and out["recent_low_share"] > 0.9 and out["baseline_low_share"] < 0.1 and "100% vs 0%" in out["reasons"][0]
    quiet = metrics.drift_alert(p.where("id = 100"), t, now).first()
    assert not quiet["enough_data"] and not quiet["alert"]


def test_seed_history_stays_out_of_live_metrics(spark):
    frame = spark.createDataFrame(
        [(1, "SEED", T0, "NEW", "STANDARD", False, 0.5), (2, "API", T0, "NEW", "SENIOR", True, 0.7)],
        "id BIGINT, source STRING, ingested_at TIMESTAMP, status STRING, queue STRING, sla_breached BOOLEAN, escalation_risk FLOAT",
    )
    now = F.lit(str(T0)).cast("timestamp")
    assert metrics.metric_totals(frame, now).first()["tickets"] == 1
    assert sum(r["tickets"] for r in metrics.risk_histogram(frame, now).collect()) == 2


def test_rank_metrics_with_ties_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    frame = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y INT, p DOUBLE")
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(evaluate.roc_auc(frame).first()["roc_auc"] - want) < 1e-12
    ap, seen = 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        recall = (y[p >= cut]).sum() / y.sum()
        ap += (recall - seen) * y[p >= cut].mean()
        seen = recall
    assert abs(evaluate.pr_auc(frame).first()["pr_auc"] - ap) < 1e-12


def test_incident_setting_is_the_quietest_good_one(spark):
    rows = [(0.55, 3, 1.0, 5.0, 9.0), (0.7, 3, 1.0, 6.0, 0.0), (0.8, 3, 0.5, 4.0, 0.0)]
    sweep = spark.createDataFrame(rows, "tau DOUBLE, window_h INT, recall DOUBLE, median_delay_min DOUBLE, false_alarms_per_week DOUBLE")
    assert [r["tau"] for r in evaluate.choose_incident_setting(sweep).where("chosen").collect()] == [0.7]
