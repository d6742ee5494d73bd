"""Pairs, clusters, replay and search against brute force on small fixtures."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskstream.operators import blockjoin, graph, joins, lifecycle, metricindex, search, windows

T0 = dt.datetime(2024, 1, 1)
VECTORS = "ticket_id BIGINT, product STRING, created_at TIMESTAMP, customer_id BIGINT, embedding ARRAY<FLOAT>"


def tickets(n=240, topics=6, seed=3, hot=0.5):
    """Tickets around topic vectors; one product and one exact copy group are hot."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(topics, 16))
    out = []
    for k in range(n):
        topic = 0 if rng.random() < hot else int(rng.integers(topics))
        noise = 0.0 if topic == 0 and rng.random() < 0.6 else 0.35
        v = base[topic] + rng.normal(size=16) * noise
        v = (v / np.linalg.norm(v)).astype(np.float32)
        product = "api" if rng.random() < 0.7 else "web-app"
        at = T0 + dt.timedelta(seconds=int(rng.integers(0, 30 * 3600)))
        out.append((k, product, at, int(rng.integers(0, 9)) if rng.random() < 0.9 else None, v.tolist()))
    return out


def brute_links(rows, tau, hours, k=20):
    links = {}
    for a in rows:
        found = []
        for b in rows:
            earlier = (b[2], b[0]) < (a[2], a[0])
            if a[1] == b[1] and earlier and a[2] - b[2] <= dt.timedelta(hours=hours):
                s = round(float(np.dot(np.array(a[4], float), np.array(b[4], float))), 9)
                if s >= tau:
                    found.append((-s, b[0]))
        links[a[0]] = [i for _, i in sorted(found)[:k]]
    return links


@pytest.mark.parametrize("block", [7, 4096])
def test_links_equal_brute_force_for_any_block_size(spark, block):
    rows = tickets()
    frame = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in blockjoin.duplicate_pairs(frame, 0.7, 3.0, 20, block).collect():
        got.setdefault(r["ticket_id"], set()).add(r["similar_id"])
    want = {i: set(x) for i, x in brute_links(rows, 0.7, 3.0).items() if x}
    assert got == want
    counts = {r["ticket_id"]: r["similar_recent"] for r in blockjoin.similar_recent(frame, 0.7, 3.0, None, block).collect()}
    assert counts == {i: len(x) for i, x in brute_links(rows, 0.7, 3.0, 10**6).items()}


def test_closed_candidates_are_left_out(spark):
    v = [1.0, 0.0]
    rows = [(1, "api", T0, T0 + dt.timedelta(minutes=5), v), (2, "api", T0 + dt.timedelta(minutes=10), None, v), (3, "api", T0 + dt.timedelta(minutes=20), None, v)]
    frame = spark.createDataFrame(rows, "ticket_id BIGINT, product STRING, created_at TIMESTAMP, resolved_at TIMESTAMP, embedding ARRAY<FLOAT>")
    assert {(r[0], r[1]) for r in blockjoin.duplicate_pairs(frame).collect()} == {(3, 2)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(links):
    parent = {i: i for i in links}
    for a, others in links.items():
        for b in others:
            ra, rb = find(parent, a), find(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
    linked = {i for i, x in links.items() if x} | {b for x in links.values() for b in x}
    return {i: find(parent, i) for i in linked}


def test_components_and_long_chain(spark):
    rows = tickets(seed=5)
    links = brute_links(rows, 0.7, 3.0)
    edges = [(a, b) for a, x in links.items() for b in x] + [(k, k + 1) for k in range(1000, 1200)]
    frame = spark.createDataFrame(edges, "ticket_id BIGINT, similar_id BIGINT")
    got = {r["id"]: r["component"] for r in graph.connected_components(frame).collect()}
    want = brute_components(links)
    want.update({k: 1000 for k in range(1000, 1201)})
    assert got == want


def brute_replay(rows, links, burst_min, min_tickets, min_customers, cover=0.5):
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    parent = {r[0]: r[0] for r in rows}
    seen, alarms = [], []
    for r in order:
        seen.append(r)
        for b in links[r[0]]:
            parent[find(parent, b)] = find(parent, r[0])
        root = find(parent, r[0])
        live = [x for x in seen if find(parent, x[0]) == root and r[2] - x[2] <= dt.timedelta(minutes=burst_min)]
        who = {x[3] if x[3] is not None else ("t", x[0]) for x in live}
        if len(live) >= min_tickets and len(who) >= min_customers:
            now = {x[0] for x in live}
            covered = any(r[2] - t <= dt.timedelta(minutes=burst_min) and len(now & s) >= cover * len(now) for t, s in alarms)
            if not covered:
                alarms.append((r[2], now))
    return {(t, tuple(sorted(s))) for t, s in alarms}


@pytest.mark.parametrize("burst", [60, 600])
def test_replay_equals_brute_force(spark, burst):
    rows = tickets(n=300, seed=11)
    links = brute_links(rows, 0.7, 3.0)
    frame = spark.createDataFrame(rows, VECTORS)
    linked = blockjoin.duplicate_links(frame, 0.7, 3.0)
    components = graph.connected_components(linked)
    base = frame.select(F.col("ticket_id").alias("id"), "created_at", "customer_id")
    got = graph.incident_replay(base, linked, components, 3.0, burst, 5, 3)
    want = brute_replay(rows, links, burst, 5, 3)
    assert {(r["alarm_at"], tuple(r["members"])) for r in got.collect()} == want and want


def test_suppression_tells_every_burst_and_which_alarms_are_raised(spark):
    rows = tickets(n=200, seed=12)
    frame = spark.createDataFrame(rows, VECTORS)
    linked = blockjoin.duplicate_links(frame, 0.7, 3.0)
    components = graph.connected_components(linked)
    base = frame.select(F.col("ticket_id").alias("id"), "created_at", "customer_id")
    got = graph.alarm_suppression(base, linked, components, 3.0, 90, 5, 3).collect()
    free = graph.incident_replay(base, linked, components, 3.0, 90, 5, 3, cover=1.5)
    assert {(r["ticket_id"], r["live"]) for r in got} == {(r["ticket_id"], len(r["members"])) for r in free.collect()}
    raised = graph.incident_replay(base, linked, components, 3.0, 90, 5, 3)
    assert {r["ticket_id"] for r in got if r["kept"]} == {r["ticket_id"] for r in raised.collect()} and len(got) > sum(r["kept"] for r in got)


def test_late_joins_cost_no_pass_over_the_live_members():
    """A large cluster takes up older single tickets one by one: the work grows with the tickets, not with both."""
    import time

    def seconds(n):
        state, start = graph._Replay(10**9, 10**9, 3, 2, 0.5), time.perf_counter()
        for k in range(n):
            state.arrive(k, k, str(k), [])
        for k in range(n):
            state.arrive(n + k, n + k, "a", [n + k - 1] if k else [])
        for k in range(n):
            state.arrive(2 * n + k, 2 * n + k, "b", [2 * n + k - 1, k])
        return time.perf_counter() - start

    assert seconds(8000) < 30 * max(seconds(1000), 0.01)


def test_contraction_works_on_whole_tasks(spark):
    edges = spark.range(1, 40_001, 1, 1).select(F.col("id").alias("u"), F.lit(0).cast("bigint").alias("v"))
    twice = edges.unionByName(edges).coalesce(1)
    assert graph._contract(twice).count() == 40_000
    assert graph._contract(twice, room=7_000).distinct().count() == 40_000


def test_six_reports_make_one_incident_and_the_seventh_reuses_the_draft(spark):
    topic = [1.0, 0.0, 0.0]
    rows = [(k, "api", T0 + dt.timedelta(minutes=k), k, topic) for k in range(1, 7)]
    frame = spark.createDataFrame(rows, VECTORS)
    base = frame.select(F.col("ticket_id").alias("id"), "product", F.lit("down").alias("subject"), "created_at", "customer_id")
    clusters, members = graph.duplicate_clusters(base, blockjoin.duplicate_links(frame))
    flagged = graph.incidents(members, clusters, 60, 5, 3).collect()
    assert [(r["size"], r["is_incident"], r["canonical_ticket_id"]) for r in flagged] == [(6, True, 1)]

    seventh = spark.createDataFrame([(7, 1)], "id BIGINT, cluster_id BIGINT")
    known = members.select("id", "cluster_id").unionByName(seventh)
    drafts = spark.createDataFrame(
        [(50, 1, "GENERATED", None, T0 + dt.timedelta(minutes=8), "reply", None, "STRONG", None)],
        "id BIGINT, ticket_id BIGINT, status STRING, reused_from_draft_id BIGINT, created_at TIMESTAMP, body STRING, citations STRING, grounding STRING, sources STRING",
    )
    incident = spark.createDataFrame([(1, True)], "id BIGINT, is_incident BOOLEAN")
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    match = {r["ticket_id"]: r["draft_id"] for r in joins.reusable_draft(known, drafts, incident, now).collect()}
    assert match[7] == 50 and 1 not in match
    copies = lifecycle.reuse_incident_draft(known, drafts, incident, now).where("ticket_id = 7").collect()
    assert copies[0]["reused_from_draft_id"] == 50 and copies[0]["model"] == "incident-reuse" and copies[0]["cost_usd"] == 0


def test_unrelated_tickets_have_no_cluster(spark):
    rows = [(1, "api", T0, 1, [1.0, 0.0]), (2, "api", T0 + dt.timedelta(minutes=1), 2, [0.0, 1.0])]
    links = blockjoin.duplicate_links(spark.createDataFrame(rows, VECTORS))
    assert graph.connected_components(links).count() == 0


def test_near_dup_removal_is_the_greedy_order(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 8))
    rows = []
    for k in range(120):
        v = base[int(rng.integers(8))] + rng.normal(size=8) * float(rng.choice([0.0, 0.15, 0.3]))
        v = (v / np.linalg.norm(v)).astype(np.float32)
        rows.append((k, "train" if k % 3 else "test", "INC" if k % 10 == 0 else None, v.tolist()))
    dropped = set()
    background = [r for r in rows if r[2] is None]
    for n, a in enumerate(background):
        if a[0] in dropped:
            continue
        for b in background[n + 1 :]:
            if a[1] == b[1] and round(float(np.dot(np.array(a[3], float), np.array(b[3], float))), 9) > 0.97:
                dropped.add(b[0])
    frame = spark.createDataFrame(rows, "id BIGINT, split STRING, incident_id STRING, embedding ARRAY<FLOAT>")
    kept = {r["id"] for r in graph.near_dup_removal(frame, 0.97).collect()}
    assert kept == {r[0] for r in rows} - dropped and dropped


@pytest.mark.parametrize("block", [5, 4096])
def test_nearest_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 8))
    m = np.round(m / np.linalg.norm(m, axis=1, keepdims=True), 2)
    m[10:20] = m[10]  # ties
    m = m.astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id BIGINT, embedding ARRAY<FLOAT>")
    got = {}
    for r in metricindex.vector_topk(frame, frame, 5, block).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    s = np.round(m.astype(float) @ m.astype(float).T, 9)
    want = {q: sorted((i for i in range(60) if i != q), key=lambda i: (-s[q, i], i))[:5] for q in range(60)}
    assert got == want


def test_bm25_block_size_does_not_matter(spark):
    docs = [(1, "reset the token"), (2, "token token expired"), (3, "invoice wrong"), (4, "invoice token"), (5, "slow sync")]
    frame = spark.createDataFrame(docs, "id BIGINT, text STRING").select("id", F.split("text", " ").alias("tokens"))
    query = spark.createDataFrame([(9, ["token", "expired"])], "id BIGINT, tokens ARRAY<STRING>")
    bag = search.inverted_index(query).select("id", "term", F.col("tf").cast("double").alias("weight"))
    weights = search.bm25_weights(frame)
    for block in (1, 1000):
        hits = search.sparse_topk(bag, weights, 3, block=block).orderBy("rank").collect()
        assert [h["id"] for h in hits][0] == 2 and len(hits) == 3


def test_look_back_counts_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [
        (k, int(rng.integers(0, 3)) if rng.random() < 0.9 else None, T0 + dt.timedelta(minutes=int(rng.integers(0, 4000))), 1 + k % 2)
        for k in range(300)
    ]
    frame = spark.createDataFrame(rows, "id BIGINT, customer_id BIGINT, created_at TIMESTAMP, cluster_id BIGINT")
    got = {r["id"]: r["n"] for r in windows.prior_tickets(frame, days=1, name="n").collect()}
    day = dt.timedelta(days=1)
    want = {a[0]: sum(1 for b in rows if a[1] is not None and a[1] == b[1] and a[2] - day <= b[2] < a[2]) for a in rows}
    assert got == want
    live = {r["id"]: (r["live_tickets"], r["live_customers"]) for r in windows.live_counts(frame, 120).collect()}
    span = dt.timedelta(minutes=120)
    for a in rows:
        inside = [b for b in rows if b[3] == a[3] and a[2] - span <= b[2] <= a[2]]
        who = {b[1] if b[1] is not None else ("t", b[0]) for b in inside}
        assert live[a[0]] == (len(inside), len(who))


def test_exact_percentiles_with_a_hot_value(spark):
    values = [1.0] * 700 + [float(k) for k in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    row = windows.exact_percentiles(frame, "v", [0.5, 0.95, 0.999], ["a", "b", "c"]).first()
    assert np.allclose(list(row), np.percentile(values, [50, 95, 99.9]))
    empty = windows.exact_percentiles(frame.where("v < 0"), "v", [0.5], ["a"]).first()
    assert empty["a"] == 0.0


def test_results_do_not_depend_on_the_number_of_partitions(spark, inputs):
    from deskstream.plans.similarity import incidents_of

    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = incidents_of(inputs, tau=0.25, window_hours=72.0).select("cluster_id", "size", "is_incident").collect()
        seen.add(tuple(sorted(map(tuple, rows))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_equal_vectors_are_multiplied_once(spark, monkeypatch):
    """Many tickets with few vectors: only classes of equal vectors meet in products, and no link is lost or added."""
    rng = np.random.default_rng(5)
    rows = []
    vectors = rng.normal(size=(6, 4))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    for n in range(300):
        at = T0 + dt.timedelta(minutes=int(rng.integers(0, 400)) * 20)
        rows.append((n, None if n % 50 == 0 else "ab"[n % 2], at, vectors[n % 6].tolist()))
    frame = spark.createDataFrame(rows, "ticket_id BIGINT, product STRING, created_at TIMESTAMP, embedding ARRAY<DOUBLE>")
    seen = []
    join = blockjoin.block_join

    def spied(left, right, *args, **more):
        if "embedding" in left.columns:
            seen.append((left.count(), right.count()))
        return join(left, right, *args, **more)

    monkeypatch.setattr(blockjoin, "block_join", spied)
    want = {}
    for i, p, at, v in rows:
        near = [
            (-round(float(np.dot(v, w)), 9), j) for j, q, t, w in rows
            if q == p and at - dt.timedelta(hours=20) <= t and (t, j) < (at, i) and round(float(np.dot(v, w)), 9) >= 0.5
        ]
        want[i] = sorted(near)
    for block in (7, 4096):
        got = blockjoin.duplicate_pairs(frame, 0.5, 20.0, 5, block).collect()
        assert sorted((r[0], r[1]) for r in got) == sorted((i, j) for i, near in want.items() for _, j in near[:5])
        every = blockjoin.duplicate_pairs(frame, 0.5, 20.0, None, block).collect()
        assert sorted((r[0], r[1]) for r in every) == sorted((i, j) for i, near in want.items() for _, j in near)
        counts = {r[0]: r[1] for r in blockjoin.similar_recent(frame, 0.5, 20.0, None, block).collect()}
        assert counts == {i: len(near) for i, near in want.items()}
    assert len(seen) == 6 and all(right < 200 for _, right in seen)  # 300 tickets


def test_near_duplicates_lose_no_link(spark):
    """Equal vectors of two labels are a pair, and pairs with the rows they stand for are all pairs above the threshold."""
    from types import SimpleNamespace

    from deskstream.plans import similarity

    rng = np.random.default_rng(4)
    base = [v / np.linalg.norm(v) for v in rng.normal(size=(6, 3))]
    rows = [(k, "val" if k % 3 else "test", k % 2, "x" if k % 11 == 0 else None, base[int(rng.integers(6))].astype(np.float32).tolist()) for k in range(40)]
    frame = spark.createDataFrame(rows, "ticket_id BIGINT, split STRING, label INT, incident_id STRING, embedding ARRAY<FLOAT>")
    given = SimpleNamespace(labelled=frame)
    kept = [r for r in rows if r[3] is None]
    close = lambda a, b: a[1] == b[1] and a[0] < b[0] and np.dot(np.array(a[4], float), np.array(b[4], float)) > 0.40
    want = {(a[0], b[0]) for a in kept for b in kept if close(a, b)}
    pairs = {(r["first_id"], r["second_id"]) for r in similarity._near_pairs(given).collect()}
    stands = {r["id"]: r["first_id"] for r in similarity._near_members(given).collect()}
    assert set(stands) == {r[0] for r in kept}
    linked = lambda a, b: a == b or (min(a, b), max(a, b)) in pairs
    got = {(a[0], b[0]) for a in kept for b in kept if a[1] == b[1] and a[0] < b[0] and linked(stands[a[0]], stands[b[0]])}
    assert got == want and pairs <= want
    assert any(a[4] == b[4] and a[2] != b[2] for a in kept for b in kept if (a[0], b[0]) in pairs)


def test_incident_setting_is_chosen_before_the_test_period(spark, monkeypatch):
    """The query sweeps the days of training and validation alone, and judges the other days and all days at what was chosen."""
    from types import SimpleNamespace

    from deskstream.operators import evaluate
    from deskstream.plans import similarity

    rows = [(k, p, at + dt.timedelta(days=23), who, v) for k, p, at, who, v in tickets(n=90, seed=8)]  # 24 and 25 January
    vectors = spark.createDataFrame(rows, VECTORS)
    named = vectors.withColumns({"incident_id": F.when(F.col("product") == "api", F.concat(F.lit("I"), F.dayofmonth("created_at")))})
    given = SimpleNamespace(vectors=vectors, tickets=vectors.withColumnRenamed("ticket_id", "id"), labelled=named)
    swept = []

    def sweep(v, t, truth, taus, windows, *rest):
        swept.append([frame.count() for frame in (v, t, truth)])
        assert taus == similarity.SETTINGS_TAU and windows == similarity.SETTINGS_HOURS
        return spark.createDataFrame([(0.7, 3.0, True), (0.1, 3.0, False)], "tau DOUBLE, window_h DOUBLE, chosen BOOLEAN")

    monkeypatch.setattr(evaluate, "incident_sweep", sweep)
    got = {r["period"]: r for r in similarity._incident_eval(given).collect()}
    late = [r for r in rows if r[2].day > 24]
    assert swept == [[90 - len(late)] * 3] and 0 < len(late) < 90
    for period, part in (("test", late), ("full", rows)):
        want = brute_replay(part, brute_links(part, 0.7, 3.0), similarity.BURST_MINUTES, similarity.MIN_TICKETS, similarity.MIN_CUSTOMERS)
        assert got[period]["alarms"] == len(want) > 0 and (got[period]["tau"], got[period]["window_h"]) == (0.7, 3.0)
        assert got[period]["incidents"] == len({r[2].day for r in part if r[1] == "api"})


def test_candidates_of_a_class_never_leave_a_task(spark, monkeypatch):
    """One join, over rows of classes: no table of pairs of a class and its candidates is laid out for a second one."""
    rows = tickets(n=120, seed=9)
    seen, join = [], blockjoin.block_join

    def spied(left, right, *args, **more):
        seen.append((right.select(F.explode("ids")).count(), right.count()))
        return join(left, right, *args, **more)

    monkeypatch.setattr(blockjoin, "block_join", spied)
    assert blockjoin.similar_recent(spark.createDataFrame(rows, VECTORS), 0.7, 3.0).count() == 120
    assert len(seen) == 1 and seen[0][0] == 120 > seen[0][1]
