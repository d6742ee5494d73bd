"""Streams drained over the small data set equal their batch counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from deskstream.operators import blockjoin, graph
from deskstream.plans.streams import StreamInputs
from deskstream.streaming import operators as op


def test_cluster_state_equals_the_batch_components(spark, inputs):
    stream = StreamInputs(inputs)
    vectors = stream.vectors.join(inputs.tickets.select(F.col("id").alias("ticket_id"), "customer_id"), "ticket_id")
    events = op.drain(op.stream_dedup_clusters(vectors, 0.25, 72.0, 24 * 60, 3, 2, idle_hours=24 * 365), "clusters").collect()
    label = {}
    for e in sorted((e for e in events if e["event"] == "ticket.linked"), key=lambda e: e["at"]):
        label[e["ticket_id"]] = e["cluster_id"]
    into = {e["cluster_id"]: e["ticket_id"] for e in events if e["event"] == "cluster.merged"}

    def root(c):
        while c in into:
            c = into[c]
        return c

    links = blockjoin.duplicate_links(inputs.vectors, 0.25, 72.0)
    want = {}
    for r in graph.connected_components(links).collect():
        want.setdefault(r["component"], set()).add(r["id"])
    got = {}
    for ticket, cluster in label.items():
        got.setdefault(root(cluster), set()).add(ticket)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_sink_repeats_a_batch_without_doubling(spark, tmp_path):
    from deskstream.session import scratch_path

    path = scratch_path(spark, "sink-test")
    batch = spark.range(5)
    for _ in range(2):
        batch.write.mode("overwrite").parquet(f"{path}/batch=0")
    assert spark.read.schema("id BIGINT, batch INT").parquet(path).count() == 5


def test_replay_arrives_in_time_order(spark, inputs):
    rows = inputs.tickets.select("id", "product", "created_at")
    seen = []
    op.run_batches(
        op.replay_stream(rows, 250),
        lambda batch, n: seen.append((n, *batch.agg(F.min("created_at"), F.max("created_at"), F.count(F.lit(1))).first())),
        "order",
    )
    seen.sort()
    assert sum(s[3] for s in seen) == rows.count() and len(seen) >= 4
    assert all(a[2] <= b[1] for a, b in zip(seen, seen[1:]))


def _cut(spark, frame, batches, order="created_at"):
    """``frame`` as a file stream of so many micro-batches, in the order of ``order``."""
    import math

    from deskstream.session import scratch_path

    rows = sorted(frame.collect(), key=lambda r: (r[order], r["id"]))
    path = scratch_path(spark, "cut")
    step = math.ceil(len(rows) / batches)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], frame.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_keeps_the_earliest_however_the_input_is_cut(spark, inputs):
    from deskstream.operators import ingest

    rows = inputs.uploads.withColumn("created_at", F.coalesce(ingest.parse_created_at(F.col("created_raw")), F.lit("2024-01-01").cast("timestamp"))).limit(600)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    valid = [r for r in ingest.validate_rows(rows).where(F.col("error").isNull()).collect()]
    first = {}
    for r in valid:
        key = r["external_id"] if r["external_id"] is not None else ("row", r["id"])
        if key not in first or (r["created_at"], r["arrival"], r["id"]) < first[key]:
            first[key] = (r["created_at"], r["arrival"], r["id"])
    mark = max(r["created_at"] for r in valid if r["external_id"] is not None)
    want = sorted(v[2] for k, v in first.items() if isinstance(k, tuple) or v[0] < mark)
    for batches in (1, 8):
        out = op.drain(op.stream_ingest(_cut(spark, rows, batches), "0 seconds"), "cut-ingest")
        assert out.columns == rows.columns
        got = out.collect()
        assert sorted(r["id"] for r in got) == want
        by_id = {r["id"]: r for r in valid}
        assert all(r["created_at"] == by_id[r["id"]]["created_at"] and r["subject"] == by_id[r["id"]]["subject"] for r in got)


def test_latency_and_bursts_do_not_depend_on_the_cut(spark, inputs):
    tickets = inputs.tickets.select("id", "product", "customer_id", "created_at", "ingested_at", "triaged_at", "drafted_at")
    seen, bursts = set(), set()
    for batches in (1, 6):
        seen.add(tuple(op.stream_pipeline_latency(_cut(spark, tickets, batches)).first()))
        burst = op.drain(op.stream_burst(_cut(spark, tickets, batches), "60 minutes", "10 minutes", 2, 2), "cut-burst")
        bursts.add(tuple(sorted(tuple(r) for r in burst.collect())))
    assert len(seen) == 1 and len(bursts) == 1
    import numpy as np

    rows = tickets.collect()
    seconds = [[(r[end] - r["ingested_at"]).total_seconds() for r in rows if r[end] is not None] for end in ("triaged_at", "drafted_at")]
    assert np.allclose(next(iter(seen)), [np.percentile(x, p) for x in seconds for p in (50, 95)])


def test_deadlines_share_a_bucket_and_do_not_depend_on_the_cut(spark, inputs, monkeypatch):
    tickets = inputs.tickets.select("id", "created_at", "sla_due_at", "first_response_at").limit(400)
    tickets = spark.createDataFrame(tickets.collect(), tickets.schema)
    rows = tickets.collect()
    mark = max(max(r["created_at"], r["first_response_at"] or r["created_at"]) for r in rows)
    open_ = [r for r in rows if r["sla_due_at"] and (r["first_response_at"] is None or r["first_response_at"] > r["sla_due_at"])]
    calls = spark.sparkContext.accumulator(0)
    step = op._deadlines

    def counted(key, frames, state):
        calls.add(1)
        yield from step(key, frames, state)

    monkeypatch.setattr(op, "_deadlines", counted)
    monkeypatch.setattr(op, "BUCKETS", 4)
    for batches, wait in ((1, dt.timedelta(0)), (5, dt.timedelta(days=1))):
        stream = _cut(spark, tickets, batches)
        answers = stream.where("first_response_at IS NOT NULL").selectExpr("id AS ticket_id", "first_response_at AS responded_at")
        out = op.drain(op.stream_sla_breach(stream, answers, f"{wait.days} days"), "cut-breach").collect()
        want = sorted((r["id"], r["sla_due_at"]) for r in open_ if r["sla_due_at"] < mark - wait)
        assert sorted((r["ticket_id"], r["breached_at"]) for r in out) == want and want
    assert 0 < calls.value < 100  # a call per bucket and micro-batch, not per ticket


def test_best_of_the_window_are_read_off_the_classes():
    """Equal to comparing with every ticket of the window, while a class is compared with another once."""
    import numpy as np

    rng = np.random.default_rng(7)
    topics = rng.normal(size=(12, 8))
    topics /= np.linalg.norm(topics, axis=1)[:, None]
    held, rows = op._Window(0.2), []
    for k in range(2500):
        v = topics[rng.integers(12)] if k % 3 else rng.normal(size=8) / 3  # every third vector occurs once
        number, kind = held.add((k * 7) % 2501, k, "c", v)
        best = held.best(number, kind)
        scores = [(-s, i, n) for n, i, s in ((n, i, round(float(w @ v), 9)) for n, i, w in rows) if s >= 0.2]
        assert best == [n for _, _, n in sorted(scores)[:20]]
        rows.append((number, (k * 7) % 2501, v))
        if len(rows) > 150:
            assert held.leave()[0] == rows.pop(0)[0]
    assert held.classes <= 2 * 151 + 1025 and all(len(held.near[k][1]) <= held.classes for k in held.near)


def test_bursts_count_customers_once_without_a_row_per_customer_and_window(spark):
    from deskstream.session import scratch_path

    start = dt.datetime(2024, 1, 1)
    rows = [(k, "api", k % 90, start + dt.timedelta(seconds=37 * k % 9000)) for k in range(400)]
    rows += [(400 + k, "web-app", None, start + dt.timedelta(minutes=7 * k)) for k in range(9)] + [(500, "api", 1, start + dt.timedelta(days=1))]
    path = scratch_path(spark, "burst-rows")
    schema = "id BIGINT, product STRING, customer_id BIGINT, created_at TIMESTAMP"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stream = op.stream_burst(spark.readStream.schema(schema).parquet(path), "60 minutes", "1 minute", 3, 2)
    ran = stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", scratch_path(spark, "bursts")).trigger(availableNow=True).start()
    ran.awaitTermination()
    got = {tuple(r) for r in spark.table("bursts").collect()}
    minute, want = dt.timedelta(minutes=1), set()
    for product in ("api", "web-app"):
        for k in range(-60, 160):
            a, b = start + k * minute, start + (k + 60) * minute
            inside = [r for r in rows if r[1] == product and a <= r[3] < b]
            who = {f"t{r[0]}" if r[2] is None else str(r[2]) for r in inside}
            if len(inside) >= 3 and len(who) >= 2:
                want.add((a, b, product, len(inside), len(who)))
    assert got == want
    kept = sum(o.numRowsUpdated for p in ran.recentProgress for o in p.stateOperators)
    assert kept < 10 * len(rows)  # a row per customer and window would be 60 times the tickets
