"""Structured Streaming operators: ingest, windows, state, enrichment, sinks.

Times are event times. A watermark bounds the state of every operator; what a watermark
closes is emitted once (append mode).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heapify

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deskstream.functions import scoring
from deskstream.operators import ingest, windows
from deskstream.operators.graph import _Live
from deskstream.schemas import DEFAULTS
from deskstream.session import scratch_path


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over everything available and return what it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(path)


NEVER = 2**62
BUCKETS = 512  # keys that share their state as one table; a constant, because the state outlives the cluster it began on


def bucket(key: str) -> Column:
    """The bucket of a key. Python is called once per bucket and micro-batch, not once per key."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _packed(table: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(table, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas()


def _store(state: GroupState, tables: tuple[pd.DataFrame, ...], due_ms: int) -> None:
    """Keep the tables of a bucket and call again when the watermark has passed ``due_ms``."""
    if not any(len(t) for t in tables):
        state.remove()
        return
    state.update(tuple(_packed(t) for t in tables))
    if due_ms < NEVER:
        state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs()))


def _earliest(remember_ms: int) -> Callable:
    """Per external id: the earliest row so far, held until the watermark passes it, then remembered as sent."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, sent = (_unpacked(x) for x in state.get) if state.exists else (None, pd.DataFrame({"external_id": pd.Series(dtype="object"), "at": pd.Series(dtype="int64")}))
        rows = [] if held is None else [held]
        if not state.hasTimedOut:
            fresh = pd.concat(list(frames))[["external_id", "at", "arrival", "id", "payload"]]
            rows.append(fresh[~fresh["external_id"].isin(sent["external_id"])])
        best = pd.concat(rows).sort_values(["at", "arrival", "id"], kind="stable").drop_duplicates("external_id")
        mark = state.getCurrentWatermarkMs()
        done = best["at"] // 1000 < mark
        out = best.loc[done, "payload"]
        sent = pd.concat([sent[sent["at"] // 1000 + remember_ms >= mark], best.loc[done, ["external_id", "at"]]])
        best = best[~done]
        ends = [best["at"].min() // 1000] if len(best) else []
        ends += [sent["at"].min() // 1000 + remember_ms] if len(sent) else []
        _store(state, (best, sent), int(min(ends, default=NEVER)))
        yield pd.DataFrame({"payload": out})

    return step


def stream_ingest(rows: DataFrame, watermark: str = "10 minutes", remember_days: float = 60) -> DataFrame:
    """Valid rows, each external id once; rows without one always pass.

    Of the rows of an external id the earliest wins (created_at, then arrival, then id), however the input is cut
    into micro-batches: it is held until the watermark passes its time, when no earlier row can follow, and later
    repeats are dropped for ``remember_days``. ``rows`` has id, arrival, created_at.
    """
    rocksdb_state(rows)
    valid = ingest.validate_rows(rows).where(F.col("error").isNull()).drop("error")
    form = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    packed = valid.where(F.col("external_id").isNotNull()).select(
        "external_id", "created_at", F.unix_micros("created_at").alias("at"), F.col("arrival").cast("bigint").alias("arrival"), F.col("id").cast("bigint").alias("id"),
        F.to_json(F.struct(*valid.columns), form).alias("payload"),
    )
    held = packed.withWatermark("created_at", watermark).withColumn("bucket", bucket("external_id")).groupBy("bucket").applyInPandasWithState(
        _earliest(int(remember_days * 86_400_000)), "payload STRING", "held BINARY, sent BINARY", "append", GroupStateTimeout.EventTimeTimeout
    )
    once = held.select(F.from_json("payload", valid.schema, form).alias("row")).select("row.*")
    return once.unionByName(valid.where(F.col("external_id").isNull()))


def stream_volume(tickets: DataFrame, every: str = "1 minute", keys: tuple[str, ...] = ("product",), watermark: str = "10 minutes") -> DataFrame:
    """Tickets per tumbling window and key."""
    counted = tickets.withWatermark("created_at", watermark).groupBy(F.window("created_at", every), *keys)
    return counted.agg(F.count(F.lit(1)).alias("tickets")).select(F.col("window.start").alias("window_start"), *keys, "tickets")


class _LastSeen(StatefulProcessor):
    """Per bucket of customers: how long before a slide with tickets the same customer had one, at most ``size``.

    Slides arrive closed, so those of a later micro-batch are later. What is kept is the last slide of every
    customer seen within ``size``.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "who STRING, us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["who", "us"], kind="stable")
        known = pd.DataFrame(list(self.last.get()), columns=["who", "us"]).set_index("who")["us"].astype("int64")
        before = frame.groupby("who")["us"].shift().fillna(frame["who"].map(known))
        frame["gap"] = (frame["us"] - before).fillna(self.size).clip(upper=self.size).astype("int64")
        latest = frame.groupby("who")["us"].max()
        latest = pd.concat([known[~known.index.isin(latest.index)], latest])
        latest = latest[latest > timerValues.getCurrentWatermarkInMs() * 1000 - self.size]
        if len(latest):
            self.last.put(list(zip(latest.index.tolist(), latest.tolist())))
        else:
            self.last.clear()
        yield frame.drop(columns=["bucket", "who", "us"])

    def close(self) -> None:
        pass


def stream_burst(
    tickets: DataFrame,
    size: str = "60 minutes",
    slide: str = "1 minute",
    min_tickets: int = DEFAULTS.burst_min_tickets,
    min_customers: int = DEFAULTS.burst_min_customers,
    keys: tuple[str, ...] = ("product",),
    watermark: str = "10 minutes",
) -> DataFrame:
    """Sliding windows with enough tickets from enough customers, counted exactly.

    A customer's tickets of a slide add up first. A customer counts in a window at its first slide there: the one
    whose distance from the customer's slide before is longer than that from the window's start. So slides add up
    by key and distance, over all customers, before they are spread over the windows they lie in: what is spread
    grows with the time covered, not with the tickets. Tickets without a customer count as one each.
    """
    rocksdb_state(tickets)
    who = F.coalesce(F.col("customer_id").cast("string"), F.concat(F.lit("t"), F.col("id").cast("string"))).alias("_who")
    timed = tickets.withWatermark("created_at", watermark)
    slides = timed.groupBy(F.window("created_at", slide).alias("w"), *keys, who).agg(F.count(F.lit(1)).alias("n"))
    named = slides.select(F.window_time("w").alias("at"), *keys, F.to_json(F.struct(*keys, "_who")).alias("who"), "n")
    named = named.withColumns({"us": F.unix_micros("at"), "bucket": bucket("who")})
    micros = tickets.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {size})").first()[0]
    kinds = ", ".join(f"`{k}` {tickets.schema[k].dataType.simpleString()}" for k in keys)
    apart = named.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_LastSeen(micros), outputStructType=f"at TIMESTAMP, {kinds}, n BIGINT, gap BIGINT",
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="at",
    )
    added = apart.groupBy(F.window("at", slide).alias("w"), *keys, "gap").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("slides"))
    spread = added.select(F.window_time("w").alias("at"), *keys, "gap", "n", "slides")
    spread = spread.select(F.window("at", size, slide).alias("w"), "at", *keys, "gap", "n", "slides")
    fresh = F.col("gap") > F.unix_micros("at") - F.unix_micros("w.start")
    counted = spread.groupBy("w", *keys).agg(F.sum("n").alias("tickets"), F.sum(F.when(fresh, F.col("slides")).otherwise(0)).alias("customers"))
    return counted.where((F.col("tickets") >= min_tickets) & (F.col("customers") >= min_customers)).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "tickets", "customers"
    )


def stream_sessions(tickets: DataFrame, gap: str = "3 hours", keys: tuple[str, ...] = ("product",), watermark: str = "10 minutes") -> DataFrame:
    """Runs of reports without an idle gap."""
    counted = tickets.withWatermark("created_at", watermark).groupBy(F.session_window("created_at", gap), *keys)
    return counted.agg(F.count(F.lit(1)).alias("tickets")).select(
        F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "tickets"
    )


# ------------------------------------------------------- clusters, kept as state
CLUSTER_EVENTS = "event STRING, product STRING, cluster_id BIGINT, ticket_id BIGINT, at TIMESTAMP, size BIGINT"


class _Window:
    """Tickets of the look-back window by class of equal vectors, and the clusters they belong to.

    Similarities are computed once per pair of classes, not per pair of tickets. The members of a class are kept
    in the order of their ids, so the 20 best of a ticket are read off the classes it resembles, best first.
    """

    ROOM = 4_000_000  # similar classes remembered, beyond that they are computed anew

    def __init__(self, tau: float):
        self.tau = tau
        self.rows: deque[tuple[int, int, str, int]] = deque()  # (number, at, who, class) in the order of arrival
        self.ids: dict[int, int] = {}  # of the rows in the window, by number
        self.label: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        self.number = 0
        self._reset(np.zeros((0, 0)))

    def _reset(self, vectors: np.ndarray) -> None:
        self.vectors, self.classes = vectors, len(vectors)
        self.known = {v.tobytes(): k for k, v in enumerate(vectors)}
        self.members: list[list[tuple[int, int]]] = [[] for _ in range(len(vectors))]
        self.near: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        self.seen: Counter[int] = Counter()
        self.held = 0

    def _compact(self) -> None:
        """Forget the classes that have no member left."""
        live = [k for k in range(self.classes) if self.members[k]]
        at = {k: n for n, k in enumerate(live)}
        members = [self.members[k] for k in live]
        self._reset(self.vectors[live])
        self.members = members
        self.rows = deque((n, t, w, at[k]) for n, t, w, k in self.rows)

    def root(self, cluster: int) -> int:
        while (up := self.parent.get(cluster, cluster)) != cluster:
            self.parent[cluster] = self.parent.get(up, up)
            cluster = up
        return cluster

    def add(self, ticket: int, at: int, who: str, vector: np.ndarray) -> tuple[int, int]:
        """(number, class) of a new row."""
        if self.classes > 2 * len(self.rows) + 1024:
            self._compact()
        key = vector.tobytes()
        if key not in self.known:
            if self.classes == len(self.vectors):
                wider = np.zeros((2 * self.classes + 64, len(vector)))
                if self.classes:
                    wider[: self.classes] = self.vectors[: self.classes]
                self.vectors = wider
            self.vectors[self.classes] = vector
            self.known[key] = self.classes
            self.members.append([])
            self.classes += 1
        kind, number = self.known[key], self.number
        self.number += 1
        self.rows.append((number, at, who, kind))
        self.ids[number] = ticket
        insort(self.members[kind], (ticket, number))
        return number, kind

    def leave(self) -> tuple[int, int, str]:
        """(number, at, who) of the oldest row, which leaves the window."""
        number, at, who, kind = self.rows.popleft()
        members = self.members[kind]
        del members[bisect_left(members, (self.ids.pop(number), number))]
        return number, at, who

    def _similar(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes at or above ``tau`` and their similarities, best first; remembered from the second time on."""
        upto, near, scores = self.near.get(kind, (0, np.zeros(0, np.int64), np.zeros(0)))
        if upto < self.classes:
            fresh = np.round(self.vectors[upto : self.classes] @ self.vectors[kind], 9)
            found = np.flatnonzero(fresh >= self.tau)
            near, scores = np.append(near, found + upto), np.append(scores, fresh[found])
            order = np.argsort(-scores, kind="stable")
            near, scores = near[order], scores[order]
            self.seen[kind] += 1
            if self.seen[kind] > 1:
                self.held += len(found)
                if self.held > self.ROOM:
                    self.near, self.held = {}, len(near)
                self.near[kind] = (self.classes, near, scores)
        return near, scores

    def best(self, number: int, kind: int, k: int = 20) -> list[int]:
        """Numbers of the ``k`` most similar rows besides ``number``, ties by id."""
        near, scores = self._similar(kind)
        out: list[int] = []
        at = 0
        while at < len(near) and len(out) < k:
            group, score = [], scores[at]
            while at < len(near) and scores[at] == score:
                group += self.members[near[at]][: k + 1]
                at += 1
            out += [n for _, n in sorted(group) if n != number][: k - len(out)]
        return out


class _ClusterState(StatefulProcessor):
    """Per product: the open vectors of the look-back window and the live clusters.

    A ticket links to at most 20 similar open ones, joins their clusters, the smallest id
    survives a merge, a burst is flagged once per cluster, and a cluster that stays idle
    is closed by an event-time timer.
    """

    def __init__(self, tau: float, window: int, burst: int, min_tickets: int, min_customers: int, idle: int):
        self.tau, self.window, self.burst = tau, window, burst
        self.min_tickets, self.min_customers, self.idle = min_tickets, min_customers, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "id BIGINT, at BIGINT, who STRING, cluster BIGINT, vector ARRAY<FLOAT>")
        self.clusters = handle.getMapState("clusters", "cluster BIGINT", "size BIGINT, flagged BOOLEAN, seen BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        product = key[0]
        frame = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        before = {k[0]: list(v) for k, v in self.clusters.iterator()}
        info = dict(before)
        held, live = _Window(self.tau), {}  # members of a cluster that is not flagged yet, for the burst rule
        for ticket, at, who, cluster, vector in self.recent.get():
            number, _ = held.add(ticket, at, who, np.asarray(vector, dtype=np.float64))
            if cluster >= 0:
                held.label[number] = cluster
                self._watch(live, cluster, info, at, number, who)
        out: list[tuple] = []
        for ticket, at, who, embedding in zip(frame["id"].tolist(), frame["at"].tolist(), frame["who"], frame["embedding"]):
            while held.rows and held.rows[0][1] < at - self.window:
                self._leave(held, live, at)
            number, kind = held.add(ticket, at, who, np.asarray(embedding, dtype=np.float64))
            order = held.best(number, kind)
            if not order:
                continue
            joined = sorted({held.root(held.label[n]) for n in order if n in held.label})
            members = [n for n in order if n not in held.label] + [number]
            target = joined[0] if joined else min(held.ids[n] for n in members)
            size, flagged, _ = info.get(target, [0, False, at])
            for other in joined[1:]:
                gone = info.pop(other, [0, False, at])
                size, flagged = size + gone[0], flagged or gone[1]
                held.parent[other] = target
                left, right = live.pop(target, None), live.pop(other, None)
                if not flagged and (left or right):
                    if left and right and len(left.members) < len(right.members):
                        left, right = right, left
                    if left and right:
                        left.absorb(right)
                    live[target] = left or right
                out.append(("cluster.merged", product, other, target, at, gone[0]))
            info[target] = [size, flagged, at]
            arrived = {number: (at, who)}
            if len(members) > 1:
                wanted = set(members)
                arrived |= {n: (t, w) for n, t, w, _ in held.rows if n in wanted}
            for n in members:
                held.label[n] = target
                self._watch(live, target, info, arrived[n][0], n, arrived[n][1])
                out.append(("ticket.linked", product, target, held.ids[n], at, 1))
            size += len(members)
            if not flagged:
                now = live[target]
                now.expire(at - self.burst)
                if len(now.members) >= self.min_tickets and len(now.who) >= self.min_customers:
                    flagged = True
                    del live[target]
                    out.append(("incident.detected", product, target, ticket, at, size))
            info[target] = [size, flagged, at]
            out.append(("cluster.updated", product, target, ticket, at, size))
        cluster_of = lambda n: held.root(held.label[n]) if n in held.label else -1
        vectors = held.vectors.astype(np.float32)
        self.recent.put([(held.ids[n], t, w, cluster_of(n), vectors[k].tolist()) for n, t, w, k in held.rows])
        for gone in set(before) - set(info):
            self.clusters.removeKey((gone,))
        for cluster, value in info.items():
            if before.get(cluster) != value:
                self.clusters.updateValue((cluster,), tuple(value))
        if info:
            self.handle.registerTimer((min(v[2] for v in info.values()) + self.idle) // 1000 + 1)
        yield self._frame(out)

    @staticmethod
    def _watch(live: dict[int, _Live], cluster: int, info: dict, at: int, number: int, who: str) -> None:
        if cluster in info and info[cluster][1]:
            return
        if cluster in live:
            live[cluster].absorb(_Live(at, number, who))
        else:
            live[cluster] = _Live(at, number, who)

    def _leave(self, held: _Window, live: dict[int, _Live], now: int) -> None:
        number, at, who = held.leave()
        cluster = held.label.pop(number, None)
        if cluster is not None and at >= now - self.burst and (watched := live.get(held.root(cluster))):
            watched.members = [m for m in watched.members if m[1] != number]  # the window is shorter than the burst
            heapify(watched.members)
            watched.who = Counter(m[2] for m in watched.members)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out, left = [], []
        for (cluster,), (size, _, seen) in list(self.clusters.iterator()):
            if seen + self.idle < now:
                self.clusters.removeKey((cluster,))
                out.append(("cluster.closed", key[0], cluster, None, seen + self.idle, size))
            else:
                left.append(seen)
        if left:
            self.handle.registerTimer((min(left) + self.idle) // 1000 + 1)
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["event", "product", "cluster_id", "ticket_id", "at", "size"])
        frame["at"] = pd.to_datetime(frame["at"].astype("int64"), unit="us")
        frame["cluster_id"] = frame["cluster_id"].astype("int64")
        frame["ticket_id"] = frame["ticket_id"].astype("Int64")
        frame["size"] = frame["size"].astype("int64")
        return frame

    def close(self) -> None:
        pass


def rocksdb_state(stream: DataFrame) -> None:
    """Custom state needs the RocksDB store; its snapshots go to the checkpoint location."""
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def stream_dedup_clusters(
    vectors: DataFrame,
    tau: float = DEFAULTS.tau,
    window_hours: float = DEFAULTS.window_hours,
    burst_minutes: float = DEFAULTS.burst_minutes,
    min_tickets: int = DEFAULTS.burst_min_tickets,
    min_customers: int = DEFAULTS.burst_min_customers,
    idle_hours: float = DEFAULTS.cluster_idle_hours,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Cluster events of a stream of tickets with vectors.

    ``vectors`` has ticket_id, product, created_at, customer_id, embedding. Tickets of one
    product form one ordered sequence, like the lock per product they replace.
    """
    rocksdb_state(vectors)
    who = F.coalesce(F.concat(F.lit("c"), F.col("customer_id").cast("string")), F.concat(F.lit("t"), F.col("ticket_id").cast("string")))
    rows = vectors.select(
        "product", "created_at", F.col("ticket_id").alias("id"), F.unix_micros("created_at").alias("at"), who.alias("who"), "embedding"
    ).withWatermark("created_at", watermark)
    hours = lambda h: int(h * 3_600_000_000)
    processor = _ClusterState(tau, hours(window_hours), hours(burst_minutes / 60), min_tickets, min_customers, hours(idle_hours))
    return rows.groupBy("product").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=CLUSTER_EVENTS, outputMode="Append", timeMode="EventTime"
    )


def stream_close_clusters(events: DataFrame) -> DataFrame:
    """The clusters a stream of cluster events closed for being idle."""
    return events.where(F.col("event") == "cluster.closed")


# ------------------------------------------------------------ deadlines as timers
def _deadlines(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per ticket: a time-out at the deadline, taken back by a response."""
    if state.exists:
        known = _unpacked(state.get[0])
    else:
        known = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("ticket_id", "due", "answer")})
    known = known.set_index("ticket_id")
    if not state.hasTimedOut:
        frame = pd.concat(list(frames))
        due = frame[frame["kind"] == "ticket"].groupby("ticket_id")["due"].min()
        answer = frame[frame["kind"] == "response"].groupby("ticket_id")["at"].min()
        known = known.reindex(known.index.union(due.index).union(answer.index), fill_value=NEVER)
        known.loc[due.index, "due"] = due
        known.loc[answer.index, "answer"] = np.minimum(known.loc[answer.index, "answer"], answer)
    known.loc[known["answer"] <= known["due"], "due"] = NEVER
    late = (known["due"] != NEVER) & (known["due"] // 1000 < state.getCurrentWatermarkMs())
    out = pd.DataFrame({"ticket_id": known.index[late].astype("int64"), "breached_at": pd.to_datetime(known.loc[late, "due"].to_numpy(), unit="us").astype("datetime64[us]")})
    known.loc[late, "due"] = NEVER
    known = known[(known["due"] != NEVER) | (known["answer"] != NEVER)]
    _store(state, (known.rename_axis("ticket_id").reset_index(),), int(known["due"].min()) // 1000 if (known["due"] != NEVER).any() else NEVER)
    yield out


def stream_sla_breach(tickets: DataFrame, responses: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(ticket_id, breached_at) once per ticket whose deadline passes without a response.

    ``tickets`` has id, created_at, sla_due_at; ``responses`` has ticket_id, responded_at.
    """
    rocksdb_state(tickets)
    asked = tickets.where(F.col("sla_due_at").isNotNull()).select(
        F.col("id").alias("ticket_id"), F.lit("ticket").alias("kind"), F.col("created_at").alias("event_at"),
        F.unix_micros("created_at").alias("at"), F.unix_micros("sla_due_at").alias("due"),
    )
    answered = responses.select(
        "ticket_id", F.lit("response").alias("kind"), F.col("responded_at").alias("event_at"),
        F.unix_micros("responded_at").alias("at"), F.lit(NEVER).cast("bigint").alias("due"),
    )
    log = asked.unionByName(answered).withWatermark("event_at", watermark)
    return log.withColumn("bucket", bucket("ticket_id")).groupBy("bucket").applyInPandasWithState(
        _deadlines, "ticket_id BIGINT, breached_at TIMESTAMP", "known BINARY", "append", GroupStateTimeout.EventTimeTimeout
    )


# --------------------------------------------------------- drift, joins, scoring
def hourly_scores(predictions: DataFrame, low: float = DEFAULTS.low_confidence) -> DataFrame:
    """Pre-aggregated category predictions: one row per hour and label."""
    score = F.col("score")
    return predictions.groupBy(F.date_trunc("hour", "created_at").alias("hour"), "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(score < F.lit(low).cast("float")).alias("low"),
        F.sum(score.cast("double")).alias("score_sum"),
    )


def stream_drift(predictions: DataFrame, label: str = "drift") -> DataFrame:
    """Hourly pre-aggregates of a prediction stream, one folder per micro-batch.

    A repeated batch overwrites its own folder, so the table stays exact.
    """
    spark = predictions.sparkSession
    path = scratch_path(spark, label)

    def store(batch: DataFrame, batch_id: int) -> None:
        hourly_scores(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(predictions, store, label)
    return spark.read.schema("hour TIMESTAMP, label STRING, n BIGINT, low BIGINT, score_sum DOUBLE, batch INT").parquet(path)


def drift_from_hours(hours: DataFrame, as_of: Column) -> DataFrame:
    """Window shares and the category shift at an hour boundary, from the pre-aggregates."""
    day = F.expr("INTERVAL 1 DAY")
    period = F.when((F.col("hour") >= as_of - 7 * day) & (F.col("hour") < as_of), F.lit("recent")).when(
        (F.col("hour") >= as_of - 37 * day) & (F.col("hour") < as_of - 7 * day), F.lit("baseline")
    )
    part = lambda c, p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col(c))), F.lit(0))
    labelled = hours.withColumn("period", period).where(F.col("period").isNotNull()).groupBy("label").agg(
        *[part(c, p).alias(f"{p}_{c}") for p in ("recent", "baseline") for c in ("n", "low")]
    )
    total = labelled.agg(F.sum("recent_n").alias("_r"), F.sum("baseline_n").alias("_b"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return labelled.join(F.broadcast(total)).agg(  # one row
        F.sum("recent_n").alias("recent_n"),
        (F.sum("recent_low") / F.sum("recent_n")).alias("recent_low_share"),
        F.sum("baseline_n").alias("baseline_n"),
        (F.sum("baseline_low") / F.sum("baseline_n")).alias("baseline_low_share"),
        (F.sum(F.abs(share("recent_n", "_r") - share("baseline_n", "_b"))) / 2).alias("category_shift"),
    )


def stream_enrich(tickets: DataFrame, policies: DataFrame, clusters: DataFrame) -> DataFrame:
    """A ticket stream with its deadline and cluster, from static tables."""
    from deskstream.operators.joins import sla_due
    from deskstream.operators.projection import tickets_with_cluster

    return tickets_with_cluster(sla_due(tickets, policies), clusters)


def stream_ticket_x_feedback(tickets: DataFrame, feedback: DataFrame, bound: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """Tickets with their feedback within ``bound`` of the report; unanswered ones once the time is over."""
    left = tickets.select(F.col("id").alias("ticket_id"), "created_at", "status").withWatermark("created_at", watermark)
    right = feedback.select(
        F.col("ticket_id").alias("_ticket"), "action", F.col("created_at").alias("reviewed_at")
    ).withWatermark("reviewed_at", watermark)
    within = F.expr(
        f"ticket_id = _ticket AND reviewed_at >= created_at AND reviewed_at <= created_at + INTERVAL {bound}"
    )
    joined = left.join(right, within, "left_outer").drop("_ticket")
    outcome = F.when(F.col("action").isin("APPROVE", "EDIT_APPROVE"), F.lit("RESOLVED")).when(
        F.col("action") == "REJECT", F.lit("IN_REVIEW")
    )
    return joined.withColumn("status", F.coalesce(outcome, "status"))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], label: str) -> None:
    """Feed every available micro-batch to ``handle(batch, batch_id)``."""
    (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", scratch_path(stream.sparkSession, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def stream_event_sink(events: DataFrame, path: str) -> None:
    """Append an event log with at-least-once input and exactly-once files.

    The folder of a micro-batch is named by its id and overwritten when the batch repeats.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(events, store, "sink")


def stream_score(tickets: DataFrame, model, senior_threshold: float = DEFAULTS.senior_threshold) -> DataFrame:
    """A fitted model applied to a stream; the probability of the positive class routes the ticket."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(tickets)
    risk = F.get(vector_to_array("probability"), F.lit(1))
    return scored.withColumn("risk", risk).withColumn("queue", scoring.route_queue(F.col("risk"), senior_threshold))


LEGS = {"triage": "triaged_at", "draft": "drafted_at"}


def stream_pipeline_latency(tickets: DataFrame, legs: dict[str, str] = LEGS, label: str = "latency") -> DataFrame:
    """Exact p50 and p95 of the seconds from ingest to each leg's end, one row over all micro-batches.

    A micro-batch stores how often each duration occurs, in a folder of its own that a repeated batch overwrites.
    Value counts add up, so the percentiles do not depend on how the input was cut. ``legs`` names the end times.
    """
    spark = tickets.sparkSession
    path = scratch_path(spark, label)
    ends = F.array(*[F.struct(F.lit(leg).alias("leg"), F.col(end).alias("end")) for leg, end in legs.items()])

    def store(batch: DataFrame, batch_id: int) -> None:
        each = batch.select("ingested_at", F.inline(ends)).where("end IS NOT NULL")
        counts = each.groupBy("leg", (F.unix_micros("end") - F.unix_micros("ingested_at")).alias("micros")).agg(F.count(F.lit(1)).alias("c"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(tickets, store, label)
    counts = spark.read.schema("leg STRING, micros BIGINT, c BIGINT, batch INT").parquet(path)
    values = counts.groupBy("leg", (F.col("micros") / F.lit(1e6)).alias("v")).agg(F.sum("c").alias("c"))
    rows = [windows.counted_percentiles(values.where(F.col("leg") == leg).select("v", "c"), [0.5, 0.95], [f"{leg}_p50", f"{leg}_p95"]) for leg in legs]
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)  # one row each


def stream_triage_latency(tickets: DataFrame, label: str = "latency") -> DataFrame:
    """The triage leg of ``stream_pipeline_latency``."""
    return stream_pipeline_latency(tickets, {"triage": LEGS["triage"]}, label)


def replay_stream(tickets: DataFrame, rows_per_batch: int, label: str = "replay") -> DataFrame:
    """Tickets as a file stream in time order, about ``rows_per_batch`` rows per micro-batch.

    One range shuffle cuts the rows into time slots; the slots are then published one
    after the other, because a file stream reads in the order in which files appear.
    """
    spark = tickets.sparkSession
    staged, path = scratch_path(spark, f"{label}-staged"), scratch_path(spark, label)
    slots = max(1, -(-tickets.count() // rows_per_batch))
    ranged = tickets.repartitionByRange(slots, "created_at").withColumn("_slot", F.spark_partition_id())
    ranged.write.partitionBy("_slot").parquet(staged)
    for slot in range(slots):
        part = spark.read.schema(tickets.schema).parquet(f"{staged}/_slot={slot}")
        part.coalesce(1).sortWithinPartitions("created_at", "id").write.mode("append").parquet(path)
    return spark.readStream.schema(tickets.schema).option("maxFilesPerTrigger", 1).parquet(path)
