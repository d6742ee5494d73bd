"""Clusters over the similarity graph: components, cluster table, replay, near-duplicates."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from deskstream.operators import blockjoin, windows
from deskstream.schemas import DEFAULTS
from deskstream.session import cut_lineage, scratch_path


def _signature(edges: DataFrame) -> tuple[int, int]:
    """Size and order-independent hash of an edge set."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2_147_483_647))).alias("h"),
    ).first()
    return row["n"], row["h"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest one around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    self_links = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(self_links).where(F.col("u") != F.col("v")).distinct()


def _local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected to) over one batch of edges."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return nodes, nodes[parent]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


CONTRACT_EDGES = 2_000_000  # edges of a task that are contracted at once, 32 MB


def _contract(edges: DataFrame, room: int = CONTRACT_EDGES) -> DataFrame:
    """Replace the edges of every task by star forests with the same components.

    A partial aggregate before the first shuffle. A task adds its batches up to ``room`` edges and contracts them
    with the forest so far; a forest of more than ``room`` edges is sent on, so memory is bounded. At most one edge
    per node and forest stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def forest() -> tuple[np.ndarray, np.ndarray]:
            nodes, roots = _local_roots(*(np.concatenate(x) for x in zip(*held)))
            moved = nodes != roots
            return nodes[moved], roots[moved]

        def parts(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(u), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(x[start : start + 65_536]) for x in (u, v)], names=["u", "v"])

        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            waiting += len(batch)
            if waiting >= room:
                held, waiting = [forest()], 0
                if len(held[0][0]) > room:
                    yield from parts(*held[0])
                    held = []
        if held:
            yield from parts(*forest())

    return edges.mapInArrow(run, "u BIGINT, v BIGINT")


def connected_components(
    edges: DataFrame,
    left: str = "ticket_id",
    right: str = "similar_id",
) -> DataFrame:
    """(id, component) for every node that has an edge; the component is its smallest id.

    Edges are contracted inside their tasks, then large-star / small-star alternate
    (Kiveris et al., 2014) until nothing changes. Minima are partial
    aggregates and joins, so a node with a huge neighbourhood is never collected. Each
    round ends in a reliable checkpoint.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col("u") != F.col("v"))
    current = cut_lineage(_contract(pairs).distinct())
    before = _signature(current)
    while True:
        current = cut_lineage(_contract(_small_star(_large_star(current))))
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("id")).distinct()
    return (
        current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        .unionByName(roots.select("id", F.col("id").alias("component")))
        .groupBy("id")
        .agg(F.min("component").alias("component"))
    )


def duplicate_clusters(
    tickets: DataFrame, links: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): components of the link graph; a ticket without links has no cluster.

    ``tickets`` has id, created_at, subject, product, customer_id. ``members`` is
    the matching tickets with ``cluster_id``.
    """
    components = connected_components(links)
    members = tickets.join(components.withColumnRenamed("component", "cluster_id"), "id")
    return cluster_stats(members), members


def cluster_stats(members: DataFrame) -> DataFrame:
    """Size, first and last report, canonical ticket and title of every cluster."""
    oldest = F.struct("created_at", "id")
    return members.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.min("product").alias("product"),
        F.count(F.lit(1)).alias("size"),
        F.min("created_at").alias("first_seen_at"),
        F.max("created_at").alias("last_seen_at"),
        F.min_by("id", oldest).alias("canonical_ticket_id"),
        F.min_by("subject", oldest).alias("title"),
    )


def incidents(members: DataFrame, clusters: DataFrame, minutes: float, min_tickets: int, min_customers: int) -> DataFrame:
    """Clusters with their incident flag, from the burst rule over final membership."""
    flags = (
        windows.incident_burst(members, minutes, min_tickets, min_customers)
        .groupBy("cluster_id")
        .agg(
            F.min("incident_flagged_at").alias("incident_flagged_at"),
            F.max("live_tickets").alias("peak_tickets"),
            F.max("live_customers").alias("peak_customers"),
        )
    )
    return clusters.join(flags, "cluster_id").withColumn("is_incident", F.col("incident_flagged_at").isNotNull())


def merge_clusters(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-point members of merged clusters; ``mapping`` is (cluster_id, merged_into)."""
    moved = members.join(mapping, "cluster_id", "left")
    return moved.withColumn("cluster_id", F.coalesce("merged_into", "cluster_id")).drop("merged_into")


def incident_merge_flags(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """After a merge: the survivor inherits the incident flag and the earliest time; the rest are MERGED."""
    joined = clusters.join(mapping.withColumnRenamed("cluster_id", "id"), "id", "left").withColumn(
        "_target", F.coalesce("merged_into", "id")
    )
    folded = joined.groupBy(F.col("_target").alias("id")).agg(
        F.bool_or("is_incident").alias("_incident"),
        F.min("incident_flagged_at").alias("_flagged"),
        F.sum("size").alias("_size"),
    )
    gone = F.col("merged_into").isNotNull()
    return joined.drop("_target").join(folded, "id", "left").select(
        "id",
        F.when(gone, F.col("is_incident")).otherwise(F.col("_incident")).alias("is_incident"),
        F.when(gone, F.col("incident_flagged_at")).otherwise(F.col("_flagged")).alias("incident_flagged_at"),
        F.when(gone, F.lit("MERGED")).otherwise(F.col("status")).alias("status"),
        "merged_into",
        F.when(gone, F.lit(0)).otherwise(F.col("_size")).cast("bigint").alias("size"),
    )


# ------------------------------------------------------------------ exact replay
class _Live:
    """Recent members of one online cluster, a heap by time, with running counts."""

    __slots__ = ("members", "who", "alarms")

    def __init__(self, at: int, ticket: int, who: str):
        self.members: list[tuple[int, int, str, list[int]]] = [(at, ticket, who, [])]
        self.who: Counter[str] = Counter([who])
        self.alarms: Counter[int] = Counter()

    def expire(self, before: int) -> None:
        while self.members and self.members[0][0] < before:
            _, _, who, alarms = heappop(self.members)
            for counts, keys in ((self.who, (who,)), (self.alarms, alarms)):
                for key in keys:
                    counts[key] -= 1
                    if not counts[key]:
                        del counts[key]

    def absorb(self, other: _Live) -> None:
        for member in other.members:
            heappush(self.members, member)
        self.who.update(other.who)
        self.alarms.update(other.alarms)


class _Replay:
    """State of one final component while its tickets arrive in order.

    Only tickets of the link window stay in memory: older ones cannot be linked again
    and cannot be live, so the label they carried is all that is left of them. Counts of
    live members, customers and members covered by an earlier alarm are kept up to date,
    and the smaller of two clusters is added to the larger, so an arrival costs about as much as it has links.
    An alarm that covers live members is never older than they are, so it lies in the window by itself.
    """

    def __init__(self, window: int, burst: int, min_tickets: int, min_customers: int, cover: float):
        self.window, self.burst = window, burst
        self.min_tickets, self.min_customers, self.cover = min_tickets, min_customers, cover
        self.label: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        self.recent: deque[tuple[int, int]] = deque()
        self.live: dict[int, _Live] = {}
        self.raised, self.last = 0, None

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _covered(self, now: _Live, at: int) -> bool:
        """Whether an alarm of the last ``burst`` covers enough of the live members."""
        if self.cover <= 0:  # every alarm does
            return self.last is not None and self.last >= at - self.burst
        least = self.cover * len(now.members)
        return any(n >= least for n in now.alarms.values())

    def arrive(self, ticket: int, at: int, who: str, links: list[int]) -> tuple[_Live, bool] | None:
        """The live members after an arrival that makes them a burst, and whether it raises an alarm; else None."""
        while self.recent and self.recent[0][1] < at - self.window:
            self.label.pop(self.recent.popleft()[0], None)
        self.parent[ticket] = self.label[ticket] = ticket
        self.live[ticket] = _Live(at, ticket, who)
        self.recent.append((ticket, at))
        for other in links:
            if other not in self.label:
                continue
            a, b = self._root(ticket), self._root(self.label[other])
            if a != b:
                if len(self.live[a].members) < len(self.live[b].members):
                    a, b = b, a
                self.parent[b] = a
                gone = self.live.pop(b)
                gone.expire(at - self.burst)
                self.live[a].absorb(gone)
        now = self.live[self._root(ticket)]
        now.expire(at - self.burst)
        if len(self.parent) > 4 * len(self.recent) + 64:
            self._compact()
        if len(now.members) < self.min_tickets or len(now.who) < self.min_customers:
            return None
        if self._covered(now, at):
            return now, False
        self.raised, self.last = self.raised + 1, at
        if self.cover <= 1:  # otherwise no alarm can cover another
            now.alarms[self.raised] = len(now.members)
            for member in now.members:
                member[3].append(self.raised)
        return now, True

    def _compact(self) -> None:
        self.label = {t: self._root(self.label[t]) for t, _ in self.recent}
        keep = set(self.label.values())
        self.parent = {**self.label, **{r: r for r in keep}}
        self.live = {r: members for r, members in self.live.items() if r in keep}


def _replayed(
    tickets: DataFrame, links: DataFrame, components: DataFrame, replay: Callable[[], _Replay],
    row: Callable[[int, int, int, _Live, bool], tuple | None], schema: str,
) -> DataFrame:
    """What ``row(component, at, id, live members, raised)`` makes of the arrivals that find a burst; None is left out.

    A ticket's online cluster is a subset of its final component, so components replay
    independently. Rows arrive sorted within their partition and stream through a state
    that only holds the current look-back window; a component is never collected.
    """
    grouped = links.groupBy(F.col("ticket_id").alias("id")).agg(F.collect_list("similar_id").alias("links"))
    rows = (
        tickets.join(components, "id")
        .join(grouped, "id", "left")
        .select(
            "component",
            "id",
            F.unix_micros("created_at").alias("at"),
            F.coalesce(F.col("customer_id").cast("string"), F.concat(F.lit("t"), F.col("id").cast("string"))).alias("who"),
            F.coalesce("links", F.array().cast("array<bigint>")).alias("links"),
        )
        .repartition("component")
        .sortWithinPartitions("component", "at", "id")
    )
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, state = None, None
        for batch in batches:
            out = []
            for comp, ticket, at, who, near in zip(*(column.to_pylist() for column in batch.columns)):
                if comp != component:
                    component, state = comp, replay()
                found = state.arrive(ticket, at, who, near)
                if found is not None and (made := row(comp, at, ticket, *found)) is not None:
                    out.append(made)
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds.field(n).type) for n, x in zip(names, columns)], names=names)

    return rows.mapInArrow(run, schema)


def incident_replay(
    tickets: DataFrame,
    links: DataFrame,
    components: DataFrame,
    window_hours: float = DEFAULTS.window_hours,
    burst_minutes: float = DEFAULTS.burst_minutes,
    min_tickets: int = DEFAULTS.burst_min_tickets,
    min_customers: int = DEFAULTS.burst_min_customers,
    cover: float = 0.5,
) -> DataFrame:
    """(component, alarm_at, ticket_id, members): alarms as they would have been raised online.

    An alarm is skipped when one of the last ``burst_minutes`` covers at least ``cover`` of it.
    """
    window, burst = int(window_hours * 3_600_000_000), int(burst_minutes * 60_000_000)

    def alarm(component: int, at: int, ticket: int, now: _Live, raised: bool) -> tuple | None:
        return (component, at, ticket, sorted(m[1] for m in now.members)) if raised else None

    schema = "component BIGINT, alarm_micros BIGINT, ticket_id BIGINT, members ARRAY<BIGINT>"
    alarms = _replayed(tickets, links, components, lambda: _Replay(window, burst, min_tickets, min_customers, cover), alarm, schema)
    return alarms.select(
        "component", F.timestamp_micros("alarm_micros").alias("alarm_at"), "ticket_id", "members"
    )


def alarm_suppression(
    tickets: DataFrame,
    links: DataFrame,
    components: DataFrame,
    window_hours: float = DEFAULTS.window_hours,
    burst_minutes: float = DEFAULTS.burst_minutes,
    min_tickets: int = DEFAULTS.burst_min_tickets,
    min_customers: int = DEFAULTS.burst_min_customers,
    cover: float = 0.5,
) -> DataFrame:
    """(component, ticket_id, kept, live): every arrival at a burst, whether its alarm is raised, and the live members.

    Suppression changes no cluster, so one replay tells both; members are counted, not listed.
    """
    window, burst = int(window_hours * 3_600_000_000), int(burst_minutes * 60_000_000)

    def arrival(component: int, at: int, ticket: int, now: _Live, raised: bool) -> tuple:
        return component, ticket, raised, len(now.members)

    schema = "component BIGINT, ticket_id BIGINT, kept BOOLEAN, live INT"
    return _replayed(tickets, links, components, lambda: _Replay(window, burst, min_tickets, min_customers, cover), arrival, schema)


def alarm_overlap(alarms: DataFrame, truth: DataFrame, min_overlap: int = DEFAULTS.burst_min_tickets) -> DataFrame:
    """(alarm_id, incident_id, n): how many members of an alarm belong to a true incident, at least ``min_overlap``."""
    exploded = alarms.select(F.col("ticket_id").alias("alarm_id"), F.explode("members").alias("id"))
    return (
        exploded.join(truth.where(F.col("incident_id").isNotNull()).select("id", "incident_id"), "id")
        .groupBy("alarm_id", "incident_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_overlap)
    )


# --------------------------------------------------------------- near-duplicates
def near_dup_removal(tickets: DataFrame, threshold: float = DEFAULTS.near_duplicate) -> DataFrame:
    """Per split, drop a row that is too close to an earlier row that was kept.

    ``tickets`` has id (row order), split, incident_id, embedding; incident rows always
    stay. Rows with the same vector share their neighbourhood, so only the first of them
    can be kept and the comparison runs on distinct vectors. The greedy order is then
    resolved in rounds until no edge is left: a row whose earlier neighbours are all dropped
    is kept, a row with a kept earlier neighbour is dropped. Dropped ids are appended to one
    table in the shared folder.
    """
    background = tickets.where(F.col("incident_id").isNull())
    marked = background.select("id", "split", "embedding", F.md5(F.to_json("embedding")).alias("_v"))
    firsts = marked.groupBy("split", "_v").agg(F.min("id").alias("id"))
    distinct = marked.join(firsts.select("id"), "id", "left_semi")
    edges = cut_lineage(blockjoin.similar_above(distinct, F.col("split"), threshold))

    spark = tickets.sparkSession
    decided = scratch_path(spark, "dropped")
    edges.select(F.col("second_id").alias("id")).limit(0).write.parquet(decided)
    pending = edges
    while not pending.isEmpty():
        waiting = pending.select(F.col("second_id").alias("id")).distinct()
        # an earlier endpoint that waits for nobody is kept, and drops everything after it
        kept = pending.select(F.col("first_id").alias("id")).distinct().join(waiting, "id", "left_anti")
        newly = (
            pending.join(kept.withColumnRenamed("id", "first_id"), "first_id", "left_semi")
            .select(F.col("second_id").alias("id"))
            .distinct()
        )
        newly = cut_lineage(newly)
        newly.write.mode("append").parquet(decided)
        pending = cut_lineage(
            pending.join(newly.withColumnRenamed("id", "first_id"), "first_id", "left_anti").join(
                newly.withColumnRenamed("id", "second_id"), "second_id", "left_anti"
            )
        )
    dropped = spark.read.schema("id BIGINT").parquet(decided)
    copies = marked.join(firsts.select("id"), "id", "left_anti").select("id")
    return tickets.join(dropped.unionByName(copies), "id", "left_anti")
