"""Look-back counts, exact ranks and top-k that do not funnel a hot key into one task.

Spark's sliding RANGE frames re-aggregate the frame for every row and need the whole
key in one partition. The look-back counts here are sweeps instead: each row becomes
a few signed points on the time axis, a running sum inside (key, time bucket) gives
the level, and the level at the start of a bucket comes from pre-aggregated bucket
totals. Cost is linear in the rows, and a hot key is spread over its time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskstream.schemas import DEFAULTS

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


# ----------------------------------------------------------------- primitives
def ago(as_of: Column, micros: int) -> Column:
    """A point in time before ``as_of``; a constant when ``as_of`` is one, so that scans can be filtered by it."""
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(micros))


def bucketed_running(
    frame: DataFrame, group: list[str], bucket: str, order: list[Column | str], sums: dict[str, str]
) -> DataFrame:
    """Running inclusive sums in (group, bucket, order), computed per bucket.

    ``sums`` maps a new column to the column it accumulates. The bucket totals (one row
    per group and bucket) carry the offsets from one bucket to the next.
    """
    totals = frame.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, bucket, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = frame.select("*", *[F.sum(c).over(inside).alias(f"_r_{n}") for n, c in sums.items()])
    joined = running.join(offsets, [*group, bucket])
    return joined.select(*frame.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def sweep_levels(points: DataFrame, keys: list[str], levels: dict[str, str], bucket_micros: int) -> DataFrame:
    """Level of each signed counter at every query point.

    ``points`` has ``keys``, ``t`` (micros), ``phase``, ``pos``, ``sub`` (order within equal
    times), one delta column per level and ``query`` (id to report, NULL for a pure delta).
    """
    bucketed = points.withColumn("_b", F.floor(F.col("t") / F.lit(bucket_micros)))
    swept = bucketed_running(bucketed, keys, "_b", ["t", "phase", "pos", "sub"], levels)
    return swept.where(F.col("query").isNotNull()).select("query", *levels)


ROWS_PER_SLICE = 1_000_000


def quantile_bounds(frame: DataFrame, value: str, parts: int = 32) -> list[float]:
    """Cut points of about equal depth (a sketch, only used to spread work): ``parts``, or more when a part would be large."""
    parts = max(parts, -(-frame.count() // ROWS_PER_SLICE))
    cuts = [i / parts for i in range(1, parts)]
    row = frame.agg(F.percentile_approx(value, cuts, 32 * parts).alias("q")).first()
    return sorted({float(x) for x in (row["q"] or [])})


def bucket_by_bounds(value: Column, bounds: list[float]) -> Column:
    """Number of bounds at or below ``value``, as a balanced tree of comparisons."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(bounds))


def ranked_in_group(frame: DataFrame, group: list[str], hex_hash: str, tie: list[str]) -> DataFrame:
    """Add ``position`` (1-based, by hash) and ``group_size``.

    The order is by a hex hash, so its first digits cut every group into even slices; their
    number grows with the rows.
    """
    digits, rows = 2, frame.count()
    while rows // 16**digits > ROWS_PER_SLICE:
        digits += 1
    sliced = frame.withColumn("_slice", F.substring(hex_hash, 1, digits)).withColumn("_one", F.lit(1))
    ranked = bucketed_running(sliced, group, "_slice", [hex_hash, *tie], {"position": "_one"})
    sizes = frame.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))
    return ranked.drop("_slice", "_one").join(sizes, group)


def topk_per_key(frame: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key, ranked from 1.

    Catalyst plans ``row_number() <= k`` as a partial group limit before the shuffle, so a
    hot key sends at most ``k`` rows per map task.
    """
    ranked = frame.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def exact_percentiles(frame: DataFrame, value: str, percentages: list[float], names: list[str]) -> DataFrame:
    """Interpolated percentiles of a numeric column in one row, 0 when there are no rows.

    Equal values collapse first; the rank of every distinct value comes from equal-depth
    buckets, so neither a sort nor a value map ever has to hold the whole column.
    """
    values = frame.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    return counted_percentiles(values, percentages, names)


def counted_percentiles(values: DataFrame, percentages: list[float], names: list[str]) -> DataFrame:
    """``exact_percentiles`` of values that are already counted: ``values`` is (v, c), each v once."""
    bounds = quantile_bounds(values, "v")
    bucketed = values.withColumn("_b", bucket_by_bounds(F.col("v"), bounds))
    ranked = bucketed_running(bucketed, [], "_b", ["v"], {"upto": "c"})
    total = values.agg(F.sum("c").alias("n"))
    placed = ranked.join(F.broadcast(total))  # one row by construction
    covers = lambda rank: (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
    picks = []
    for i, p in enumerate(percentages):
        exact = F.lit(p) * (F.col("n") - 1)
        picks += [
            F.max(F.when(covers(F.floor(exact)), F.col("v"))).alias(f"_lo{i}"),
            F.max(F.when(covers(F.ceil(exact)), F.col("v"))).alias(f"_hi{i}"),
            F.max(exact - F.floor(exact)).alias(f"_f{i}"),
        ]
    chosen = placed.agg(*picks)
    return chosen.select(
        *[
            F.coalesce(
                F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"), F.lit(0.0)
            ).alias(name)
            for i, name in enumerate(names)
        ]
    )


def _points(*entries: tuple[Column, int, Column | int, int, dict[str, int], Column | None]) -> Column:
    """Array of sweep points; each entry is (time, phase, pos, sub, deltas, query id)."""
    structs = []
    for t, phase, pos, sub, deltas, query in entries:
        position = pos if isinstance(pos, Column) else F.lit(pos).cast("bigint")
        structs.append(
            F.struct(
                t.alias("t"),
                F.lit(phase).alias("phase"),
                position.alias("pos"),
                F.lit(sub).alias("sub"),
                *[F.lit(delta).cast("bigint").alias(name) for name, delta in deltas.items()],
                (query if query is not None else F.lit(None).cast("bigint")).alias("query"),
            )
        )
    return F.array(*structs)


# ------------------------------------------------------------ look-back counts
def prior_tickets(tickets: DataFrame, days: float = 7, name: str = "prior_tickets_7d") -> DataFrame:
    """Other tickets of the customer in [t - days, t); 0 without a customer."""
    at, span = F.unix_micros("created_at"), F.lit(int(days * MICROS_PER_DAY))
    known = tickets.where(F.col("customer_id").isNotNull())
    points = known.select(
        "customer_id",
        F.explode(
            _points(
                (at, 0, 0, 0, {"d": 0}, F.col("id")),
                (at, 1, 0, 0, {"d": 1}, None),
                (at + span, 2, 0, 0, {"d": -1}, None),
            )
        ).alias("p"),
    ).select("customer_id", "p.*")
    counts = sweep_levels(points, ["customer_id"], {name: "d"}, int(days * MICROS_PER_DAY))
    joined = tickets.join(counts.withColumnRenamed("query", "id"), "id", "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def prior_tickets_offline(tickets: DataFrame, days: int = 7, name: str = "prior_tickets_7d") -> DataFrame:
    """Rows of the customer before this one by (time, id), at most ``days`` older, in whole seconds."""
    second = F.floor(F.unix_micros("created_at") / F.lit(1_000_000)) * F.lit(1_000_000)
    span = F.lit(days * MICROS_PER_DAY)
    # rows of one second keep their order by exact time, then id
    order = F.struct(F.unix_micros("created_at"), F.col("id"))
    known = tickets.where(F.col("customer_id").isNotNull())
    points = known.select(
        "customer_id",
        F.explode(
            _points(
                (second, 0, order, 0, {"d": 0}, F.col("id")),
                (second, 0, order, 1, {"d": 1}, None),
                (second + span, 1, order, 0, {"d": -1}, None),
            )
        ).alias("p"),
    ).select("customer_id", "p.*")
    counts = sweep_levels(points, ["customer_id"], {name: "d"}, days * MICROS_PER_DAY)
    joined = tickets.join(counts.withColumnRenamed("query", "id"), "id", "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def live_counts(members: DataFrame, minutes: float = DEFAULTS.burst_minutes) -> DataFrame:
    """Per ticket: members of its cluster in the last ``minutes`` (inclusive) and their distinct customers.

    A customer counts once: each report represents them from its own time until their
    next report in the cluster or until it leaves the window, whichever comes first.
    """
    span = int(minutes * 60_000_000)
    at = F.unix_micros("created_at")
    who = F.coalesce(F.concat(F.lit("c"), F.col("customer_id").cast("string")), F.concat(F.lit("t"), F.col("id").cast("string")))
    base = members.select("cluster_id", "id", at.alias("at"), who.alias("who"), F.floor(at / F.lit(span)).alias("slot"))
    # next report of the same customer: in the same slot by lead, else the first one of the next slot
    firsts = base.groupBy("cluster_id", "who", (F.col("slot") - 1).alias("slot")).agg(F.min("at").alias("_first"))
    order = Window.partitionBy("cluster_id", "who", "slot").orderBy("at", "id")
    chained = base.withColumn("_lead", F.lead("at").over(order)).join(firsts, ["cluster_id", "who", "slot"], "left")
    following = F.coalesce("_lead", "_first")
    replaced = following.isNotNull() & (following <= F.col("at") + span)
    points = chained.select(
        "cluster_id",
        F.explode(
            F.concat(
                _points(
                    (F.col("at"), 0, 0, 0, {"dn": 1, "dc": 1}, None),
                    (F.col("at"), 1, 0, 0, {"dn": 0, "dc": 0}, F.col("id")),
                    (F.col("at") + span, 2, 0, 0, {"dn": -1, "dc": 0}, None),
                ),
                F.when(replaced, _points((following, 0, 0, 0, {"dn": 0, "dc": -1}, None))).otherwise(
                    _points((F.col("at") + span, 2, 0, 0, {"dn": 0, "dc": -1}, None))
                ),
            )
        ).alias("p"),
    ).select("cluster_id", "p.*")
    return sweep_levels(points, ["cluster_id"], {"live_tickets": "dn", "live_customers": "dc"}, span).withColumnRenamed(
        "query", "id"
    )


def incident_burst(
    members: DataFrame,
    minutes: float = DEFAULTS.burst_minutes,
    min_tickets: int = DEFAULTS.burst_min_tickets,
    min_customers: int = DEFAULTS.burst_min_customers,
) -> DataFrame:
    """Arrivals at which a cluster holds enough recent reports from enough customers, and the sticky flag.

    ``members`` has id, cluster_id, created_at, customer_id. ``incident_flagged_at`` is
    the first such arrival of the cluster, ``is_incident`` whether there is one.
    """
    counted = members.join(live_counts(members, minutes), "id")
    burst = (F.col("live_tickets") >= min_tickets) & (F.col("live_customers") >= min_customers)
    flagged = counted.withColumn("burst", burst)
    first = flagged.groupBy("cluster_id").agg(
        F.min(F.when(F.col("burst"), F.col("created_at"))).alias("incident_flagged_at")
    )
    return flagged.join(first, "cluster_id").withColumn("is_incident", F.col("incident_flagged_at").isNotNull())


# ---------------------------------------------------------------- rank queries
def latest_prediction(predictions: DataFrame) -> DataFrame:
    """Newest prediction per ticket and task."""
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return topk_per_key(predictions, ["ticket_id", "task"], newest, 1).drop("rank")


def active_drafts(drafts: DataFrame, n: int = 5) -> DataFrame:
    """Newest ``n`` drafts per ticket that were not superseded; ``is_active`` marks the one shown."""
    shown = drafts.where(F.col("status") != "SUPERSEDED")
    ranked = topk_per_key(shown, ["ticket_id"], [F.col("created_at").desc(), F.col("id").desc()], n)
    per_ticket = Window.partitionBy("ticket_id")
    first_kept = F.min(F.when(F.col("status") != "SKIPPED", F.col("rank"))).over(per_ticket)
    return ranked.withColumn("is_active", F.coalesce(F.col("rank") == first_kept, F.lit(False)))


def rank_legs(hits: DataFrame, query: str, order: list[Column]) -> DataFrame:
    """0-based rank of each hit within its query."""
    window = Window.partitionBy(query).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window) - 1)


def diversify_by_cluster(hits: DataFrame, k: int = DEFAULTS.retrieval_k, query: str = "qid") -> DataFrame:
    """Walk ranked hits, keep the first of every cluster (no cluster: always), stop at ``k``."""
    alone = F.when(F.col("cluster_id").isNull(), F.concat(F.lit("d"), F.col("id").cast("string"))).otherwise(
        F.concat(F.lit("c"), F.col("cluster_id").cast("string"))
    )
    firsts = topk_per_key(hits.withColumn("_g", alone), [query, "_g"], [F.col("rank")], 1, "_n").drop("_g", "_n")
    return topk_per_key(firsts.withColumnRenamed("rank", "_rank"), [query], [F.col("_rank")], k).drop("_rank")


def stratified_sample(tickets: DataFrame, by: str, k: int) -> DataFrame:
    """min(group size, k) rows per group, chosen by a hash of the id."""
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    return topk_per_key(tickets, [by], order, k, "_n").drop("_n")


def rank_labels(counts: DataFrame, label: str = "label", n: str = "tickets") -> DataFrame:
    """Rank of every label by frequency; one row per label, so one small partition."""
    return counts.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col(n).desc())))


def popularity_weight(causes: DataFrame, exponent: float = 0.6) -> DataFrame:
    """1 / rank ** exponent inside a category, by frequency then name.

    ``causes`` has one row per root cause (category, root_cause_id, tickets).
    """
    order = Window.partitionBy("category").orderBy(F.col("tickets").desc(), "root_cause_id")
    return causes.withColumn("weight", F.pow(F.row_number().over(order).cast("double"), F.lit(-exponent)))
