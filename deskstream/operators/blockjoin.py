"""Blocked similarity joins: numpy products inside bounded tasks, laid out by Spark.

A *cell* is a set of rows that must be compared with each other (a product in a time
slice, a split, a whole corpus). Cell sizes are counted first, every side of a cell is
cut into chunks of a bounded number of rows by a hash of the id, and one task sees one
left chunk and one right chunk. A hot cell therefore becomes many tasks of the same
bounded size, and each task emits only what its kernel keeps (matches above a threshold,
the best k, or counts), never the pairs it looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from deskstream.schemas import DEFAULTS
from deskstream.session import written

BLOCK_ROWS = 4096  # chunk size of a small cell; large cells use up to GROWTH times as much
GROWTH = 4
STEP_ROWS = 512  # left rows scored at a time, so a score matrix stays below 100 MB
WINDOW_ROWS = 65_536  # chunk size of the look-back joins: a row is copied once for each chunk of the other side
SCORES = GROWTH * BLOCK_ROWS * STEP_ROWS  # fewer left rows at a time where the right chunk is larger
MEMBERS = 32  # tickets of a class in one row
HOT = 4096  # tickets of a class that are listed together
PAIRS_ROWS = 1 << 20  # pairs of tickets looked at together
SIMILARITY_DIGITS = 9  # ranks must not depend on the summation order of a dot product


def _chunked(side: DataFrame, sizes: DataFrame, block: int, own: str, other: str, role: int) -> DataFrame:
    """Attach the own chunk by hash and fan out over the chunks of the other side."""
    # sixteen chunks before a chunk grows: parallel when small, less copying when large
    rows = lambda n: F.least(F.lit(GROWTH * block), F.greatest(F.lit(block), F.ceil(F.col(n) / 16)))
    chunks = lambda n: F.ceil(F.col(n) / rows(n)).cast("int")
    own_chunk = F.pmod(F.xxhash64("id"), chunks(own)).cast("int")
    fan = F.explode(F.sequence(F.lit(0), chunks(other) - 1))
    sized = side.join(sizes, "cell")
    if role == 0:
        return sized.select("*", own_chunk.alias("_lc")).select("*", fan.alias("_rc")).drop("_nl", "_nr")
    return sized.select("*", own_chunk.alias("_rc")).select("*", fan.alias("_lc")).drop("_nl", "_nr")


class Side:
    """One chunk as numpy columns, converted once."""

    def __init__(self, table: pa.Table):
        self.table = table
        self._columns: dict[str, np.ndarray] = {}

    def longs(self, name: str) -> np.ndarray:
        if name not in self._columns:
            self._columns[name] = self.table.column(name).to_numpy()
        return self._columns[name]

    def once(self, name: str, build: Callable[[pa.Table], object]) -> object:
        """What ``build`` makes of the chunk, made at its first use."""
        if name not in self._columns:
            self._columns[name] = build(self.table)
        return self._columns[name]

    def flat(self, name: str) -> np.ndarray:
        """All values of a list column, one list after the other."""
        return self.once(name, lambda table: table.column(name).combine_chunks().flatten().to_numpy())

    def matrix(self, name: str = "embedding") -> np.ndarray:
        """A list column as a dense float64 matrix."""
        if name not in self._columns:
            column = self.table.column(name).combine_chunks()
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            self._columns[name] = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
        return self._columns[name]


def block_join(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[Side, Side], pa.Table],
    schema: str,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``kernel(left_rows, right_rows)`` for every pair of chunks of every cell.

    Both sides have ``cell`` (string), ``id`` (long) and the same further columns. The cell
    sizes are counted and written first, so the planner knows their bytes: below its own
    threshold it broadcasts them and the rows are shuffled once, straight to their chunks; beyond
    that the rows meet the sizes in a shuffle join, which it splits where it is skewed.
    """
    sizes = written(
        left.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("_nl"))
        .join(right.groupBy("cell").agg(F.count(F.lit(1)).alias("_nr")), "cell")
    )
    lefts = _chunked(left, sizes, block, "_nl", "_nr", 0).withColumn("_side", F.lit(0))
    rights = _chunked(right, sizes, block, "_nr", "_nl", 1).withColumn("_side", F.lit(1))
    both = lefts.unionByName(rights)

    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        if side.min() == side.max():  # the hash left one of the chunks empty
            return nothing
        mine = table.take(np.flatnonzero(side == 0))
        theirs = Side(table.take(np.flatnonzero(side == 1)))
        step = max(1, min(STEP_ROWS, SCORES // len(theirs.table)))
        steps = range(0, max(len(mine), 1), step)
        return pa.concat_tables([kernel(Side(mine.slice(start, step)), theirs) for start in steps])

    return both.groupBy("cell", "_lc", "_rc").applyInArrow(run, schema)


def best_k(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the ``k`` best allowed scores per row; ties by smaller id."""
    masked = np.where(allowed, scores, -np.inf)
    by_id = np.argsort(ids, kind="stable")
    if masked.shape[1] > 4 * k:
        # everything at or above the k-th value stays, so ties are settled by id below
        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        masked = np.where(masked >= kth[:, None], masked, -np.inf)
    rows, cols = np.nonzero(np.isfinite(masked[:, by_id]))
    cols = by_id[cols]
    order = np.lexsort((ids[cols], -masked[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(masked.shape[0]))
    position = np.arange(len(rows)) - starts[rows] if len(rows) else np.empty(0, int)
    keep = position < k
    return rows[keep], cols[keep]


# ------------------------------------------------------- pairs in a time window
def window_cells(vectors: DataFrame, window_hours: float, tau: float, block: int = WINDOW_ROWS) -> tuple[DataFrame, DataFrame]:
    """Query and candidate sides of the look-back join.

    A cell is (product, time slice of the window length); a query looks into its own slice and the one before.
    Where a slice holds more than a block, cells are cut further by the nearest of some pivots (``Pivots``), as many
    as the fullest slice has blocks: a query goes only to pivots around which a candidate can reach ``tau``, so
    tickets about different things never meet, and equal vectors stand in one cell.
    """
    width = int(window_hours * 3_600_000_000)
    at = F.unix_micros("created_at")
    closed = (
        F.coalesce(F.unix_micros("resolved_at"), F.lit(2**62)) if "resolved_at" in vectors.columns else F.lit(2**62)
    )
    # labels travel as hashes, NULL as -1, so that the tasks compare integers
    extra = [
        F.coalesce(F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.lit(-1)).alias(c)
        for c in ("incident_id", "root_cause_id")
        if c in vectors.columns
    ]
    base = vectors.select(
        F.col("ticket_id").alias("id"),
        "product",
        at.alias("at"),
        closed.cast("bigint").alias("closed"),
        F.floor(at / F.lit(width)).alias("slot"),
        *extra,
        "embedding",
    )
    from deskstream.operators.metricindex import near_pivots

    fullest = base.groupBy("product", "slot").count().agg(F.max("count")).first()[0] or 0
    if fullest > block:
        base = near_pivots(base, -(-fullest // block), tau)
    else:
        base = base.withColumns({"home": F.lit(0), "reach": F.array(F.lit(0))})
    cell = lambda slot, pivot: F.concat_ws("|", F.col("product"), slot.cast("string"), pivot.cast("string"))
    candidates = base.withColumn("cell", cell(F.col("slot"), F.col("home"))).drop("product", "slot", "home", "reach")
    queries = (
        base.withColumn("_p", F.explode("reach"))
        .withColumn("_s", F.explode(F.array(F.col("slot") - 1, F.col("slot"))))
        .withColumn("cell", cell(F.col("_s"), F.col("_p")))
        .drop("product", "slot", "home", "reach", "_p", "_s")
    )
    return queries, candidates


def _window_scores(left: Side, right: Side, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rounded cosines and the mask of pairs inside the window, candidate first."""
    lt, rt = left.longs("at"), right.longs("at")
    li, ri = left.longs("id"), right.longs("id")
    closed = right.longs("closed")
    scores = np.round(left.matrix() @ right.matrix().T, SIMILARITY_DIGITS)
    earlier = (rt[None, :] < lt[:, None]) | ((rt[None, :] == lt[:, None]) & (ri[None, :] < li[:, None]))
    inside = rt[None, :] >= lt[:, None] - width
    still_open = closed[None, :] > lt[:, None]
    return li, ri, scores, earlier & inside & still_open


def _by_class(vectors: DataFrame, window_hours: float, tau: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the look-back join in cells of (kind, slice), one row for a class of equal vectors in a slice.

    A class has its vector once and its tickets as a list, cut into rows of at most ``MEMBERS``; classes of more than ``HOT``
    tickets are dealt out before, so that no list has to fit one task as a whole. Vectors count as equal by a hash of their
    text; unlike spellings of equal vectors only make two classes of one.
    """
    width = int(window_hours * 3_600_000_000)
    at = F.unix_micros("created_at")
    closed = F.coalesce(F.unix_micros("resolved_at"), F.lit(2**62)) if "resolved_at" in vectors.columns else F.lit(2**62)
    rows = vectors.where(F.col("embedding").isNotNull()).select(
        F.coalesce(F.concat(F.lit("p"), "product"), F.lit("")).alias("kind"), F.floor(at / F.lit(width)).alias("slot"),
        F.md5(F.to_json("embedding")).alias("same"), F.struct(F.col("ticket_id").alias("id"), at.alias("at"), closed.cast("bigint").alias("closed")).alias("m"), "embedding",
    )
    hot = written(rows.groupBy("kind", "slot", "same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "hot")
    dealt = rows.join(hot, ["kind", "slot", "same"], "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("m.id"), F.ceil(F.col("n") / HOT)), F.lit(0)))
    listed = dealt.groupBy("kind", "slot", "same", "deal").agg(F.collect_list("m").alias("all"), F.first("embedding").alias("embedding"))
    some = F.sequence(F.lit(0), F.expr(f"(size(all) - 1) div {MEMBERS}").cast("int"))
    cut = listed.withColumn("_k", F.explode(some)).withColumn("some", F.slice("all", F.col("_k") * MEMBERS + 1, MEMBERS))
    classes = cut.select(
        F.array_min("some.id").alias("id"), "kind", "slot", F.array_min("some.at").alias("low"), F.array_max("some.at").alias("high"),
        F.col("some.id").alias("ids"), F.col("some.at").alias("ats"), F.col("some.closed").alias("closeds"), "embedding",
    )
    classes = written(classes, "classes")

    fullest = classes.groupBy("kind", "slot").count().agg(F.max("count")).first()[0] or 0
    if fullest > block:
        from deskstream.operators.metricindex import near_pivots

        classes = near_pivots(classes, -(-fullest // block), tau)
    else:
        classes = classes.withColumns({"home": F.lit(0), "reach": F.array(F.lit(0))})
    cell = lambda slot, pivot: F.concat_ws("|", "kind", slot.cast("string"), pivot.cast("string"))
    columns = ("id", "low", "high", "ids", "ats", "closeds", "embedding")
    right = classes.select(cell(F.col("slot"), F.col("home")).alias("cell"), *columns)
    left = classes.withColumn("_p", F.explode("reach")).withColumn("_s", F.explode(F.array(F.col("slot") - 1, F.col("slot"))))
    return left.select(cell(F.col("_s"), F.col("_p")).alias("cell"), *columns), right


def _window_pairs(left: Side, right: Side, width: int, tau: float):
    """In bounded parts: places of the left and right tickets that are similar and inside the window, and their similarity."""
    scores = np.round(left.matrix() @ right.matrix().T, SIMILARITY_DIGITS)
    near = (right.longs("low") <= left.longs("high")[:, None]) & (right.longs("high") >= left.longs("low")[:, None] - width)
    x, y = np.nonzero(near & (scores >= tau))
    sizes = [side.once("sizes", lambda t: np.asarray(t.column("ids").combine_chunks().value_lengths())) for side in (left, right)]
    (nl, nr), (l0, r0) = sizes, (np.cumsum(n) - n for n in sizes)
    lt, li = left.flat("ats"), left.flat("ids")
    rt, ri, closed = right.flat("ats"), right.flat("ids"), right.flat("closeds")
    count = nl[x].astype(np.int64) * nr[y]
    ends = np.cumsum(count)
    start = 0
    while start < len(x):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_ROWS, "right")))
        c = count[start:stop]
        pair = np.repeat(np.arange(start, stop), c)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(c) - c, c)
        mine, theirs = l0[x[pair]] + place // nr[y[pair]], r0[y[pair]] + place % nr[y[pair]]
        earlier = (rt[theirs] < lt[mine]) | ((rt[theirs] == lt[mine]) & (ri[theirs] < li[mine]))
        kept = earlier & (rt[theirs] >= lt[mine] - width) & (closed[theirs] > lt[mine])
        pair = pair[kept]
        yield mine[kept], theirs[kept], scores[x[pair], y[pair]]
        start = stop


def duplicate_pairs(
    vectors: DataFrame,
    tau: float = DEFAULTS.tau,
    window_hours: float = DEFAULTS.window_hours,
    k: int | None = None,
    block: int = WINDOW_ROWS,
) -> DataFrame:
    """(ticket_id, similar_id, similarity): earlier open tickets of the product within the window.

    ``vectors`` has ticket_id, product, created_at, embedding (unit norm) and optionally
    resolved_at. With ``k``, each task keeps the best ``k`` per ticket and the merge keeps
    the best ``k`` overall; taking the best k first and cutting at tau after gives the same rows.
    """
    width = int(window_hours * 3_600_000_000)
    queries, candidates = _by_class(vectors, window_hours, tau, block)

    def kernel(left: Side, right: Side) -> pa.Table:
        li, ri = left.flat("ids"), right.flat("ids")
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for mine, theirs, similarity in _window_pairs(left, right, width, tau):
            if k is not None:
                order = np.lexsort((ri[theirs], -similarity, mine))
                mine, theirs, similarity = mine[order], theirs[order], similarity[order]
                best = np.arange(len(mine)) - np.searchsorted(mine, mine) < k
                mine, theirs, similarity = mine[best], theirs[best], similarity[best]
            parts.append((li[mine], ri[theirs], similarity))
        return pa.table(dict(zip(("ticket_id", "similar_id", "similarity"), (np.concatenate(x) for x in zip(*parts)))))

    pairs = block_join(queries, candidates, kernel, "ticket_id BIGINT, similar_id BIGINT, similarity DOUBLE", block)
    if k is None:
        return pairs
    from deskstream.operators.windows import topk_per_key

    return topk_per_key(pairs, ["ticket_id"], [F.col("similarity").desc(), F.col("similar_id")], k).drop("rank")


def duplicate_links(vectors: DataFrame, tau: float = DEFAULTS.tau, window_hours: float = DEFAULTS.window_hours) -> DataFrame:
    """The stored links: best 20 per ticket."""
    return duplicate_pairs(vectors, tau, window_hours, DEFAULTS.neighbours)


def similar_recent(
    vectors: DataFrame,
    tau: float = DEFAULTS.tau,
    window_hours: float = DEFAULTS.window_hours,
    cap: int | None = None,
    block: int = WINDOW_ROWS,
) -> DataFrame:
    """(ticket_id, similar_recent): how many earlier similar tickets; counted inside the tasks.

    Training counts all of them, serving at most ``cap`` = 20.
    """
    width = int(window_hours * 3_600_000_000)
    queries, candidates = _by_class(vectors, window_hours, tau, block)

    def kernel(left: Side, right: Side) -> pa.Table:
        n = np.zeros(len(left.flat("ids")), np.int64)
        for mine, _, _ in _window_pairs(left, right, width, tau):
            n += np.bincount(mine, minlength=len(n))
        return pa.table({"ticket_id": left.flat("ids")[n > 0], "n": n[n > 0]})

    counts = block_join(queries, candidates, kernel, "ticket_id BIGINT, n BIGINT", block)
    total = F.sum("n")
    counts = counts.groupBy("ticket_id").agg((total if cap is None else F.least(total, F.lit(cap))).alias("n"))
    return (
        vectors.select("ticket_id")
        .join(counts, "ticket_id", "left")
        .select("ticket_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("similar_recent"))
    )


def pair_histogram(
    vectors: DataFrame, thresholds: list[float], window_hours: float = 72.0, block: int = WINDOW_ROWS
) -> DataFrame:
    """Per threshold: pairs at or above it, and how many share the incident or the root cause.

    Only these counts leave a task, whatever the number of pairs.
    """
    width = int(window_hours * 3_600_000_000)
    cuts = sorted(thresholds)
    queries, candidates = window_cells(vectors, window_hours, cuts[0], block)

    def kernel(left: Side, right: Side) -> pa.Table:
        _, _, scores, allowed = _window_scores(left, right, width)
        linc, rinc = left.longs("incident_id"), right.longs("incident_id")
        lrc, rrc = left.longs("root_cause_id"), right.longs("root_cause_id")
        rows, cols = np.nonzero(allowed & (scores >= cuts[0]))
        kept = scores[rows, cols]
        same_inc = (linc[rows] != -1) & (linc[rows] == rinc[cols])
        same_rc = lrc[rows] == rrc[cols]
        out = {"threshold": [], "pairs": [], "same_incident": [], "same_cause": []}
        for cut in cuts:
            at = kept >= cut
            out["threshold"].append(cut)
            out["pairs"].append(int(at.sum()))
            out["same_incident"].append(int((at & same_inc).sum()))
            out["same_cause"].append(int((at & same_rc).sum()))
        return pa.table(out)

    counts = block_join(
        queries,
        candidates,
        kernel,
        "threshold DOUBLE, pairs BIGINT, same_incident BIGINT, same_cause BIGINT",
        block,
    )
    return counts.groupBy("threshold").agg(
        *[F.sum(c).alias(c) for c in ("pairs", "same_incident", "same_cause")]
    )


def similar_above(
    vectors: DataFrame, cell: Column, threshold: float, block: int = BLOCK_ROWS
) -> DataFrame:
    """(cell, first_id, second_id): pairs of a cell with cosine above ``threshold``, first_id < second_id."""
    side = vectors.select(cell.cast("string").alias("cell"), "id", "embedding")

    def kernel(lt: Side, rt: Side) -> pa.Table:
        li, ri = lt.longs("id"), rt.longs("id")
        scores = np.round(lt.matrix() @ rt.matrix().T, SIMILARITY_DIGITS)
        rows, cols = np.nonzero((scores > threshold) & (li[:, None] < ri[None, :]))
        return pa.table({"first_id": li[rows], "second_id": ri[cols]})

    return block_join(side, side, kernel, "first_id BIGINT, second_id BIGINT", block)
