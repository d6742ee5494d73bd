"""Exact nearest vectors through a distributed metric index.

Equal vectors count once. Distinct vectors lie in cells around pivots, a bounded sample of them; a cell has a
radius, the largest distance of a member from its pivot. No member of a cell scores more for a query q than
``q . pivot + |q| * radius`` (Cauchy-Schwarz), whatever the lengths of the vectors. A query first visits the
cells nearest to it until they hold enough members; its k-th best score there is a floor, and of the other
cells it visits only those whose bound reaches the floor. Results are exact; how much is pruned depends on the
data (``visited_share``). Rows that travel are a query's live cells, ``MOST_CELLS`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.operators.blockjoin import BLOCK_ROWS, SIMILARITY_DIGITS, Side, best_k, block_join
from deskstream.operators.windows import topk_per_key
from deskstream.schemas import DEFAULTS
from deskstream.session import written

CELL_ROWS = 1024  # rows a cell should have; beyond MOST_CELLS cells grow and are cut into chunks
MOST_CELLS = 2048  # bounds what the driver holds of the index: pivots, radii and sizes of so many cells
MARGIN = 1e-6


def distinct_vectors(frame: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """((name, embedding) of distinct vectors under their smallest id, (name, id) of all rows)."""
    first = written(frame.groupBy("embedding").agg(F.min("id").alias(name)), "vectors")
    return first.select(name, "embedding"), frame.join(first, "embedding").select(name, "id")


class Pivots:
    """Pivots of the cells and, once the members are placed, radii and sizes."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.radius, self.size = vectors, np.zeros(len(vectors)), np.zeros(len(vectors), np.int64)
        self.square = (vectors**2).sum(axis=1)

    @staticmethod
    def choose(distinct: DataFrame, rows: int) -> Pivots:
        """At most ``MOST_CELLS`` vectors in the order of a hash of their ids."""
        n = max(1, min(MOST_CELLS, -(-distinct.count() // rows)))
        some = distinct.orderBy(F.xxhash64("id"), "id").limit(n).select("embedding").collect()
        return Pivots(np.array([r["embedding"] for r in some], float) if some else np.zeros((0, 0)))

    def distances(self, x: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.zeros((len(x), 0))
        square = (x**2).sum(axis=1)[:, None] + self.square - 2 * (x @ self.vectors.T)
        return np.sqrt(np.maximum(square, 0.0))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The most that a member of each cell can score for each row of ``x``."""
        if not len(self.vectors):
            return np.zeros((len(x), 0))
        length = np.sqrt((x**2).sum(axis=1))
        return x @ self.vectors.T + length[:, None] * self.radius


def near_pivots(rows: DataFrame, n: int, tau: float) -> DataFrame:
    """``rows`` (id, embedding, ...) with ``home``, the nearest of ``n`` pivots, and ``reach``, the pivots around which a row can score ``tau``."""
    wide = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names, at = list(rows.columns), rows.columns.index("embedding")
    some = rows.where(F.size("embedding") > 0).orderBy(F.xxhash64("id"), "id").limit(4 * min(n, MOST_CELLS)).select("embedding").collect()
    pivots = Pivots(np.array(list(dict.fromkeys(tuple(r["embedding"]) for r in some)), float)[:n])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = pivots.distances(_matrix(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))], names=[*names, "home", "far"])

    placed = written(rows.mapInArrow(home, f"{wide}, home INT, far DOUBLE"), "placed")
    for r in placed.groupBy("home").agg(F.max("far").alias("radius")).collect():  # a row a pivot
        pivots.radius[r["home"]] = r["radius"] + MARGIN
    used = pivots.radius > 0

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                row, pivot = np.nonzero((pivots.bounds(_matrix(batch.column(at))) >= tau - MARGIN) & used)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pivot.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "home", "reach"])

    return placed.drop("far").mapInArrow(reach, f"{wide}, home INT, reach ARRAY<INT>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def place(distinct: DataFrame, pivots: Pivots) -> DataFrame:
    """(cell, id, embedding, floor): every vector in the cell of its nearest pivot, written; fills radii and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = pivots.distances(_matrix(batch.column(1)))
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1), pa.array(far.min(axis=1))], names=["cell", "id", "embedding", "far"])

    kind = dict(distinct.dtypes)["embedding"]
    placed = written(distinct.select("id", "embedding").mapInArrow(run, f"cell INT, id BIGINT, embedding {kind}, far DOUBLE"), "cells")
    for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        pivots.radius[r["cell"]], pivots.size[r["cell"]] = r["radius"] + MARGIN, r["n"]
    return placed.select(F.col("cell").cast("string").alias("cell"), "id", "embedding", F.lit(float("-inf")).alias("floor"))


def _visits(queries: DataFrame, pivots: Pivots, k: int, home: bool) -> DataFrame:
    """(cell, id, embedding, floor): the cells that a query visits first, or those besides whose bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                x = _matrix(batch.column(1))
                order = np.argsort(pivots.distances(x), axis=1, kind="stable")
                held = np.cumsum(pivots.size[order], axis=1)
                first = np.zeros(order.shape, bool)
                np.put_along_axis(first, order, held - pivots.size[order] <= k, axis=1)
                go = first if home else ~first & (pivots.bounds(x) >= batch.column(2).to_numpy()[:, None] - MARGIN)
                row, cell = np.nonzero(go)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(str), pa.string()), *taken.columns], names=["cell", "id", "embedding", "floor"])

    kind = dict(queries.dtypes)["embedding"]
    return queries.select("id", "embedding", "floor").mapInArrow(run, f"cell STRING, id BIGINT, embedding {kind}, floor DOUBLE")


def _best(visits: DataFrame, placed: DataFrame, k: int, block: int) -> DataFrame:
    def kernel(lt: Side, rt: Side) -> pa.Table:
        ri = rt.longs("id")
        scores = np.round(lt.matrix() @ rt.matrix().T, SIMILARITY_DIGITS)
        rows, cols = best_k(scores, ri, scores >= lt.longs("floor")[:, None] - MARGIN, k)
        return pa.table({"qid": lt.longs("id")[rows], "id": ri[cols], "cosine": scores[rows, cols]})

    hits = block_join(visits, placed, kernel, "qid BIGINT, id BIGINT, cosine DOUBLE", block)
    return topk_per_key(hits, ["qid"], [F.col("cosine").desc(), F.col("id")], k)


def nearest(queries: DataFrame, distinct: DataFrame, k: int, block: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, Pivots]:
    """((qid, id, cosine) of the best ``k`` distinct vectors, second visits, index). Both sides are (id, embedding)."""
    pivots = Pivots.choose(distinct, cell_rows)
    placed = place(distinct, pivots)
    open_ = queries.select("id", "embedding", F.lit(float("-inf")).alias("floor"))
    near = written(_best(_visits(open_, pivots, k, True), placed, k, block), "near")
    floors = near.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("cosine").alias("floor"))
    bounded = queries.join(floors, "id", "left").select("id", "embedding", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    more = written(_visits(bounded, pivots, k, False), "visits")
    far = _best(more, placed, k, block)
    both = near.drop("rank").unionByName(far.drop("rank"))
    return topk_per_key(both, ["qid"], [F.col("cosine").desc(), F.col("id")], k).drop("rank"), more, pivots


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int = DEFAULTS.retrieval_leg, block: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(qid, id, cosine, rank): exact nearest ``k`` corpus rows per query, itself excluded.

    Both sides have id and embedding. Rank is 0-based, ties go to the smaller id. One more than ``k`` is
    searched for, because a query may find itself; of equal vectors only so many smallest ids can be among the best.
    """
    asked, askers = distinct_vectors(queries, "gid")
    vectors, members = distinct_vectors(corpus, "vid")
    hits, _, _ = nearest(asked.withColumnRenamed("gid", "id"), vectors.withColumnRenamed("vid", "id"), k + 1, block, cell_rows)
    few = topk_per_key(members, ["vid"], [F.col("id")], k + 1).drop("rank")
    best = [F.col("cosine").desc(), F.col("id")]
    found = hits.select(F.col("qid").alias("gid"), F.col("id").alias("vid"), "cosine").join(few, "vid")
    found = topk_per_key(found, ["gid"], best, k + 1).drop("rank", "vid")
    mine = found.join(askers.withColumnRenamed("id", "qid"), "gid").where(F.col("qid") != F.col("id")).drop("gid")
    ranked = topk_per_key(mine, ["qid"], best, k)
    return ranked.select("qid", "id", "cosine", (F.col("rank") - 1).alias("rank"))


def visited_share(queries: DataFrame, corpus: DataFrame, k: int = DEFAULTS.retrieval_leg, cell_rows: int = CELL_ROWS) -> float:
    """The share of (query, cell) that is visited after the first visits."""
    asked, _ = distinct_vectors(queries, "gid")
    vectors, _ = distinct_vectors(corpus, "vid")
    _, more, pivots = nearest(asked.withColumnRenamed("gid", "id"), vectors.withColumnRenamed("vid", "id"), k + 1, cell_rows=cell_rows)
    return more.count() / max(1, asked.count() * len(pivots.vectors))
