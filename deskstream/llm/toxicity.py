"""Toxicity by exact nearest labelled examples under TF-IDF cosine.

Examples are a bounded sample of labelled rows (``EXAMPLES`` a class, by a seeded hash). Features are
words and word beginnings of four to six bytes; those that go with toxic examples in the sample
(chi-squared, at most ``FEATURES``) form the vocabulary: clean texts mostly share none of them. Inverse document frequencies come from all
documents. The examples' unit vectors go into an inverted index with a maximum weight per
feature and block of examples: for a text, blocks are visited in the order of the bound that these
maxima give on their cosine, and the search ends when no bound beats the K-th neighbour, so neighbours
are exact. Neighbours vote with weights that fall with distance, and a logistic fit on other labelled
rows turns the vote into a calibrated score. Evidence: the nearest examples and their similarity.

The index has at most 2 * EXAMPLES rows of FEATURES weights, a proven bound, and is broadcast.

Defined results: a text without vocabulary words (null, empty) has no neighbours and gets the score
of a vote of none. Rows without an id are scored but teach nothing. Of neighbours at equal distance
those earlier in the index count. Without labels of both classes nothing is learnt and every score is 0.
Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskstream.llm import common as c

EXAMPLES = 4000
CALIBRATION = 2000
FEATURES = 1024
LEAST_CHI2 = 30.0
LEAST_TEXTS = 5
NEIGHBOURS = 15
BLOCK = 128
PRIOR_VOTES = 1.0
LETTERS = c.byte_set((0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF))
BEGINNINGS = (4, 5, 6)


def text_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words (lower-cased letters) and of their beginnings, and the text of each."""
    starts, ends, first = c.word_spans(data, bounds, LETTERS)
    sums = c.prefix_sums(data, c.BYTE_HASH_LOWER)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    hashes, owners = [c.span_hashes(sums, starts, ends)], [owner]
    for size in BEGINNINGS:
        long = ends - starts > size
        hashes.append(c.span_hashes(sums, starts[long], starts[long] + size) ^ c.U64(size))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners)


def _sample(labels: DataFrame, most: int, salt: int) -> DataFrame:
    """At most ``most`` rows of each class, the least by a seeded hash."""
    key = F.xxhash64(F.lit(salt), "doc_id")
    return c.union_all([labels.where(F.col("toxic") == y).orderBy(key, "doc_id").limit(most) for y in (0, 1)])


def _texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(text, toxic) of the sampled rows; at most 2 * EXAMPLES ids are broadcast."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))  # copies would vouch for each other


def _vocabulary(rows: DataFrame) -> np.ndarray:
    """Sorted features that go with the toxic class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, _, data, bounds in c.chunks(batch.column(0)):
                hashes, owner = text_features(data, bounds)
                pairs = np.unique(np.rec.fromarrays([hashes, owner]))
                found, at = np.unique(pairs["f0"], return_inverse=True)
                bad = np.bincount(at, weights=toxic[low + pairs["f1"]], minlength=len(found)).astype(np.int64)
                all_ = np.bincount(at, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(found)), pa.array(all_), pa.array(bad)], names=["feature", "n", "bad"])

    counts = rows.select("text", "toxic").mapInArrow(run, "feature bigint, n bigint, bad bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    clean = total - toxic
    good = F.col("n") - F.col("bad")
    cross = F.col("bad") * F.lit(float(clean)) - good * F.lit(float(toxic))
    chi2 = F.lit(float(total)) * cross * cross / (F.lit(float(toxic) * clean) * F.col("n") * (F.lit(float(total)) - F.col("n") + 1e-9))
    best = counts.withColumn("chi2", chi2).where((F.col("n") >= LEAST_TEXTS) & (cross > 0) & (F.col("chi2") >= LEAST_CHI2)).orderBy(F.col("chi2").desc(), "feature").limit(FEATURES)
    return np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(c.U64))


def _matrix(data: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature number, count) of the vocabulary features of the texts, in order."""
    hashes, owner = text_features(data, bounds)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes
    cells, counts = np.unique(owner[hit] * len(vocabulary) + at[hit], return_counts=True)
    return cells // len(vocabulary), cells % len(vocabulary), counts


def _document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those with each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, _, data, bounds in c.chunks(batch.column(0)):
                counts += np.bincount(_matrix(data, bounds, vocabulary)[1], minlength=len(vocabulary))
        number = np.append(np.arange(len(vocabulary)), -1)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.append(counts, total))], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        out[r["feature"]] = r["n"]
    return int(out[-1]), out[:-1]


class BlockMaxIndex:
    """Unit vectors of the examples as postings by feature in blocks of examples, with the greatest weight of each block.

    Rows stand by their strongest feature, so that a block's maxima are tight.
    """

    def __init__(self, vectors: np.ndarray, toxic: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, -vectors.max(axis=1, initial=0), vectors.argmax(axis=1))) if vectors.size else np.arange(len(vectors))
        self.toxic, self.ids = toxic[order], ids[order]
        blocks = max(1, -(-len(vectors) // BLOCK))
        padded = np.zeros((blocks * BLOCK, vectors.shape[1]), np.float32)
        padded[: len(vectors)] = vectors[order]
        self.postings = padded.reshape(blocks, BLOCK, -1).transpose(2, 0, 1).copy()  # (features, blocks, BLOCK)
        self.most = self.postings.max(axis=2)

    def nearest(self, features: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Exact nearest examples by cosine (of those with a common feature), best first.

        Blocks are visited in the order of their bounds, each time twice as many, until none can hold a better one.
        """
        weights = weights.astype(np.float32)
        bounds = weights @ self.most[features]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rows, scores, low, step = np.zeros(0, np.int64), np.zeros(0, np.float32), 0, 2
        while low < len(order) and (len(rows) < k or bounds[order[low]] >= scores[-1] - 1e-5):
            visit = order[low : low + step]
            dots = np.round(np.einsum("f,fbr->br", weights, self.postings[np.ix_(features, visit)]), 5)
            block, row = np.nonzero(dots > 0)
            rows = np.concatenate([rows, visit[block] * BLOCK + row])
            scores = np.concatenate([scores, dots[block, row]])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            low, step = low + step, step * 2
        return rows, scores


class Model:
    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, index: BlockMaxIndex, calibration: tuple[float, float]):
        self.vocabulary, self.idf, self.index, self.calibration = vocabulary, idf, index, calibration

    def vectors(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, weight) of unit TF-IDF vectors."""
        text, feature, count = _matrix(data, bounds, self.vocabulary)
        weight = (1 + np.log(count)) * self.idf[feature]
        norm = np.sqrt(np.bincount(text, weights=weight**2, minlength=len(bounds) - 1))
        return text, feature, weight / norm[text]

    def votes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Distance-weighted share of toxic neighbours (a prior vote for clean), the neighbours and their similarity."""
        n = len(bounds) - 1
        text, feature, weight = self.vectors(data, bounds)
        edges = np.searchsorted(text, np.arange(n + 1))
        vote, rows, likes = np.zeros(n), [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        for k in np.flatnonzero(np.diff(edges)):
            part = slice(edges[k], edges[k + 1])
            near, like = self.index.nearest(feature[part], weight[part])
            w = 1 / (1.05 - np.minimum(like, 1.0))
            vote[k] = (w * self.index.toxic[near]).sum() / (w.sum() + PRIOR_VOTES)
            rows[k], likes[k] = near, like
        return vote, rows, likes

    def score(self, vote: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * vote + b)))


def _logistic(vote: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, lightly held to zero."""
    x, theta = np.column_stack([vote, np.ones(len(vote))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + 0.01 * theta
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 0.01 * np.eye(2), slope)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sparse(frame: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, counts by feature) of the sampled rows: tasks read the texts, the driver gets at most FEATURES counts a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in c.chunks(batch.column(2)):
                text, feature, count = _matrix(data, bounds, vocabulary)
                edges = pa.array(np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (feature, count)]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:2], *lists], names=["doc_id", "toxic", "feature", "count"])

    columns = frame.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    rows = columns.mapInArrow(run, "doc_id bigint, toxic int, feature array<int>, count array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["feature"]))
    counts = np.zeros((len(rows), len(vocabulary)), np.int32)
    for k, r in enumerate(rows):
        counts[k, r["feature"]] = r["count"]
    return np.array([r["doc_id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], np.int64), counts


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The index from labelled rows outside the held-out fifth; one more fifth calibrates."""
    c.ready(docs.sparkSession)
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    learn = c.saved(_texts(docs, _sample(usable.where(fold > 1), EXAMPLES, 7)), "examples")
    tune = _texts(docs, _sample(usable.where(fold == 1), CALIBRATION, 11))
    if learn.select("toxic").distinct().count() < 2:
        return None
    vocabulary = _vocabulary(learn)
    if not len(vocabulary):
        return None
    total, frequency = _document_frequencies(docs, vocabulary)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    ids, toxic, counts = _sparse(learn, vocabulary)
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.sqrt((weights**2).sum(axis=1, keepdims=True))
    some = norm[:, 0] > 0
    index = BlockMaxIndex((weights[some] / norm[some]).astype(np.float32), toxic[some], ids[some])
    model = Model(vocabulary, idf, index, (8.0, -4.0))

    shares = {y: n for y, n in usable.where(fold > 0).groupBy("toxic").count().collect()}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in c.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(model.votes(data, bounds)[0])], names=["toxic", "vote"])

    seen = tune.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(vote, "toxic int, vote double").toPandas().sort_values(["toxic", "vote"])
    y = seen["toxic"].to_numpy()
    if len(np.unique(y)) == 2:
        weight = np.where(y == 1, shares.get(1, 1) / (y == 1).sum(), shares.get(0, 1) / (y == 0).sum())
        model.calibration = _logistic(seen["vote"].to_numpy(), y, weight / weight.mean())
    return model


SCORE_SCHEMA = "doc_id bigint, score double, neighbours array<bigint>, similarity array<double>"


def toxicity(docs: DataFrame, labels: DataFrame, evidence: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours, similarity) of every document."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low, high, data, bounds in c.chunks(batch.column(1)):
                n = high - low
                if model is None:
                    score, rows, likes = np.zeros(n), [[]] * n, [[]] * n
                else:
                    vote, near, similar = model.votes(data, bounds)
                    score = model.score(vote)
                    rows = [model.index.ids[x[:evidence]] for x in near]
                    likes = [x[:evidence] for x in similar]
                arrays = [pa.array(score), pa.array(rows, pa.list_(pa.int64())), pa.array(likes, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), *arrays], names=["doc_id", "score", "neighbours", "similarity"])

    scored = docs.select("doc_id", "text").mapInArrow(run, SCORE_SCHEMA)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "similarity")
