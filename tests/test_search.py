"""Search against brute force: stems, cover density, exact top-k with pruning, the metric index, resolved-only legs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskstream.functions import stemming
from deskstream.operators import metricindex, search

STEMS = {
    "refund": "refund", "refunded": "refund", "refunds": "refund", "happiness": "happi", "hoping": "hope", "hopping": "hop", "generally": "general",
    "skies": "sky", "dying": "die", "cries": "cri", "by": "by", "say": "say", "enjoy": "enjoy", "youth": "youth", "agreed": "agre", "feed": "feed",
    "luxuriated": "luxuri", "conflated": "conflat", "sized": "size", "rational": "ration", "relational": "relat", "operator": "oper", "callousness": "callous",
    "sensibility": "sensibl", "triplicate": "triplic", "formative": "format", "electrical": "electr", "replacement": "replac", "adoption": "adopt",
    "bowdlerize": "bowdler", "rate": "rate", "cease": "ceas", "controll": "control", "apology": "apolog", "proceeds": "proceed", "knackeries": "knackeri",
    "consolatory": "consolatori", "knightly": "knight", "403": "403", "b2b": "b2b", "invoices": "invoic", "charging": "charg", "ties": "tie", "gas": "gas", "kiwis": "kiwi",
}


def test_stems(spark):
    frame = spark.createDataFrame([(w,) for w in STEMS], "term string")
    assert {r["term"]: r["stem"] for r in stemming.stems(frame).collect() if r["stem"] != STEMS[r["term"]]} == {}


@pytest.fixture(scope="module")
def notes(spark):
    rng = np.random.default_rng(4)
    forms = ["refund", "refunded", "refunds", "invoice", "invoices", "charging", "charged", "the", "of", "token", "tokens", "sync", *(f"w{k}" for k in range(60))]
    weights = 1 / np.arange(1, len(forms) + 1)
    rows = []
    for k in range(120):
        words = rng.choice(forms, size=int(rng.integers(1, 40)), p=weights / weights.sum())
        rows.append((k, "s", " ".join(words), "token" if k % 3 else None, ["TRIAGED", "RESOLVED", "CLOSED"][k % 3]))
    rows.append((500, None, None, None, None))
    return rows


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def covers(words, asked):
    """Ranks of the shortest runs of places that satisfy "any of the asked stems", one after another."""
    rank, at = 0.0, 0
    while True:
        end = next((p for p in range(at, len(words)) if words[p] in asked), None)
        if end is None:
            return rank
        start = max(p for p in range(end + 1) if words[p] in asked)
        rank += 0.1 / (1 + (end - start))
        at = start + 1


def test_keyword_rank_is_cover_density(spark, notes):
    stem = lambda w: STEMS.get(w, {"invoice": "invoic", "charged": "charg", "tokens": "token"}.get(w, w))
    frame = spark.createDataFrame(notes, "id bigint, subject string, body string, resolution string, status string")
    asked = spark.createDataFrame([(1000, "please refund the invoices"), (3, "charging tokens of w5"), (7, "zzz"), (8, None)], "id bigint, text string")
    found = search.resolved(frame)
    docs = found.select("id", F.regexp_extract_all(F.lower(F.concat_ws(" ", "subject", "body", "resolution")), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))
    got = {}
    for r in search.keyword_topk(asked, docs, k=15).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    want = {}
    for qid, words in ((1000, ["refund", "invoic"]), (3, ["charg", "token"])):
        scores = []
        for i, subject, body, resolution, status in notes:
            if status in ("RESOLVED", "CLOSED") and resolution and i != qid:
                text = [stem(w) for w in tokens(" ".join(x for x in (subject, body, resolution) if x))]
                scores.append((i, round(covers(text, set(words)), 9)))
        want[qid] = sorted((x for x in scores if x[1] > 0), key=lambda x: (-x[1], x[0]))[:15]
    assert got == want


def test_web_search_uses_stems_and_places(spark):
    rows = [(1, "a", "we refunded it", None), (2, "a", "locked out since your update", None), (3, "a", "locks are out of stock", "refunds"), (4, "a", None, None), (5, "50 refund", "x", None)]
    frame = spark.createDataFrame(rows, "id bigint, subject string, body string, resolution string")
    find = lambda q: sorted(r["id"] for r in search.text_search_filter(frame, q).collect())
    assert find("refund") == [1, 3, 5] and find("refunding -lock") == [1, 5] and find('"locking the since"') == [2]
    assert find("refund locks or update") == [2, 3] and find('"out stock"') == [3] and find('"locks stock"') == [] and find('"locks of out"') == [2, 3] and find("the") == [1, 2, 3, 4, 5]


def test_sparse_topk_equals_brute_force(spark, notes):
    """Frequent and rare terms, weights of both signs, small blocks, self excluded or not."""
    rng = np.random.default_rng(9)
    docs = [(i, t, float(n) * (2.0 if len(t) > 4 else -0.3 if t == "the" else 0.4)) for i, _, body, _, _ in notes for t, n in Counter(tokens(body)).items()]
    asks = [(q, str(t), float(rng.integers(1, 4))) for q in range(40) for t in rng.choice(sorted({d[1] for d in docs}), 6, replace=False)]
    left, right = (spark.createDataFrame(x, "id bigint, term string, weight double") for x in (asks, docs))
    for k, block, exclude in ((3, 16, True), (3, 1000, False), (200, 30, True)):
        want = {}
        for q in range(40):
            scores = Counter()
            for _, t, w in (a for a in asks if a[0] == q):
                for i, u, v in docs:
                    if u == t:
                        scores[i] += w * v
            ranked = sorted((-round(s, 9), i) for i, s in scores.items() if round(s, 9) > 0 and not (exclude and i == q))[:k]
            if ranked:
                want[q] = [(i, -s) for s, i in ranked]
        got = {}
        for r in search.sparse_topk(left, right, k, exclude, block).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["id"], r["score"]))
        assert got == want


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 24)) * 0.1
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    x[: n // 4] = x[0]  # a common vector
    return x


def test_metric_index_is_exact_and_prunes(spark):
    x = clustered(400, 2)
    x[300] *= 3.0  # lengths may differ
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, embedding array<float>").repartition(3)
    asked = frame.where("id % 3 = 0")
    scores = np.round(x.astype(float) @ x.astype(float).T, 9)
    for cell_rows, k in ((20, 7), (1000, 120)):
        got = {}
        for r in metricindex.vector_topk(asked, frame, k, cell_rows=cell_rows).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["id"], r["cosine"]))
        want = {q: [(i, scores[q, i]) for i in sorted((i for i in range(400) if i != q), key=lambda i: (-scores[q, i], i))[:k]] for q in range(0, 400, 3)}
        assert got == want
    unit = frame.where("id <> 300")
    assert metricindex.visited_share(unit, unit, 5, cell_rows=20) < 0.5
    assert metricindex.vector_topk(frame.where("id < 0"), frame, 3).count() == 0 and metricindex.vector_topk(frame, frame.where("id < 0"), 3).count() == 0


def test_window_cells_are_cut_by_pivots(spark):
    """Tight topics in one hot product: the same pairs, and queries meet a small part of the candidates."""
    import datetime as dt

    from deskstream.operators import blockjoin

    x = clustered(600, 5)
    rng = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, "api", start + dt.timedelta(seconds=int(rng.integers(0, 50_000))), v.tolist()) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "ticket_id bigint, product string, created_at timestamp, embedding array<float>")
    queries, candidates = blockjoin.window_cells(frame, 24.0, 0.7, block=25)
    met = queries.groupBy("cell").count().join(candidates.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert met < 0.6 * 600 * 600
    pairs = lambda block: sorted(tuple(r) for r in blockjoin.duplicate_pairs(frame, 0.7, 24.0, block=block).collect())
    s = np.round(x.astype(float) @ x.astype(float).T, 9)
    order = [(r[2], r[0]) for r in rows]
    want = sorted((a, b, s[a, b]) for a in range(600) for b in range(600) if order[b] < order[a] and s[a, b] >= 0.7)
    assert pairs(25) == want == pairs(10_000)


def test_a_slice_of_some_thousand_tickets_is_not_copied_to_pivots(spark):
    """A ticket asks in its slice and the one before: no further copies of its vector where a slice fits one chunk."""
    from deskstream.operators import blockjoin

    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.sin(F.col("ticket_id") * (k + 1)).cast("float"))
    frame = spark.range(5000).select(F.col("id").alias("ticket_id"), F.lit("api").alias("product"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    queries, candidates = blockjoin.window_cells(frame.withColumn("embedding", vector), 24.0, 0.1)
    assert queries.count() == 10_000 and candidates.count() == 5000
