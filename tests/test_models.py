from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from deskstream.operators import modelling


def test_tree_contributions_add_up_to_the_margin(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    frame = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id BIGINT, x ARRAY<DOUBLE>, y DOUBLE")
    ready = frame.withColumn("features", array_to_vector("x"))
    model = GBTClassifier(labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(ready)
    base = sum(w * t._java_obj.rootNode().prediction() for w, t in zip(model.treeWeights, model.trees))
    out = modelling.tree_contributions(model.transform(ready), model, ["a", "b", "c"])
    for r in out.limit(20).collect():
        total = base + sum(c["value"] for c in r["contributions"])
        margin = sum(w * t.predict(r["features"]) for w, t in zip(model.treeWeights, model.trees))
        assert total == pytest.approx(margin, abs=1e-9)


def test_texts_are_encoded_once(spark):
    frame = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "other")], "id BIGINT, text STRING")
    got = {r["id"]: r["embedding"] for r in modelling.embed_text(frame).collect()}
    assert got[1] == got[2] != got[3] and abs(np.dot(got[1], got[1]) - 1) < 1e-5


def test_platt_recovers_a_logistic_curve(spark):
    rng = np.random.default_rng(5)
    raw = rng.random(4000) * 0.98 + 0.01
    odds = 2.0 * np.log(raw / (1 - raw)) - 1.0
    y = (rng.random(4000) < 1 / (1 + np.exp(-odds))).astype(int)
    frame = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, raw)], "y INT, p DOUBLE")
    slope, intercept = modelling.platt_calibrate(frame)
    assert abs(slope - 2.0) < 0.3 and abs(intercept + 1.0) < 0.3


def test_character_grams_of_a_short_word(spark):
    got = spark.range(1).select(modelling.char_grams(F.lit("ab")).alias("g")).first()["g"]
    assert got == [" ab", "ab ", " ab "]


def test_tree_contributions_are_shapley_values(spark):
    """Against the definition: all subsets of features, unknown ones averaged over the training rows of each split."""
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(1)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] > 0).astype(float)
    frame = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id BIGINT, x ARRAY<DOUBLE>, y DOUBLE").withColumn("features", array_to_vector("x"))
    model = GBTClassifier(labelCol="y", maxIter=3, maxDepth=4, seed=1).fit(frame)
    trees = [(w, modelling._flatten_tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]

    def value(tree, row, known, at=0):
        f = tree["feature"][at]
        if f < 0:
            return tree["value"][at]
        left, right = tree["left"][at], tree["right"][at]
        if f in known:
            return value(tree, row, known, left if row[f] <= tree["threshold"][at] else right)
        return (tree["cover"][left] * value(tree, row, known, left) + tree["cover"][right] * value(tree, row, known, right)) / tree["cover"][at]

    out = modelling.tree_contributions(frame.where("id < 12"), model, list("abcd"))
    for r in out.collect():
        for i, c in enumerate(r["contributions"]):
            others = [j for j in range(4) if j != i]
            want = sum(
                w * factorial(k) * factorial(3 - k) / factorial(4) * (value(t, r["x"], {*s, i}) - value(t, r["x"], set(s)))
                for w, t in trees for k in range(4) for s in combinations(others, k)
            )
            assert c["value"] == pytest.approx(want, abs=1e-9)


def test_isotonic_steps_equal_the_sequential_fit(spark, monkeypatch):
    rng = np.random.default_rng(7)
    for n, digits in ((1, 3), (3000, 3), (500, 1)):
        p = np.round(rng.random(n), digits)
        y = (rng.random(n) < 0.2 + 0.5 * p).astype(int)
        frame = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y INT, p DOUBLE").repartition(4)
        values = np.unique(p)
        want = modelling.pool_adjacent([(v, v, int((p == v).sum()), float(y[p == v].sum())) for v in values])
        got = [tuple(r) for r in modelling.isotonic_steps(frame).orderBy("lo").collect()]
        assert got == want
    means = [s / w for _, _, w, s in want]
    assert all(a < b for a, b in zip(means, means[1:]))
    model = modelling.isotonic_calibrate(frame)
    asked = spark.createDataFrame([(-1.0,), (2.0,), (0.55,), (None,)], "p DOUBLE").select(model.calibrated(F.col("p")).alias("q")).collect()
    assert asked[0]["q"] == means[0] and asked[1]["q"] == means[-1] and means[0] <= asked[2]["q"] <= means[-1]
    assert modelling.isotonic_calibrate(frame.where("p > 5")).x == []


def test_term_weights_shuffle_the_text_and_never_write_the_terms(spark, monkeypatch):
    def refuse(frame):
        raise AssertionError("the terms of all documents were written")

    monkeypatch.setattr(modelling, "cut_lineage", refuse)
    rows = spark.createDataFrame([(1, "ab abcde x"), (2, "ab abcd"), (3, "ab"), (4, "")], "id BIGINT, text STRING")
    for weigh in (modelling.tfidf_char, modelling.tfidf_word):
        weights = weigh(rows, min_df=1)
        got = {}
        for r in weights.collect():
            got.setdefault(r["id"], {})[r["term"]] = r["weight"]
        assert all(abs(sum(w * w for w in terms.values()) - 1) < 1e-9 for terms in got.values())
        if weigh is modelling.tfidf_char:
            assert sorted(got[3]) == [" ab", " ab ", "ab "] and " x " in got[1] and "abcde" in got[1]
            assert weights._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # in the initial plan and the final one


def test_texts_are_embedded_in_one_shuffle_and_folds_carry_no_text(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "same words" if k % 3 else f"text {k}") for k in range(200)] + [(200, None), (201, "")], "id BIGINT, text STRING")
    vectors = modelling.embed_text(rows, modelling.HashedEncoder(8), batch=7)
    got = {r["id"]: r for r in vectors.collect()}
    assert sorted(got) == [k for k in range(202) if k != 200]  # no vector without a text
    encode = modelling.HashedEncoder(8)
    assert all(r["text"] == ("" if k == 201 else "same words" if k % 3 else f"text {k}") for k, r in got.items())
    assert all(np.array_equal(np.float32(r["embedding"]), encode([r["text"]])[0]) for r in got.values())
    assert vectors._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # in the initial plan and the final one

    seen = []
    kept = modelling.written
    monkeypatch.setattr(modelling, "written", lambda frame, label="table": seen.append(frame.columns) or kept(frame, label))
    train = vectors.select("id", "text", array_to_vector("embedding").alias("features"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    probs = modelling.out_of_fold_probs(train.where("id < 150"), train.where("id >= 150"), "y", ["a", "b"], k=2, max_iter=2)
    assert probs.count() == 201 and seen and all("text" not in columns for columns in seen)
