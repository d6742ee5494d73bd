"""The registered model queries do the whole search and return all of the result."""

from __future__ import annotations

import inspect
from functools import partial

import pytest
from pyspark.sql import functions as F

from deskstream.operators import modelling
from deskstream.plans import modelling as plans
from deskstream.schemas import CATEGORIES, PRIORITIES


class Stop(Exception):
    pass


def asked(monkeypatch, name, run):
    """The arguments, defaults included, that ``run`` gives to an operator, which is not run."""
    found, signature = {}, inspect.signature(getattr(modelling, name))

    def stop(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        found.update(bound.arguments)
        raise Stop

    with monkeypatch.context() as patch:
        patch.setattr(modelling, name, stop)
        with pytest.raises(Stop):
            run()
    return found


def small(monkeypatch):
    monkeypatch.setattr(modelling, "escalation_gbt", partial(modelling.escalation_gbt, trials=2, max_iter=2))
    monkeypatch.setattr(modelling, "out_of_fold_probs", partial(modelling.out_of_fold_probs, k=2, max_iter=2))


def test_priority_lr_tries_the_whole_grid(inputs, monkeypatch):
    given = asked(monkeypatch, "priority_lr", lambda: plans._priority(inputs))
    assert given["grid"] == (0.3, 1.0, 3.0, 10.0) and given["width"] == 1 << 18 and given["max_iter"] == 50
    assert given["lexicon"] is not None


def test_escalation_gbt_makes_all_trials(inputs, monkeypatch):
    rows = inputs.spark.createDataFrame([("train", 1.0)], "split STRING, y_index DOUBLE")
    given = asked(monkeypatch, "escalation_gbt", lambda: plans._gbt(rows))
    assert given["trials"] == 20 and given["max_iter"] == 100


def test_contributions_of_every_feature(inputs, monkeypatch):
    small(monkeypatch)
    rows = plans._contributions(inputs).collect()
    names = {}
    for r in rows:
        names.setdefault(r["id"], []).append(r["feature"])
    assert len(names) == plans._texts(inputs).where("split = 'test'").count() > 0
    assert all(sorted(x) == sorted(modelling.escalation_names()) for x in names.values())


def test_batch_score_returns_all_that_it_scores(inputs, monkeypatch):
    assert asked(monkeypatch, "category_lr", lambda: plans._score(inputs))["grid"] == (1.0, 3.0, 10.0, 30.0)
    small(monkeypatch)
    monkeypatch.setattr(modelling, "category_lr", partial(modelling.category_lr, max_iter=2))
    monkeypatch.setattr(modelling, "priority_lr", partial(modelling.priority_lr, width=1 << 10, max_iter=2))
    rows = plans._score(inputs).collect()
    assert len(rows) == plans._texts(inputs).count()
    for r in rows:
        assert len(r["factors"]) == 3 and 0 <= r["risk"] <= 1 and 0 < r["priority_conf"] <= 1
        assert len(r["category_probs"]) == len(CATEGORIES) and len(r["priority_probs"]) == len(PRIORITIES)
        assert sum(r["category_probs"]) == pytest.approx(1) and sum(r["priority_probs"]) == pytest.approx(1)


def test_columns_left_out_of_a_wide_fit_change_no_probability(spark):
    """Hashed columns that never vary get no weight, so the fit without them is the fit with them."""
    texts = [f"word{k % 7} again{k % 3} urgent" if k % 2 else f"other{k % 5} today" for k in range(60)]
    rows = [(k, t, PRIORITIES[k % 4 if k % 5 else 0], "PRO") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id BIGINT, text STRING, priority STRING, customer_tier STRING")
    features, prepare, chosen, _ = modelling.priority_lr(frame, frame, grid=(1.0,), width=1 << 10)
    ready = features.transform(prepare(frame))
    full = modelling.fit_lr(modelling.indexed(ready, "priority", PRIORITIES), "features", 1.0)
    assert chosen.model.numFeatures < full.numFeatures
    got = modelling.probabilities(chosen.model.transform(ready.drop("y_index")), "a").select("id", "a")
    want = modelling.probabilities(full.transform(ready), "b").select("id", "b")
    apart = got.join(want, "id").select(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("d")).agg(F.max("d")).first()[0]
    assert apart < 1e-3
