"""Models over the driver tables.

Priority, escalation and what is made from them (contributions, scores) use the operators' defaults; the other fits
have small iteration counts.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.functions import scoring
from deskstream.operators import evaluate
from deskstream.operators import modelling as op
from deskstream.plans.bindings import bind
from deskstream.plans.registry import query
from deskstream.schemas import CATEGORIES, PRIORITIES
from deskstream.session import written
from deskstream.sources.bind import Inputs

WIDTH, ITERATIONS, DIM = 1 << 12, 10, 64

_WEIGHTS = """, p AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1 HAVING count(*) >= {min_df}),
r AS (SELECT id, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM notes) + 1) / (df + 1)) + 1) AS w FROM p JOIN d USING (term)),
n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1)
SELECT id, count(*) AS terms, max(w / norm) AS top_weight, sum(w / norm) AS total_weight FROM r JOIN n USING (id) GROUP BY 1"""


def _digest(weights: DataFrame) -> DataFrame:
    return weights.groupBy("id").agg(
        F.count(F.lit(1)).alias("terms"), F.max("weight").alias("top_weight"), F.sum("weight").alias("total_weight")
    )


@query(
    "tfidf_word",
    bind("notes")
    + r""", toks AS (SELECT id, unnest(w) AS a, generate_subscripts(w, 1) AS k FROM (SELECT id, regexp_extract_all(lower(subject || chr(10) || body), '[\p{L}\p{N}_]{2,}') AS w FROM notes)),
terms AS (SELECT id, a AS term FROM toks UNION ALL SELECT id, a || ' ' || b FROM (SELECT id, a, lead(a) OVER (PARTITION BY id ORDER BY k) AS b FROM toks) WHERE b IS NOT NULL)"""
    + _WEIGHTS.format(min_df=2),
    num="top_weight total_weight",
)
def _tfidf_word(i: Inputs) -> DataFrame:
    return _digest(op.tfidf_word(_texts(i).select("id", "text")))


@query(
    "tfidf_char",
    bind("notes")
    + r""", ws AS (SELECT id, ' ' || word || ' ' AS word, n FROM (SELECT id, word, count(*) AS n FROM
  (SELECT id, unnest(regexp_extract_all(lower(subject || chr(10) || body), '[^\s]+')) AS word FROM notes) GROUP BY 1, 2)),
g AS (SELECT id, n, substr(word, k, s) AS term FROM (SELECT id, n, word, s, unnest(range(1, greatest(length(word) - s + 2, 2))) AS k
  FROM ws, (SELECT unnest([3, 4, 5]) AS s) WHERE s = 3 OR length(word) >= s)),
p AS (SELECT id, term, sum(n) AS tf FROM g GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1 HAVING count(*) >= 3 ORDER BY sum(tf) DESC, term LIMIT 150000),
r AS (SELECT id, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM notes) + 1) / (df + 1)) + 1) AS w FROM p JOIN d USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1)
SELECT id, count(*) AS terms, max(w / norm) AS top_weight, sum(w / norm) AS total_weight FROM r JOIN n USING (id) GROUP BY 1""",
    num="top_weight total_weight",
)
def _tfidf_char(i: Inputs) -> DataFrame:
    return _digest(op.tfidf_char(_texts(i).select("id", "text")))


def _texts(i: Inputs) -> DataFrame:
    """Documents as labelled tickets, split by a hash of the id; escalated follows from tier, priority and category."""
    digit = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 1), 16, 10).cast("int")
    odds = scoring.escalation_logit(
        F.col("customer_tier"), F.col("priority"), F.lit(0.0), F.col("category") == "BILLING", F.lit(True),
        scoring.time_features(F.col("created_at"))["off_hours"], F.lit(2), F.col("category"),
    )
    return i.notes.withColumns(
        {
            "text": F.concat("subject", F.lit("\n"), "body"),
            "split": F.when(digit < 10, F.lit("train")).when(digit < 13, F.lit("val")).otherwise(F.lit("test")),
            "root_cause_id": F.concat_ws("-", "category", F.col("id") % 4),
            "prior_tickets_7d": F.col("id") % 6,
            "similar_recent": F.col("id") % 3,
            "escalated": (odds > -1.2).cast("double"),
        }
    )


USED = ["id", "text", "split", "root_cause_id", "category", "priority", "customer_tier", "product", "created_at", "prior_tickets_7d", "similar_recent", "escalated"]


def _labelled(i: Inputs) -> DataFrame:
    """Texts with the columns that models use, written once: every fit reads them again, and only the columns it needs."""
    return written(_texts(i).select(*USED), "texts")


def _embedded(i: Inputs) -> DataFrame:
    """Texts with vectors and their Spark ML form, written once because every fit reads it again."""
    vectors = op.embed_text(_texts(i).select(*USED), op.HashedEncoder(DIM))
    return written(vectors.withColumn("features", array_to_vector("embedding")), "embedded")


def _part(rows: DataFrame, *names: str) -> DataFrame:
    return rows.where(F.col("split").isin(*names))


@query("embed_text")
def _embed(i: Inputs) -> DataFrame:
    rows = op.embed_text(_texts(i).select("id", "text"), op.HashedEncoder(DIM))
    return rows.select("id", F.size("embedding").alias("dim"), scoring.cosine(F.col("embedding"), F.col("embedding")).alias("norm2"))


@query("category_lr")
def _category(i: Inputs) -> DataFrame:
    rows = _embedded(i)
    chosen = op.category_lr(_part(rows, "train"), _part(rows, "val"), "category", CATEGORIES, grid=(3.0, 30.0), max_iter=ITERATIONS)
    return evaluate.classification_report(op.predicted(chosen.model.transform(_part(rows, "test")), CATEGORIES), "category", "pred")


@query("category_mlp")
def _mlp(i: Inputs) -> DataFrame:
    rows = _embedded(i)
    model = op.category_mlp(_part(rows, "train"), "category", CATEGORIES, DIM, hidden=32, max_iter=ITERATIONS)
    return evaluate.classification_summary(op.predicted(model.transform(_part(rows, "test")), CATEGORIES), "category", "pred")


@query("priority_features")
def _priority_features(i: Inputs) -> DataFrame:
    rows = _labelled(i)
    stages, prepare = op.priority_features(rows, WIDTH)
    out = stages.fit(prepare(_part(rows, "train"))).transform(prepare(rows))
    dense = vector_to_array("_ss")
    return out.select("id", F.get(dense, F.lit(0)).alias("deadline"), F.get(dense, F.lit(9)).alias("n_words"), "customer_tier")


@query("priority_lr")
def _priority(i: Inputs) -> DataFrame:
    rows = _labelled(i)
    features, prepare, chosen, weight = op.priority_lr(_part(rows, "train"), _part(rows, "val"), lexicon=i.lexicon)
    scored = chosen.model.transform(features.transform(prepare(_part(rows, "test"))))
    adjusted = scoring.urgent_reweight(vector_to_array("probability"), weight)
    judged = scored.select(F.col("priority").alias("y"), scoring.argmax_label(adjusted, PRIORITIES)["label"].alias("pred"))
    return evaluate.urgent_metrics(judged, PRIORITIES).withColumn("urgent_weight", F.lit(weight))


@query("out_of_fold_probs")
def _oof(i: Inputs) -> DataFrame:
    rows = _embedded(i)
    probs = op.out_of_fold_probs(_part(rows, "train"), _part(rows, "val", "test"), "category", CATEGORIES, max_iter=ITERATIONS)
    return probs.select("id", F.size("probs").alias("classes"), F.array_max("probs").alias("best"))


def _escalation_rows(rows: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, object]:
    """(rows with ``x``, features and y_index, pca) of embedded rows; the class probabilities are out of fold."""
    train, rest = _part(rows, "train"), _part(rows, "val", "test")
    category = op.out_of_fold_probs(train, rest, "category", CATEGORIES)
    priority = op.out_of_fold_probs(train, rest, "priority", PRIORITIES)
    pca = op.fit_pca(train)
    featured = op.escalation_features(rows.drop("features"), pca, category, priority, lexicon)
    ready = featured.withColumns({"features": array_to_vector("x"), "y_index": F.col("escalated")})
    return written(ready.select("id", "split", "x", "features", "y_index"), "escalation"), pca


@query("escalation_features")
def _escalation_features(i: Inputs) -> DataFrame:
    rows, _ = _escalation_rows(_embedded(i), i.lexicon)
    return rows.select("id", F.size("x").alias("width"), F.lit(len(op.escalation_names())).alias("names"), F.get("x", F.lit(56)).alias("tier"))


def _gbt(rows: DataFrame) -> op.Chosen:
    return op.escalation_gbt(_part(rows, "train"), _part(rows, "val"))


def _raw_scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("id", F.col("y_index").alias("y"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


@query("escalation_gbt")
def _escalation(i: Inputs) -> DataFrame:
    rows, _ = _escalation_rows(_embedded(i), i.lexicon)
    chosen = _gbt(rows)
    scores = _raw_scores(chosen.model, _part(rows, "test"))
    return evaluate.roc_auc(scores).join(evaluate.brier(scores)).withColumn("val_auc", F.lit(chosen.score))  # one row each


@query("platt_calibrate")
def _platt(i: Inputs) -> DataFrame:
    """Fitted on the validation half, judged on the test half."""
    slope, intercept = op.platt_calibrate(i.scored.where("id % 2 = 0"))
    calibrated = i.scored.where("id % 2 = 1").select("y", scoring.logit_platt(F.col("p"), slope, intercept).alias("p"))
    return evaluate.ece_binary(calibrated).join(evaluate.brier(calibrated))  # one row each


@query(
    "isotonic_calibrate",
    bind("scored")
    + """, v AS (SELECT p, count(*) AS w, sum(y) AS s, row_number() OVER (ORDER BY p) AS k FROM scored WHERE id % 2 = 0 GROUP BY p),
run AS (SELECT p, k, w, s, sum(w) OVER (ORDER BY k) AS cw, sum(s) OVER (ORDER BY k) AS cs FROM v),
means AS (SELECT a.k AS i, b.k AS j, (b.cs - a.cs + a.s)::DOUBLE / (b.cw - a.cw + a.w)::DOUBLE AS m FROM run a JOIN run b ON b.k >= a.k),
least AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM means),
fit AS (SELECT r.p AS x, f.f AS f FROM (SELECT j AS k, max(m) AS f FROM least GROUP BY 1) f JOIN run r USING (k)),
near AS (SELECT t.id, t.y, t.p, (SELECT max(x) FROM fit WHERE x <= t.p) AS x0, (SELECT min(x) FROM fit WHERE x >= t.p) AS x1 FROM scored t WHERE id % 2 = 1)
SELECT n.id, n.y, CASE WHEN x0 IS NULL THEN b.f WHEN x1 IS NULL OR x0 = x1 THEN a.f ELSE a.f + (b.f - a.f) * (n.p - x0) / (x1 - x0) END AS p
FROM near n LEFT JOIN fit a ON a.x = n.x0 LEFT JOIN fit b ON b.x = n.x1""",
    num="p",
)
def _isotonic(i: Inputs) -> DataFrame:
    """Fitted on the validation half, applied to the test half."""
    model = op.isotonic_calibrate(i.scored.where("id % 2 = 0"))
    return i.scored.where("id % 2 = 1").select("id", "y", model.calibrated(F.col("p")).alias("p"))


@query("contributions")
def _contributions(i: Inputs) -> DataFrame:
    """Tree contributions of the test rows, one row for every feature; with the root values they add up to the margin."""
    rows, _ = _escalation_rows(_embedded(i), i.lexicon)
    model = _gbt(rows).model
    explained = op.tree_contributions(_part(rows, "test"), model, op.escalation_names())
    every = explained.select("id", F.posexplode("contributions").alias("pos", "f"))
    return every.select("id", "pos", "f.feature", F.col("f.value").alias("contribution"))


@query("linear_contributions")
def _linear(i: Inputs) -> DataFrame:
    rows, _ = _escalation_rows(_embedded(i), i.lexicon)
    model = LogisticRegression(labelCol="y_index", maxIter=ITERATIONS, regParam=0.01).fit(_part(rows, "train"))
    explained = op.linear_contributions(_part(rows, "test"), list(model.coefficients), op.escalation_names())
    return op.global_importance(explained)


@query("logreg_baseline")
def _baseline(i: Inputs) -> DataFrame:
    rows, _ = _escalation_rows(_embedded(i), i.lexicon)
    auc = op.logreg_baseline(_part(rows, "train"), _part(rows, "test"), ITERATIONS)
    return _part(rows, "test").agg(F.count(F.lit(1)).alias("n")).withColumn("auc", F.lit(auc))


@query("oracle_model")
def _oracle(i: Inputs) -> DataFrame:
    rows = _texts(i).withColumns(
        {
            "tier": scoring.tier_ordinal(F.col("customer_tier")).cast("double"),
            "urgent": F.col("priority").isin("HIGH", "URGENT").cast("double"),
            "privacy": (F.col("category") == "DATA_PRIVACY").cast("double"),
            "y_index": F.col("escalated"),
        }
    )
    auc = op.oracle_model(_part(rows, "train"), _part(rows, "test"), ["tier", "urgent", "privacy"], ITERATIONS)
    return _part(rows, "test").agg(F.count(F.lit(1)).alias("n")).withColumn("auc", F.lit(auc))


@query("batch_score")
def _score(i: Inputs) -> DataFrame:
    rows = _embedded(i)
    train, val = _part(rows, "train"), _part(rows, "val")
    category = op.category_lr(train, val, "category", CATEGORIES)
    text_only = rows.drop("features")
    features, prepare, priority, weight = op.priority_lr(_part(text_only, "train"), _part(text_only, "val"), lexicon=i.lexicon)
    escalation, pca = _escalation_rows(rows, i.lexicon)
    gbt = _gbt(escalation)
    platt = op.platt_calibrate(_raw_scores(gbt.model, _part(escalation, "val")))
    models = op.Models(category.model, features, prepare, priority.model, weight, pca, gbt.model, platt, lexicon=i.lexicon)
    return op.batch_score(text_only, models)


def _fit_text(train: DataFrame):
    rows = op.indexed(train, "category", CATEGORIES)
    lr = LogisticRegression(featuresCol="tfidf", labelCol="y_index", maxIter=ITERATIONS, regParam=0.001)
    return Pipeline(stages=[*op.text_stages(WIDTH), lr]).fit(rows)


@query("robustness_masked")
def _masked(i: Inputs) -> DataFrame:
    return op.robustness(_labelled(i), None, True, _fit_text, CATEGORIES)


@query("robustness_unseen")
def _unseen(i: Inputs) -> DataFrame:
    """One of the four causes of every category is never trained on; with and without masked codes."""
    rows = _labelled(i)
    causes = rows.select("root_cause_id").distinct().where(F.col("root_cause_id").endswith("-2") | F.col("root_cause_id").endswith("-0"))
    run = lambda mask: op.robustness(rows, causes, mask, _fit_text, CATEGORIES).withColumn("masked", F.lit(mask))
    return run(False).unionByName(run(True))
