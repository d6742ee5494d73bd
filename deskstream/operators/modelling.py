"""Text features, classifiers, calibration and explanations on Spark ML.

Features are hashed to a fixed width, so no vocabulary passes through the driver; only
fitted models (bounded by their parameters) do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce
from math import factorial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import PCA, HashingTF, IDF, NGram, Normalizer, RegexTokenizer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskstream.functions import scoring, text
from deskstream.operators import evaluate, windows
from deskstream.operators.windows import ranked_in_group
from deskstream.schemas import CATEGORIES, PRIORITIES
from deskstream.session import cut_lineage, written

SIGNAL_NAMES = [
    "sig_deadline", "sig_outage", "sig_error_code", "sig_blocked", "sig_legal", "sig_churn",
    "exclaim", "caps_ratio", "questions", "n_words", "vader_neg", "vader_compound",
]
META_NAMES = ["tier", "product", "hour", "weekday", "off_hours", "prior_tickets_7d", "similar_recent"]
PCA_COMPONENTS = 32


# -------------------------------------------------------------- term weights
def _grams(words: Column, sizes: tuple[int, int]) -> Column:
    """Word n-grams of every size in ``sizes``, joined by a blank; linear in the number of words."""

    def of(n: int) -> Column:
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        shifted = [F.slice(words, k + 1, count) for k in range(n)]
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), shifted)

    return reduce(F.concat, [of(n) for n in range(sizes[0], sizes[1] + 1)])


def char_grams(word: Column, sizes: tuple[int, int] = (3, 5)) -> Column:
    """Character n-grams of one word padded with a blank on both sides.

    A padded word shorter than the smallest size counts once as a whole.
    """
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    parts = []
    cut = lambda n: (lambda i: F.substr(padded, i, F.lit(n)))
    for n in range(sizes[0], sizes[1] + 1):
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
        grams = F.transform(starts, cut(n))
        if n == sizes[0]:
            parts.append(grams)
        else:
            # a word that already fitted whole into a smaller size is not repeated
            parts.append(F.when(F.length(padded) >= n, grams).otherwise(F.array().cast("array<string>")))
    return reduce(F.concat, parts)


def tfidf_weights(postings: DataFrame, rows: DataFrame, min_df: int, cap: int | None = None) -> DataFrame:
    """(id, term, weight) from (id, term, tf): 1 + ln tf, smoothed idf, unit length per document.

    ``postings`` come hashed by id and are counted twice, once for the vocabulary: their terms are many times the
    text, so they are never written, and only the text is shuffled to make them. With ``cap`` only the terms that occur
    most often in the corpus stay; that many are broadcast, and a document's terms stay where they are. Without it
    the terms that stay travel to their idf and back.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n_docs"))
    vocabulary = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf")).where(F.col("df") >= min_df)
    if cap is not None:
        vocabulary = vocabulary.orderBy(F.col("ctf").desc(), "term").limit(cap)
    idf = vocabulary.join(F.broadcast(total)).select(  # one row
        "term", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )
    idf = written(idf, "idf")
    raw = postings.join(idf if cap is None else F.broadcast(idf), "term")  # at most ``cap`` rows
    raw = raw.select("id", "term", ((F.log("tf") + 1) * F.col("idf")).alias("w"))
    # one document's terms at a time, so the window is as small as a document
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def tfidf_word(rows: DataFrame, ngrams: tuple[int, int] = (1, 2), min_df: int = 2) -> DataFrame:
    """Word 1-2 grams of (id, text); words have two or more characters."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    listed = rows.repartition("id").select("id", words.alias("words"))
    terms = listed.select("id", F.explode(_grams(F.col("words"), ngrams)).alias("term"))
    return tfidf_weights(terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")), rows, min_df)


def tfidf_char(rows: DataFrame, ngrams: tuple[int, int] = (3, 5), min_df: int = 3, cap: int = 150_000) -> DataFrame:
    """Character 3-5 grams of (id, text), at most ``cap`` of them.

    Words are counted per document first, so a repeated word is cut into grams once.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0))
    counted = rows.repartition("id").select("id", F.explode(words).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    least, most = ngrams
    padded = counted.select("id", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w")).withColumn("l", F.length("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("l") - (least - 1), F.lit(1)))
    placed = padded.select("id", "n", "w", "l", F.explode(starts).alias("k"))
    # the same grams as char_grams, by start: a lambda per gram is not compiled, and they are cut twice
    cuts = [F.when(F.lit(size == least) | (F.col("k") + (size - 1) <= F.col("l")), F.substr("w", "k", F.lit(size))) for size in range(least, most + 1)]
    grams = placed.select("id", "n", F.explode(F.array(*cuts)).alias("term")).where(F.col("term").isNotNull())
    return tfidf_weights(grams.groupBy("id", "term").agg(F.sum("n").alias("tf")), rows, min_df, cap)


# ------------------------------------------------------------------ embeddings
class HashedEncoder:
    """Stateless default encoder: signed hashed words and word pairs, unit length.

    A stand-in for a sentence model: any callable from texts to a matrix can replace it.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, value in enumerate(texts):
            words = re.findall(r"\w+", value.lower())
            tokens = words + [a + " " + b for a, b in zip(words, words[1:])]
            h = np.fromiter((zlib.crc32(token.encode()) for token in tokens), np.uint32, len(tokens))
            out[row] = np.bincount(h % self.dim, np.where(h & 0x80000000, 1.0, -1.0), self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


COPIES = 8  # a text that many rows share lies in so many tasks at most and is encoded once in each


def embed_text(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, batch: int = 32) -> DataFrame:
    """Add ``embedding`` to (.., text): rows meet by text in one shuffle, and a text is
    encoded once for a run of its rows. Rows without text are left out."""
    encode = encoder or HashedEncoder()
    names = rows.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # text and vector of the row before
        for record in batches:
            for start in range(0, len(record), batch):
                part = record.slice(start, batch)
                texts = part.column(at).to_pylist()
                fresh = [t for t in dict.fromkeys(texts) if last is None or t != last[0]]
                vectors = dict(zip(fresh, encode(fresh))) if fresh else {}
                if last:
                    vectors.setdefault(*last)
                out = [vectors[t] for t in texts]
                last = texts[-1], out[-1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float32()))], names=[*names, "embedding"])

    salt = F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in names if x != "text"], F.lit(0)), F.lit(COPIES))
    keyed = rows.where(F.col("text").isNotNull()).withColumns({"_key": F.xxhash64("text"), "_salt": salt})
    met = keyed.repartition("_key", "_salt").sortWithinPartitions("_key", "text").drop("_key", "_salt")
    return met.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


# ------------------------------------------------------------- shared helpers
def text_stages(width: int = 1 << 18, min_df: int = 2, source: str = "text", target: str = "tfidf") -> list:
    """Word 1-2 grams, hashed, idf-weighted, unit length, as Spark ML stages."""
    return [
        RegexTokenizer(inputCol=source, outputCol="_w", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
        NGram(n=2, inputCol="_w", outputCol="_g"),
        HashingTF(numFeatures=width, inputCol="_w", outputCol="_h1"),
        HashingTF(numFeatures=width, inputCol="_g", outputCol="_h2"),
        VectorAssembler(inputCols=["_h1", "_h2"], outputCol="_h"),
        IDF(minDocFreq=min_df, inputCol="_h", outputCol="_i"),
        Normalizer(inputCol="_i", outputCol=target),
    ]


def indexed(rows: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Add ``y_index``: the position of the label in ``classes`` (a fixed order, so models agree on it)."""
    order = F.array(*[F.lit(c) for c in classes])
    return rows.withColumn("y_index", (F.array_position(order, F.col(label)) - 1).cast("double"))


def balanced(rows: DataFrame, by: str = "y_index") -> DataFrame:
    """Add ``weight``: rows / (classes * rows of the class)."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = sizes.join(F.broadcast(total)).select(by, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), by)  # one row per class


def probabilities(scored: DataFrame, target: str) -> DataFrame:
    return scored.withColumn(target, vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")


def predicted(scored: DataFrame, classes: list[str]) -> DataFrame:
    """Add ``pred`` and ``conf`` from ``probability``."""
    best = scoring.argmax_label(vector_to_array("probability"), classes)
    return scored.withColumn("_b", best).withColumns({"pred": F.col("_b.label"), "conf": F.col("_b.confidence")}).drop("_b")


BLOCK_MB = 16  # a block of rows costs a pass over all coefficients, so wide features need large blocks
FITS = 4  # fits that run at a time: each is a chain of small jobs, which leaves cores idle


def _together(spark: SparkSession, fits: list[Callable[[], object]]) -> list:
    """What independent fits return, in their order. For small models: each holds its state on the driver while it runs."""
    calls = [inheritable_thread_target(spark)(fit) for fit in fits]
    with ThreadPool(min(FITS, len(calls))) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)


# ---------------------------------------------------------------- classifiers
@dataclass
class Chosen:
    """A fitted model, its validation score and the parameter it was chosen by."""

    model: Transformer
    score: float
    parameter: float


def fit_lr(train: DataFrame, features: str, strength: float, max_iter: int = 50) -> LogisticRegressionModel:
    """Class-balanced multinomial logistic regression; ``strength`` is the inverse penalty on the summed loss."""
    weighted = balanced(train)
    n = train.count()
    lr = LogisticRegression(
        featuresCol=features, labelCol="y_index", weightCol="weight", family="multinomial",
        regParam=1.0 / (strength * n), maxIter=max_iter, maxBlockSizeInMB=BLOCK_MB,
    )
    return lr.fit(weighted)


def category_lr(
    train: DataFrame, val: DataFrame, label: str, classes: list[str], features: str = "features",
    grid: tuple[float, ...] = (1.0, 3.0, 10.0, 30.0), max_iter: int = 50,
) -> Chosen:
    """The grid point with the best macro F1 on ``val``."""
    fitted, best = indexed(train, label, classes), None
    for strength in grid:
        model = fit_lr(fitted, features, strength, max_iter)
        judged = predicted(model.transform(val), classes)
        score = evaluate.classification_summary(judged, label, "pred").first()["macro_f1"]
        if best is None or score > best.score:
            best = Chosen(model, score, strength)
    return best


def category_mlp(train: DataFrame, label: str, classes: list[str], width: int, hidden: int = 256, max_iter: int = 50, features: str = "features") -> Transformer:
    layers = [width, hidden, len(classes)]
    mlp = MultilayerPerceptronClassifier(featuresCol=features, labelCol="y_index", layers=layers, maxIter=max_iter, seed=0)
    return mlp.fit(indexed(train, label, classes))


def signal_columns(rows: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Add the twelve text signals as ``signals`` (array<double>); sentiment is 0 without a lexicon."""
    body = F.col("text")
    fired = text.urgency_signals(body)
    stats = text.text_stats(body)
    out = rows.withColumn("_u", fired).withColumn("_s", stats)
    if lexicon is not None:
        from deskstream.operators.projection import sentiment_lexicon

        scores = sentiment_lexicon(rows.select("id", text.tokens(F.col("text")).alias("tokens")), F.broadcast(lexicon))  # one row a word
        out = out.join(scores, "id", "left")
    else:
        out = out.withColumns({"neg": F.lit(0.0), "compound": F.lit(0.0)})
    names = [name for name, _, _ in text.SIGNAL_PATTERNS]
    values = [F.col(f"_u.{n}").cast("double") for n in names]
    values += [F.col(f"_s.{n}").cast("double") for n in ("exclaim", "caps_ratio", "questions", "n_words")]
    values += [F.coalesce(c, F.lit(0.0)) for c in ("neg", "compound")]
    return out.withColumn("signals", F.array(*values)).drop("_u", "_s", "neg", "compound")


def priority_features(train: DataFrame, width: int = 1 << 18, lexicon: DataFrame | None = None) -> tuple[Pipeline, Callable[[DataFrame], DataFrame]]:
    """(unfitted feature stages, preparation): TF-IDF, scaled signals and tier one-hot in ``features``."""

    def prepare(rows: DataFrame) -> DataFrame:
        marked = signal_columns(rows, lexicon)
        return marked.withColumns(
            {"_sv": array_to_vector("signals"), "_tv": array_to_vector(scoring.one_hot_tier(F.col("customer_tier")))}
        )

    stages = [
        *text_stages(width),
        StandardScaler(inputCol="_sv", outputCol="_ss", withMean=True, withStd=True),
        VectorAssembler(inputCols=["tfidf", "_ss", "_tv"], outputCol="features"),
    ]
    return Pipeline(stages=stages), prepare


def priority_lr(
    train: DataFrame, val: DataFrame, grid: tuple[float, ...] = (0.3, 1.0, 3.0, 10.0), width: int = 1 << 18,
    lexicon: DataFrame | None = None, max_iter: int = 50, target: float = 0.90,
) -> tuple[PipelineModel, Callable[[DataFrame], DataFrame], Chosen, float]:
    """(feature model, preparation, chosen classifier, URGENT weight).

    The weight is the smallest of 1, 1.25 .. 6 whose validation recall of URGENT reaches ``target``.
    Hashed columns that are the same in all training rows (mostly empty ones) would get no weight; they are left out of ``used``.
    """
    stages, prepare = priority_features(train, width, lexicon)
    every = stages.fit(prepare(train))
    keep = ["id", "priority", "features"]
    fit_rows = written(every.transform(prepare(train)).select(*keep), "fit")
    selector = VarianceThresholdSelector(featuresCol="features", outputCol="used").fit(fit_rows)
    features = PipelineModel([*every.stages, selector])
    val_rows = written(features.transform(prepare(val)).select("id", "priority", "used"), "judged")
    used = written(selector.transform(fit_rows).drop("features"), "used")
    chosen = category_lr(used, val_rows, "priority", PRIORITIES, features="used", grid=grid, max_iter=max_iter)
    scored = chosen.model.transform(val_rows).select(F.col("priority").alias("y"), vector_to_array("probability").alias("probs"))
    sweep = evaluate.urgent_weight_sweep(scored, PRIORITIES, target).where("chosen").first()
    return features, prepare, chosen, float(sweep["weight"]) if sweep else 1.0


def out_of_fold_probs(
    train: DataFrame, rest: DataFrame, label: str, classes: list[str], features: str = "features",
    k: int = 5, strength: float = 30.0, max_iter: int = 50,
) -> DataFrame:
    """(id, probs): train rows scored by models that never saw them, other rows by the full fit.

    Folds are stratified: the hash order inside every class deals its rows out in turn.
    """
    narrow = train.select("id", label, features)  # texts and the like are not dealt out with the folds
    hashed = indexed(narrow, label, classes).withColumn("_h", F.md5(F.col("id").cast("string")))
    dealt = ranked_in_group(hashed, [label], "_h", ["id"]).withColumn("fold", F.col("position") % k)
    folded = written(dealt.drop("_h", "position", "group_size"), "folds")
    seen = [folded.where(F.col("fold") != fold) for fold in range(k)] + [folded]
    judged = [folded.where(F.col("fold") == fold) for fold in range(k)] + [rest]
    models = _together(train.sparkSession, [partial(fit_lr, rows, features, strength, max_iter) for rows in seen])
    parts = [probabilities(model.transform(rows), "probs").select("id", "probs") for model, rows in zip(models, judged)]
    return reduce(DataFrame.unionByName, parts)


def fit_pca(train: DataFrame, k: int = PCA_COMPONENTS) -> Transformer:
    return PCA(k=k, inputCol="_ev", outputCol="_pc").fit(train.withColumn("_ev", array_to_vector("embedding")))


def escalation_features(
    rows: DataFrame, pca: Transformer, category_probs: DataFrame, priority_probs: DataFrame, lexicon: DataFrame | None = None
) -> DataFrame:
    """Add ``x`` (array<double>): 12 signals, PCA of the embedding, class probabilities, 7 context values.

    ``rows`` has id, text, embedding, customer_tier, product, created_at, prior_tickets_7d, similar_recent.
    """
    reduced = pca.transform(signal_columns(rows, lexicon).withColumn("_ev", array_to_vector("embedding")))
    clock = scoring.time_features(F.col("created_at"))
    meta = F.array(
        scoring.tier_ordinal(F.col("customer_tier")).cast("double"),
        scoring.product_index(F.col("product")).cast("double"),
        clock["hour"].cast("double"),
        clock["weekday"].cast("double"),
        clock["off_hours"].cast("double"),
        F.col("prior_tickets_7d").cast("double"),
        F.col("similar_recent").cast("double"),
    )
    joined = reduced.join(category_probs.withColumnRenamed("probs", "_cp"), "id").join(
        priority_probs.withColumnRenamed("probs", "_pp"), "id"
    )
    return joined.withColumn("x", F.concat("signals", vector_to_array("_pc"), "_cp", "_pp", meta)).drop(
        "_ev", "_pc", "_cp", "_pp", "signals"
    )


def escalation_names(components: int = PCA_COMPONENTS) -> list[str]:
    return [
        *SIGNAL_NAMES,
        *[f"emb_pc{i}" for i in range(components)],
        *[f"p_cat_{c}" for c in CATEGORIES],
        *[f"p_pri_{p}" for p in PRIORITIES],
        *META_NAMES,
    ]


def _auc(model: Transformer, rows: DataFrame, y: str) -> float:
    scored = model.transform(rows).select(F.col(y).alias("y"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    return evaluate.roc_auc(scored).first()["roc_auc"] or 0.0


def escalation_gbt(train: DataFrame, val: DataFrame, trials: int = 20, max_iter: int = 100, seed: int = 0) -> Chosen:
    """Boosted trees: random search on validation AUC, each trial stopped early by the validation loss.

    Both frames have features (vector) and y_index.
    """
    rng = np.random.default_rng(seed)
    both = cut_lineage(train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True))))
    held = both.where("_val")
    settings = [
        GBTClassifier(
            featuresCol="features", labelCol="y_index", validationIndicatorCol="_val", maxIter=max_iter, seed=trial,
            stepSize=0.1, maxDepth=int(rng.choice([3, 4, 5])), minInstancesPerNode=int(rng.choice([20, 40, 80])),
            subsamplingRate=float(rng.choice([0.7, 0.9])), featureSubsetStrategy=str(rng.choice(["0.5", "0.7", "0.9"])),
        )
        for trial in range(trials)
    ]

    def tried(trial: int) -> Chosen:
        model = settings[trial].fit(both)
        return Chosen(model, _auc(model, held, "y_index"), float(trial))

    return max(_together(train.sparkSession, [partial(tried, trial) for trial in range(trials)]), key=lambda chosen: chosen.score)  # the first of equals


def logreg_baseline(train: DataFrame, test: DataFrame, max_iter: int = 50) -> float:
    """AUC of a standardised logistic regression on the same features."""
    stages = [
        StandardScaler(inputCol="features", outputCol="_z", withMean=True),
        LogisticRegression(featuresCol="_z", labelCol="y_index", regParam=1.0 / train.count(), maxIter=max_iter),
    ]
    return _auc(Pipeline(stages=stages).fit(train), test, "y_index")


def oracle_model(train: DataFrame, test: DataFrame, inputs: list[str], max_iter: int = 50) -> float:
    """AUC reachable with the hidden inputs of the outcome; ``inputs`` are numeric columns."""
    assemble = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    return logreg_baseline(assemble.transform(train), assemble.transform(test), max_iter)


# ---------------------------------------------------------------- calibration
def platt_calibrate(scores: DataFrame, y: str = "y", p: str = "p") -> tuple[float, float]:
    """(slope, intercept) of a logistic regression on the logit of the raw score."""
    rows = scores.select(F.col(y).cast("double").alias("label"), array_to_vector(F.array(scoring.logit(F.col(p)))).alias("features"))
    model = LogisticRegression(regParam=0.0, maxIter=100, standardization=False).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


STEP_SCHEMA = "_b INT, lo DOUBLE, hi DOUBLE, w BIGINT, s DOUBLE"
MERGED = 16


def pool_adjacent(blocks: list[tuple[float, float, int, float]]) -> list[tuple[float, float, int, float]]:
    """Neighbouring blocks (lo, hi, weight, sum of labels) put together until their means rise."""
    out: list[tuple[float, float, int, float]] = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            (lo, _, w, s), (_, hi, v, t) = out[-2], out[-1]
            out[-2:] = [(lo, hi, w + v, s + t)]
    return out


def isotonic_steps(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(lo, hi, w, s): the blocks of the isotonic fit, by pooling inside score ranges and then across them.

    The fit is the lower hull of running sums, and the hull of hulls is the hull: ranges are pooled by
    themselves, and ``MERGED`` neighbours of what is left at a time, so that no task sees all scores.
    """
    values = scores.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("v"))
    counted = values.agg(F.count(F.lit(1)).alias("w"), F.sum(F.col(y).cast("double")).alias("s"))
    bounds = windows.quantile_bounds(counted, "v")
    blocks = counted.select(windows.bucket_by_bounds(F.col("v"), bounds).cast("int").alias("_b"), F.col("v").alias("lo"), F.col("v").alias("hi"), "w", "s")

    def pool(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(x).to_pylist() for x in ("lo", "hi", "w", "s"))))
        columns = list(zip(*pool_adjacent(rows)))
        return pa.table([pa.array([table.column("_b")[0].as_py()] * len(columns[0]), pa.int32()), *(pa.array(x) for x in columns)], names=["_b", "lo", "hi", "w", "s"])

    ranges = len(bounds) + 1
    while True:
        blocks = blocks.groupBy("_b").applyInArrow(pool, STEP_SCHEMA)
        if ranges <= 1:
            return blocks.drop("_b")
        blocks = blocks.withColumn("_b", F.floor(F.col("_b") / MERGED).cast("int"))
        ranges = -(-ranges // MERGED)


@dataclass(frozen=True)
class IsotonicModel:
    """A rising step function with straight lines between steps; scores beyond the fitted range are clipped to it."""

    x: list[float]
    y: list[float]

    def calibrated(self, p: Column) -> Column:
        x, y = np.array(self.x), np.array(self.y)

        def at(values: pd.Series) -> pd.Series:
            return pd.Series(np.where(values.isna(), np.nan, np.interp(values, x, y)) if len(x) else np.nan, index=values.index)

        return F.pandas_udf(at, "double")(p)


def isotonic_calibrate(scores: DataFrame, y: str = "y", p: str = "p") -> IsotonicModel:
    """The fit of ``isotonic_steps``; only its steps, far fewer than the scores, come to the driver."""
    x, means = [], []
    for r in isotonic_steps(scores, y, p).orderBy("lo").collect():
        for edge in dict.fromkeys((r["lo"], r["hi"])):
            x.append(edge)
            means.append(r["s"] / r["w"])
    return IsotonicModel(x, means)


# --------------------------------------------------------------- explanations
def linear_contributions(rows: DataFrame, coefficients: list[float], names: list[str], x: str = "x") -> DataFrame:
    """Add ``contributions``: coefficient times value per feature, exact for a linear model."""
    items = [
        F.struct(F.lit(name).alias("feature"), (F.lit(float(w)) * F.get(F.col(x), F.lit(i))).alias("value"))
        for i, (name, w) in enumerate(zip(names, coefficients))
    ]
    return rows.withColumn("contributions", F.array(*items))


def _flatten_tree(root) -> dict[str, np.ndarray]:
    """A fitted tree as arrays: feature (-1 at a leaf), threshold, children, prediction, training rows."""
    feature, threshold, left, right, value, cover = [], [], [], [], [], []

    def add(node) -> int:
        at = len(feature)
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        value.append(float(node.prediction()))
        cover.append(float(node.impurityStats().count()))
        if node.subtreeDepth() > 0:
            split = node.split()
            feature[at], threshold[at] = int(split.featureIndex()), float(split.threshold())
            left[at], right[at] = add(node.leftChild()), add(node.rightChild())
        return at

    add(root)
    return {
        "feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left),
        "right": np.array(right), "value": np.array(value), "cover": np.array(cover),
    }


def _leaf_paths(tree: dict[str, np.ndarray]) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Every leaf's value, and for each feature above it: its bounds (low, high] and the share of training rows that its splits let through."""
    out = []

    def walk(at: int, path: dict[int, tuple[float, float, float]]) -> None:
        feature = int(tree["feature"][at])
        if feature < 0:
            out.append((float(tree["value"][at]), path))
            return
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        cut = float(tree["threshold"][at])
        for child, bounds in ((tree["left"][at], (low, min(high, cut))), (tree["right"][at], (max(low, cut), high))):
            walk(child, {**path, feature: (*bounds, share * tree["cover"][child] / tree["cover"][at])})

    walk(0, {})
    return out


def shapley_values(tree: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """(rows, features): exact Shapley values of one tree.

    With the features of a set S known and the others averaged over the training rows, a leaf is worth its value
    times one factor for each feature on its path: whether the row passes that feature's splits if it is in S, else
    the share of training rows that pass. So the sum over sets is a polynomial in the size of S, built
    feature by feature for all rows at once; sizes are weighted as Shapley values weigh them.
    """
    out = np.zeros(data.shape)
    for value, path in _leaf_paths(tree):
        d = len(path)
        passes = np.array([(data[:, f] > low) & (data[:, f] <= high) for f, (low, high, _) in path.items()], float).reshape(d, len(data))
        shares = np.array([share for _, _, share in path.values()])
        weight = [factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)]
        for i, f in enumerate(path):
            sizes = np.zeros((d, len(data)))
            sizes[0] = 1.0
            for j in range(d):
                if j != i:
                    sizes[1:] = sizes[1:] * shares[j] + sizes[:-1] * passes[j]
                    sizes[0] *= shares[j]
            out[:, f] += value * (passes[i] - shares[i]) * np.dot(weight, sizes)
    return out


def tree_contributions(rows: DataFrame, model: GBTClassificationModel, names: list[str], x: str = "x") -> DataFrame:
    """Add ``contributions`` of a boosted model: the exact Shapley values of its trees (``shapley_values``).

    The contributions and the root values add up to the margin of the model.
    """
    trees = [(w, _flatten_tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]

    @F.pandas_udf("array<double>")
    def walk(values: pd.Series) -> pd.Series:
        data = np.stack(values.to_numpy()) if len(values) else np.zeros((0, len(names)))
        return pd.Series(list(sum((weight * shapley_values(tree, data) for weight, tree in trees), np.zeros(data.shape))))

    listed = F.array(*[F.lit(n) for n in names])
    zipped = F.zip_with(listed, walk(F.col(x)), lambda n, v: F.struct(n.alias("feature"), v.alias("value")))
    return rows.withColumn("contributions", zipped)


def global_importance(contributions: DataFrame, k: int = 12) -> DataFrame:
    """Mean absolute contribution per feature, the ``k`` largest."""
    flat = contributions.select(F.explode("contributions").alias("c"))
    means = flat.groupBy(F.col("c.feature").alias("feature")).agg(F.avg(F.abs("c.value")).alias("mean_abs"))
    return means.orderBy(F.col("mean_abs").desc(), "feature").limit(k)


# --------------------------------------------------------------------- scoring
@dataclass
class Models:
    """Everything :func:`batch_score` needs, fitted."""

    category: Transformer
    priority_features: PipelineModel
    priority_prepare: Callable[[DataFrame], DataFrame]
    priority: Transformer
    urgent_weight: float
    pca: Transformer
    escalation: GBTClassificationModel
    platt: tuple[float, float]
    senior_threshold: float = 0.4
    lexicon: DataFrame | None = None


def batch_score(rows: DataFrame, models: Models) -> DataFrame:
    """Labels, confidences, probabilities, risk, route and the three main factors in one pass.

    ``rows`` has id, text, embedding and the context columns of :func:`escalation_features`.
    """
    labelled = rows.select("id", array_to_vector("embedding").alias("features"))
    category = models.category.transform(labelled).select("id", vector_to_array("probability").alias("probs"))
    prepared = models.priority_features.transform(models.priority_prepare(rows))
    raw = models.priority.transform(prepared).select("id", vector_to_array("probability").alias("probs"))
    adjusted = raw.withColumn("adjusted", scoring.urgent_reweight(F.col("probs"), models.urgent_weight))

    names = escalation_names()
    featured = escalation_features(rows, models.pca, category, raw, models.lexicon)
    scored = models.escalation.transform(featured.withColumn("features", array_to_vector("x")))
    risk = scoring.logit_platt(F.get(vector_to_array("probability"), F.lit(1)), *models.platt)
    risked = tree_contributions(scored.withColumn("risk", risk), models.escalation, names)
    best_category = scoring.argmax_label(F.col("category_probs"), CATEGORIES)
    best_priority = scoring.argmax_label(F.col("priority_probs"), PRIORITIES)
    return (
        risked.select("id", "risk", scoring.top_factors(F.col("contributions")).alias("factors"))
        .join(category.withColumnRenamed("probs", "category_probs"), "id")
        .join(adjusted.select("id", F.col("adjusted").alias("priority_probs")), "id")
        .withColumns({"_c": best_category, "_p": best_priority})
        .select(
            "id",
            F.col("_c.label").alias("category"),
            F.col("_c.confidence").alias("category_conf"),
            F.col("_p.label").alias("priority"),
            F.col("_p.confidence").alias("priority_conf"),
            scoring.cascade_flag(F.col("_c.confidence")).alias("needs_llm"),
            "risk",
            scoring.route_queue(F.col("risk"), models.senior_threshold).alias("queue"),
            "factors",
            "category_probs",
            "priority_probs",
        )
    )


def robustness(
    rows: DataFrame, causes: DataFrame | None, mask: bool, fit: Callable[[DataFrame], Transformer], classes: list[str]
) -> DataFrame:
    """Retrain and judge with codes masked and / or with some root causes unseen, one summary row.

    ``rows`` has id, text, split, root_cause_id, category; ``fit`` returns a model that adds ``probability``.
    """
    from deskstream.operators.joins import heldout_split

    seen = rows.withColumn("text", text.mask_error_codes(F.col("text"))) if mask else rows
    if causes is None:
        train, test = seen.where(F.col("split") == "train"), seen.where(F.col("split") == "test")
    else:
        train, test = heldout_split(seen, causes)
    judged = predicted(fit(train).transform(test), classes)
    return evaluate.classification_summary(judged, "category", "pred")
