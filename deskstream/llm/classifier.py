"""Quality classifier: n-gram perplexity under a model of trusted text.

Trusted text is every document labelled good. Its ids reach the texts as bitmaps of 32,768 ids each, one
bit an id where ids are dense; where they are so sparse that the bitmaps would not be small, by a shuffle join. Its n-gram
counts become an interpolated modified Kneser-Ney model by joins of sharded tables (see ``ngrams``): n-grams with
their contexts, discounts and lower orders, for every n-gram that occurs anywhere in the corpus.
No model is broadcast and no text is shuffled (but for sparse ids). Thresholds are language-specific quantiles of the
trusted documents: the upper quartile plus ``REACH`` quartile distances.

Defined results: documents without an n-gram, and those of a language without trusted text, have no
perplexity and are kept. Rows without an id teach nothing and are scored. Repeated rows are scored
alike. Rows without a language share a model. Only doc_id, text, lang and the label
``quality`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.llm import common as c
from deskstream.llm import ngrams as g

BITMAPS = 8_192  # of four kilobytes, broadcast: 268 million dense ids
REACH = 8.0
LEAST_SPREAD = 0.016


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct()


def flagged(docs: DataFrame, ids: DataFrame, mark: str, most: int = BITMAPS) -> DataFrame:
    """The rows of ``docs`` with the flag ``mark``: whether their doc_id is among the distinct ``ids``."""
    bits = ids.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket"))
    if bits.agg(F.lit(1)).limit(most + 1).count() > most:
        return docs.join(ids.withColumn(mark, F.lit(True)), "doc_id", "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
    bitmaps = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias(f"{mark}_bits"))
    bitmaps = bitmaps.withColumnRenamed("bucket", f"{mark}_bucket")
    bit = "bitmap_bit_position(doc_id)"
    byte = f"CAST(conv(hex(substring({mark}_bits, CAST({bit} div 8 + 1 AS INT), 1)), 16, 10) AS INT)"
    flag = F.coalesce(F.expr(f"shiftright({byte}, CAST({bit} % 8 AS INT)) & 1 = 1"), F.lit(False))
    met = docs.join(F.broadcast(bitmaps), F.bitmap_bucket_number("doc_id") == F.col(f"{mark}_bucket"), "left")
    return met.select(*[F.col(f"`{x}`") for x in docs.columns], flag.alias(mark))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_symbols, perplexity, threshold, score, kept) of every document; the score falls from 1 with perplexity, 0.5 at the threshold."""
    c.ready(docs.sparkSession)
    good = c.saved(trusted_ids(labels), "trusted")
    (mark,) = c.unused(docs.select("text", "lang", "doc_id"), "trusted")
    marked = flagged(docs.select("doc_id", "text", "lang"), good, mark)
    counts = c.saved(g.ngram_counts(marked.select("text", g.language().alias("slot"), F.col(mark).alias("flag"))), "ngrams")
    known = counts.where("trusted > 0").select("slot", "code", F.col("trusted").alias("n"))
    needed = counts.select("slot", "code").join(F.broadcast(known.select("slot").distinct()), "slot", "left_semi")  # one row per language
    model = c.saved(g.probabilities(needed, known), "probabilities")
    c.discard(counts)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", g.language().alias("slot"))
    scores = c.saved(g.text_bits(numbered, model), "bits")
    mean = F.col("bits") / F.col("scored")
    usable = scores.where("scored > 0").join(good, "doc_id", "left_semi")
    quartiles = usable.groupBy("slot").agg(F.percentile_approx(mean, [0.25, 0.5, 0.75], 10000).alias("q"))
    q = [F.col("q")[k] for k in range(3)]
    edges = quartiles.select("slot", q[1].alias("centre"), (q[2] + REACH * F.greatest(q[2] - q[0], F.lit(LEAST_SPREAD))).alias("edge"))
    rows = scores.join(F.broadcast(edges), "slot", "left")  # one row per language
    level = g.shrunk(F.col("bits"), F.col("scored"), F.col("centre"))
    some = F.col("scored") > 0
    return rows.select(
        "doc_id", F.col("symbols").alias("n_symbols"), F.when(some, F.pow(F.lit(2.0), mean)).alias("perplexity"), F.pow(F.lit(2.0), "edge").alias("threshold"),
        F.when(some, 1 / (1 + F.exp((level - F.col("edge")) * 8))).alias("score"), F.coalesce(~some | (level <= F.col("edge")), F.lit(True)).alias("kept"),
    )
