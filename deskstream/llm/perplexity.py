"""Quality rules and n-gram perplexity bands.

Spark counts the code-point n-grams of all texts by language and by half of the texts (a hash of the
text); each half's counts become a modified Kneser-Ney model by joins of sharded tables (see
``ngrams``), and every text gets its mean bits a symbol under the model of the other half. So no text
is judged by its own n-grams, which would make a rare one look as expected as common ones, and equal
texts stand in one half. No model passes through the driver. A language's band lies around the median
of the texts that pass the base rules, its width in quartile distances; texts under the lower edge
(formulaic) or over the upper one (noise) go.

Defined results: null, empty and very short texts fail the base rules; a text without an n-gram has
no perplexity; every language has its model, and rows without a language share one; where the other
half has no text, all symbols are alike. Ties and repeated rows are scored alike. Columns beyond
doc_id, text and lang are passed on untouched by ``passing``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskstream.llm import common as c
from deskstream.llm import ngrams as g

MIN_WORDS = 50
MAX_REPEATED = 50
BELOW, ABOVE = 8.0, 25.0
LEAST_SPREAD = 0.008
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#*$%&|<>")] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_stats(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(STATS, texts)."""
    texts = len(bounds) - 1
    starts, ends, first = c.word_spans(data, bounds)
    sums = c.prefix_sums(data)
    words = c.span_hashes(sums, starts, ends)
    counts = np.diff(first)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    per_word = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
    signs = np.concatenate([[0], np.cumsum(SIGNS[data])])

    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(bounds, breaks, "right") - 1
    line_start = np.concatenate([bounds[:-1], breaks + 1])
    line_text = np.concatenate([np.arange(texts), owner])
    order = np.lexsort((line_start, line_text))
    line_start, line_text = line_start[order], line_text[order]
    line_end = np.append(line_start[1:] - 1, len(data))
    final = np.append(line_text[1:] != line_text[:-1], True)
    line_end[final] = bounds[1:][line_text[final]]
    has_word = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_start, line_end, line_text = line_start[has_word], line_end[has_word], line_text[has_word]
    keys = c.mix(c.span_hashes(sums, line_start, line_end) ^ (line_text.astype(c.U64) * c.U64(0x9E3779B97F4A7C15)))
    _, kept = np.unique(keys, return_index=True)
    dup_lines = np.bincount(line_text, minlength=texts) - np.bincount(line_text[kept], minlength=texts)

    repeated = np.zeros(texts, np.int64)
    if len(words) >= 3:
        triples = c.shingle_hashes(words, 3)
        text = np.repeat(np.arange(texts), counts)
        good = text[:-2] == text[2:]
        keys = c.mix(triples ^ (text[:-2].astype(c.U64) * c.U64(0x9E3779B97F4A7C15)))[good]
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.flatnonzero(good)[times[inverse] > 1]
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[at + k] = True
        repeated = np.bincount(text[covered], minlength=texts)
    return np.stack([counts, np.diff(per_word[first]), np.diff(signs[bounds]), dup_lines, repeated]).astype(np.int64)


def scores(docs: DataFrame) -> DataFrame:
    """Base figures, symbols, bits and two hashes of text and language of every document; saved."""
    c.ready(docs.sparkSession)
    slot = g.language().bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit(1)))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", slot.alias("slot"), *_keys())
    counts = c.saved(g.ngram_counts(numbered.select("text", "slot", F.lit(False).alias("flag"))), "ngrams")
    other = counts.select(F.col("slot").bitwiseXOR(F.lit(1)).alias("slot"), "code", "n")
    model = c.saved(g.probabilities(counts.select("slot", "code"), other), "probabilities")
    c.discard(counts)
    return c.saved(g.text_bits(numbered, model, ["key_a", "key_b", *STATS], base_stats), "perplexity")


def _keys() -> list[Column]:
    return [F.xxhash64("text", "lang").alias("key_a"), F.coalesce(F.crc32("text"), F.lit(-1)).alias("key_b")]


def judged(docs: DataFrame) -> DataFrame:
    """``scores`` with the language's band and the verdict."""
    rows = scores(docs).withColumn("slot", F.col("slot").bitwiseAND(F.lit(-2)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    mean = F.col("bits") / F.col("symbols")
    middle = rows.where(~failed & (F.col("symbols") > 0)).groupBy("slot").agg(F.percentile_approx(mean, [0.25, 0.5, 0.75], 10000).alias("q"))
    low, centre, high = (F.col("q")[k] for k in range(3))
    spread = F.greatest((high - low) / 2, F.lit(LEAST_SPREAD))
    edges = middle.select("slot", centre.alias("centre"), (centre - BELOW * spread).alias("low"), (centre + ABOVE * spread).alias("high"))
    level = g.shrunk(F.col("bits"), F.col("symbols"), F.col("centre"))
    within = F.coalesce((F.col("symbols") == 0) | level.between(F.col("low"), F.col("high")), F.lit(True))
    joined = rows.join(F.broadcast(edges), "slot", "left")  # one row per language
    return joined.withColumns({"base_failed": failed, "kept": ~failed & within})


def quality(docs: DataFrame) -> DataFrame:
    """Base figures, perplexity, band and verdict of every document."""
    perplexity = F.when(F.col("symbols") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("symbols")))
    return judged(docs).select(
        "doc_id", *STATS, "base_failed", perplexity.alias("perplexity"),
        F.pow(F.lit(2.0), F.col("low")).alias("lower"), F.pow(F.lit(2.0), F.col("high")).alias("upper"), "kept",
    )


def passing(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Equal texts of a language have one verdict."""
    gone = c.saved(judged(docs).where(~F.col("kept")).select("key_a", "key_b").distinct(), "rejected")
    names = c.unused(docs, "key_a", "key_b")
    marked = docs.withColumns(dict(zip(names, _keys())))
    return marked.join(gone.toDF(*names), names, "left_anti").select(*[F.col(f"`{x}`") for x in docs.columns])
