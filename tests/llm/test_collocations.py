"""Collocations against a dictionary count, the summary's guarantee, awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from deskstream.llm import collocations as m

SCHEMA = "text string, lang string, phrase string, rank int, n int, block int"


def plain(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting all phrases of all pieces."""
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    many = {x: n for x, n in counts.items() if n >= least}
    found = []
    for (lang, w), a in many.items():
        if len(w) == 1:
            continue
        longer = [n for (other, v), n in many.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * n >= 80 * a for n in longer):
            continue
        score, _, left, right = min((2_000_000 * a // (many[lang, w[:k]] + many[lang, w[k:]]), k, many[lang, w[:k]], many[lang, w[k:]]) for k in range(1, len(w)))
        found.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    common = ["new york city", "in spite of", "state of the art", "a b a b", "Straße é \U0001f600"]
    out = []
    for _ in range(n):
        parts = [rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 60))]
        out.append((rng.choice([" ", "  ", "\t", ". ", "\n"]).join(parts), rng.choice(["en", "en", "de", None, "und", ""])))
    return out


def test_equals_a_plain_count(spark):
    rows = texts(1, 400) + [(None, "en"), ("", "en"), ("...", "de"), ("  \t ", None)] + [("repeat me now", "en")] * 40 + [("x" * 200_000 + " tail", "fr")] * 31
    frame = spark.createDataFrame([(t, lang, "p", 1, 2, 3) for t, lang in rows], SCHEMA).repartition(5)
    for least, top in ((30, 2000), (5, 40)):
        got = sorted(tuple(r) for r in m.collocations(frame, least, top).collect())
        assert got == plain(rows, least, top) and got


def test_blocks_and_parts_do_not_matter(spark, monkeypatch):
    rows = texts(2, 150)
    frame = spark.createDataFrame([(t, lang, "p", 1, 2, 3) for t, lang in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(m, "PART_MASS", 100)
    assert sorted(tuple(r) for r in m.collocations(frame, 10).collect()) == plain(rows, 10, 2000)


def test_empty(spark):
    assert m.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert m.collocations(spark.createDataFrame([(None, None, "p", 1, 2, 3)], SCHEMA)).count() == 0


def test_words_with_equal_hashes_stay_apart(spark):
    """Thue-Morse words of 2,048 letters share every polynomial hash modulo 2^64."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(f"{one} x", "en")] * 20 + [(f"{other} x", "en")] * 35
    frame = spark.createDataFrame([(t, lang, "p", 1, 2, 3) for t, lang in rows], SCHEMA).coalesce(1)
    assert [(r["phrase"], r["a"]) for r in m.collocations(frame).collect()] == [(f"{other} x", 35)]


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    for least in (5, 30):
        keys = np.concatenate([rng.integers(0, 50_000, 60_000), np.repeat(np.arange(60_000, 60_040), least)]).astype(np.uint32)
        rng.shuffle(keys)
        true = Counter(keys.tolist())
        found = m.MisraGries(len(keys) // least + 1)
        peak = 0
        for part in np.array_split(keys, 300):
            found.add(*np.unique(part, return_counts=True))
            peak = max(peak, len(found.keys))
        keep = set(found.survivors(least).tolist())
        assert {k for k, n in true.items() if n >= least} <= keep and peak <= found.capacity and found.missing < least
