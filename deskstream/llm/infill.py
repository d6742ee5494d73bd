"""Fill-in-middle: cut every text into prefix, middle and suffix at unit ranks and write them in another order.

A unit is a run of ASCII letters or one other character. An indexable skip list stands over the units of
a block of texts: lane 0 holds every unit, each lane above about one in ``SPAN`` of the lane below (a
hash of the unit's place decides) and always a text's first unit. Every node carries the units, the code
points and the bytes up to the next node of its lane. A cut rank is found by walking from the top lane
down: a lane is followed while the accumulated units stay within the rank. All texts of a block walk at
once, so the work is lanes times steps, not texts. No row leaves its partition.

The ranks and the form come from the SHA-256 of a seed and doc_id, so a repeated doc_id is cut by the
same numbers, and a retried task gives the same rows. Defined results: null and empty texts are plain
with no units; texts that hold a sentinel, in whole, are plain; a missing doc_id is hashed as the empty
string; repeated rows give repeated rows; an empty table gives none. A long text is one block of its
own: memory follows the longest text. Columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskstream.llm import common as c

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # of 100
SPM_BELOW = 20  # of 100
SPAN = 8
LETTER = c.byte_set((0x41, 0x5A), (0x61, 0x7A))
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Lanes:
    """An indexable skip list over the units of many texts. ``bounds`` are the texts' bounds in bytes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        head = (data & 0xC0) != 0x80
        letter = LETTER[data]
        starts = head.copy()
        starts[1:] &= ~(letter[1:] & letter[:-1])
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        starts[first] = True
        place = np.flatnonzero(starts)
        self.first = [np.searchsorted(place, bounds)]  # each text's first node, by lane
        self.units = np.diff(self.first[0])
        ends = np.append(place[1:], len(data))
        points = np.concatenate([[0], np.cumsum(head)])
        # widths of a node: units, code points, bytes
        self.widths = [np.stack([np.ones(len(place), np.int64), points[ends] - points[place], ends - place])]
        self.down: list[np.ndarray] = []
        height = self._heights(place)
        height[self.first[0][:-1][self.units > 0]] = np.iinfo(np.int64).max
        while (self.first[-1][1:] - self.first[-1][:-1]).max(initial=0) > SPAN:
            lane = len(self.down) + 1
            up = np.flatnonzero(height >= lane)
            if len(up) == len(height):
                break
            height = height[up]
            self.down.append(up)
            self.first.append(np.searchsorted(up, self.first[-1]))
            self.widths.append(np.add.reduceat(self.widths[-1], up, axis=1))

    @staticmethod
    def _heights(place: np.ndarray) -> np.ndarray:
        """A geometric height for each node: the lanes above lane 0 that it stands in."""
        draw = (c.mix(np.arange(1, len(place) + 1, dtype=c.U64)) >> c.U64(11)).astype(float) * 2.0**-53
        return np.floor(-np.log(np.maximum(draw, 2.0**-53)) / np.log(SPAN)).astype(np.int64)

    def descend(self, ranks: np.ndarray) -> np.ndarray:
        """(code points, bytes) before unit ``ranks[t]`` of each text t; a rank of all units gives the text's whole widths."""
        texts = np.flatnonzero(self.units > 0)
        node = self.first[-1][:-1][texts]
        gone = np.zeros((3, len(texts)), np.int64)
        for lane in range(len(self.widths) - 1, -1, -1):
            width, last = self.widths[lane], self.first[lane][1:][texts]
            moving = np.arange(len(texts))
            while len(moving):
                at = node[moving]
                good = at < last[moving]
                moving, at = moving[good], at[good]
                good = gone[0, moving] + width[0, at] <= ranks[texts[moving]]
                moving, at = moving[good], at[good]
                gone[:, moving] += width[:, at]
                node[moving] += 1
            if lane:
                # past the last node of a lane there is nothing left below it either
                over = node >= last
                node = np.where(over, self.first[lane - 1][1:][texts], self.down[lane - 1][np.minimum(node, len(self.down[lane - 1]) - 1)])
        out = np.zeros((2, len(self.units)), np.int64)
        out[:, texts] = gone[1:]
        return out


def _draws(seed: int) -> list[Column]:
    """The first four groups of eight digits of the hash of seed and doc_id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; form is plain, psm or spm."""
    c.ready(docs.sparkSession)
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            ids = batch.column(0)
            draws = np.stack([batch.column(k).to_numpy() for k in range(2, 6)])
            for low, high, data, bounds in c.chunks(batch.column(1)):
                lanes, h = Lanes(data, bounds), draws[:, low:high]
                n = lanes.units
                cuts = np.sort(h[:2] % (n + 1), axis=0)
                (points_a, bytes_a), (points_b, bytes_b) = lanes.descend(cuts[0]), lanes.descend(cuts[1])
                raw = data.tobytes()
                forms, outputs = [], []
                for t in range(high - low):
                    text = raw[bounds[t] : bounds[t + 1]]
                    if not text or h[2, t] % 100 >= PLAIN_FROM or p in text or s in text or m in text:
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = text[: bytes_a[t]], text[bytes_a[t] : bytes_b[t]], text[bytes_b[t] :]
                    spm = h[3, t] % 100 < SPM_BELOW
                    forms.append("spm" if spm else "psm")
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[low:high], pa.array(n), pa.array(forms, pa.string()), pa.array(points_a, mask=plain),
                        pa.array(points_b - points_a, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", "text", *_draws(seed)).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text behind ``output``: no sentinel stands in a text that was cut, so the sentinels split it exactly."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``fill_in_middle`` with digests in place of the texts."""
    again = restored(F.col("output"), F.col("form"))
    return fill_in_middle(docs, seed).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


ORACLE = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
         ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                   OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
              WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS m,
         coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
