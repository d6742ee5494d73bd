"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds modular prefix arrays of a text's code points under two primes. Any span's hash is
read in constant time, spans compare by it, and the longest common extension of two positions is
found by binary search. A fingerprint keeps the length, the whole hash and the prefix and suffix
hashes at fixed lengths of a slow geometric grid, so two fingerprints alone tell (by binary search
over the grid) how long a beginning and an end two texts share. It also keeps hash and length of the
spans between anchors: places whose own short span has a smaller hash than all places up to ``REACH``
before and behind. Anchors depend on the characters around them alone, so equal stretches have equal
spans wherever they stand. Likeness is the share of the longer text that common beginning and end, or
common spans (as often as both texts have them), cover, whichever is more: 1 for equal texts only, near
1 for a text that was shifted by a character, about a half when the second half was replaced, near 0 for
unrelated texts. A fingerprint holds about one span for each 2 * ``REACH`` characters, an eighth of a text.

Defined results: null and empty texts are the empty text; two empty texts are alike (1). Documents
stand in descending order of doc_id (missing ids last); documents of one id stand in the order of
their texts. After the last document comes the first; a lone document follows itself. Only doc_id
and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.llm import common as c

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 747796405)
STEPS = BASES + tuple(pow(base, -1, prime) for base, prime in zip(BASES, PRIMES))
ANCHOR = 8
REACH = 64
_powers: list[np.ndarray] = [np.ones(1, np.int64) for _ in STEPS]


def _grid() -> np.ndarray:
    """Lengths 1 to 2^40, each an eighth longer than the one before."""
    lengths, at = [], 1
    while at < 1 << 40:
        lengths.append(at)
        at = max(at + 1, at * 9 // 8)
    return np.array(lengths)


GRID = _grid()


def _power(which: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, or (from 2 on) of its inverse."""
    have = _powers[which]
    while len(have) < n:
        prime, base = PRIMES[which % 2], STEPS[which]
        step = pow(base, len(have), prime)
        have = np.concatenate([have, have * step % prime])
        _powers[which] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Prefixes:
    """Modular prefix arrays of one sequence of code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        values = points.astype(np.int64) + 1
        for k, prime in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(values * _power(k, self.n) % prime, out=sums[1:])
            self.sums.append(sums % prime)

    def prefix(self, lengths: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of the given lengths, both primes in one number."""
        a, b = (s[lengths].astype(np.uint64) for s in self.sums)
        return (a << np.uint64(31)) | b

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of many spans, both primes in one number, equal for equal spans wherever they stand."""
        a, b = (
            ((s[ends] - s[starts]) % prime * _power(k + 2, self.n + 1)[starts] % prime).astype(np.uint64)
            for k, (s, prime) in enumerate(zip(self.sums, PRIMES))
        )
        return (a << np.uint64(31)) | b

    def anchors(self, width: int = ANCHOR, reach: int = REACH) -> np.ndarray:
        """Places whose span of ``width`` has a smaller hash than those up to ``reach`` before and not a greater one than those behind."""
        if self.n < width + 2 * reach:
            return np.zeros(0, np.int64)
        starts = np.arange(self.n - width + 1)
        low = local = c.mix(self.spans(starts, starts + width))
        span = 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])  # the least of ``reach`` places from each on
        at = np.arange(reach, len(local) - reach)
        return at[(local[at] < low[at - reach]) & (local[at] <= low[at + 1])]

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """The span's hash, shifted to a common power so that equal spans agree wherever they stand."""
        return tuple(
            int(s[start + length] - s[start]) % prime * pow(pow(base, start, prime), -1, prime) % prime
            for s, prime, base in zip(self.sums, PRIMES, BASES)
        )

    def common_extension(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension of two positions."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, middle) == other.span(at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def fingerprint(points: np.ndarray) -> str:
    """Length, whole hash, prefix hashes and suffix hashes on the grid, hashes and lengths of the spans between anchors, as text."""
    n = len(points)
    lengths = GRID[: np.searchsorted(GRID, n, "right")]
    ahead, behind = Prefixes(points), Prefixes(points[::-1])
    whole = int(ahead.prefix(np.array([n]))[0])
    short = [(h % np.uint64(0xFFFFFFFB)).astype(">u4").tobytes().hex() for h in (ahead.prefix(lengths), behind.prefix(lengths))]
    cuts = np.concatenate([[0], ahead.anchors(), [n]])
    spans = (ahead.spans(cuts[:-1], cuts[1:]) % np.uint64(0xFFFFFFFB)) << np.uint64(32) | np.diff(cuts).astype(np.uint64)
    return f"{n}:{whole:016x}:{short[0]}:{short[1]}:{spans.astype('>u8').tobytes().hex()}"


def _shared(a: str, b: str, longest: int) -> int:
    """The longest grid length up to which two rows of prefix hashes agree, by binary search."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        middle = (low + high + 1) // 2
        if a[8 * middle - 8 : 8 * middle] == b[8 * middle - 8 : 8 * middle]:
            low = middle
        else:
            high = middle - 1
    return min(int(GRID[low - 1]), longest) if low else 0


def _common(a: str, b: str) -> int:
    """Characters in the spans that two texts share, each as often as both have it."""
    (x, n), (y, m) = (np.unique(np.frombuffer(bytes.fromhex(v), ">u8").astype(np.uint64), return_counts=True) for v in (a, b))
    same, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(((same & np.uint64(0xFFFFFFFF)).astype(np.int64) * np.minimum(n[i], m[j])).sum())


def likeness(a: str, b: str) -> float:
    """Share of the longer text that the common beginning and end, or the common spans, cover; 1 only for equal texts."""
    if a == b:
        return 1.0
    (n, _, ahead, behind, spans), (m, _, ahead2, behind2, spans2) = a.split(":"), b.split(":")
    shortest, longest = min(int(n), int(m)), max(int(n), int(m))
    shared = _shared(ahead, ahead2, shortest) + _shared(behind, behind2, shortest)
    return min(max(shared, _common(spans, spans2)), shortest) / (longest + 1)


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (slice, doc_id, text, guest), sorted; a slice ends with the first document of the next one, as a guest."""
    before = None
    for batch in batches:
        out: list[tuple] = []
        for part in range(0, batch.num_rows, 512):
            for slot, doc, text, guest in zip(*(col.to_pylist() for col in batch.slice(part, 512).columns)):
                text = text or ""
                print_ = fingerprint(code_points(text))
                if before is not None and before[0] == slot:
                    _, held, old, old_print = before
                    new = edited(old, text)
                    new_print = fingerprint(code_points(new))
                    digest = hashlib.sha256(new.encode()).hexdigest()
                    out.append((held, len(old), digest, old_print, new_print, likeness(old_print, new_print), likeness(old_print, print_)))
                before = None if guest else (slot, doc, text, print_)
        columns = list(zip(*out)) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def fingerprints(docs: DataFrame, rows_per_slice: int = 200) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness.

    Texts are shuffled once, by slice of the descending order of ids; slice bounds are approximate
    quantiles of the ids (their number grows with the rows). The first document of each slice also
    goes to the slice before it. Bounds and first documents are one row per slice.
    """
    spark = docs.sparkSession
    c.ready(spark)
    ids = docs.select("doc_id")
    total, low = ids.agg(F.count("*"), F.min("doc_id")).first()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    slices = max(1, min(total // rows_per_slice, 4 * c.partitions(spark)))
    bounds = sorted({int(q) for q in ids.approxQuantile("doc_id", [k / slices for k in range(1, slices)], 0.25 / slices)}) if slices > 1 else []
    missing = F.lit(-1).cast("bigint")
    rank = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    slot = F.when(F.col("doc_id").isNull(), missing).otherwise(F.size(F.filter(rank, lambda q: F.col("doc_id") >= q)).cast("bigint"))
    placed = docs.select("doc_id", "text", slot.alias("slice"))
    tops = {r["slice"]: r["top"] for r in ids.select("doc_id", slot.alias("slice")).groupBy("slice").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    previous = {b: a for a, b in zip([order[-1], *order[:-1]], order)}
    hosts = F.create_map(*[F.lit(x).cast("bigint") for pair in previous.items() for x in pair])
    peaks = F.create_map(*[F.lit(x).cast("bigint") for pair in tops.items() for x in pair])
    first = F.col("doc_id").eqNullSafe(peaks[F.col("slice")])
    own = F.struct(F.col("slice").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(hosts[F.col("slice")].alias("at"), F.lit(True).alias("guest"))
    spread = placed.select("doc_id", "text", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("p"))
    dealt = spread.select(F.col("p.at").alias("slice"), "doc_id", "text", F.col("p.guest").alias("guest")).repartition(slices, "slice")
    ordered = dealt.sortWithinPartitions(F.col("slice").desc(), "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_rows, SCHEMA)
