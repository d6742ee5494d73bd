"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of five words. Equal sets collapse into one class first,
so copies cost one row each. Every class has 1,024 minima: the first 128 give candidate keys in 32
bands of four, and the low two bits of all are packed into 32 numbers. Band generation is followed by
a bit count: equal slots, corrected for chance collisions, estimate the similarity, and pairs that
estimate below ``ESTIMATE`` (four standard errors under the threshold) go. All others are confirmed
on full sets. The chance that a pair of exactly the least similarity shares no band is 5e-6.

No bucket is expanded into all its pairs. First every member of a bucket is paired with the bucket's
hub, the class that meets most others over all bands (the text that a family of near copies was made
from). Confirmed links give components. Only members of one bucket that are still in different
components are then compared with one another, inside tasks, in blocks of bounded size: a large bucket
becomes many block pairs, and only pairs that pass the estimate leave a task.

Defined results: without words or text the set is empty and linked with nothing. A document without
an id is linked with nothing, its component is null, and it is kept. Rows that repeat an id and text
repeat the result; rows of one id with different texts follow their texts. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskstream.llm import common as c
from deskstream.llm.graphs import components

BANDS, ROWS, BITS = 32, 4, 2
HASHES = 1024
LANES = HASHES * BITS // 64
ESTIMATE = 0.685
BLOCK = 512

SIGNATURE = [f"s{k}" for k in range(LANES)]
SKETCH_SCHEMA = "doc_id bigint, n bigint, d1 bigint, d2 bigint, " + ", ".join(f"{s} bigint" for s in SIGNATURE) + ", bands array<bigint>"
_SLOTS = 0x5555555555555555


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds. A to Z are lower-cased."""
    starts, ends, first = c.word_spans(data, bounds)
    words = c.span_hashes(c.prefix_sums(data, c.BYTE_HASH_LOWER), starts, ends)
    return c.distinct_by_text(*c.text_shingles(words, first, width))


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over each run of ``values``: (HASHES, runs)."""
    factors, shifts = c.seeds(HASHES, 101) | c.U64(1), c.seeds(HASHES, 202)
    out = np.empty((HASHES, len(starts)), c.U64)
    hashed = np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, factors[k], out=hashed)
        hashed += shifts[k]
        np.minimum.reduceat(hashed, starts, out=out[k])
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, ``64 / BITS`` slots to a number: (LANES, runs)."""
    low = c.mix(least) & c.U64((1 << BITS) - 1)
    per = 64 // BITS
    out = np.zeros((LANES, least.shape[1]), c.U64)
    for k in range(HASHES):
        out[k // per] |= low[k] << c.U64(BITS * (k % per))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(runs, BANDS) 64-bit keys."""
    keys = np.empty((least.shape[1], BANDS), c.U64)
    for band in range(BANDS):
        value = np.full(least.shape[1], band + 1, c.U64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            value = c.mix(value * c.U64(0xA24BAED4963EE407) + least[k])
        keys[:, band] = value
    return keys


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """Set size, set digest, packed signature and band keys of every document; no shuffle."""
    c.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in c.chunks(batch.column(1)):
                values, ends = shingle_sets(data, bounds, width)
                sizes = np.diff(ends)
                some = sizes > 0
                starts = ends[:-1][some]
                rows = high - low
                digests = np.zeros((2, rows), c.U64)
                lanes = np.zeros((LANES, rows), c.U64)
                keys = np.zeros((0, BANDS), c.U64)
                if len(starts):
                    digests[0, some] = np.add.reduceat(c.mix(values ^ c.U64(0x5BF03635DE6E9A21)), starts)
                    digests[1, some] = np.bitwise_xor.reduceat(c.mix(values + c.U64(0x2545F4914F6CDD1D)), starts)
                    least = minima(values, starts)
                    lanes[:, some] = pack(least)
                    keys = band_keys(least)
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.signed(keys.ravel())))
                numbers = [sizes.astype(np.int64), *(c.signed(x) for x in (*digests, *lanes))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, rows), *map(pa.array, numbers), bands], names=["doc_id", "n", "d1", "d2", *SIGNATURE, "bands"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH_SCHEMA)


def estimate(left: str, right: str):
    """Similarity from bit counts: the share of equal slots, corrected for chance collisions."""
    differing = None
    for s in SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_SLOTS))
        differing = F.bit_count(x) if differing is None else differing + F.bit_count(x)
    return (1 - differing / HASHES - 1 / 2**BITS) / (1 - 1 / 2**BITS)


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for arrays of packed signatures (pairs, LANES)."""
    x = left ^ right
    x |= x >> c.U64(1)
    differing = np.bitwise_count(x & c.U64(_SLOTS)).sum(axis=1, dtype=np.int64)
    return (1 - differing / HASHES - 1 / 2**BITS) / (1 - 1 / 2**BITS)


def confirmed(pairs: DataFrame, docs: DataFrame, part: int, whole: int, width: int) -> DataFrame:
    """The pairs (a, b) with ``whole * intersection >= part * union``, on full sets of the texts."""
    spark = docs.sparkSession
    # these ids grow with the corpus: the join is never a broadcast
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct().hint("merge")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in c.chunks(batch.column(1)):
                values, ends = shingle_sets(data, bounds, width)
                sets = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), c.U64), np.frombuffer(y.as_buffer(), c.U64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(whole * shared >= part * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    wanted = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = c.saved(wanted.mapInArrow(full, "doc_id bigint, set binary"), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    joined = left.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    return c.saved(joined.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint").distinct(), "links")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, rep, component, signature, bands) sorted by block pair: the pairs that pass the estimate.

    A pair leaves the task of its first common band only.
    """

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, i, j, side, rep, part, *lanes, bands = columns
        change = np.ones(len(key), bool)
        change[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        ends = np.append(np.flatnonzero(change)[1:], len(key)) if len(key) else np.zeros(0, np.int64)
        stop = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        signature = np.column_stack(lanes).view(c.U64) if len(key) else np.zeros((0, LANES), c.U64)
        out = []
        counts = stop - np.arange(len(key)) - 1
        done = np.concatenate([[0], np.cumsum(counts)])
        low = 0
        while low < len(key):
            high = max(low + 1, int(np.searchsorted(done, done[low] + 500_000, "right")) - 1)
            n = counts[low:high]
            left = np.repeat(np.arange(low, high), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(done[low:high] - done[low], n)
            use = (part[left] != part[right]) & ((i[left] == j[left]) | (side[left] != side[right]))
            left, right = left[use], right[use]
            good = estimates(signature[left], signature[right]) >= ESTIMATE
            left, right = left[good], right[good]
            home = (bands[left] == bands[right]).argmax(axis=1)
            home = bands[left, home] == key[left]
            out.append(np.stack([rep[left[home]], rep[right[home]]]))
            low = high
        pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [col.to_numpy(zero_copy_only=False) for col in batch.columns[:-1]]
        columns.append(batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, BANDS))
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        key, i, j = columns[:3]
        open_ = (key == key[-1]) & (i == i[-1]) & (j == j[-1]) if len(key) else np.zeros(0, bool)
        cut = int(len(key) - np.count_nonzero(open_))
        held = [x[cut:] for x in columns]
        yield found([x[:cut] for x in columns])
    if held is not None:
        yield found(held)


def links(docs: DataFrame, classes: DataFrame, part: int, whole: int, width: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to give all components."""
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = c.saved(keyed.join(sizes, "key"), "buckets")
    signature = classes.select("rep", *SIGNATURE, "bands")
    met = shared.groupBy("rep").agg(F.sum("members").alias("met"))
    hubs = shared.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("least"))).alias("hub"))
    hubs = c.saved(hubs.select("key", (-F.col("hub.least")).alias("hub")), "hubs")
    star = shared.join(hubs, "key").where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    sided = star.join(signature.select(F.col("rep").alias("a"), F.struct(*SIGNATURE).alias("x")), "a")
    sided = sided.join(signature.select(F.col("rep").alias("b"), F.struct(*SIGNATURE).alias("y")), "b")
    candidates = c.saved(sided.where(estimate("x", "y") >= ESTIMATE).select("a", "b"), "candidates")
    first = confirmed(candidates, docs, part, whole, width)

    roots = components(first)
    placed = shared.join(roots, shared["rep"] == roots["node"], "left").select("key", "rep", "members", F.coalesce("root", "rep").alias("part"))
    open_ = placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("key")
    blocks = F.ceil(F.col("members") / BLOCK)
    side = F.pmod(F.xxhash64("rep"), blocks)
    rows = placed.join(open_, "key", "left_semi").join(signature, "rep").withColumn("side", side.cast("bigint"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint"))).alias("other")
    rows = rows.select("key", "side", "rep", "part", *SIGNATURE, "bands", other)
    rows = rows.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "part", *SIGNATURE, "bands")
    dealt = rows.repartition(c.partitions(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    across = dealt.mapInArrow(_compare, "a bigint, b bigint").distinct().join(candidates, ["a", "b"], "left_anti")
    second = confirmed(c.saved(across, "across"), docs, part, whole, width)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, part: int = 75, whole: int = 100, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    sketch = c.saved(sketches(docs, width), "sketches")
    some = sketch.where("n > 0 AND doc_id IS NOT NULL")
    first = [F.first(x).alias(x) for x in (*SIGNATURE, "bands")]
    classes = c.saved(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), *first), "classes")
    roots = components(links(docs, classes, part, whole, width))
    narrow = classes.select("d1", "d2", "n", "rep")
    named = narrow.join(roots, narrow["rep"] == roots["node"], "left").select("d1", "d2", "n", F.coalesce("root", "rep").alias("root"))
    rows = sketch.select("doc_id", "n", "d1", "d2").join(c.saved(named, "roots"), ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which ``near_duplicates`` keeps the row, one row for each id."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    (salt,) = c.unused(docs, "_row")
    left = docs.join(gone, "doc_id", "left_anti").withColumn(salt, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return left.dropDuplicates(["doc_id", salt]).select(*[F.col(f"`{x}`") for x in docs.columns])
