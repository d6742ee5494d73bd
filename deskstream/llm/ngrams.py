"""Code-point n-grams of texts and interpolated modified Kneser-Ney models over them, as sharded tables.

A text's code points are its symbols: scripts, capitals and marks stay apart, and every language has a
model of its own. An n-gram of four is one 64-bit number, so the tables grow with the corpus and no
part of them passes through the driver. Documents become packed rows (dictionary, places, counts) by
shard of the n-gram; a shard's rows meet its part of the model in a join, give partial sums, and the
sums of all shards are a document's bits. The number of shards follows the counted n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskstream.llm import common as c

ORDER = 4
BASE = 55_103  # a prime whose fourth power is below 2^63: code points up to the Hangul syllables stand for themselves, later ones for their remainder
SHARDS = 16
SHARD_GRAMS = 1 << 16
TASK_GRAMS = 1 << 20
PACK_BYTES = 1 << 20
HELD_BYTES = 8 << 20
ROWS = 1 << 16
LEAD = np.array([0x7F, 0x7F, 0x1F, 0x0F, 0x07])


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, and the bounds of each text in them."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if len(heads) == len(data):
        return data.astype(np.int64), bounds
    lead = data[heads]
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    points = lead.astype(np.int64) & LEAD[size]
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        byte = data[np.minimum(heads[at] + k, len(data) - 1)]
        good = (byte & 0xC0) == 0x80
        points[at[good]] = points[at[good]] << 6 | (byte[good] & 0x3F)
    return points % BASE, np.searchsorted(heads, bounds)


def text_codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams inside the texts, and the text of each."""
    points, bounds = symbols(data, bounds)
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = points[:n].copy()
    for k in range(1, ORDER):
        codes *= BASE
        codes += points[k : k + n]
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[:n]
    inside = np.ones(n + ORDER - 1, bool)
    for k in range(1, ORDER):  # the last places of every text begin no n-gram
        last = bounds[1:] - k
        inside[last[last >= bounds[:-1]]] = False
    inside = inside[:n]
    return codes[inside], owner[inside]


def language(column: str = "lang") -> Column:
    """The number of a row's model: one for every language, and one for rows without a language. The lowest bit is free."""
    return F.xxhash64(column).bitwiseAND(F.lit(-2))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    raw = [k - (k + 1) * y * (n[k + 1] / n[k] if n[k] else 0) for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))])


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each order, sorted arrays: n-grams with interpolated probabilities, contexts with back-off weights."""
    levels = [(codes, counts)]
    for k in range(ORDER - 1, 0, -1):
        levels.append(np.unique(levels[-1][0] % BASE**k, return_counts=True))
    out: list[dict[str, np.ndarray]] = []
    for grams, n in reversed(levels):
        d = discounts(n)[np.minimum(n, 3)]
        contexts, inverse = np.unique(grams // BASE, return_inverse=True)
        total = np.bincount(inverse, weights=n)
        weight = np.bincount(inverse, weights=d) / total
        lower = 1 / BASE if not out else lookup(out, grams % BASE ** len(out), len(out))
        out.append({"grams": grams, "p": (n - d) / total[inverse] + weight[inverse] * lower, "contexts": contexts, "weight": weight})
    return out


def lookup(model: list[dict[str, np.ndarray]], codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Probabilities by binary search in the sorted arrays; unseen n-grams back off."""
    if not order:
        return np.full(len(codes), 1 / BASE)
    level = model[order - 1]
    at = np.minimum(np.searchsorted(level["grams"], codes), len(level["grams"]) - 1)
    p = level["p"][at]
    unseen = np.flatnonzero(level["grams"][at] != codes)
    if len(unseen):
        context = codes[unseen] // BASE
        at = np.minimum(np.searchsorted(level["contexts"], context), len(level["contexts"]) - 1)
        weight = np.where(level["contexts"][at] == context, level["weight"][at], 1.0)
        p[unseen] = weight * lookup(model, codes[unseen] % BASE ** (order - 1), order - 1)
    return p


COUNT_SCHEMA = "slot bigint, code bigint, n bigint, trusted bigint"


def _by_slot(slot: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each slot with the places of its n-grams, in order."""
    names, rank = np.unique(slot, return_inverse=True)
    if len(names) == 1:
        yield int(names[0]), np.arange(len(owner))
        return
    rank = rank.astype(np.min_scalar_type(len(names)))[owner]
    order = np.argsort(rank, kind="stable")
    ends = np.cumsum(np.bincount(rank, minlength=len(names)))
    for k, name in enumerate(names.tolist()):
        yield name, order[ends[k - 1] if k else 0 : ends[k]]


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, n, trusted = (np.concatenate(x) for x in zip(*parts))
    at, names = pd.factorize(codes)
    return names, np.bincount(at, n, len(names)).astype(np.int64), np.bincount(at, trusted, len(names)).astype(np.int64)


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(slot, code, n, trusted): counts over all of ``texts`` (text, slot, flag) and over those whose flag is set.

    Tasks add up before the shuffle and hold at most about ``TASK_GRAMS`` n-grams at a time.
    """
    c.ready(texts.sparkSession)

    def out(table):
        for k, parts in table.items():
            codes, n, trusted = _added(parts)
            for at in range(0, len(codes), ROWS):
                part = slice(at, at + ROWS)
                arrays = [np.full(len(codes[part]), k, np.int64), codes[part], n[part], trusted[part]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["slot", "code", "n", "trusted"])

    def run(batches):
        table: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        held = 0
        for batch in batches:
            slot = batch.column(1).to_numpy()
            flags = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for low, high, data, bounds in c.chunks(batch.column(0)):
                codes, owner = text_codes(data, bounds)
                good = flags[low:high][owner]
                for k, mine in _by_slot(slot[low:high], owner):
                    if len(mine):
                        table.setdefault(k, []).append(_added([(codes[mine], np.ones(len(mine)), good[mine])]))
                        held += len(table[k][-1][0])
                if held > TASK_GRAMS:
                    table = {k: [_added(parts)] for k, parts in table.items()}
                    held = sum(len(parts[0][0]) for parts in table.values())
                    if held > TASK_GRAMS // 2:
                        yield from out(table)
                        table, held = {}, 0
        yield from out(table)
        table = {}
        c.release()

    parts = texts.select("text", "slot", "flag").mapInArrow(run, COUNT_SCHEMA)
    return parts.groupBy("slot", "code").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))


def probabilities(needed: DataFrame, known: DataFrame) -> DataFrame:
    """(slot, code, bits) for every needed n-gram (slot, code) under the model of the known counts (slot, code, n); without a count all symbols are alike."""
    levels = {ORDER: known}
    for k in range(ORDER - 1, 0, -1):
        types = levels[k + 1].select("slot", (F.col("code") % BASE**k).alias("code"))
        levels[k] = types.groupBy("slot", "code").agg(F.count("*").alias("n"))
    lower = None
    for k in range(1, ORDER + 1):
        grams = levels[k]
        n = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        cut = [
            F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * F.col("y") * F.coalesce(F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.0)))).alias(f"d{i}")
            for i in (1, 2, 3)
        ]
        discount = grams.groupBy("slot").agg(*n).withColumn("y", y).select("slot", *cut)
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cutoff = grams.join(F.broadcast(discount), "slot").select("slot", "code", "n", less.alias("d"), F.expr(f"code div {BASE}").alias("context"))
        contexts = cutoff.groupBy("slot", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"))
        want = needed.select("slot", (F.col("code") % BASE**k).alias("code")).distinct() if k < ORDER else needed
        want = want.withColumn("context", F.expr(f"code div {BASE}"))
        rows = want.join(contexts, ["slot", "context"], "left").join(cutoff.select("slot", "code", "n", "d"), ["slot", "code"], "left")
        own = F.coalesce((F.col("n") - F.col("d")) / F.col("total"), F.lit(0.0))
        weight = F.coalesce("weight", F.lit(1.0))
        if lower is None:
            lower = rows.select("slot", "code", (own + weight / BASE).alias("p"))
        else:
            rows = rows.withColumn("under", F.col("code") % BASE ** (k - 1))
            below = lower.select("slot", F.col("code").alias("under"), F.col("p").alias("q"))
            lower = rows.join(below, ["slot", "under"]).select("slot", "code", (own + weight * F.col("q")).alias("p"))
    return lower.select("slot", "code", (-F.log2("p")).alias("bits"))


PACK_SCHEMA = "shard int, slot bigint, rows binary, ids binary, side binary, ends binary, names binary, places binary, counts binary"
SUM_SCHEMA = "row bigint, doc_id bigint, slot bigint, symbols bigint, scored bigint, bits double"
KINDS = (np.int64, np.int64, np.int64, np.int32, np.int64, np.uint32, np.uint32)
RISING = (3, 4, 5)  # ends, names and places rise, the places of a document at a time: their steps are small


APART = 4096


def _put(x: np.ndarray, kind: type, rising: bool, pack) -> bytes:
    """The bytes of ``x`` (or of its steps) by significance: in one pack, or plane by plane where that is smaller, as it can be for long arrays only."""
    x = x.reshape(-1)
    x = np.diff(x, prepend=x.dtype.type(0)).astype(kind) if rising else x.astype(kind)
    whole = b"\0" + pack(np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.itemsize).T.tobytes())
    return whole if x.size < APART else min(whole, b"\1" + c.pack_numbers(x, pack), key=len)


def _got(data: bytes, kind: type, rising: bool, unpack) -> np.ndarray:
    if data[0]:
        x = c.unpack_numbers(data[1:], unpack).view(kind)
    else:
        planes = np.frombuffer(unpack(data[1:]), np.uint8).reshape(np.dtype(kind).itemsize, -1)
        x = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if rising else x


def _by_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (text and slot third and fourth) again, those of one slot together: about ``PACK_BYTES`` of text, less where more than ``HELD_BYTES`` wait."""
    held: dict[int, list[pa.RecordBatch]] = {}
    sizes: dict[int, int] = {}

    def out(k: int) -> Iterator[pa.RecordBatch]:
        del sizes[k]
        yield from pa.Table.from_batches(held.pop(k)).combine_chunks().to_batches()

    for batch in batches:
        slot = batch.column(3).to_numpy()
        length = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
        for k, at in _by_slot(slot, np.arange(len(slot))):
            if not len(at):
                continue
            part = np.cumsum(length[at]) // PACK_BYTES
            for some in np.split(at, np.flatnonzero(np.diff(part)) + 1):
                held.setdefault(k, []).append(batch.take(pa.array(some)))
                sizes[k] = sizes.get(k, 0) + int(length[some].sum())
                if sizes[k] >= PACK_BYTES:
                    yield from out(k)
        while sum(sizes.values()) > HELD_BYTES:
            yield from out(max(sizes, key=sizes.get))
    for k in list(held):
        yield from out(k)


def _packed(texts: DataFrame, shards: int, figures: Callable | None) -> DataFrame:
    """Documents' n-gram counts by shard and slot, many documents to a row.

    A document's ends point into places (in the row's sorted n-grams) and counts; every document has its
    row in shard 0, so that those without n-grams are there too. That row also carries the side columns.
    """
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in _by_model(batches):
            row, ids, slot = batch.column(0).to_numpy(), batch.column(1), batch.column(3).to_numpy()
            have = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = np.where(have, ids.fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).min).astype(np.int64)
            carried = np.array([x.to_numpy() for x in batch.columns[4:]], np.int64).reshape(-1, len(row))
            for low, high, data, bounds in c.chunks(batch.column(2), PACK_BYTES):
                codes, owner = text_codes(data, bounds)
                side = carried[:, low:high]
                if figures:
                    side = np.concatenate([side, figures(data, bounds)])
                mine, out = slot[low:high], []
                for k, at in _by_slot(mine, owner):
                    docs_in = np.flatnonzero(mine == k)
                    place, names = pd.factorize(codes if len(at) == len(codes) else codes[at])
                    shard = names % shards
                    order = np.lexsort((names, shard))
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    names = names[order]
                    opens = np.searchsorted(shard[order], np.arange(shards + 1))
                    cells = shard[place]  # one array in place of several: a task holds some of this size
                    cells *= len(mine)
                    cells += owner[at]
                    cells *= max(len(names), 1)
                    cells += rank[place]
                    del place
                    cells.sort()
                    fresh = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
                    cells, counts = cells[fresh], np.diff(fresh, append=len(cells))
                    group, cell = np.divmod(cells, max(len(names), 1))
                    first = np.searchsorted(group, np.arange(shards + 1) * len(mine))
                    for s in np.flatnonzero((np.diff(first) > 0) | (np.arange(shards) == 0)).tolist():
                        part = slice(first[s], first[s + 1])
                        ends = np.searchsorted(group[part], s * len(mine) + docs_in, "right")
                        fields = (
                            row[low:high][docs_in], ids[low:high][docs_in], side[:, docs_in] if s == 0 else side[:, :0],
                            ends, names[opens[s] : opens[s + 1]], cell[part] - opens[s], counts[part],
                        )
                        out.append((s, k, *(_put(np.asarray(x), t, n in RISING, pack) for n, (x, t) in enumerate(zip(fields, KINDS)))))
                columns = list(zip(*out))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[f.split()[0] for f in PACK_SCHEMA.split(", ")])
        c.release()

    return texts.mapInArrow(run, PACK_SCHEMA)


def copies_of(partitions: int, shards: int, models: float) -> int:
    """How often a model is copied so that its texts spread: a group for each partition if it stood alone, two where there are more; ``models`` counts those as large as the largest."""
    return max(1, min(-(-partitions // shards), -(-2 * partitions // int(shards * models))))


def text_bits(texts: DataFrame, model: DataFrame, side: list[str] = (), figures: Callable | None = None) -> DataFrame:
    """Symbols and bits of every row of ``texts`` (row, doc_id, text, slot, and bigint columns to carry) under the model (slot, code, bits).

    ``model`` is a saved table and is deleted once its sorted shards are written.

    ``side`` names the carried columns and then the rows of ``figures(data, bounds)``. Rows whose slot has no model have nothing scored.
    """
    found = model.groupBy("slot").count().agg(F.max("count").alias("n"), F.sum("count").alias("all")).first()
    largest, every = found["n"] or 1, found["all"] or 1
    shards = max(SHARDS, 1 << (-(-largest // SHARD_GRAMS) - 1).bit_length())
    parts = model.groupBy((F.col("code") % shards).cast("int").alias("shard"), "slot").agg(F.sort_array(F.collect_list(F.struct("code", "bits"))).alias("m"))
    parts = c.saved(parts.select("shard", "slot", F.col("m.code").alias("keys"), F.col("m.bits").alias("values")), "shards")
    c.discard(model)
    # a leading language holds most rows of every shard: its rows are dealt over salts, the shard's part of the model is copied to each
    salts = copies_of(c.partitions(texts.sparkSession), shards, every / largest)
    fields = [f.split()[0] for f in PACK_SCHEMA.split(", ")][2:]
    packed = _packed(texts, shards, figures).withColumns({"salt": (F.crc32("rows") % salts).cast("int"), "keys": F.lit(None).cast("array<bigint>"), "values": F.lit(None).cast("array<double>")})
    copies = parts.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1))), **{x: F.lit(None).cast("binary") for x in fields}})
    # a part of the model stands once, ahead of the rows that it scores, not beside each of them
    group = ["shard", "slot", "salt"]
    met = packed.unionByName(copies).repartition(max(c.partitions(texts.sparkSession), shards), *group).sortWithinPartitions(*group, F.col("keys").isNull())
    schema = ", ".join([SUM_SCHEMA, *(f"{x} bigint" for x in side)])
    columns = [f.split()[0] for f in schema.split(", ")]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        now = keys = values = None
        for batch in batches:
            for r in range(batch.num_rows):
                shard, slot, salt = (batch.column(k)[r].as_py() for k in range(3))
                if now != (shard, slot, salt):
                    now, keys, values = (shard, slot, salt), None, None
                if batch.column(10)[r].is_valid:
                    keys, values = (batch.column(k)[r].values.to_numpy().copy() for k in (10, 11))
                    continue
                rows, ids, more, ends, names, places, counts = (_got(batch.column(n + 3)[r].as_py(), t, n in RISING, open_) for n, t in enumerate(KINDS))
                text = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
                symbols = np.bincount(text, counts, len(rows)).astype(np.int64)
                bits, scored = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
                if keys is not None and len(places):
                    at = np.searchsorted(keys, names)
                    bits = np.bincount(text, counts * values[at][places], len(rows))
                    scored = symbols
                more = more.reshape(len(side), len(rows)) if shard == 0 else np.zeros((len(side), len(rows)), np.int64)
                use = np.ones(len(rows), bool) if shard == 0 else symbols > 0
                arrays = [pa.array(rows[use]), pa.array(ids[use], mask=ids[use] == np.iinfo(np.int64).min), *(pa.array(x[use]) for x in (np.full(len(rows), slot), symbols, scored, bits, *more))]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)
        c.release()

    got = met.select(*group, *fields, "keys", "values").mapInArrow(sums, schema)
    return got.groupBy("row", "doc_id", "slot").agg(*[F.sum(x).alias(x) for x in ("symbols", "scored", "bits", *side)])


PRIOR_SYMBOLS = 500


def shrunk(bits: Column, symbols: Column, centre: Column) -> Column:
    """Mean bits a symbol, drawn to the language's middle as if ``PRIOR_SYMBOLS`` more had been seen: short texts vary more."""
    return (bits + centre * PRIOR_SYMBOLS) / (symbols + PRIOR_SYMBOLS)
