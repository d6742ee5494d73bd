"""Phrase collocations: frequent word n-grams of each language, found by Misra-Gries summaries and counted exactly.

1. Texts become blocks (``blocks``): lower-cased words of some megabytes of text, a space between words of a
   piece and a line feed after a piece, written once. A block has an id that later steps refer to.
2. A block's distinct n-grams of one to four words, told apart exactly by interned words, become rows by hash
   partition: a 32-bit fingerprint, a count and the place of the first occurrence (``_packed``). No text moves.
3. A hash partition's rows are merged into a Misra-Gries summary whose capacity exceeds its mass divided by the
   threshold (``summary``): what is taken off a count stays below the threshold, so every frequent n-gram
   survives. Equal fingerprints only add up, which can keep an n-gram too many but lose none.
4. The second pass takes the survivors back to their blocks, where the place gives the words; counts are added by
   language and phrase and those below the threshold go. So counts are exact whatever fingerprints meet.

The number of partitions follows the counted words, so a summary and the packed rows of one partition stay of
one size. A frequent n-gram is one entry of a block, not one of each occurrence: no hash partition is hot.
The scores are joins of the frequent phrases with themselves, at most a thirtieth of the words.

Defined results: null and empty texts have no words; rows without a language are of language ``und``; repeated
rows count as often as they stand; an empty table gives no row. Words of any length and texts of any length are
taken whole: a long text is a block of its own. Ties are ordered by phrase. Only text and lang are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskstream.llm import common as c

LONGEST = 4
LEAST = 30
BLOCK_BYTES = 4 << 20
PART_MASS = 1 << 22
TOP = 2000
SALTS = 64
BREAK = c.byte_set((0x0A, 0x0D), *((ord(x), ord(x)) for x in ".,;:!?"))
WORD = ~(BREAK | c.byte_set((0x20, 0x20), (0x09, 0x09)))
SPACE, END = 0x20, 0x0A

BLOCK_SCHEMA = "block bigint, langs array<string>, sizes array<bigint>, body binary"
PACK_SCHEMA = "part int, block bigint, prints binary, counts binary, places binary"
FOUND_SCHEMA = "block bigint, counts binary, places binary"
COUNT_SCHEMA = "lang string, words int, phrase string, n bigint"


def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def body_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words of all texts, each followed by a space or, at the end of a piece, a line feed; and the words of each text."""
    starts, ends, first = c.word_spans(data, bounds, WORD)
    if not len(starts):
        return np.zeros(0, np.uint8), np.diff(first)
    size = ends - starts + 1
    to = np.cumsum(size)
    source = np.arange(to[-1]) + np.repeat(starts - (to - size), size)
    body = c.LOWER[data[np.minimum(source, len(data) - 1)]]
    pieces = np.cumsum(BREAK[data])[starts]
    last = np.append(pieces[1:] != pieces[:-1], True)
    last[first[1:][np.diff(first) > 0] - 1] = True
    body[to - 1] = np.where(last, END, SPACE)
    return body, np.diff(first)


def blocks(docs: DataFrame) -> DataFrame:
    """The words of all texts in blocks of about ``BLOCK_BYTES``, saved; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, _ = _zstd()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column(1).fill_null("und")
            for low, high, data, bounds in c.chunks(batch.column(0), BLOCK_BYTES):
                body, sizes = body_of(data, bounds)
                if len(body):
                    arrays = [pa.array([number]), pa.array([langs[low:high].to_pylist()]), pa.array([sizes.tolist()]), pa.array([pack(body)])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["block", "langs", "sizes", "body"])
                    number += 1

    c.ready(docs.sparkSession)
    return c.saved(docs.select("text", "lang").mapInArrow(run, BLOCK_SCHEMA), "blocks")


def _word_ids(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An exact number for every word, and a hash for every number."""
    text = body.copy()
    text[ends] = SPACE
    offsets = np.concatenate([[0], ends + 1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
    data, bounds = c.text_bytes(words.dictionary)
    return words.indices.to_numpy(), c.span_hashes(c.prefix_sums(data), bounds[:-1], bounds[1:])


def block_grams(body: np.ndarray, langs: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and places (first word times four, plus the words after it) of a block's distinct n-grams."""
    ends = np.flatnonzero((body == SPACE) | (body == END))
    ids, hashes = _word_ids(body, ends)
    names, rank = np.unique(np.array(langs, object).astype(str), return_inverse=True)
    lang = np.repeat(rank, sizes)
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in names], c.U64)
    hashes = c.mix(hashes[ids] ^ seeds[lang])
    word, _ = pd.factorize(lang * (ids.max() + 1) + ids)
    vocabulary = int(word.max()) + 1
    open_ = body[ends] == SPACE  # the piece goes on after this word
    at, gram = np.arange(len(word)), word
    out = []
    for k in range(LONGEST):
        if k:
            on = np.flatnonzero(open_[at + k - 1])
            at = at[on]
            gram, _ = pd.factorize(gram[on].astype(np.int64) * vocabulary + word[at + k])
        if not len(at):
            break
        counts = np.bincount(gram)
        first = np.empty(len(counts), np.int64)
        first[gram[::-1]] = at[::-1]
        total = hashes[first]
        for j in range(1, k + 1):
            total = c.mix(total * c.U64(0xA24BAED4963EE407) + hashes[first + j])
        out.append((total, counts, first * LONGEST + k))
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(texts: DataFrame, parts: int) -> DataFrame:
    """Distinct n-grams of every block by hash partition, in the order of their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = _zstd()
        for batch in batches:
            for row in range(batch.num_rows):
                block, langs, sizes, body = (batch.column(k)[row].as_py() for k in range(4))
                hashes, counts, places = block_grams(np.frombuffer(unpack(body), np.uint8), langs, sizes)
                key = (hashes >> c.U64(32)) % c.U64(parts) << c.U64(32) | hashes & c.U64(0xFFFFFFFF)
                order = np.argsort(key)
                key, counts, places = key[order], counts[order], places[order]
                bounds = np.searchsorted(key, np.arange(parts + 1, dtype=c.U64) << c.U64(32))
                kind = np.uint64 if places.max(initial=0) >> 32 else np.uint32
                columns: list[list] = [[], [], [], [], []]
                for part in np.flatnonzero(np.diff(bounds)).tolist():
                    cut = slice(bounds[part], bounds[part + 1])
                    prints = np.diff((key[cut] & c.U64(0xFFFFFFFF)).astype(np.int64), prepend=0).astype(np.uint32)
                    packed = (c.pack_numbers(x, pack) for x in (prints, counts[cut].astype(np.uint32), places[cut].astype(kind)))
                    for column, value in zip(columns, (part, block, *packed)):
                        column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["part", "block", "prints", "counts", "places"])

    return texts.mapInArrow(run, PACK_SCHEMA)


class MisraGries:
    """A mergeable summary of counted keys: at most ``capacity`` counters, each short of its count by ``missing`` at most."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.missing = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > 2 * self.capacity + (1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
        self.waiting, self.held = [], 0
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(place, counts, len(self.keys)).astype(np.int64)  # exact below 2^53
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off
            self.missing += off

    def survivors(self, least: int) -> np.ndarray:
        """Keys, in order, that may have been added ``least`` times."""
        self.merge()
        return self.keys[self.counts + self.missing >= least]


def survivors(packed: DataFrame, parts: int, least: int) -> DataFrame:
    """Counts and places of the n-grams that a partition's summary keeps, by block."""

    def judged(rows: list[tuple], unpack, pack) -> pa.RecordBatch:
        read = lambda data: c.unpack_numbers(data, unpack)
        prints = lambda data: np.cumsum(read(data), dtype=np.uint32)
        mass = sum(int(read(counts).sum(dtype=np.int64)) for _, _, counts, _ in rows)
        found = MisraGries(mass // least + 1)
        for _, keys, counts, _ in rows:
            found.add(prints(keys), read(counts))
        keep = found.survivors(least)
        out: list[tuple] = []
        for block, keys, counts, places in rows:
            keys, counts = prints(keys), read(counts)
            at = np.minimum(np.searchsorted(keep, keys), max(len(keep) - 1, 0))
            good = keep[at] == keys if len(keep) else np.zeros(len(keys), bool)
            if good.any():
                places = read(places)[good].astype(np.uint64)
                order = np.argsort(places)  # in the order of their places, whose steps are small
                out.append((block, c.pack_numbers(counts[good][order], pack), c.pack_numbers(np.diff(places[order], prepend=np.uint64(0)), pack)))
        columns = list(zip(*out)) or [(), (), ()]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["block", "counts", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = _zstd()
        now, rows = None, []
        for batch in batches:
            for part, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if part != now and rows:
                    yield judged(rows, unpack, pack)
                    rows = []
                now = part
                rows.append(row)
        if rows:
            yield judged(rows, unpack, pack)

    dealt = packed.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, FOUND_SCHEMA)


def exact_counts(texts: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(lang, words, phrase, n) of the survivors that occur ``least`` times; a block's row stands ahead of its survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpack = _zstd()
        body = starts = ends = langs = opens = None
        for batch in batches:
            for row in range(batch.num_rows):
                whole, names, sizes, counts, places = (batch.column(k)[row].as_py() for k in range(2, 7))
                if whole is not None:
                    body = np.frombuffer(unpack(whole), np.uint8)
                    ends = np.flatnonzero((body == SPACE) | (body == END))
                    starts = np.concatenate([[0], ends[:-1] + 1])
                    langs, opens = pa.array(names, pa.string()), np.cumsum(sizes)
                    continue
                counts, places = c.unpack_numbers(counts, unpack), np.cumsum(c.unpack_numbers(places, unpack)).astype(np.int64)
                first, more = np.divmod(places, LONGEST)
                size = ends[first + more] - starts[first]
                to = np.concatenate([[0], np.cumsum(size)])
                text = body[np.arange(to[-1]) + np.repeat(starts[first] - to[:-1], size)]
                phrases = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(to), pa.py_buffer(text)])
                owner = np.searchsorted(opens, first, "right")
                arrays = [langs.take(pa.array(owner)), pa.array((more + 1).astype(np.int32)), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "words", "phrase", "n"])

    wide = texts.select("block", F.lit(0).alias("kind"), "body", "langs", "sizes", *(F.lit(None).cast("binary").alias(x) for x in ("counts", "places")))
    narrow = found.withColumns({"kind": F.lit(1), "body": F.lit(None).cast("binary"), "langs": F.lit(None).cast("array<string>"), "sizes": F.lit(None).cast("array<bigint>")})
    order = wide.unionByName(narrow).repartition(c.partitions(texts.sparkSession), "block").sortWithinPartitions("block", "kind")
    counts = order.select("block", "kind", "body", "langs", "sizes", "counts", "places").mapInArrow(run, COUNT_SCHEMA)
    return counts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n): all n-grams of one to four words that occur at least ``least`` times, saved. ``texts`` are ``blocks``."""
    words = texts.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(c.partitions(texts.sparkSession), -(-LONGEST * words // PART_MASS))
    return c.saved(exact_counts(texts, survivors(_packed(texts, parts), parts, least), least), "frequent")


def scored(phrases: DataFrame) -> DataFrame:
    """The lowest-scoring cut of every phrase of two words or more: (lang, words, phrase, a, l, r, score)."""
    long = phrases.where("words > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
    cut = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " "))
    cut = cut.withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")).drop("w")
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(2000000 * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))")
    best = both.select("lang", "words", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = best.groupBy("lang", "words", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    return best.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, over): the largest count of a longer phrase that holds the phrase's words one after another."""
    long = phrases.where("words > 2").withColumn("w", F.split("phrase", " "))
    size = long.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    part = size.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = part.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), F.col("n").alias("over"))
    return inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases."""
    texts = blocks(docs)
    phrases = frequent(texts, least)
    words = texts.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    held = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left")
    kept = held.where("over IS NULL OR 100 * cast(over AS decimal(19, 0)) < 80 * cast(a AS decimal(19, 0))")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language may hold most phrases: its first ones are those among the first ones of its salts
    salted = Window.partitionBy("lang", F.crc32("phrase") % SALTS).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM starts, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
costs AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, c.cut), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, c.cut + 1, c.k), ' ')),
best AS (SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, a AS over
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i
        FROM (SELECT lang, k, a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS size FROM f WHERE k > 2))),
kept AS (
  SELECT b.* FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100::HUGEINT * i.over >= 80::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r.r AS r, t.n AS n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= {TOP}
"""
