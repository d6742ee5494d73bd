"""Shared helpers: tables, scratch, and vectorised word and hash kernels over Arrow text batches.

Text is handled as UTF-8 bytes. All separators used by the operators are single ASCII bytes, so
splitting bytes equals splitting code points. Kernels work on chunks of about a megabyte, so the
memory of a task depends on its longest text, not on its number of rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskstream.session import scratch_path, ship_package

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U64), np.ones(1, U64)]


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Tasks import this package on the workers."""
    ship_package(spark)


def saved(frame: DataFrame, label: str) -> DataFrame:
    """Written below the shared folder and read again: computed once, safe when executors are lost."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete saved tables after their last reader has ended."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pack_numbers(x: np.ndarray, pack) -> bytes:
    """The bytes of ``x`` by significance, each plane packed on its own: random planes stay as they are, even ones vanish."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    packed = [pack(np.ascontiguousarray(plane)) for plane in planes]
    return np.array([len(packed), *map(len, packed)], np.uint32).tobytes() + b"".join(packed)


def unpack_numbers(data: bytes, unpack) -> np.ndarray:
    """What ``pack_numbers`` was given, as unsigned numbers of its size."""
    size = int.from_bytes(data[:4], "little")
    ends = np.cumsum([4 * (size + 1), *np.frombuffer(data, np.uint32, size, 4)]).tolist()
    planes = [np.frombuffer(unpack(data[low:high]), np.uint8) for low, high in zip(ends, ends[1:])]
    return np.ascontiguousarray(np.array(planes).T).reshape(-1).view(f"u{size}")


def release() -> None:
    """Free memory of a Python worker goes back to its machine, instead of staying with the idle worker while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_MULTIPLIER) + U64(salt))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier modulo 2^64, and of its inverse, for positions below ``n``."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Flags of 256 bytes, true inside any of the inclusive ranges."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_HASH = seeds(256, 17)
BYTE_HASH_LOWER = BYTE_HASH[LOWER]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the bounds of each text; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of texts of about ``limit`` bytes, or one longer text."""
    data, bounds = text_bytes(column)
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        high = min(high, rows)
        yield low, high, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


def word_spans(data: np.ndarray, bounds: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text (plus one) the number of its first word."""
    inside = word[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_HASH) -> np.ndarray:
    """Prefix polynomial hashes modulo 2^64; ``span_hashes`` reads spans from them."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words, text bounds ignored."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = words[:n].copy()
    for k in range(1, width):
        total *= U64(0xA24BAED4963EE407)
        total += words[k : k + n]
    return mix(total)


def text_shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and their bounds by text.

    A text of fewer than ``width`` words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    every = shingle_hashes(words, width)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], U64)
    long = np.repeat(counts >= width, sizes)
    source = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], sizes)
    out[long] = every[source[long]]
    for k in np.flatnonzero((counts > 0) & (counts < width)):
        value = U64(counts[k])
        for w in words[first[k] : first[k + 1]]:
            value = mix(np.array([value], U64) * U64(_MULTIPLIER) + w)[0]
        out[bounds[k]] = value
    return out, bounds


def distinct_by_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values inside each text, and their bounds."""
    out, sizes = [], []
    for k in range(len(bounds) - 1):
        one = np.unique(values[bounds[k] : bounds[k + 1]])
        out.append(one)
        sizes.append(len(one))
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def unused(frame: DataFrame, *names: str) -> list[str]:
    """Column names for helpers that clash with no column of ``frame``."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def keyed_min(*columns: str):
    return F.min(F.struct(*columns))
