"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark partitions.

Every task splits its texts into the pieces of the tokenizer's pattern and keeps one copy of each
distinct piece. Pieces that are tokens themselves are done. The bytes of the others become
token-position rows of a DuckDB table. A recursive query joins neighbouring tokens with the merge
table and contracts, in every piece, the leftmost pair of minimum rank until no piece has a pair
left. Ids are decoded by a join with the vocabulary and an aggregation ordered by position.

Texts of ASCII and Latin letters are split on whole arrays of bytes; any other text goes through the
pattern itself. Pieces are known by 64-bit hashes; a text whose ids do not decode to its bytes (a
collision) is encoded again without them.

Defined results: a null or empty text has no tokens. A text may be of any length: it is cut into
pieces first, and pieces longer than ``LONG_PIECE`` bytes (one recursion step per merge would be
quadratic) contract the same pairs in the same order with a heap. Repeated rows give repeated
results. Other columns are not read. The rank file is a parameter; its bytes (about a megabyte)
travel with the closure.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deskstream.llm import common as c

LONG_PIECE = 256
KNOWN_PIECES = 1_500_000
CHUNK_BYTES = 2 << 20

CONTRACT = """
WITH RECURSIVE step(piece, pos, tok, done) AS (
    SELECT piece, pos, tok, false FROM start
    UNION ALL
    (
        WITH pairs AS MATERIALIZED (
            SELECT piece, pos, tok, before, m.rank
            FROM (
                SELECT piece, pos, tok, lead(tok) OVER w AS next, lag(pos) OVER w AS before
                FROM step WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)
            ) AS p
            LEFT JOIN merges AS m ON m.pair = (p.tok::BIGINT << 20) | p.next
        ),
        best AS (SELECT piece, min((rank::BIGINT << 16) | pos) AS code FROM pairs GROUP BY piece)
        SELECT p.piece, p.pos, CASE WHEN p.pos = (code & 65535) THEN p.rank ELSE p.tok END, code IS NULL
        FROM pairs AS p JOIN best USING (piece)
        WHERE code IS NULL OR before IS NULL OR before <> (code & 65535)
    )
)
SELECT piece, tok FROM step WHERE done ORDER BY piece, pos
"""
DECODE = """
SELECT text, string_agg(symbols, '') AS symbols
FROM (SELECT text, pos, symbols FROM ids JOIN vocabulary USING (tok) ORDER BY text, pos) GROUP BY text ORDER BY text
"""

LETTER, DIGIT, OTHER, BLANK = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[*range(9, 14), 32]] = BLANK
#: Bytes of texts that need the pattern itself: control characters, and lead bytes beyond U+00C0 to U+027F.
UNUSUAL = c.byte_set((0, 8), (14, 31), (127, 127), (0xC0, 0xC2), (0xCA, 255))


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver."""
    with open(path, "rb") as source:
        return source.read()


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Flags of bytes that start a piece, for texts without unusual characters.

    The pattern takes contractions, letters, digits and other characters in runs with one space
    before them; of white space before them the last character stands alone unless it is a space.
    """
    n = len(data)
    kind = CLASS[data]
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    run |= opens[:n]
    blank, space = kind == BLANK, data == 32
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    after_space &= ~opens[:n]
    ends_run = np.ones(n, bool)
    ends_run[:-1] = run[1:]
    last = blank & ends_run & ~opens[1:]
    flags = (run & ~(after_space & ~blank)) | last
    text_end = np.repeat(bounds[1:], np.diff(bounds)) if (data == 39).any() else None
    if text_end is not None:
        quote = np.flatnonzero((data == 39) & flags & ends_run)
        quote = quote[quote + 1 < text_end[quote]]
        one = quote[np.isin(data[quote + 1], np.frombuffer(b"stmd", np.uint8))]
        two = quote[quote + 2 < text_end[quote]]
        pair = data[two + 1].astype(np.int32) * 256 + data[two + 2]
        two = two[np.isin(pair, [256 * a + b for a, b in (b"re", b"ve", b"ll")])]
        for at, width in ((one, 1), (two, 2)):
            flags[at + 1] = False
            beyond = at + 1 + width
            flags[beyond[beyond < text_end[at]]] = True
    return flags


class Encoder:
    """One per worker: the vocabulary, a DuckDB connection and the pieces met so far."""

    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.find = regex.compile(pattern).findall
        self.byte_rank = np.array([self.ranks[bytes([value])] for value in range(256)], np.int32)
        triples = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self.merges = {(a << 20) | b: rank for a, b, rank in triples}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array(self.merges.keys(), pa.int64()), "rank": pa.array(self.merges.values(), pa.int32())})
        words = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "symbols": [t.decode("latin-1") for t in self.ranks]})
        for name, rows in (("merges", merges), ("vocabulary", words)):
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(lengths)
        start = pa.table(
            {
                "piece": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths),
                "pos": (np.arange(len(data)) - np.repeat(ends - lengths, lengths)).astype(np.int32),
                "tok": data,
            }
        )
        self.db.register("start", start)
        out = self.db.execute(CONTRACT).fetchnumpy()
        return np.split(out["tok"].astype(np.int32), np.cumsum(np.bincount(out["piece"], minlength=len(pieces)))[:-1])

    def contract_long(self, piece: bytes) -> np.ndarray:
        """The same contractions of one long piece, the next pair taken from a heap."""
        tokens = self.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
        n = len(tokens)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank_of = self.merges.get
        heap = [(r, i) for i in range(n - 1) if (r := rank_of((tokens[i] << 20) | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if tokens[i] >= 0 else -1
            if j < 0 or rank_of((tokens[i] << 20) | tokens[j]) != rank:
                continue
            tokens[i], tokens[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := rank_of((tokens[k] << 20) | tokens[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([t for t in tokens if t >= 0], np.int32)

    def tokens_of(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Tokens of each piece."""
        out: list = [None if (t := self.ranks.get(p)) is None else np.array([t], np.int32) for p in pieces]
        left = [k for k, t in enumerate(out) if t is None]
        short = [k for k in left if len(pieces[k]) <= LONG_PIECE]
        for low in range(0, len(short), 50_000):
            part = short[low : low + 50_000]
            for k, value in zip(part, self.contract([pieces[k] for k in part])):
                out[k] = value
        for k in left:
            if len(pieces[k]) > LONG_PIECE:
                out[k] = self.contract_long(pieces[k])
        return out

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        tokens = self.tokens_of(pieces)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        at = np.cumsum(sizes) - sizes + len(self.tokens)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.sizes = (np.insert(a, place, b) for a, b in ((self.keys, keys), (self.at, at), (self.sizes, sizes)))
        self.tokens = np.concatenate([self.tokens, *tokens])

    def encode_plain(self, text: bytes) -> np.ndarray:
        pieces = [p.encode() for p in self.find(text.decode())]
        order = {p: None for p in pieces}
        found = dict(zip(order, self.tokens_of(list(order))))
        return np.concatenate([found[p] for p in pieces]) if pieces else np.zeros(0, np.int32)

    def encode_usual(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without unusual characters, and the bounds of each text."""
        if len(self.keys) > KNOWN_PIECES:
            self.forget()
        starts = np.flatnonzero(piece_starts(data, bounds))
        ends = np.append(starts[1:], len(data))
        keys = c.span_hashes(c.prefix_sums(data), starts, ends)
        place = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != keys[inside]
        if fresh.any():
            new, first = np.unique(keys[fresh], return_index=True)
            where = np.flatnonzero(fresh)[first]
            raw = data.tobytes()
            self.learn(new, [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            place = np.searchsorted(self.keys, keys)
        sizes = self.sizes[place]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.tokens[np.arange(stops[-1]) + np.repeat(self.at[place] - stops[:-1], sizes)]
        return ids, stops[np.searchsorted(starts, bounds)]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the bounds of each text."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        odd = np.flatnonzero(UNUSUAL[data] | ((data == 0xC3) & np.isin(np.append(data[1:], 0), (0x97, 0xB7))))
        if not len(odd):
            return self.encode_usual(data, bounds)
        unusual = np.zeros(len(bounds) - 1, bool)
        unusual[np.searchsorted(bounds, odd, "right") - 1] = True
        parts = []
        for k, slow in enumerate(unusual):
            one = data[bounds[k] : bounds[k + 1]]
            parts.append(self.encode_plain(one.tobytes()) if slow else None)
        rest = np.flatnonzero(~unusual)
        sizes = np.diff(bounds)
        keep = np.repeat(~unusual, sizes)
        ids, inner = self.encode_usual(data[keep], np.concatenate([[0], np.cumsum(sizes[rest])])) if keep.any() else (np.zeros(0, np.int32), np.zeros(len(rest) + 1, np.int64))
        for j, k in enumerate(rest):
            parts[k] = ids[inner[j] : inner[j + 1]]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text. A query takes at most about a chunk of tokens; longer texts are joined from parts."""
        parts: list[list[bytes]] = [[] for _ in range(len(bounds) - 1)]
        owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        for low in range(0, len(ids), CHUNK_BYTES // 2):
            tokens = ids[low : low + CHUNK_BYTES // 2].astype(np.int32)
            rows = {"text": owner[low : low + len(tokens)], "pos": np.arange(len(tokens), dtype=np.int32), "tok": tokens}
            self.db.register("ids", pa.table(rows))
            out = self.db.sql(DECODE).to_arrow_table()
            for text, symbols in zip(out["text"].to_pylist(), out["symbols"].to_pylist()):
                parts[text].append(symbols.encode("latin-1"))
        return [b"".join(p) for p in parts]

    def both(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids and decoded bytes of each text."""
        ids, ends = self.encode(data, bounds)
        decoded = self.decode(ids, ends)
        out = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for k, text in enumerate(decoded):
            original = data[bounds[k] : bounds[k + 1]].tobytes()
            if text != original:
                out[k] = self.encode_plain(original)
                decoded[k] = self.decode(out[k], np.array([0, len(out[k])]))[0]
        return out, decoded


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_of(rank_file: bytes, pattern: str) -> Encoder:
    """The worker's encoder; later tasks of the worker find its pieces known."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(rank_file, pattern)
    return _encoders[key]


SCHEMA = "n_tokens bigint, ids binary, decoded binary"
DIGEST_SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def bpe(docs: DataFrame, rank_file: bytes, pattern: str, digest: bool = False, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with n_tokens, the ids (little-endian unsigned 32-bit) and the decoded bytes, or their digests."""
    c.ready(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(rank_file, pattern)
        for batch in batches:
            for low, high, data, bounds in c.chunks(batch.column(batch.num_columns - 1), CHUNK_BYTES):
                ids, decoded = encoder.both(data, bounds)
                raw = [x.astype("<u4").tobytes() for x in ids]
                result = [pa.array([hashlib.sha256(x).hexdigest() for x in xs]) if digest else pa.array(xs, pa.binary()) for xs in (raw, decoded)]
                count = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:-1], count, *result], names=names)

    kept = docs.select(*[docs[f"`{k}`"] for k in keep])
    added = DIGEST_SCHEMA if digest else SCHEMA
    names = [*keep, *(f.split()[0] for f in added.split(", "))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), added])
    return docs.select(*[docs[f"`{k}`"] for k in keep], docs[f"`{text}`"]).mapInArrow(encode, schema)
