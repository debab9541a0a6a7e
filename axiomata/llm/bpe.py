"""Byte-level BPE encoding and decoding.

Texts are split by a pattern into pieces. The distinct new pieces of a block
of text become rows of padded numpy matrices, one matrix for each length
bucket. In every round each row merges its leftmost pair of minimum rank; the
rank of a pair comes from a hash table with open addressing. Merged cells are
closed up and rows without a pair left are compacted out of the matrix.

Pieces longer than ``MATRIX_WIDTH`` bytes (runs without any boundary) would
make wide matrices with as many rounds as bytes, so they take the same merges
in the same order from a heap, in n log n steps. No piece is cut.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded each; extra columns are kept as they are, and the
new columns' names must differ from them (``free_name`` finds such names); an
empty table gives an empty table. Texts of any length are encoded whole: the
pieces are taken in blocks of ``BLOCK`` so that memory stays bounded.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of the longest piece that is merged in a matrix.
MATRIX_WIDTH = 128
#: Cells of a matrix at most.
CELLS = 1 << 20
#: Characters of a text from which its pieces are taken one by one, and pieces in a block.
LONG_TEXT, BLOCK = 1 << 20, 1 << 17
#: Pieces whose ids a worker keeps; beyond it the store starts anew, which costs time and changes no result.
KEPT = 120_000
NONE = np.uint32(0xFFFFFFFF)


def parse_ranks(data: bytes) -> list[bytes]:
    """The tokens in the order of their ranks, from lines of base64 and rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class PairTable:
    """Ranks of the pairs of tokens that merge, in a hash table with linear probing."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        keys, ranks = [], []
        for t, i in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(i)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, NONE)
        left, value = np.array(keys, dtype=np.uint64), np.array(ranks, dtype=np.uint32)
        at = self.slot(left)
        while len(left):
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            where = np.flatnonzero(free)
            _, first = np.unique(at[where], return_index=True)
            put = where[first]
            self.keys[at[put]], self.ranks[at[put]] = left[put], value[put]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, value, at = left[rest], value[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The same ranks as a dictionary, made when the first long piece comes."""
        taken = self.keys != np.uint64(0xFFFFFFFFFFFFFFFF)
        return dict(zip(self.keys[taken].tolist(), self.ranks[taken].tolist(), strict=True))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), NONE)
        at, open_ = self.slot(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, data: bytes, pattern: str):
        self.tokens = parse_ranks(data)
        self.table = PairTable(self.tokens)
        self.pattern = regex.compile(pattern)
        self.of_byte = np.zeros(256, dtype=np.uint32)
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.of_byte[t[0]] = i
        self.whole = {t: i for i, t in enumerate(self.tokens) if t}
        self.known: dict[str, bytes] = {}

    def merge_matrix(self, rows: list[bytes]) -> list[bytes]:
        """Ids of rows of bytes, as little-endian 32-bit integers."""
        size = np.array([len(r) for r in rows])
        width = int(size.max())
        ids = np.zeros((len(rows), width), dtype=np.uint32)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.of_byte[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        out: list[bytes] = [b""] * len(rows)
        own = np.arange(len(rows))
        pair = np.full((len(rows), max(1, width)), NONE)  # pair k: cells k and k + 1; the last column stays empty
        real = np.arange(width) < (size - 1)[:, None]
        pair[real] = self.table(ids[:, :-1][real[:, :-1]], ids[:, 1:][real[:, :-1]])
        while True:
            at = pair.argmin(axis=1)  # the leftmost of the least
            line = np.arange(len(own))
            best = pair[line, at]
            go = best != NONE
            for k in np.flatnonzero(~go):
                out[own[k]] = ids[k, : size[k]].tobytes()
            if not go.any():
                return out
            if not go.all():
                ids, pair, size, own, at, best = ids[go], pair[go], size[go], own[go], at[go], best[go]
                line = np.arange(len(own))
            size = size - 1
            ids[line, at] = best
            take = np.arange(int(size.max()))
            take = take + (take > at[:, None])  # cell at + 1 goes
            ids, pair = np.take_along_axis(ids, take, axis=1), np.take_along_axis(pair, take, axis=1)
            # only the pairs that touch the merged cell change
            pair[line, at] = NONE
            right = np.flatnonzero(at < size - 1)
            pair[right, at[right]] = self.table(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            pair[left, at[left] - 1] = self.table(ids[left, at[left] - 1], ids[left, at[left]])

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: least rank first, then leftmost."""
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids))) + [-1], [-1, *range(len(ids) - 1)]
        pairs = self.table.pairs
        heap = [(r, i) for i in range(len(ids) - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := pairs.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode new distinct pieces and keep their ids."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if (i := self.whole.get(data)) is not None:  # a token merges to itself
                self.known[piece] = i.to_bytes(4, "little")
            elif len(data) > MATRIX_WIDTH:
                self.known[piece] = self.merge_long(data)
            else:
                buckets.setdefault(-(-len(data) // 4) * 4, []).append((piece, data))
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                self.known.update(zip((p for p, _ in part), self.merge_matrix([d for _, d in part]), strict=True))

    def know(self, pieces: set[str]) -> None:
        """Have the ids of all these pieces in the store."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(pieces)
        self.learn(new)

    def ids_of(self, pieces: list[str]) -> bytes:
        self.know(set(pieces))
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, each as four bytes, the least significant first."""
        if not text:
            return b""
        if len(text) < LONG_TEXT:
            return self.ids_of(self.pattern.findall(text))
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(self.ids_of(block) for block in iter(lambda: list(islice(found, BLOCK)), []))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """As encode(), with the new pieces of about a megabyte of text learned together."""
        out: list[bytes] = []
        k = 0
        while k < len(texts):
            start, chars = k, 0
            while k < len(texts) and (chars == 0 or chars + len(texts[k] or "") <= LONG_TEXT):
                chars += len(texts[k] or "")
                k += 1
            block = texts[start:k]
            if chars > LONG_TEXT:
                out += [self.encode(t) for t in block]
                continue
            split = [self.pattern.findall(t) if t else [] for t in block]
            self.know(set().union(*split))
            get = self.known.__getitem__
            out += [b"".join(map(get, pieces)) for pieces in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with two binary columns in place of the text.

    ``ids``: the token ids as little-endian unsigned 32-bit integers;
    ``decoded``: the bytes that the ids decode to. ``ranks_path`` is the
    vocabulary file on the driver; its bytes (a fixed file of about a
    megabyte) are broadcast. The work has no shuffle: each Arrow batch is
    encoded where it was read.
    """
    with open(ranks_path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != text]
    if {ids.lower(), decoded.lower()} & {c.lower() for c in keep}:
        raise ValueError(f"the table already has a column {ids} or {decoded}")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for k in range(0, batch.num_rows, 256):
                rows = codec.encode_all(texts.slice(k, 256).to_pylist())
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(rows, pa.binary()), pa.array([codec.decode(r) for r in rows], pa.binary())], names=[*keep, ids, decoded])

    return df.mapInArrow(run, schema)
