"""Byte-level BPE encoding and decoding as a tree reduction.

Encodings form a monoid: the encoding of two neighbouring byte strings can be joined without
encoding both anew. BPE encodings have a local test: a sequence of tokens is the encoding of
its bytes exactly if each two neighbouring tokens are the encoding of their joint bytes. So a
join encodes a window around the boundary anew, and is done when the window's first and last
token pass that test with the tokens outside; else the window grows.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from isospark.llm.common import held, map_slices
from isospark.llm.pretokens import PATTERN, BoundedCache, chunk_text, pattern_chunks, utf8

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a leaf of the encoding tree, ids of a leaf of the decoding tree, bytes of an inner node that is kept.
LEAF_BYTES, LEAF_IDS, KEPT_BYTES = 2, 1 << 16, 6
SMALL = 48
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class TreeBpe:
    """Encodes and decodes with one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.reached = BoundedCache(lambda token: self.merge(token) == [self.ranks[token]], limit=1 << 17)
        self.pairs: dict[int, list[int] | None] = {}  # by first id * size + second id
        self.nodes: dict[bytes, list[int]] = {}
        self.matches = BoundedCache(lambda match: array("i", self.encode_match(match)).tobytes(), limit=200_000)
        self.chunks = BoundedCache(self._chunk, limit=600_000)
        self.lengths = np.zeros(max(self.token, default=-1) + 1, np.int64)
        for rank, token in self.token.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.store = np.frombuffer(b"".join(self.token[r] for r in sorted(self.token)), np.uint8)

    def merge(self, data: bytes) -> list[int]:
        """The plain rule: merge the neighbours of the lowest rank, the first of equals, until none has a rank."""
        if len(data) <= SMALL:
            return self._merge_small(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after, before = [*range(1, len(data)), -1], [-1, *range(len(data) - 1)]
        heap = [(self.ranks[data[i : i + 2]], i, 2) for i in range(len(data) - 1) if data[i : i + 2] in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left, j = parts[i], after[i]
            if left is None or j < 0 or len(left) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i], parts[j] = left + parts[j], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (rank := self.ranks.get(joint := parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (rank, a, len(joint)))
        return [self.ranks[p] for p in parts if p is not None]

    def _merge_small(self, data: bytes) -> list[int]:
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while ranks and (lowest := min(ranks)) < NONE:
            i = ranks.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], NONE)
        return [self.ranks[p] for p in parts]

    def pair(self, a: int, b: int) -> list[int] | None:
        """The encoding of two tokens' joint bytes, None if that is the two."""
        key = a * len(self.lengths) + b
        try:
            return self.pairs[key]
        except KeyError:
            merged = self.merge(self.token[a] + self.token[b])
            found = None if merged == [a, b] else merged
            if len(self.pairs) >= 400_000:
                self.pairs.clear()
            self.pairs[key] = found
            return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both: a window around the boundary is encoded anew and grows until its edges are stable."""
        window, size = self.pair(left[-1], right[0]), 1
        if window is None:
            return left + right
        while True:
            if (size >= len(left) or self.pair(left[-size - 1], window[0]) is None) and (size >= len(right) or self.pair(window[-1], right[size]) is None):
                return left[:-size] + window + right[size:]
            size *= 2
            window = self.merge(b"".join(map(self.token.__getitem__, left[-size:] + right[:size])))

    def reduce(self, data: bytes) -> list[int]:
        """The encoding of `data`, up a tree of halves. A node that is a token ends its branch; short nodes are kept, as words share them."""
        rank = self.ranks.get(data)
        if rank is not None and self.reached[data]:
            return [rank]
        size = len(data)
        if size <= LEAF_BYTES:
            return self.merge(data)
        found = self.nodes.get(data) if size <= KEPT_BYTES else None
        if found is None:
            half = size >> 1
            found = self.join(self.reduce(data[:half]), self.reduce(data[half:]))
            if size <= KEPT_BYTES:
                if len(self.nodes) >= 200_000:
                    self.nodes.clear()
                self.nodes[data] = found
        return found

    def encode_match(self, match: str) -> list[int]:
        """One match of the pattern; a match that is a token itself is that token."""
        data = match.encode()
        rank = self.ranks.get(data)
        return self.reduce(data) if rank is None else [rank]

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        return b"".join(map(self.matches.__getitem__, PATTERN.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        found = PATTERN.findall(chunk_text(chunk))
        return array("i", self.encode_match(found[0])).tobytes() if len(found) == 1 else b"".join(map(self.matches.__getitem__, found))

    def encode_batch(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text."""
        texts = utf8(texts)
        chunks, uncut = pattern_chunks(texts)
        ids, ends = chunks.joined(list(map(self.chunks.__getitem__, chunks.unique)))
        if uncut.any():
            own = [np.frombuffer(self.encode(t.as_py()), np.int32) if u else x for t, u, x in zip(texts, uncut, np.split(ids, ends[:-1]), strict=True)]
            ids, ends = np.concatenate(own), np.cumsum([len(x) for x in own])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of `ids`: leaves are gathered from the tokens' store, neighbours are concatenated up the tree."""
        if len(ids) <= LEAF_IDS:
            each = self.lengths[ids]
            ends = np.cumsum(each)
            return self.store[np.repeat(self.starts[ids] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decode_batch(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; a null list has none. KeyError for an id without token."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise KeyError("an id without token")
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        places = np.append(0, np.cumsum(self.lengths[ids]))[ends]
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(self.decode(ids))]).cast(pa.binary())


def _bpe(path: str) -> TreeBpe:
    """One for each Python worker, with what it has kept."""
    return held(("bpe", path), lambda: TreeBpe(read_ranks(path)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) of each row of `docs`.

    Null and empty texts have no ids. Repeated rows and null ids stay as they are; other
    columns are not read. `vocabulary`: a rank file, at the same place on each executor.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            ids = bpe.encode_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    docs = docs.select(id_col, text_col)
    return map_slices(docs, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>", 2048, 16)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, ids, decoded binary) of each row of `encoded`; null ids decode to no bytes. An id without token raises KeyError."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bpe.decode_batch(batch.column(1))], names=[id_col, "ids", "decoded"])

    encoded = encoded.select(id_col, ids_col)
    return map_slices(encoded, run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary", 2048, 16)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids, decoded) of each row of `docs`: `encode` and then `decode`, in one pass of one Python worker.

    Null and empty texts have no ids and no bytes; null ids and repeated rows stay each for
    itself; texts of any length are encoded whole; an empty table gives an empty one; other
    columns are not read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            ids = bpe.encode_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, bpe.decode_batch(ids)], names=[id_col, "ids", "decoded"])

    docs = docs.select(id_col, text_col)
    return map_slices(docs, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary", 2048, 16)
