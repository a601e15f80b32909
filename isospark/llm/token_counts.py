"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.llm.common import held, map_slices
from isospark.llm.pretokens import PATTERN, chunk_text, pattern_chunks, utf8

VOCABULARY = "byte_bpe_50k.json"
NONE = np.iinfo(np.int32).max
#: Chunks and matches kept between batches, and how long they may be; bytes that are merged at a time, unless one match is longer.
KEEP, LONGEST, MERGED = 600_000, 48, 1 << 19
SLOTS = 20  # bits of the pair table, a few hundredths full


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class RankMerger:
    """Counts the tokens of many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.made = made
        self.slots = np.full(1 << SLOTS, -1, np.int64)
        self.slot_rank = np.full(1 << SLOTS, NONE, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & ((1 << SLOTS) - 1)
            self.slots[slot], self.slot_rank[slot] = key, rank
        born = dict(zip(made.tolist(), range(len(made)), strict=True))
        late = [r for r, (a, b) in enumerate(pairs) if max(born.get(vocab[a], -1), born.get(vocab[b], -1)) >= r]
        if late:
            raise ValueError("a merge comes before the merges of its parts; all places of a pair cannot be merged at once")
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.matches: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it has none, from an open-addressed table."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        out = self.slot_rank[slot]
        open_ = np.flatnonzero(self.slots[slot] != keys)
        slot = slot[open_]
        while len(open_):
            found = self.slots[slot]
            hit = found == keys[open_]
            out[open_] = np.where(hit, self.slot_rank[slot], NONE)
            more = ~hit & (found >= 0)
            open_, slot = open_[more], (slot[more] + 1) & ((1 << SLOTS) - 1)
        return out

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token.

        Each round finds every sequence's lowest-ranked pair and merges all its places, from
        left to right where they overlap; sequences without a ranked pair are done.
        """
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        out = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens), dtype=np.int32), lengths)
        while len(symbols) > 1:
            ranks = np.append(np.where(owner[1:] == owner[:-1], self._ranks(symbols[:-1], symbols[1:]), np.int32(NONE)), np.int32(NONE))
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(ranks, starts)
            best = np.repeat(lowest, sizes)
            hit = (ranks == best) & (best != NONE)
            # of neighbouring hits (a pair of equal symbols that overlaps itself) every second one counts
            index = np.arange(len(hit), dtype=np.int32)
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - run_start) % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, ranks, 0)], symbols)
            keep = ~np.append(False, hit[:-1])
            left = np.add.reduceat(keep.astype(np.int64), starts)
            out[owner[starts]] = left
            going = np.repeat(lowest != NONE, sizes) & keep
            symbols, owner = symbols[going], owner[going]
        return out

    def _known(self, matches: list[str]) -> dict[str, int]:
        """The counts of `matches`; those not seen before are merged in slices of at most MERGED bytes, or of one match."""
        unseen = list({m for m in matches if m not in self.matches})
        if not unseen:
            return self.matches
        counts: list[int] = []
        part, size = [], 0
        for data in map(str.encode, unseen):
            if part and size + len(data) > MERGED:
                counts += self.count(part).tolist()
                part, size = [], 0
            part.append(data)
            size += len(data)
        counts += self.count(part).tolist()
        known = {m: self.matches[m] for m in matches if m in self.matches} | dict(zip(unseen, counts, strict=True))
        if len(self.matches) > KEEP:
            self.matches.clear()
        self.matches.update((m, n) for m, n in zip(unseen, counts, strict=True) if len(m) <= LONGEST)
        return known

    def _text_counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, which has no special strings. Texts are taken together up to a size, long ones in parts of their matches."""
        out, waiting, size = [0] * len(texts), [], 0

        def settle() -> None:
            known = self._known([m for _, ms in waiting for m in ms])
            for i, ms in waiting:
                out[i] += sum(map(known.__getitem__, ms))
            waiting.clear()

        for i, text in enumerate(texts):
            if len(text) > MERGED:
                found = PATTERN.finditer(text)
                while part := [m.group() for m in islice(found, 1 << 16)]:
                    waiting.append((i, part))
                    settle()
                continue
            waiting.append((i, PATTERN.findall(text)))
            size += len(text)
            if size > MERGED:
                settle()
                size = 0
        settle()
        return out

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; special strings inside a text are one token each."""
        texts = utf8(texts)
        chunks, uncut = pattern_chunks(texts)
        if len(self.chunks) > KEEP:
            self.chunks.clear()
        new = [c for c in chunks.unique if c not in self.chunks]
        own = dict(zip(new, self._text_counts(list(map(chunk_text, new))), strict=True))
        self.chunks.update((c, n) for c, n in own.items() if len(c) <= LONGEST)
        out = chunks.sums([own[c] if c in own else self.chunks[c] for c in chunks.unique])
        for s in self.special:
            uncut |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(uncut):
            parts = [texts[i].as_py()]
            for s in self.special:
                parts = [y for x in parts for y in x.split(s)]
            out[i] = len(parts) - 1 + sum(self._text_counts(parts))
        return out


def _merger(path: str) -> RankMerger:
    """One for each Python worker, with what it has kept."""
    return held(("token_counts", path), lambda: RankMerger(path))


def token_counts(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of `docs`.

    Null and empty texts have 0 bytes and tokens. Repeated rows and null ids stay as they are;
    other columns are not read. An empty table gives an empty one. Texts of any length are
    counted whole, in slices of MERGED bytes; only a single match (a run of letters, say) that
    is longer is held at once.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path)
        for batch in batches:
            counts = merger.count_texts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = map_slices(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long", 2048, 16)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
