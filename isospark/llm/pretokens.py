"""Cutting a batch of texts into chunks that a tokenizer encodes independently of each other.

Most chunks are words, so a batch has few different ones, and each is encoded once: Arrow cuts
and numbers them, Python sees the different ones only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Marks chunks that have no space before them.
MARK = "\x01"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNCUT = f"{_WHITE}{_WHITE}|{MARK}"
_WORD_END = r"([A-Za-z])([.,;:!?])"


class Chunks:
    """The chunks of a batch: `unique` ones, `index` of each chunk in them, `ends` of each text's chunks."""

    def __init__(self, parts: pa.ListArray):
        coded = parts.flatten().dictionary_encode()
        self.unique: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # seven times as fast as to_pylist
        self.index = coded.indices.to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))

    def sums(self, values: list[int]) -> np.ndarray:
        """The sum over each text's chunks of what `values` has for the unique ones."""
        total = np.append(0, np.cumsum(np.array(values, np.int64)[self.index]))[np.append(0, self.ends)]
        return np.diff(total)

    def joined(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The 32-bit ids of all chunks in turn, from those of the unique ones, and the end of each text's."""
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        store, starts = np.frombuffer(b"".join(values), np.int32), np.append(0, np.cumsum(lengths))[:-1]
        each = lengths[self.index]
        ends = np.cumsum(each)
        ids = store[np.repeat(starts[self.index] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(0, ends)[self.ends]


def utf8(texts: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets, so that a batch may be long; null is empty."""
    if texts.offset:  # some of Arrow's string functions are wrong for slices
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def pattern_chunks(texts: pa.Array) -> tuple[Chunks, np.ndarray]:
    """Chunks for the byte-level pattern, and which texts are uncut: those are one chunk.

    Where all white space is single, no match of the pattern goes past a newline, begins
    before a space and ends after it, or has a letter and the mark after it. So texts are cut
    there; in the others white space comes in runs. A chunk that begins with MARK is what
    follows it; the others have a space before them.
    """
    uncut = pc.match_substring_regex(texts, _UNCUT)
    plain = pc.if_else(uncut, pa.scalar("", texts.type), texts)
    cut = pc.replace_substring(pc.replace_substring_regex(plain, _WORD_END, rf"\1 {MARK}\2"), "\n", f" {MARK}\n")
    return Chunks(pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK, texts.type), cut, pa.scalar("", texts.type)), " ")), uncut.to_numpy(zero_copy_only=False)


def chunk_text(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == MARK else " " + chunk


def white_chunks(texts: pa.Array) -> Chunks:
    """Chunks between ASCII white space, the marks after ASCII letters cut off."""
    return Chunks(pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _WORD_END, r"\1 \2")))


class BoundedCache(dict):
    """What `compute` gives for a key; emptied when it holds `limit` keys, so memory is bounded. Keys over `longest` long are not kept."""

    def __init__(self, compute: Callable, limit: int = 400_000, longest: int = 48):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
