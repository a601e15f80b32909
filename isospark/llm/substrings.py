"""Removal of repeated passages, found by difference-cover anchors.

A difference cover D modulo v has, for any two positions, an offset below v that takes both to
positions whose remainders are in D. So two equal windows of `window` words share an anchor, a
run of window - v + 1 words that begins at a cover position in both documents. Only anchors
are hashed at first, a fifth of all positions; where an anchor is in two documents, the match
is extended: all windows around it are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.llm.common import let_go, map_slices, raw_texts, stage

WINDOW = 50
#: Rows and MB of texts that a task handles at a time: each word has hashes of its own for that while.
SLICE = (128, 4)
#: A perfect difference set: each remainder modulo 31 but 0 is the difference of just one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def _slices(words: list[bytes], size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, and where the runs of `size` words begin and end in that."""
    clean = b" ".join(words)
    starts = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
    return clean, starts[:-size], starts[size:] - 1


def words_table(rows: DataFrame, window: int) -> DataFrame:
    """(id, key, whole, n_words, sha) of each row (id, key, text); `whole` is 128 bits of the word sequence, null below `window` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            whole, n, sha = [], [], []
            for text in raw_texts(batch.column(2)):
                words = text.split()
                clean = b" ".join(words)
                whole.append(xxhash.xxh3_128_digest(clean) if len(words) >= window else None)
                n.append(len(words))
                sha.append(hashlib.sha256(clean).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.binary()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["id", "key", "whole", "n_words", "sha"])

    return map_slices(rows, run, f"id {_kind(rows)}, key long, whole binary, n_words long, sha string", *SLICE)


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, id, at) of the runs at cover positions of each row (id, text)."""
    size = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            hashes, places, rows = [], [], []
            for i, text in enumerate(raw_texts(batch.column(1))):
                words = text.split()
                if len(words) < window:
                    continue
                clean, starts, ends = _slices(words, size)
                at = np.flatnonzero(np.isin(np.arange(len(starts)) % PERIOD, COVER))
                hashes += [xxhash.xxh3_64_intdigest(clean[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                places.append(at)
                rows.append(np.full(len(at), i))
            where = pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64))
            at = pa.array(np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), batch.column(0).take(where), at], names=["anchor", "id", "at"])

    return map_slices(docs, run, f"anchor long, id {_kind(docs)}, at int", *SLICE)


def windows(found: DataFrame, window: int) -> DataFrame:
    """(w1, w2, id, key, at) of the windows of `found` (id, key, text, ats) that hold a shared anchor."""
    size = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            data, rows, places = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, (text, ats) in enumerate(zip(raw_texts(batch.column(2)), batch.column(3), strict=True)):
                words = text.split()
                if len(words) < window:
                    continue
                clean, starts, ends = _slices(words, window)
                ats = ats.values.to_numpy(zero_copy_only=False).astype(np.int64)
                marks = np.zeros(len(starts) + 1, np.int64)
                first, last = np.maximum(ats + size - window, 0), np.minimum(ats, len(starts) - 1)
                fits = first <= last
                np.add.at(marks, first[fits], 1)
                np.add.at(marks, last[fits] + 1, -1)
                at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                data += [xxhash.xxh3_128_digest(clean[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                places.append(at)
                rows.append(np.full(len(at), i))
            keys = np.frombuffer(b"".join(data), np.int64).reshape(-1, 2)
            where = pa.array(np.concatenate(rows).astype(np.int64))
            at = pa.array(np.concatenate(places).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), batch.column(0).take(where), batch.column(1).take(where), at], names=["w1", "w2", "id", "key", "at"])

    return map_slices(found, run, f"w1 long, w2 long, id {_kind(found)}, key long, at int", *SLICE)


def trimmed(found: DataFrame, window: int) -> DataFrame:
    """(id, key, n_removed, kept) of `found` (id, key, text, ats): windows that begin at `ats` go, `kept` are the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            removed, kept = [], []
            for text, ats in zip(raw_texts(batch.column(2)), batch.column(3), strict=True):
                words = text.split()
                marks = np.zeros(len(words) + 1, np.int64)
                ats = ats.values.to_numpy(zero_copy_only=False)
                np.add.at(marks, ats, 1)
                np.add.at(marks, ats + window, -1)
                gone = np.cumsum(marks[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "key", "n_removed", "kept"])

    return map_slices(found, run, f"id {_kind(found)}, key long, n_removed long, kept string", *SLICE)


def _owners(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, owner) of the keys that several ids of `rows` have, owner being the smallest.

    A written table: joined back by a shuffle of its own, a key that very many rows have is
    split by the skew join, which it isn't where the aggregation's shuffle serves the join too.
    """
    ids = rows.groupBy(*keys).agg(F.min("id").alias("owner"), F.max("id").alias("last"))
    return stage(ids.where("owner < last").drop("last"))


def removals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What goes from `docs`, as two tables.

    The first has each row: (id, key, n_words, sha, copy). `key` is xxhash64 of the text, `sha`
    that of all its words; of a `copy`, all words go, as a smaller id has the same ones. The
    second has the other rows that lose words: (id, key, n_removed, kept); rows that are the
    same in id and text may be there more than once.

    A word goes if a window of `window` words over it also begins in a document with a smaller
    id. Texts below `window` words, null and empty ones and rows with a null id lose nothing.
    Rows with one id are not smaller than each other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    base = stage(words_table(rows, window))
    owners = _owners(base.where("whole is not null and id is not null"), ["whole"])
    marked = stage(base.hint("merge").join(owners, "whole", "left").select("id", "key", "n_words", "sha", F.coalesce(F.col("id") > F.col("owner"), F.lit(False)).alias("copy")))

    texts = rows.where("id is not null")
    places = anchors(texts.select("id", "text"), window)
    shared = _owners(places, ["anchor"]).select("anchor")
    # written before texts are shuffled, and so are the windows below: the hashes' shuffles are gone by then
    ats = stage(places.hint("merge").join(shared, "anchor").groupBy("id").agg(F.collect_set("at").alias("ats")))
    # a copy adds no window that its owner, which is smaller, doesn't have
    only_copies = marked.groupBy("id").agg(F.min("copy").alias("copy")).where("copy").select("id")
    found = stage(texts.join(ats.join(only_copies, "id", "left_anti"), "id"))

    spans = windows(found, window)
    owned = _owners(spans, ["w1", "w2"])
    gone = stage(spans.hint("merge").join(owned, ["w1", "w2"]).where("owner < id").groupBy("id", "key").agg(F.collect_set("at").alias("ats")))
    lost = trimmed(found.drop("ats").join(gone, ["id", "key"]).select("id", "key", "text", "ats"), window)
    return marked, lost


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row of `docs`; see `removals`.

    Null and empty texts have no words; rows with a null id lose nothing; repeated rows stay
    each for itself, as do rows of one id; texts of any length are read whole; an empty table
    gives an empty one; other columns are not read.
    """
    marked, lost = removals(docs, window, id_col, text_col)
    lost = lost.select("id", "key", "n_removed", F.sha2("kept", 256).alias("kept_sha")).dropDuplicates(["id", "key"])
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed")
    kept = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256")
    return marked.join(lost, ["id", "key"], "left").select(F.col("id").alias(id_col), "n_words", removed, kept)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the same rows and columns, the texts that lose words being the words left, joined by one space.

    Other texts, null and empty ones too, stay as they are. Rows with a null id lose nothing.
    Texts of any length are read whole; an empty table gives an empty one; other columns keep
    their values, whatever their names.
    """
    marked, lost = removals(docs, window, id_col, text_col)
    copies = marked.where("copy").select("id", "key", F.lit("").alias("kept"))
    new = lost.select("id", "key", "kept").unionByName(copies).dropDuplicates(["id", "key"])
    new = new.select(F.struct("id", "key").alias("_k"), F.col("kept").alias("_kept"))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    text = F.coalesce(F.col("_new._kept"), F.col(f"_old.`{text_col}`"))
    joined = docs.alias("_old").join(new.alias("_new"), key == F.col("_new._k"), "left")
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"_old.`{c}`") for c in docs.columns])
