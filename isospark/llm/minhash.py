"""MinHash fingerprints: universal hash permutations over word shingles, in numpy.

A fingerprint has SLOTS minima, 16 bits of each. The share of equal slots estimates the Jaccard
likeness of the shingle sets. Bands of slots are joined in Spark to find near-duplicates, and
their likeness is verified on the shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.llm.common import let_go, map_slices, raw_texts, stage, texts_of
from isospark.llm.groups import TILE, smallest_ids, verified_components
from isospark.llm.shingles import LIKENESS, shingle_hashes

SLOTS, BANDS = 64, 16
_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_SHIFT = np.uint64(32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS minima, 16 bits of each; all ones for no shingles."""
    low = np.full(SLOTS, np.iinfo(np.uint32).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, ((_A[:, None] * hashes[None, i : i + 2048] + _B[:, None]) >> _SHIFT).min(axis=1))
    return low.astype(np.uint16)


def band_words(hashes: np.ndarray) -> np.ndarray:
    """The BANDS bands of the signature, each as one 64-bit word."""
    return signature(hashes).view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def edited(text: str, after: str) -> str:
    """`text` with its last third (rounded down) replaced by as much of the beginning of `after`."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row of `docs`: 4 hex digits a slot. Null, empty and blank texts have no shingles and one fingerprint, all f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(signature(shingle_hashes(t))) for t in raw_texts(batch.column(1))], pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_slices(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _sharing_bands(marks: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that have a band in common, of `left` and `right` or of `left` alone; a row of `marks` is a signature, a band a word."""
    for s in range(0, len(left), 64):
        some, other = left[s : s + 64], left[s + 1 :] if right is None else right
        x, y = np.nonzero((marks[some][:, None, :] == marks[other][None, :, :]).any(axis=2))
        yield some[x], other[y]


def near_texts(texts: DataFrame, prints: DataFrame, threshold: float = LIKENESS, tile: int = TILE) -> DataFrame:
    """(node, component) of the texts that verified links connect to another one.

    `texts` (node long, text) has each node once, `prints` (node, mark binary) its signature.
    Texts that share a band of their signatures are candidates, each linked to the smallest one
    of the band's bucket; links are verified on the shingle sets. With 16 bands, two texts of
    likeness 0.8 miss all buckets once in 5,000.
    """
    width = 2 * SLOTS // BANDS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.expr("mark").substr(b * width + 1, F.lit(width))))
    banded = prints.select("node", F.explode(keys).alias("key"))
    # a written table, joined by a shuffle of its own, so that the skew join can split a bucket
    least = stage(banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("key", "a"))
    near = banded.hint("merge").join(least, "key").where("node > a").select("a", F.col("node").alias("b")).distinct()
    return verified_components(prints, texts, near, _sharing_bands, threshold, tile=tile)


def near_duplicates(docs: DataFrame, threshold: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(id, component_id) of each row: the smallest id that verified links reach.

    A link is a pair of texts that share a band and whose sets of five-word shingles have a
    Jaccard likeness of `threshold` or more. Equal texts are one. Null texts are empty ones, and
    texts without words are like each other. Rows with a null id have their component's smallest
    id, null where it has none. Texts of any length are read whole; an empty table gives an
    empty one; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("node"))
    texts = stage(rows.groupBy("node").agg(F.first("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(shingle_hashes(t)).tobytes() for t in raw_texts(batch.column(1))], pa.binary())], names=["node", "mark"])

    prints = stage(map_slices(texts, run, "node long, mark binary"))
    known = rows.select("id", "node")
    return known.join(smallest_ids(known, near_texts(texts, prints, threshold, tile)), "node").select(F.col("id").alias(id_col), "component_id")


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, after: str, own: np.ndarray, following: np.ndarray) -> tuple:
    new = edited(text, after).encode()
    sig = signature(shingle_hashes(new))
    return len(text), hashlib.sha256(new).hexdigest(), written(own), written(sig), likeness(own, sig), likeness(own, following)


def compared_to_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, beside those of its edited text and of the next row.

    The next row has the next smaller id, or the same one; the last one's is the first row. Rows
    with one id follow each other by a hash of their texts; null ids come last. A single row is
    its own next. Texts are dealt out by ranges of ids once; a range's first and last texts are
    written aside, and joined with their neighbours' afterwards: two texts of a range, however
    many rows it has. Null texts are empty ones; texts of any length are read whole; an empty
    table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("key"), F.monotonically_increasing_id().alias("place"))
    # rows alike in id and text are each other's next, in whatever order: their places let a range end among them
    order = [F.desc_nulls_last("id"), F.asc("key"), F.asc("place")]
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        part, last, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids, out = batch.column(0), []
            left = ids.slice(0, 0) if last is None else last[2]
            for text in texts_of(batch.column(1)):
                sig = signature(shingle_hashes(text.encode()))
                first = text if first is None else first
                if last is not None:
                    out.append((*_compared(last[0], text, last[1], sig), None, None, None))
                last = (text, sig, ids.slice(len(ids) - 1, 1))
            if out:
                yield _batch(pa.concat_arrays([left, ids])[: len(out)], out)
        if last is not None:
            yield _batch(last[2], [(None, None, None, None, None, None, part, last[0], first)])

    def _batch(ids: pa.Array, values: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        columns = list(zip(*values, strict=True))
        names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "last_text", "first_text"]
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", *names])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    made = stage(map_slices(ranged, run, f"id {kind}, {_RESULT}, part int, last_text string, first_text string", 256))
    ends = made.where("part is not null").select("id", "part", "last_text", "first_text")
    # numbers of the range shuffle's partitions that have rows, without texts: each one's next, the last one's is the first
    parts = sorted(r["part"] for r in ends.select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = ends.select(F.col("part").alias("next"), F.col("first_text").alias("after"))
    linked = ends.select("id", "part", "last_text").join(F.broadcast(after), "part").join(heads, "next").select("id", "last_text", "after")

    names = [x.split()[0] for x in _RESULT.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out = []
            for text, after in zip(texts_of(batch.column(1)), texts_of(batch.column(2)), strict=True):
                own, following = (signature(shingle_hashes(t.encode())) for t in (text, after))
                out.append((*_compared(text, after, own, following), None, None, None))
            if out:
                yield _batch(batch.column(0), out).select(["id", *names])

    joints = map_slices(linked, finish, f"id {kind}, {_RESULT}", 64)
    return made.where("part is null").select("id", *names).unionByName(joints).select(F.col("id").alias(id_col), *names)
