"""SimHash fingerprints and their links, by bit-sliced comparison.

Fingerprints within the radius agree in some blocks of bits (pigeonhole), so they are bucketed
by blocks. In a bucket they are stored as bit planes: plane p holds bit p of 64 fingerprints in
each word. A query is compared with 64 of them at once: each plane's differing bits go into
carry-save counters, and words whose 64 counts all exceed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.functions.graph import components
from isospark.llm.common import let_go, map_slices, raw_texts, stage
from isospark.llm.groups import TILE as TEXT_TILE
from isospark.llm.groups import Forest, runs, smallest_ids, verified_components
from isospark.llm.minhash import BANDS, band_words
from isospark.llm.shingles import LIKENESS, mixed, shingle_hashes
from isospark.llm.shingles import SHINGLE as SHINGLE_WORDS

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
TILE = 2048
#: For likeness: 64-bit words of a fingerprint, standard deviations that a distance may be off.
WORDS, WIDTH = 4, 4.5
#: Fingerprints of a tile that are held against all others of it first.
PIVOTS = 8
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB, 0xA0761D6478BD642F], np.uint64)
_ONE = np.uint64(1)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits: each is 1 where it is set in over half of the hashes of the shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    clean = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(clean, SEED)]
    else:
        starts = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
        hashes = [xxhash.xxh64_intdigest(clean[a:b], SEED) for a, b in zip(starts[:-size].tolist(), (starts[size:] - 1).tolist(), strict=True)]
    ones = bit_counts(np.array(hashes, np.uint64)[:, None])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of `rows` (n x words of 64 bits) have each bit; 255 rows are added in bytes."""
    ones = np.zeros(64 * rows.shape[1], np.int64)
    for i in range(0, len(rows), 255):
        ones += np.unpackbits(rows[i : i + 255].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return ones


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row of `docs`. Null, empty and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            found = np.array([fingerprint(t) for t in raw_texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_slices(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class BitPlanes:
    """Fingerprints (n x words of 64 bits) stored vertically, compared 64 at a time; `at` gives each one's lane, by default its number."""

    def __init__(self, fps: np.ndarray, at: np.ndarray | None = None):
        self.n, self.bits = len(fps), 64 * fps.shape[1]
        at = np.arange(self.n) if at is None else at
        words = (int(at.max(initial=-1)) >> 6) + 1
        bits, used = np.zeros((words * 64, self.bits), np.uint8), np.zeros(words * 64, np.uint8)
        bits[at], used[at] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, self.bits // 8), axis=1, bitorder="little"), 1
        lanes = np.packbits(bits.reshape(words, 64, self.bits).transpose(2, 0, 1), axis=2, bitorder="little")
        self.planes = np.ascontiguousarray(lanes).view(np.uint64).reshape(self.bits, words)
        self.valid = np.packbits(used, bitorder="little").view(np.uint64)

    def within(self, queries: np.ndarray, limits: dict[int, int], own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of query, lane of fingerprint) whose distance over the first p planes is at most r for each p: r of `limits`.

        With `own`, the queries are the fingerprints from there on, and only later ones are their partners.
        """
        words = self.planes.shape[1]
        query, word = np.repeat(np.arange(len(queries)), words), np.tile(np.arange(words), len(queries))
        if own is not None:
            later = word >= (query + own + 1) >> 6
            query, word = query[later], word[later]
        q, f = self.compared(queries, query, word, ~self.valid[word], limits)
        return (q, f) if own is None else (q[f > q + own], f[f > q + own])

    def compared(self, queries: np.ndarray, query: np.ndarray, word: np.ndarray, over: np.ndarray, limits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """As `within`, of the given pairs of a query and a word of 64 lanes; lanes that are set in `over` are none."""
        counters = np.zeros((max(limits.values()).bit_length(), len(query)), np.uint64)
        for p in range(self.bits):
            carry = self.planes[p][word] ^ (np.uint64(0) - ((queries[query, p >> 6] >> np.uint64(p & 63)) & _ONE))
            used = (p + 1).bit_length()  # no count is over p + 1
            for c in counters[:used]:
                carry, c[:] = carry & c, carry ^ c
            if used > len(counters):
                over |= carry
            if p + 1 in limits:
                over |= self._above(counters, limits[p + 1])
                alive = over != ~np.uint64(0)
                if not alive.all():
                    query, word, over, counters = query[alive], word[alive], over[alive], counters[:, alive]
                if not len(query):
                    break
        lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        return query[row], word[row] * 64 + lane

    @staticmethod
    def _above(counters: np.ndarray, radius: int) -> np.ndarray:
        """Lanes whose count exceeds `radius`, by comparing bits from the highest."""
        above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
        for bit in reversed(range(len(counters))):
            if radius >> bit & 1:
                equal = equal & counters[bit]
            else:
                above = above | (equal & counters[bit])
                equal = equal & ~counters[bit]
        return above

    def pairs(self, queries: np.ndarray, limits: dict[int, int], own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`within` for blocks of `queries`, so that memory is bounded. With `own`, the queries are the fingerprints and each pair comes once."""
        step = max(1, (1 << 16) // self.planes.shape[1])
        for s in range(0, len(queries), step):
            q, f = self.within(queries[s : s + step], limits, s if own else None)
            yield q + s, f


def exact_limits(radius: int = RADIUS, bits: int = BITS) -> dict[int, int]:
    """A block is abandoned when all its distances exceed `radius`, looked at after every four planes."""
    return dict.fromkeys(range(4, bits + 1, 4), radius)


def bucket_pairs(fps: np.ndarray, cuts: list[tuple[int, int]], limits: dict[int, int], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within `limits` in each of many small buckets, rows of `fps` from cut to cut, 64 at most: each bucket is one word of lanes, so all go through the planes together."""
    step = max(1, most // 8)
    for s in range(0, len(cuts), step):
        some = cuts[s : s + step]
        sizes = np.array([b - a for a, b in some])
        rows = np.concatenate([np.arange(a, b) for a, b in some])
        word = np.repeat(np.arange(len(some)), sizes)
        lane = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        planes = BitPlanes(fps[rows], word * 64 + lane)
        # only later lanes of the bucket are partners
        before = np.where(lane < 63, (_ONE << np.minimum(lane + 1, 63).astype(np.uint64)) - _ONE, ~np.uint64(0))
        q, f = planes.compared(fps[rows], np.arange(len(rows)), word, ~planes.valid[word] | before, limits)
        of_lane = np.full(len(some) * 64, -1)
        of_lane[word * 64 + lane] = rows
        yield rows[q], of_lane[f]


def spanning_links(left: np.ndarray, right: np.ndarray | None, limits: dict[int, int]) -> list[tuple[int, int]]:
    """Links that connect what is within `limits`: of `left` alone, or from `left` to `right`, as indices of both one after the other.

    At most one link for each fingerprint but one, instead of all pairs. A few fingerprints are
    held against all first. What they connect most of needs no pair of its own: each other pair
    has an end outside, and only those ends are compared with the rest.
    """
    all_ = left if right is None else np.concatenate([left, right])
    planes, forest, out = BitPlanes(all_), Forest(len(all_)), []

    def link(of: np.ndarray, against: BitPlanes, at: np.ndarray) -> None:
        for q, f in against.pairs(all_[of], limits):
            for a, b in forest.apart(of[q], at[f]):
                if forest.join(a, b):
                    out.append((a, b))

    every, waiting = np.arange(len(all_)), np.arange(len(all_))
    for _ in range(PIVOTS):
        if len(waiting) < 2:
            break
        pivot = waiting[:1]
        link(pivot, planes, every)
        waiting = waiting[forest.roots()[waiting] != forest.find(int(pivot[0]))]
    roots = forest.roots()
    rest = every[roots != np.bincount(roots, minlength=1).argmax()] if len(every) else every
    if right is None:
        link(rest, planes, every)
    elif len(rest):
        n = len(left)
        link(rest[rest < n], BitPlanes(right), every[n:])
        link(rest[rest >= n], BitPlanes(left), every[:n])
    return out


def block_masks(n: int, radius: int = RADIUS) -> list[list[int]]:
    """Bit masks of which two fingerprints within `radius` agree in at least one.

    The bits are cut into radius + k blocks; k of them are untouched by `radius` differences.
    k grows with `n`, so that masks have enough bits to keep buckets small.
    """
    k = 1 if n < 1 << 20 else 2 if n < 1 << 27 else 3
    edges = [BITS * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [[sum(x)] for x in combinations(blocks, k)]


def links(nodes: DataFrame, masks: list[list[int]], limits: dict[int, int], tile: int = TILE) -> DataFrame:
    """(a, b) that connect all of `nodes` (node long, fp array<long>) whose distance is within `limits` and that agree in one of `masks`."""
    signed = [[m - (1 << 64) if m >> 63 else m for m in mask] for mask in masks]
    words = len(signed[0])
    table = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(m).alias(f"m{w}") for w, m in enumerate(mask)]) for i, mask in enumerate(signed)])
    keys = F.transform(table, lambda m: F.xxhash64(m["i"], *[F.get("fp", F.lit(w)).bitwiseAND(m[f"m{w}"]) for w in range(words)]))
    return bucket_links(nodes.select("node", F.explode(keys).alias("key")), nodes, words, limits, tile)


def bucket_links(keyed: DataFrame, nodes: DataFrame, words: int, limits: dict[int, int], tile: int = TILE) -> DataFrame:
    """(a, b) that connect all of `nodes` (node long, fp array<long> of `words`) whose distance is within `limits` and that have a key of `keyed` (node, key) in common.

    Keys are counted first, and only nodes with a shared one get their fingerprints beside it.
    Buckets over `tile` are cut into tiles, and each pair of tiles is a task's own work: a tile
    goes to as many pairs as its bucket has tiles, so no task holds more than two tiles.
    """
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("int").alias("t")))
    # a shuffle of its own, not the aggregation's, so that the skew join can split a bucket
    placed = keyed.hint("merge").join(shared, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
    paired = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).join(nodes.select("node", "fp"), "node")
    sorted_ = paired.select("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), (F.col("i") > F.col("j")).cast("int").alias("side"), "node", "fp")
    # by number, so that few bytes, which are much work, are not put together in few tasks
    sorted_ = sorted_.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for rows, cuts in runs(batches, 3):
            side, node, low, high = (rows[c].to_numpy() for c in ("side", "node", "low", "high"))
            fps = rows["fp"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(node), words)
            found: list[tuple[int, int]] = []
            small = [(a, b) for a, b in cuts if 1 < b - a <= 64 and low[a] == high[a]]
            forest = Forest(len(node))
            for i, j in (pair for some in bucket_pairs(fps, small, limits) for pair in zip(*map(np.ndarray.tolist, some), strict=True)):
                if forest.join(i, j):
                    found.append((i, j))
            for start, end in set(cuts).difference(small):
                at = np.arange(start, end)
                if low[start] == high[start]:
                    left, right = at, at[:0]
                else:
                    left, right = at[side[at] == 0], at[side[at] == 1]
                if len(at) > 1 and len(left) and (len(right) or low[start] == high[start]):
                    order = np.concatenate([left, right])
                    found += [(order[x], order[y]) for x, y in spanning_links(fps[left], fps[right] if len(right) else None, limits)]
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[ends[:, k]]) for k in (0, 1)], names=["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of each row of `docs`.

    component_id is the smallest id that links of at most `radius` differing bits reach, itself
    included. Copies share a fingerprint and are one node, whatever their number. Blank and null
    texts have fingerprint zero, which links like any other. Rows with a null id keep their
    place and have their component's smallest id, which is null where all its ids are. Repeated
    rows and rows of one id stay each for itself; texts of any length are read whole; an empty
    table gives an empty one; other columns are not read.
    """
    known = stage(fingerprints(docs, id_col, text_col)).withColumnRenamed("fp", "node")
    nodes = stage(known.select("node").distinct())
    found = components(links(nodes.withColumn("fp", F.array("node")), block_masks(nodes.count(), radius), exact_limits(radius)))
    labels = smallest_ids(known, found)
    return known.join(labels, "node").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS x 64 bits of a set of shingle hashes: each is 1 where it is set in over half of them. Zero for none."""
    hashes, ones = np.unique(hashes), np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += bit_counts(mixed(hashes[i : i + (1 << 14), None] + _FACTORS, _FACTORS))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def flip_chance(threshold: float) -> float:
    """The chance that a bit differs for sets of equal size and Jaccard likeness `threshold`: their angle by a half turn."""
    return float(np.arccos(2 * threshold / (1 + threshold)) / np.pi)


def likeness_limits(threshold: float, width: float = WIDTH) -> dict[int, int]:
    """How far two fingerprints may differ after so many planes: what likeness `threshold` gives, and `width` standard deviations more."""
    q = flip_chance(threshold)
    return {p: int(q * p + width * np.sqrt(q * (1 - q) * p)) for p in range(32, 64 * WORDS + 1, 16)}


def near_texts(texts: DataFrame, threshold: float = LIKENESS, size: int = SHINGLE_WORDS, tile: int = TEXT_TILE) -> DataFrame:
    """(node, component) of each row of `texts` (node long, each once, text): texts whose sets of `size`-word shingles have a Jaccard likeness of `threshold` or more are linked.

    MinHash bands give the buckets, BANDS rows of a text at any number of texts: two texts at
    the threshold of 0.8 have none in common once in 5,000. In a bucket, fingerprints of WORDS x
    64 bits, as many SimHashes with own seeds, are compared by bit planes, abandoned where a
    distance is beyond what the likeness explains. What is left is verified on the shingle
    sets, so no unlike texts are linked. Null, empty and blank texts have no shingles and are
    like each other. Any length is read whole; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            hashes = [shingle_hashes(t, size) for t in raw_texts(batch.column(1))]
            found = np.array([wide_fingerprint(h) for h in hashes], np.uint64).reshape(-1, WORDS)
            bands = np.array([band_words(h) for h in hashes], np.uint64).reshape(-1, BANDS)
            keys = mixed(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTORS[0])
            fp, key = (pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (found, keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, key, pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "fp", "keys", "mark"])

    limits = likeness_limits(threshold)

    def candidates(marks: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        other = left if right is None else right
        if len(left) * len(other) <= 64:  # few pairs are verified as they are
            i, j = np.nonzero(np.triu(np.ones((len(left), len(left)), bool), 1) if right is None else np.ones((len(left), len(other)), bool))
            yield left[i], other[j]
            return
        for q, f in BitPlanes(marks[other]).pairs(marks[left], limits, right is None):
            yield left[q], other[f]

    prints = stage(map_slices(texts.select("node", "text"), run, "node long, fp array<long>, keys array<long>, mark binary"))
    near = stage(bucket_links(prints.select("node", F.explode("keys").alias("key")), prints, WORDS, limits))
    found = verified_components(prints.select("node", "mark"), texts, near, candidates, threshold, size, tile)
    return prints.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
