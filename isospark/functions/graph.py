"""Connected components of a link table, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.functions.staging import stage

#: Links up to which a node that all of them meet at is little work for one task; links that one task may join in memory.
FEW, SOLVED = 10_000, 50_000


class Forest:
    """Sets that are joined; the smallest member stands for each."""

    def __init__(self, size: int):
        self.root = list(range(size))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were in two sets."""
        x, y = self.find(i), self.find(j)
        self.root[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        """Who stands for each member."""
        root = np.array(self.root, np.int64)
        while (root[root] != root).any():
            root = root[root]
        return root

    def grow(self, n: int) -> np.ndarray:
        """n more members, larger than all; their numbers."""
        size = len(self.root)
        self.root += range(size, size + n)
        return np.arange(size, size + n)

    def shrink(self, size: int) -> None:
        """Forget the members from `size` on; no smaller one is lost, as the smallest stands for its set."""
        self.root = self.roots()[:size].tolist()

    def apart(self, left: np.ndarray, right: np.ndarray, step: int = 4096) -> Iterator[tuple[int, int]]:
        """The pairs that are in two sets when their turn comes, about: looked up `step` at a time, as joins go on."""
        for s in range(0, len(left), step):
            root = self.roots()
            a, b = left[s : s + step], right[s : s + step]
            open_ = root[a] != root[b]
            yield from zip(a[open_].tolist(), b[open_].tolist(), strict=True)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars around the smallest node of each of their sets: they connect the same nodes, and are no more."""
    both = [pa.Table.from_batches([x]) for x in batches]
    if both:
        table = pa.concat_tables(both)
        ends = np.stack([table.column(i).to_numpy() for i in (0, 1)]) if table.num_rows else np.empty((2, 0), np.int64)
        nodes, places = np.unique(ends, return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in zip(*places.reshape(2, -1).tolist(), strict=True):
            forest.join(i, j)
        roots = forest.roots()
        own = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[roots[own]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of `links` (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each a written table, until
    the links are stars around their smallest nodes. A node's links are aggregated to a minimum
    before they are joined, so no group is gathered in a task. Up to SOLVED links, which a task
    holds in a few MB, are made stars in one.
    """

    def star(both: DataFrame, many: bool) -> DataFrame:
        """Links (u, v) become (v, m): m is the smallest of u and its neighbours.

        Of many links, the minima are a written table, joined by a shuffle of its own, so that
        the skew join can split a node that very many others link to.
        """
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return (both.hint("merge").join(stage(low), "u") if many else both.join(low, "u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")

    def fingerprint(table: DataFrame) -> tuple:
        """Number and two hashes of the links: equal for equal tables, without a shuffle."""
        return tuple(table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())

    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    last = fingerprint(edges)
    while last[0] > SOLVED:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, last[0] > FEW).where("a > b")
        # large-star keeps a node's link to the minimum only for larger neighbours; the node's own link comes with it
        own = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
        joined = stage(large.unionByName(own).distinct())
        down = joined.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = star(down.unionByName(down.select("u", F.col("u").alias("v"))), last[0] > FEW).where("a > b")
        after = stage(small.distinct())
        edges, print_ = after, fingerprint(after)
        if print_ == last:
            break
        last = print_
    if last[0] <= SOLVED:
        edges = stage(edges.coalesce(1).mapInArrow(_stars, "a long, b long"))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
