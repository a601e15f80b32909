"""Candidate links become groups, and the texts of a group are held against each other exactly.

Candidates only connect: a spanning forest of them is enough, whatever the number of pairs. The
texts of a group then go out in tiles of bounded size, each once for a pair of tiles and not for
a pair of texts. Large groups are first held against one tile; who that links is through, and
only the others go on to all tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.functions.graph import Forest, components
from isospark.llm.common import discard, let_go, stage
from isospark.llm.shingles import LIKENESS, SHINGLE, jaccard, shingle_hashes

#: Texts and MB of a tile, about.
TILE, TILE_MB = 1024, 8


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Sorted batches as tables of whole runs of equal values of the first `keys` columns (integers without nulls), with where each run begins and ends."""
    carried: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([carried, rows]).combine_chunks() if carried is not None else rows
        change = np.zeros(rows.num_rows - 1, bool)
        for k in range(keys):
            c = rows.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        if cuts[-1]:
            yield rows.slice(0, cuts[-1]), list(zip(cuts, cuts[1:], strict=False))
        carried = rows.slice(cuts[-1])
    if carried is not None:
        yield carried, [(0, carried.num_rows)]


def tile_links(texts: list[bytes], left: np.ndarray, right: np.ndarray | None, labels: np.ndarray, pairs: Callable[[np.ndarray, np.ndarray | None], Iterator[tuple[np.ndarray, np.ndarray]]], threshold: float, size: int) -> list[tuple[int, int]]:
    """Verified links between the texts at `left` and those at `right` (None: among the former), at most one for each text: pairs that links or `labels` connect already are passed over."""
    forest, first, known = Forest(len(texts)), {}, {}
    for i, label in enumerate(labels.tolist()):
        forest.join(first.setdefault(label, i), i)

    def own(i: int) -> np.ndarray:
        if i not in known:
            known[i] = np.unique(shingle_hashes(texts[i], size))
        return known[i]

    out = []
    for i, j in (pair for some in pairs(left, right) for pair in forest.apart(*some)):
        if forest.find(i) != forest.find(j) and jaccard(own(i), own(j), threshold) >= threshold:
            forest.join(i, j)
            out.append((i, j))
    return out


def _linked(tiles: DataFrame, keys: list[str], candidates: Callable, threshold: float, size: int) -> DataFrame:
    """(a, b) of verified links in each tile pair of `tiles` (keys, side, node, label, mark, text)."""
    # by number, so that few MB of texts, which are much work, are not put together in few tasks
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = tiles.repartition(parts, *keys).sortWithinPartitions(*keys).select(*keys, "side", "node", "label", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for table, cuts in runs(batches, len(keys)):
            side, nodes, labels = (table[c].to_numpy() for c in ("side", "node", "label"))
            found = []
            for start, end in cuts:
                at = side[start:end]
                left, right = np.flatnonzero(at == 0), np.flatnonzero(at == 1)
                if end - start < 2 or not len(left):
                    continue
                rows = table.slice(start, end - start)
                texts = [t or b"" for t in rows["text"].cast(pa.binary()).to_pylist()]
                marks = np.frombuffer(b"".join(rows["mark"].to_pylist()), np.uint64).reshape(end - start, -1)
                pairs = lambda a, b: candidates(marks, a, b)  # noqa: B023, E731
                found += [(nodes[start + i], nodes[start + j]) for i, j in tile_links(texts, left, right if len(right) else None, labels[start:end], pairs, threshold, size)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([f[k] for f in found], np.int64)) for k in (0, 1)], names=["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long")


def verified_components(marks: DataFrame, texts: DataFrame, links: DataFrame, candidates: Callable, threshold: float = LIKENESS, size: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(node, component) of the nodes that verified links connect to another one, by the smallest node of each component.

    `marks` (node long, mark binary of whole 64-bit words) and `texts` (node, text) have each node
    once; `links` (a, b) connects all candidates. `candidates(marks, left, right)` gives the
    candidate pairs among the rows of a tile pair (or of one tile, `right` being None) as arrays; a
    link has sets of `size`-word shingles of Jaccard likeness `threshold` or more. Each candidate
    pair is compared, or links connect it already.
    """
    groups = stage(components(links))
    own = stage(groups.join(marks, "node").join(texts, "node").select("node", F.col("component").alias("group"), "mark", "text"))
    sizes = own.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("m"))
    tiles = F.ceil(F.greatest(F.col("n") / tile, F.coalesce("m", F.lit(0)) / (TILE_MB << 20))).cast("int")
    # few groups are larger than a tile: most often none
    large = stage(sizes.select("group", tiles.alias("tiles")).where("tiles > 1"))
    members = own.join(large, "group", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    lists = F.when(F.col("i") == 0, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("i"))
    against_first = members.withColumn("j", F.explode(lists)).withColumn("side", F.when(F.col("i") == 0, 0).otherwise(1)).withColumn("label", F.col("node"))
    # beside another tile, the first one is compared with that alone
    links = stage(_linked(against_first, ["group", "j"], candidates, threshold, size))
    if large.isEmpty():
        discard(own)
        return components(links)

    reached = stage(components(links)).withColumnRenamed("component", "label")
    labelled = stage(members.where("tiles > 1").join(reached, "node", "left").withColumn("label", F.coalesce("label", "node")))
    counts = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("all"), F.max("n").alias("most"))
    # groups that one label does not cover; the first tile has met all others
    open_ = stage(main.where("labels > 1").select("group", "main", F.ceil((F.col("all") - F.col("most")) / tile).cast("int").alias("rests")))
    left = labelled.where("i > 0").join(open_, "group")
    rest = left.where("label != main").withColumn("r", F.pmod(F.xxhash64("node"), F.col("rests")).cast("int"))
    rest_side = rest.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("tiles") - 1))).withColumn("side", F.lit(0))
    all_side = left.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("j", F.col("i")).withColumn("side", F.lit(1))
    names = ["group", "r", "j", "side", "node", "label", "mark", "text"]
    more = stage(_linked(rest_side.select(*names).unionByName(all_side.select(*names)), ["group", "r", "j"], candidates, threshold, size))
    discard(own)
    discard(labelled)
    return components(links.unionByName(more))


def smallest_ids(known: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component_id) of the nodes of `known` (id, node): the smallest id of each component of `found` (node, component), and of each node in none.

    The ids of a component are a written table, joined by a shuffle of its own, so that a
    component that very many nodes have is split by the skew join.
    """
    nodes = stage(known.groupBy("node").agg(F.min("id").alias("first")))
    roots = stage(nodes.join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    least = stage(roots.groupBy("component").agg(F.min("first").alias("component_id")))
    return stage(roots.hint("merge").join(least, "component").select("node", "component_id"))
