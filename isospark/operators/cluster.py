"""Scaling and density clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isospark.functions.graph import components
from isospark.functions.staging import free_names, stage
from isospark.operators.neighbours import core_by_leaves, leaves, reach_by_leaves
from isospark.sources.ingest import numbered

#: Parts of a cell by each column, when two cells are compared.
CUTS = 4
#: Columns up to which points are joined by grid cells.
GRID = 3


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """`df` with each of `cols` less its mean, by its population standard deviation (1 where that is 0)."""
    means, spreads = (free_names(df.columns, *[f"_{x}_{c}" for c in cols]) for x in "ms")
    stats = df.agg(*[x for c, m, s in zip(cols, means, spreads, strict=True) for x in (F.avg(c).alias(m), F.stddev_pop(c).alias(s))])
    joined = df.join(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(m)) / F.when(F.col(s) == 0, 1.0).otherwise(F.col(s)) for c, m, s in zip(cols, means, spreads, strict=True)}
    return joined.withColumns(scaled).select(*df.columns)


def dbscan(df: DataFrame, id_col: str, cols: list[str], eps: float = 0.75, min_samples: int = 5, dense: bool = True) -> DataFrame:
    """`df` with `cluster`: DBSCAN by Euclidean distance, -1 for noise.

    Clusters are numbered by their first core row; a border row takes the lowest number among
    its core neighbours. Equal points are one weighted point, and rows find their label by
    their point, so repeated ids are as good as others. Rows with a null or NaN in `cols` are
    noise. Of rows with one id, the one with the smaller values comes first. An empty table
    gives an empty one; other columns are kept, whatever their names.

    Up to three columns, points are joined by grid cells, so small that points of one are
    neighbours: a cell of `min_samples` rows is all core and one cluster without a pair of its
    points, and two such cells are compared by the bounds of their parts (`cell_links`). With
    `dense` off all neighbours are counted. Beyond three columns, space is halved until a part
    has few points, and each part gets copies of what is within `eps` of it (`neighbours`).
    All ways give the same result.
    """
    z, number = free_names([*df.columns, "cluster"], "_z", "_number")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])
    rows = df.withColumn(z, F.when(known, F.array(*[F.col(c).cast("double") + 0.0 for c in cols])))
    different = rows.where(F.col(z).isNotNull()).groupBy(F.col(z).alias("z")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    # p numbers the points by their smallest ids, and by themselves where those are equal
    points = numbered(different.select(F.struct("id", "z").alias("key"), "z", "n"), "key", "p").drop("key")
    if len(cols) <= GRID:
        points = stage(points)
        core, reach, links = _by_cells(points, len(cols), eps, min_samples, dense)
    else:
        dealt = leaves(stage(points), len(cols), eps)
        core = stage(core_by_leaves(dealt, eps, min_samples))
        found = stage(reach_by_leaves(dealt, core, eps))
        reach, links = found.where("not core").select(F.col("a").alias("p"), F.col("b").alias("o")), found.where("core").select("a", "b")
        points = dealt.where("own")
    found = components(links)
    roots = stage(core.join(found, F.col("p") == F.col("node"), "left").select("p", F.coalesce("component", "p").alias("root")))
    numbered_roots = numbered(roots.select("root").distinct(), "root", "number")
    labelled = stage(roots.join(numbered_roots, "root").select(F.col("p").alias("o"), "number"))
    # the core neighbours of a core point are all of its own cluster, so the minimum is right for core and border points alike
    border = reach.join(labelled, "o").select("p", "number").unionByName(labelled.select(F.col("o").alias("p"), "number"))
    labels = points.select(F.col("z").alias(z), "p").join(border.groupBy("p").agg(F.min("number").alias(number)), "p").drop("p")
    return rows.join(labels, z, "left").select(*df.columns, F.coalesce(number, F.lit(-1)).cast("int").alias("cluster"))


def _near_shifts(k: int, width: float, eps: float) -> list[tuple[int, ...]]:
    """Steps from a cell to those that a point within `eps` may be in."""
    far = math.ceil(eps / width)
    return [s for s in product(range(-far, far + 1), repeat=k) if sum(max(abs(x) - 1, 0) ** 2 for x in s) * width**2 <= eps**2]


def _squared(x: str, y: str, k: int) -> Column:
    return sum(((F.element_at(x, i + 1) - F.element_at(y, i + 1)) ** 2 for i in range(1, k)), (F.element_at(x, 1) - F.element_at(y, 1)) ** 2)


def _by_cells(points: DataFrame, k: int, eps: float, min_samples: int, dense: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core (p), reach (p, o), links (a, b)) of `points` (p, z, n): core points, core neighbours of points outside full cells, and links that connect core points."""
    # a little less than eps by the diagonal, so that rounding leaves no two points of a cell apart
    width = eps / k**0.5 * (1 - 1e-9) if dense else eps
    near_cells = F.array(*[F.array(*[F.get("cell", F.lit(i)) + x for i, x in enumerate(s)]) for s in _near_shifts(k, width, eps)])
    points = points.withColumn("cell", F.array(*[F.floor(F.element_at("z", i + 1) / width) for i in range(k)]))
    cells = stage(points.groupBy("cell").agg(F.sum("n").alias("m"), F.min("p").alias("rep")).withColumn("full", (F.col("m") >= min_samples) & F.lit(dense)))
    points = stage(points.join(cells.select("cell", "rep", "full"), "cell"))
    others = points.select(F.col("p").alias("o"), F.col("z").alias("oz"), F.col("n").alias("on"), F.col("full").alias("ofull"), F.col("cell").alias("at"))
    # a cell that isn't full has under min_samples points, so this is linear in the points
    near = stage(points.where("not full").select("p", "z", F.explode(near_cells).alias("at")).join(others, "at").where(_squared("z", "oz", k) <= eps * eps).select("p", "o", "on"))
    counted = near.groupBy("p").agg(F.sum("on").alias("degree")).where(F.col("degree") >= min_samples).select("p")
    core = stage(counted.unionByName(points.where("full").select("p")))
    reach = stage(near.join(core.select(F.col("p").alias("o")), "o").select("p", "o"))
    own = points.where("full").select(F.col("p").alias("a"), F.col("rep").alias("b"))
    links = reach.join(core, "p").select(F.col("p").alias("a"), F.col("o").alias("b")).unionByName(own)
    full = cells.where("full")
    if dense and not full.isEmpty():
        pairs = full.select("rep", F.explode(near_cells).alias("at")).alias("x").join(full.alias("y"), F.expr("x.at = y.cell and x.rep < y.rep")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        corners = [(F.element_at("cell", i + 1) * width).alias(f"c{i}") for i in range(k)]
        links = links.unionByName(cell_links(points.where("full").select("rep", "z", *corners), pairs, links, k, eps, width)[0])
    return core, reach, links


def _shape(k: int) -> list[Column]:
    """Bounds and outermost points of a group of points, one after the other: 2 k + 2 k * k numbers."""
    at = [F.element_at("z", i + 1) for i in range(k)]
    ends = [f(F.col("z"), x) for x in at for f in (F.min_by, F.max_by)]
    return [F.min(x) for x in at] + [F.max(x) for x in at] + [F.element_at(e, i + 1) for e in ends for i in range(k)]


def cell_links(points: DataFrame, pairs: DataFrame, known: DataFrame, k: int, eps: float, width: float) -> tuple[DataFrame, int]:
    """(links, tested): which of `pairs` (a, b) of cells have two points within `eps`, but for those that other links connect; and how many parts and points were compared.

    `points` (rep, z, c0...) are of cells of `width` at the corner (c0...). Branch and bound: a
    cell's points are summed up by CUTS parts a column: their bounds and outermost points. Two
    cells are linked by parts that are within `eps` as a whole, or by two outermost points that
    are; parts farther apart are dropped. What is left is open: pairs that the links so far
    connect anyway are passed over, the others' parts are cut again. No two points of cells
    that are known to be linked or apart are compared, however many there are.
    """
    links, tested, size = None, 0, 2 * k + 2 * k * k
    parts = points.withColumn("part", F.col("rep"))
    open_ = stage(pairs.select("a", "b", F.col("a").alias("p1"), F.col("b").alias("p2")).distinct())
    while True:
        width /= CUTS
        sub = [F.least(F.greatest(F.floor((F.element_at("z", i + 1) - F.col(f"c{i}")) / width), F.lit(0)), F.lit(CUTS - 1)) for i in range(k)]
        parts = stage(parts.withColumns({f"s{i}": x for i, x in enumerate(sub)}).withColumn("sub", F.xxhash64("part", *[f"s{i}" for i in range(k)])))
        # CUTS ** k parts of a part at most
        shapes = parts.groupBy("part", "sub").agg(F.array(*_shape(k)).alias("shape")).groupBy("part").agg(F.collect_list("sub").alias("subs"), F.flatten(F.collect_list("shape")).alias("shapes"))
        one, other = (shapes.select(F.col("part").alias(f"p{i}"), F.col("subs").alias(f"u{i}"), F.col("shapes").alias(f"h{i}")) for i in (1, 2))
        compared = stage(open_.join(one, "p1").join(other, "p2").select("a", "b", "u1", "h1", "u2", "h2").mapInArrow(_comparer(k, size, eps), "a long, b long, linked boolean, p1 long, p2 long, tested long"))
        found = compared.where("linked").select("a", "b").distinct()
        links = found if links is None else links.unionByName(found)
        tested += compared.agg(F.sum("tested")).first()[0] or 0
        undecided = compared.where("p1 is not null").join(found, ["a", "b"], "left_anti").select("a", "b", "p1", "p2")
        if undecided.isEmpty():
            return links, tested
        ends = stage(components(known.unionByName(links)))
        for x in ("a", "b"):
            undecided = undecided.join(ends.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
        open_ = stage(undecided.where("of_a != of_b").select("a", "b", "p1", "p2"))
        if open_.isEmpty():
            return links, tested
        wanted = open_.select(F.explode(F.array("p1", "p2")).alias("sub")).distinct()
        corners = [(F.col(f"c{i}") + F.col(f"s{i}") * width).alias(f"c{i}") for i in range(k)]
        parts = parts.join(wanted, "sub").select("rep", "z", *corners, F.col("sub").alias("part"))


def _comparer(k: int, size: int, eps: float):
    """For pairs of parts, with their parts: whether they are linked, or else which of their parts are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            out: list[tuple] = []
            lists = [(batch.column(i).flatten().to_numpy(), np.append(0, np.cumsum(batch.column(i).value_lengths().to_numpy()))) for i in (2, 3, 4, 5)]
            for row in range(batch.num_rows):
                u1, h1, u2, h2 = (values[ends[row] : ends[row + 1]] for values, ends in lists)
                linked, i, j, tested = _compared(h1.reshape(-1, size), h2.reshape(-1, size), k, eps)
                out.append((a[row], b[row], linked, None, None, tested))
                out += [(a[row], b[row], False, int(u1[x]), int(u2[y]), 0) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "linked", "p1", "p2", "tested"])

    return run


def _compared(one: np.ndarray, other: np.ndarray, k: int, eps: float) -> tuple[bool, np.ndarray, np.ndarray, int]:
    """(linked, open parts of one, open parts of the other, tested) of two lists of shapes."""
    none, limit = np.empty(0, np.int64), eps * eps
    lo1, hi1, lo2, hi2 = one[:, None, :k], one[:, None, k : 2 * k], other[None, :, :k], other[None, :, k : 2 * k]
    span = (np.maximum(hi1 - lo2, hi2 - lo1) ** 2).sum(2)
    tested = span.size
    if span.min() <= limit * (1 - 1e-9):
        return True, none, none, tested
    gap = (np.maximum(np.maximum(lo1 - hi2, lo2 - hi1), 0.0) ** 2).sum(2)
    i, j = np.nonzero(gap <= limit * (1 + 1e-9))
    order = np.argsort(gap[i, j], kind="stable")
    i, j = i[order], j[order]
    settled = np.zeros(len(i), bool)
    for x in range(len(i)):
        p, q = (h[2 * k :].reshape(-1, k) for h in (one[i[x]], other[j[x]]))
        squares = (p[:, None, 0] - q[None, :, 0]) ** 2
        for c in range(1, k):
            squares = squares + (p[:, None, c] - q[None, :, c]) ** 2
        tested += squares.size
        if (squares <= limit).any():
            return True, none, none, tested
        # single points are compared for good
        settled[x] = (one[i[x], :k] == one[i[x], k : 2 * k]).all() and (other[j[x], :k] == other[j[x], k : 2 * k]).all()
    return False, i[~settled], j[~settled], tested


def cluster_summary(df: DataFrame) -> DataFrame:
    """Rows of each cluster, noise as -1, and their share."""
    sizes = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.join(F.broadcast(sizes.agg(F.sum("rows").alias("total")))).select("cluster", "rows", F.round(F.col("rows") / F.col("total"), 6).alias("share"))


def cluster_rows(df: DataFrame, cluster: int) -> DataFrame:
    """The rows of one cluster, -1 being noise; none for a number that no cluster has."""
    return df.where(F.col("cluster") == cluster)
