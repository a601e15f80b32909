"""Neighbours within a radius over any number of columns: space is halved until each part has few points.

A part's task has its own points, which are few, in memory, and is given the points around it
(those within the radius of the part, of which there may be many) after those, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.functions.graph import Forest
from isospark.functions.staging import stage

#: Points of a part at most; points that the first halvings are drawn from, about, and parts that these give at most.
LEAF, SAMPLE, FIRST = 2048, 16_384, 1024
_BLOCK, _CHUNK = 256, 4096


def _halved(sample: np.ndarray, most: int, parts: int) -> list[tuple[int, float, int, int]]:
    """A tree of cuts: (column, cut, node for values up to the cut, node beyond), or (-1, 0, part, 0), by the median of the widest column."""
    tree, todo, leaf, n = [None], [(0, sample)], 0, 1
    while todo:
        node, own = todo.pop(0)
        spread = own.max(0) - own.min(0) if len(own) else np.zeros(1)
        if len(own) <= most or n >= parts or not spread.max() > 0:
            tree[node], leaf = (-1, 0.0, leaf, 0), leaf + 1
            continue
        column = int(spread.argmax())
        values = np.sort(own[:, column])
        cut = float(values[(len(values) - 1) // 2])
        cut = cut if cut < values[-1] else float(values[values < values[-1]].max())
        tree[node] = (column, cut, len(tree), len(tree) + 1)
        below = own[:, column] <= cut
        todo += [(len(tree), own[below]), (len(tree) + 1, own[~below])]
        tree += [None, None]
        n += 1
    return tree


def _dealt(tree: list[tuple[int, float, int, int]], eps: float):
    """Each point goes to its own part, and to all others that are within `eps` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, cut, low, high = (np.array([t[i] for t in tree]) for i in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            row, node, own = np.arange(len(z)), np.zeros(len(z), np.int64), np.ones(len(z), bool)
            while (column[node] >= 0).any():
                at, value, edge = column[node], z[row, np.maximum(column[node], 0)], cut[node]
                done = at < 0
                below = ~done & (value <= edge + eps * (1 + 1e-9))
                above = ~done & (value > edge - eps * (1 + 1e-9))
                row = np.concatenate([row[done], row[below], row[above]])
                own = np.concatenate([own[done], own[below] & (value <= edge)[below], own[above] & (value > edge)[above]])
                node = np.concatenate([node[done], low[node][below], high[node][above]])
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(low[node].astype(np.int64)), pa.array(own), *picked.columns], names=["leaf", "own", "p", "z", "n"])

    return run


def leaves(points: DataFrame, k: int, eps: float, most: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(leaf, own, p, z, n) of `points` (p, z, n; all z different): each in its own part, and not `own` in the parts around.

    The first halvings come from a bounded sample. Then parts with over `most` points of their
    own are halved at the median of their widest column, all at once, again and again, so no
    part keeps more than `most`.
    """
    total = points.count()
    drawn = points.where(F.pmod(F.xxhash64("p"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30))).select("z")
    known = np.array([r["z"] for r in drawn.collect()], float).reshape(-1, k)  # about `sample` rows
    tree = _halved(known, max(1, int(most * len(known) / max(1, total))), FIRST)
    rows = stage(points.select("p", "z", "n").mapInArrow(_dealt(tree, eps), "leaf long, own boolean, p long, z array<double>, n long"))
    columns = [F.element_at("z", i + 1) for i in range(k)]
    while True:
        bounds = [F.array(*[f(c) for c in columns]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"), (lambda c: F.percentile_approx(c, 0.5), "mid"))]
        wide = F.expr("zip_with(hi, lo, (h, l) -> h - l)")
        heavy = rows.where("own").groupBy("leaf").agg(F.count(F.lit(1)).alias("own_n"), *bounds).where(F.col("own_n") > most)
        heavy = heavy.withColumn("at", F.array_position(wide, F.array_max(wide)).cast("int"))
        low, high, mid = (F.element_at(c, F.col("at")) for c in ("lo", "hi", "mid"))
        # the median if there is something beyond it, else the middle, below the largest value in any case
        cuts = stage(heavy.select("leaf", "at", F.when(mid < high, mid).when((low + high) / 2 < high, (low + high) / 2).otherwise(low).alias("cut")))
        if cuts.isEmpty():
            return rows
        value, reach = F.element_at("z", F.col("at")), eps * (1 + 1e-9)
        sides = F.filter(
            F.array(
                F.when(value <= F.col("cut") + reach, F.struct(F.xxhash64("leaf", F.lit(0)).alias("leaf"), (F.col("own") & (value <= F.col("cut"))).alias("own"))),
                F.when(value > F.col("cut") - reach, F.struct(F.xxhash64("leaf", F.lit(1)).alias("leaf"), (F.col("own") & (value > F.col("cut"))).alias("own"))),
            ),
            lambda x: x.isNotNull(),
        )
        stay = F.array(F.struct("leaf", "own"))
        placed = rows.join(cuts, "leaf", "left").select(F.explode(F.when(F.col("at").isNull(), stay).otherwise(sides)).alias("x"), "p", "z", "n")
        rows = stage(placed.select("x.leaf", "x.own", "p", "z", "n"))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, summed up column by column as SQL does."""
    out = (x[:, None, 0] - y[None, :, 0]) ** 2
    for c in range(1, x.shape[1]):
        out += (x[:, None, c] - y[None, :, c]) ** 2
    return out


class _Degrees:
    """Core points of a part: those with weights of `least` within `eps`. A point is no longer compared once it has them."""

    def __init__(self, own: dict[str, np.ndarray], eps: float, least: int):
        self.own, self.limit, self.least = own, eps * eps, least
        self.degree = np.zeros(len(own["p"]), np.int64)
        self.around(own)

    def around(self, rows: dict[str, np.ndarray]) -> None:
        for s in range(0, len(rows["p"]), _CHUNK):
            z, n = rows["z"][s : s + _CHUNK], rows["n"][s : s + _CHUNK]
            missing = np.flatnonzero(self.degree < self.least)
            for t in range(0, len(missing), _BLOCK):
                some = missing[t : t + _BLOCK]
                self.degree[some] += (_squares(self.own["z"][some], z) <= self.limit) @ n

    def found(self) -> list[np.ndarray]:
        return [self.own["p"][self.degree >= self.least]]


class _Reach:
    """Links that connect a part's core points with each other and with those around, a spanning forest of them; and the core points near each of its other points."""

    def __init__(self, own: dict[str, np.ndarray], eps: float):
        self.limit, self.forest, self.links = eps * eps, Forest(0), []
        core = own["core"]
        self.core, self.other = ({c: x[mask] for c, x in own.items()} for mask in (core, ~core))
        self.forest = Forest(len(self.core["p"]))
        self.around(own, True)

    def around(self, rows: dict[str, np.ndarray], same: bool = False) -> None:
        rows = {c: x[rows["core"]] for c, x in rows.items()}
        for s in range(0, len(rows["p"]), _CHUNK):
            p, z = rows["p"][s : s + _CHUNK], rows["z"][s : s + _CHUNK]
            at = np.arange(s, s + len(p)) if same else self.forest.grow(len(p))
            for t in range(0, len(self.core["p"]), _BLOCK):
                some = np.arange(t, min(t + _BLOCK, len(self.core["p"])))
                roots = self.forest.roots()
                if len(np.unique(np.concatenate([roots[some], roots[at]]))) > 1:
                    x, y = np.nonzero(_squares(self.core["z"][some], z) <= self.limit)
                    for i, j in self.forest.apart(some[x], at[y]):
                        if self.forest.join(i, j):
                            self.links.append((self.core["p"][i], p[j - at[0]], True))
            if not same:
                self.forest.shrink(len(self.core["p"]))
            for t in range(0, len(self.other["p"]), _BLOCK):
                x, y = np.nonzero(_squares(self.other["z"][t : t + _BLOCK], z) <= self.limit)
                self.links += [(a, b, False) for a, b in zip(self.other["p"][t + x].tolist(), p[y].tolist(), strict=True)]

    def found(self) -> list[np.ndarray]:
        return [np.array([x[i] for x in self.links], kind) for i, kind in enumerate((np.int64, np.int64, bool))]


def _by_leaf(batches: Iterator[pa.RecordBatch], make) -> Iterator[list[np.ndarray]]:
    """What `make` (a part's own points) finds, part by part; rows are sorted by leaf, own points first."""
    leaf, own, task = None, [], None

    def made():
        return make({c: np.concatenate([x[c] for x in own]) for c in own[0]}) if own else None

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name) for name in batch.schema.names}
        rows = {c: (x.flatten().to_numpy().reshape(batch.num_rows, -1) if c == "z" else x.to_numpy(zero_copy_only=False)) for c, x in columns.items()}
        key, mine = rows.pop("leaf"), rows.pop("own").astype(bool)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (mine[1:] != mine[:-1])) + 1).tolist(), len(key)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if key[s] != leaf:
                task = task or made()
                if task is not None:
                    yield task.found()
                leaf, own, task = key[s], [], None
            part = {c: x[s:e] for c, x in rows.items()}
            if mine[s]:
                own.append(part)
            else:
                task = task or made()
                if task is not None:
                    task.around(part)
    task = task or made()
    if task is not None:
        yield task.found()


def _sorted(rows: DataFrame, *columns: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "leaf").sortWithinPartitions("leaf", F.desc("own")).select("leaf", "own", "p", "z", *columns)


def core_by_leaves(dealt: DataFrame, eps: float, least: int) -> DataFrame:
    """(p): points of `dealt` (see `leaves`) with a weight of `least` within `eps`, themselves included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_leaf(batches, lambda own: _Degrees(own, eps, least)):
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64())], names=["p"])

    return _sorted(dealt, "n").mapInArrow(run, "p long")


def reach_by_leaves(dealt: DataFrame, core: DataFrame, eps: float) -> DataFrame:
    """(a, b, core): links that connect the core points (p) of `dealt`, and, not `core`, each other point a with its core neighbours b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_leaf(batches, lambda own: _Reach(own, eps)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "core"])

    marked = dealt.join(core.withColumn("core", F.lit(True)), "p", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    return _sorted(marked, "core").mapInArrow(run, "a long, b long, core boolean")
