"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are rotated at random, so that a squared distance over the first d of D columns times
D / d estimates the whole one. Within each probed list the columns are read block by block; a
candidate whose partial distance is already too large, by a hypothesis test, is abandoned
(ADSampling, Gao and Long 2023). A largest inner product is a smallest distance with a bound
of its own for each candidate: q.x >= t exactly if |q - x|^2 <= |q|^2 + |x|^2 - 2 t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isospark.llm.common import discard, let_go, slices, stage

#: Rows of the sample that the lists' centres are fitted on at most, rows of it for each list at least, lists at most and rows a list is meant to have.
SAMPLE, PER_CENTRE, MOST_LISTS, PER_LIST = 65_536, 16, 4096, 400
#: Share of the sample's own nearest neighbours that the probed lists must hold, queries of the sample that tell, and lists probed at least.
RECALL, TRIED, PROBE_LEAST = 0.97, 256, 8
#: Candidates of a shard at most and, where there are few, at least; its numbers at most; about how many shards there are as long as they aren't full.
BLOCK, BLOCK_LEAST, BLOCK_NUMBERS, SHARDS = 32_768, 512, 1 << 22, 80
#: Queries and candidates that are held against each other at a time, and numbers that a step of this holds at most.
QUERIES, TILE, NUMBERS = 1024, 1024, 1 << 21
#: Columns a step reads, and the test's width: a larger one abandons fewer candidates by mistake. Reading a pair by itself takes about as long as DENSE pairs together.
COLUMNS, EPSILON, DENSE = 16, 2.1, 64


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that are not null, empty or zero and have no null or non-finite part, and whose id is not null; v is array<float> if the column is, else array<double>."""
    single = df.select(vector_col).schema[0].dataType.simpleString() == "array<float>"
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where("id is not null and size(v) > 0").where(~bad & F.exists("v", lambda x: x != 0))


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """A row for each vector, in double precision."""
    return vectors.flatten().to_numpy().astype(float).reshape(-1, size)


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same each time."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's steps on `sample`, from evenly spaced rows of it."""
    found = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        owner = nearest(sample, found)
        sums, n = np.zeros_like(found), np.bincount(owner, minlength=lists)
        np.add.at(sums, owner, sample)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def nearest(rows: np.ndarray, middles: np.ndarray) -> np.ndarray:
    step, norms = max(1, NUMBERS // len(middles)), (middles**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * rows[i : i + step] @ middles.T, axis=1) for i in range(0, len(rows), step)] or [np.empty(0, int)])


def needed_probes(sample: np.ndarray, middles: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many lists hold a share `recall` of the `k` nearest in `sample` to rows of it, lists in the order of their centres' inner product.

    In all rows the nearest are nearer than in a sample, and so in earlier lists: this is on the safe side.
    """
    tried = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
    owner, queries = nearest(sample, middles), sample[tried]
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(middles)
    best, step = [], max(1, NUMBERS // len(sample))
    for i in range(0, len(tried), step):
        scores = -queries[i : i + step] @ sample.T
        scores[np.arange(len(scores)), tried[i : i + step]] = np.inf
        best.append(np.argpartition(scores, k - 1, axis=1)[:, :k])
    best = np.concatenate(best)
    place = np.empty((len(tried), len(middles)), int)
    np.put_along_axis(place, np.argsort(-(queries @ middles.T), axis=1, kind="stable"), np.arange(len(middles))[None], axis=1)
    found = np.sort(np.take_along_axis(place, owner[best], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def shards_of(counts: dict[int, int], middles: np.ndarray, rows: int) -> list[tuple[int, int, int]]:
    """(list, its first shard, its shards) of each list that has rows: lists that lie together share a shard of at most `rows` rows, a larger list has several of its own."""
    coarse = nearest(middles, centres(middles, int(np.ceil(np.sqrt(len(middles))))))
    out, shard, filled = [], 0, 0
    for at in np.argsort(coarse, kind="stable").tolist():
        n = counts.get(at, 0)
        if filled and filled + n > rows:
            shard, filled = shard + 1, 0
        if n > rows:
            out.append((at, shard, -(-n // rows)))
            shard += out[-1][2]
        elif n:
            out.append((at, shard, 1))
            filled += n
    return out


def asked_shards(queries: np.ndarray, middles: np.ndarray, probes: int, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each query the least inner product with a centre whose list is probed, and the shards that hold its probed lists: the nearest few, and the others.

    `at` has the lists of shard after shard, `starts` where each shard's begin. As many shards
    come first as their number's root: what they give bounds what the others give.
    """
    near = np.full((len(queries), len(middles)), -np.inf)
    near[:, at] = queries @ middles[at].T
    place = len(middles) - min(probes, len(middles))
    least = np.partition(near, place, axis=1)[:, place]
    if probes >= len(middles):
        least[:] = -np.inf
    near[near < least[:, None]] = -np.inf
    best = np.maximum.reduceat(near[:, at], starts, axis=1)
    order, n = np.argsort(-best, axis=1, kind="stable").astype(np.int32), (best > -np.inf).sum(1)
    few = np.ceil(np.sqrt(n)).astype(int)
    return least, [x[:f] for x, f in zip(order, few, strict=True)], [x[f:m] for x, f, m in zip(order, few, n, strict=True)]


def scan_list(queries: np.ndarray, rows: np.ndarray, bounds: np.ndarray, epsilon: float | None = EPSILON, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (of a query, of a row) of the pairs whose inner product may be the query's bound or more; all are rotated.

    Columns are read block by block. A pair's value is what its inner product so far is over the
    least one that the test lets pass. All pairs are read on as long as one in DENSE passes, then
    only these. Without `epsilon`, only what can't reach its bound is abandoned. `room`, two rows
    of at least as many numbers as there are pairs, is written over.
    """
    size = rows.shape[1]
    query_norm, row_norm = (queries**2).sum(1), (rows**2).sum(1)
    lowest = -np.sqrt(query_norm * row_norm.max(initial=0)) * (1 + 1e-6)
    bounds = np.maximum(bounds, lowest)
    slack = 1e-9 * (1 + query_norm.max(initial=0) + row_norm.max(initial=0))
    query_part, row_part, query_least, row_least = (np.zeros(len(x)) for x in (queries, rows, queries, rows))
    pairs = len(queries) * len(rows)
    value, more = (x[:pairs].reshape(len(queries), len(rows)) for x in (np.empty((2, pairs)) if room is None else room))
    i, j = None, None
    for d in range(0, size, COLUMNS):
        q, r, end = queries[:, d : d + COLUMNS], rows[:, d : d + COLUMNS], min(d + COLUMNS, size)
        share = 1.0 if epsilon is None or end == size else min(1.0, end / size * (1 + epsilon / np.sqrt(end)) ** 2)
        query_part, row_part = query_part + (q**2).sum(1), row_part + (r**2).sum(1)
        # |q - x|^2 so far <= share * (|q|^2 + |x|^2 - 2 bound), for the inner product so far
        query_now, row_now = (query_part - share * (query_norm - 2 * bounds)) / 2, (row_part - share * row_norm) / 2
        q = np.column_stack([q, query_least - query_now, np.ones(len(q))])
        r = np.column_stack([r, np.ones(len(r)), row_least - row_now])
        query_least, row_least = query_now, row_now
        if i is None:
            np.matmul(q, r.T, out=more if d else value)
            if d:
                value += more
            passes = (value >= -slack).ravel()
            if end == size or DENSE * np.count_nonzero(passes) < pairs:
                places = np.flatnonzero(passes)
                i, j, value = places // max(1, len(rows)), places % max(1, len(rows)), value.ravel()[places]
        else:
            step = NUMBERS // COLUMNS
            for s in range(0, len(i), step):
                value[s : s + step] += (q[i[s : s + step]] * r[j[s : s + step]]).sum(1)
            passes = value >= -slack
            i, j, value = i[passes], j[passes], value[passes]
    return i, j


def firsts(who: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the `n` largest scores of each of `who`, smaller ids first among equal ones, and which of these places are an n-th."""
    order = np.lexsort((ids, -score, who))
    rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
    return order[rank < n], rank[rank < n] == n - 1


class Shard:
    """Candidates of a shard, which come list by list."""

    def __init__(self, size: int):
        self.size, self.vectors, self.lists, self.ids, self.counts = size, [], [], [], []

    def add(self, lists: np.ndarray, vectors: np.ndarray, ids: pa.Array) -> None:
        self.vectors.append(vectors)
        self.lists.append(lists)
        self.ids.append(ids.flatten().to_numpy())
        self.counts.append(pc.list_value_length(ids).to_numpy().astype(np.int64))

    def close(self, turn: np.ndarray, middles: np.ndarray) -> None:
        self.raw, owner, self.ids, self.counts = (np.concatenate(x) for x in (self.vectors, self.lists, self.ids, self.counts))
        self.vectors = self.lists = None
        self.turned, self.starts = self.raw @ turn, np.cumsum(self.counts) - self.counts
        self.cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
        self.middles, self.room = middles[owner[self.cuts[:-1]]], np.empty((2, QUERIES * TILE))

    def answers(self, raw: np.ndarray, turned: np.ndarray, bounds: np.ndarray, least: np.ndarray, k: int, epsilon: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score): the `k` + 1 best that reach the query's bound, out of those of the shard's lists that it probes."""
        reached, kept, new = bounds.copy(), (np.empty(0, int), np.empty(0, int), np.empty(0)), []

        def best(kept: tuple, new: list) -> tuple:
            who, at, score = (np.concatenate(x) for x in zip(kept, *new, strict=True))
            places, last = firsts(who, score, self.ids[self.starts[at]], k + 1)
            who, at, score = who[places], at[places], score[places]
            reached[who[last]] = np.maximum(reached[who[last]], score[last])
            return who, at, score

        probed = turned @ self.middles.T >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
        for number, (start, stop) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            asking = np.flatnonzero(probed[:, number])
            for s in range(start, stop, TILE) if len(asking) else ():
                rows = self.turned[s : min(s + TILE, stop)]
                free = asking[np.isneginf(reached[asking])]
                if len(free) and len(rows) > k:
                    head = turned[free] @ rows[: 8 * (k + 1)].T
                    edge = np.partition(head, head.shape[1] - k - 1, axis=1)[:, head.shape[1] - k - 1]
                    reached[free] = edge - 1e-9 * (1 + np.abs(edge) + (turned[free] ** 2).sum(1) + (rows**2).sum(1).max())
                i, j = scan_list(turned[asking], rows, reached[asking], epsilon, self.room)
                step = max(1, NUMBERS // self.size)
                for e in range(0, len(i), step):
                    who, at = asking[i[e : e + step]], s + j[e : e + step]
                    exact = (self.raw[at] * raw[who]).sum(1)
                    reach = exact >= bounds[who]
                    new.append((who[reach], at[reach], exact[reach]))
                if sum(len(x[0]) for x in new) > len(raw) * (k + 1):
                    kept, new = best(kept, new), []
        who, at, score = best(kept, new)
        n = self.counts[at]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who, score, ids = np.repeat(who, n), np.repeat(score, n), self.ids[np.repeat(self.starts[at], n) + inside]
        places, _ = firsts(who, score, ids, k + 1)
        return who[places], ids[places], score[places]


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): the `k` nearest found of each row whose id is divisible by `every`.

    Score is the inner product in double precision; ties go to the smaller id; a query is not
    its own candidate. Equal vectors are one candidate with its k + 1 smallest ids, which is all
    that an answer can need of them. Vectors of another size than most take no part, nor those
    `usable` leaves out. All rows are indexed; the lists' centres are fitted on at most SAMPLE
    rows, and so many lists are probed as hold a share `recall` of the sample's neighbours: few
    where vectors lie in clusters, nearly all where they have no order. `recall` 1.0 probes all
    lists and abandons no candidate by a test, which is the exact way. Lists that lie together
    go out in shards of at most BLOCK candidates, and a list that is larger in several; a shard's
    candidates are sent once for each of two rounds. A query is sent once to each shard that
    holds lists it probes, in the first round to the nearest few. Repeated
    rows are one row; of an id's different vectors, the one that comes first by its values
    counts. An empty table gives an empty one; other columns are not read.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_rows = stage(usable(df, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")))
    sizes = all_rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    size = sizes[0]["s"] if sizes else 1
    rows = all_rows.where(F.size("v") == size)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = stage(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = stage(rows.where(F.col("id") % every == 0))
    discard(all_rows)
    total = distinct.count()

    lists = int(min(MOST_LISTS, max(1, total // PER_LIST)))
    part = min(1.0, min(SAMPLE, max(SAMPLE // 3, PER_CENTRE * lists)) / max(1, total))
    drawn = distinct.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(part * (1 << 30))).select("v").toPandas()["v"]
    turn = rotation(size)
    sample = np.stack(drawn.to_list()).astype(float) @ turn if len(drawn) else np.zeros((1, size))
    middles = centres(sample[np.lexsort(sample.T[::-1])], min(lists, len(sample)))
    lists = len(middles)
    probes = lists if recall >= 1 else min(lists, max(PROBE_LEAST, needed_probes(sample, middles, k, recall)))
    epsilon = None if recall >= 1 else EPSILON
    held = spark.sparkContext.broadcast((turn, middles))
    vector = distinct.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        turn, middles = held.value
        for batch in slices(batches, 4096, 16):
            owner = nearest(matrix(batch.column(0), size) @ turn, middles)
            yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), batch.column(0), batch.column(1)], names=["list", "v", "ids"])

    placed = stage(distinct.select("v", "ids").mapInArrow(place, f"list int, v {vector}, ids array<long>"))
    discard(distinct)
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    fill = max(1, min(BLOCK, BLOCK_NUMBERS // size, max(BLOCK_LEAST, total // min(2 * parts, SHARDS))))
    shards = shards_of(counts, middles, fill)
    at = np.array([(first + i, x) for x, first, n in shards for i in range(n)], int).reshape(-1, 2)
    lists_of = spark.sparkContext.broadcast((at[:, 1], np.flatnonzero(np.diff(at[:, 0], prepend=-1))))
    where = spark.createDataFrame(shards, "list int, first int, shards int").coalesce(1)
    candidates = placed.join(F.broadcast(where), "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")).select("shard", "list", "v", "ids")
    # equal queries are searched once; q names a query vector
    queries = stage(asked.groupBy("v").agg(F.min("id").alias("q")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        turn, middles = held.value
        at, starts = lists_of.value
        for batch in slices(batches, max(1, min(512, NUMBERS // (len(at) + len(middles)))), 16):
            least, first, later = asked_shards(matrix(batch.column(1), size) @ turn, middles, probes, at, starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least), pa.array(first, pa.list_(pa.int32())), pa.array(later, pa.list_(pa.int32()))], names=["q", "v", "least", "first", "later"])

    asking = stage(queries.select("q", "v").mapInArrow(probe, f"q long, v {vector}, least double, first array<int>, later array<int>"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's candidates come first and stay in memory; its queries follow, however many, and are answered as they come."""
        let_go()
        turn, middles = held.value
        now, shard, closed = None, None, False
        for batch in slices(batches, QUERIES, 16):
            key, side = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(key)] if len(key) else [0]
            for s, e in zip(cuts, cuts[1:], strict=False):
                own = batch.slice(s, e - s)
                v = matrix(own.column(4), size)
                if now != key[s]:
                    now, shard, closed = key[s], Shard(size), False
                if side[s] == 0:
                    shard.add(own.column(2).to_numpy(), v, own.column(7))
                elif shard.vectors or closed:
                    if not closed:
                        shard.close(turn, middles)
                        closed = True
                    names, bound, least = (own.column(i).to_numpy() for i in (3, 5, 6))
                    who, ids, score = shard.answers(v, v @ turn, bound, least, k, epsilon)
                    yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(ids), pa.array(score)], names=["q", "id", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")

    def searched(asking: DataFrame, shards: str) -> DataFrame:
        none = F.lit(None)
        rows = candidates.select("shard", F.lit(0).alias("side"), "list", none.cast("long").alias("q"), "v", none.cast("double").alias("bound"), none.cast("double").alias("least"), "ids")
        rows = rows.unionByName(asking.select(F.explode(shards).alias("shard"), F.lit(1).alias("side"), none.cast("int").alias("list"), "q", "v", "bound", "least", none.cast("array<long>").alias("ids")))
        found = rows.repartition(parts, "shard").sortWithinPartitions("shard", "side", "list").mapInArrow(scan, "q long, id long, score double")
        return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)

    early = stage(searched(asking.withColumn("bound", F.lit(float("-inf"))), "first"))
    # what the first shards give k + 1 of is a bound for the others
    bounds = early.where(F.col("n") == k + 1).select("q", F.col("score").alias("bound"))
    later = asking.join(bounds, "q", "left").fillna(float("-inf"), "bound")
    both = early.unionByName(searched(later, "later")).select("q", "id", "score")
    top = both.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    named = asked.join(queries, "v").select(F.col("id").alias("query_id"), "q")
    answers = named.join(top, "q").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
