"""A trie of conversations by their turns, with what each prefix shares: double arrays, shard by shard.

Turns are known by 128 bits. A prefix's key is the exclusive-or of its turns' hashes, each mixed
with its place, so keys need no chain along a conversation. Conversations are cut into bands of
BAND turns; a band belongs under the prefix before it. The different bands of one prefix are
dealt to shards by their first turns: as many of them, doubled again and again, as keep a shard
within SHARD turns. A task packs its shards into one double array (BASE, CHECK) over dense turn
ids, walks the bands through it and sums up subtrees. Nodes above a shard's own prefix are
shared by several: their parts are merged in Spark, and they are few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isospark.llm.common import let_go, slices, stage
from isospark.llm.groups import runs
from isospark.llm.shingles import mixed

#: Turns of a band; turns of a shard, about; ids that are one block of text before they are hashed.
BAND, SHARD, BLOCK = 4096, 512, 4096
#: The rebuilt beginnings: turns of which conversation, and how many at most, less one.
GROUP, HEADS = 20, 4
_WORD = r"[^\x20\x09-\x0D]+"
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_KEYS = ["e1", "e2"]


def placed_turns(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, pos, d1, d2, words) of each turn: its place from 1 in its conversation, 128 bits of role and text, words of the text.

    Ranges of turns are ranked each for itself; the few conversations that go on in the next
    range are moved on by what came before, so no conversation needs to be one task's work.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("d1"), F.xxhash64(text, F.lit(1), role).alias("d2"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    order = ["conv", "turn", "d1", "d2"]  # nulls first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        last, reached = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            starts = np.append(0, np.flatnonzero(conv[1:] != conv[:-1]) + 1)
            sizes = np.diff(np.append(starts, len(conv)))
            pos = np.arange(len(conv)) - np.repeat(starts, sizes) + 1
            if last == conv[0]:
                pos[: sizes[0]] += reached
            last, reached = conv[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), *batch.columns[1:]], names=["conv", "pos", "d1", "d2", "words", "part"])

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "d1", "d2", "words", F.spark_partition_id().alias("part"))
    dealt = stage(ranged.mapInArrow(run, "conv long, pos long, d1 long, d2 long, words long, part int"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row at most for each range: the conversation that it goes on with
    moved = dealt.groupBy("conv", "part").agg(F.max("pos").alias("n")).select("conv", "part", F.sum("n").over(before).alias("first")).where("first is not null")
    return dealt.join(F.broadcast(moved), ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("first", F.lit(0))).alias("pos"), "d1", "d2", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lengths, turns) of the rebuilt conversations: (conv, length), and (conv, length, pos, d1, d2, words).

    Each begins with the first h turns of its group's first conversation (all if fewer, none if
    that is absent), followed by its own turns after its first h.
    """
    heads = F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, F.struct("pos", "d1", "d2", "words"))))  # at most HEADS - 1
    convs = stage(turns.groupBy("conv").agg(F.max("pos").alias("n"), heads.alias("heads")))
    own = convs.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int").alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    bases = convs.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), "heads")
    none = F.expr("cast(array() AS array<struct<pos: bigint, d1: bigint, d2: bigint, words: bigint>>)")
    begun = own.join(bases, "base", "left").withColumn("begin", F.coalesce(F.slice("heads", F.lit(1), F.col("h")), none)).withColumn("k", F.size("begin"))
    known = stage(begun.select("conv", "h", "k", "begin", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")))
    first = known.select("conv", "length", F.inline("begin"))
    rest = turns.join(known.select("conv", "h", "k", "length"), "conv").where("pos > h").select("conv", "length", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "d1", "d2", "words")
    return known.select("conv", "length"), first.unionByName(rest)


def _places(d1: np.ndarray, d2: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each turn at its place."""
    a, b, at = d1.view(np.uint64), d2.view(np.uint64), pos.astype(np.uint64)
    return mixed(mixed(a + at * _FACTORS[0], _FACTORS[1]) ^ b), mixed(mixed(b ^ (at * _FACTORS[1]), _FACTORS[0]) + a, _FACTORS[0])


def _running(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The exclusive-or of each row's values up to and with each."""
    total = np.bitwise_xor.accumulate(values)
    before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], np.uint64(0))
    return total ^ np.repeat(before, lens)


def bands(turns: DataFrame, band: int) -> DataFrame:
    """(conv, j, length, x1, x2, d1, d2, words) of each band: j from 0, the exclusive-or of its turns' hashes, and lists of its turns."""
    rows = turns.withColumn("j", F.expr(f"(pos - 1) div {band}")).groupBy("conv", "j", "length").agg(F.sort_array(F.collect_list(F.struct("pos", "d1", "d2", "words"))).alias("t"))
    rows = rows.select("conv", "j", "length", *[F.col(f"t.{c}").alias(c) for c in ("pos", "d1", "d2", "words")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, 4096, 16):
            pos, d1, d2 = (batch.column(i).flatten().to_numpy() for i in (3, 4, 5))
            starts = np.append(0, np.cumsum(batch.column(3).value_lengths().to_numpy()))[:-1]
            found = [pa.array(np.bitwise_xor.reduceat(m, starts).view(np.int64)) if len(starts) else pa.array([], pa.int64()) for m in _places(d1, d2, pos)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found, *batch.columns[4:]], names=["conv", "j", "length", "x1", "x2", "d1", "d2", "words"])

    return rows.mapInArrow(run, "conv long, j long, length long, x1 long, x2 long, d1 array<long>, d2 array<long>, words array<long>")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(e1, e2, sha): of `ends` (e1, e2, conv), SHA-256 of each key's decimal conv numbers, ascending, joined by commas.

    Ranges of rows are joined to blocks of text first; a key's blocks are then hashed one after the other.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            e1, e2, conv = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero((e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])) + 1
            cuts = np.unique(np.concatenate([[0], new, np.arange(0, len(conv), BLOCK)])) if len(conv) else np.empty(0, np.int64)
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(conv)), strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[cuts]) for x in (e1, e2, conv)], pa.array(texts, pa.string())], names=["e1", "e2", "first", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        now, hasher = None, None
        for batch in batches:
            out = []
            for key, text in zip(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True), batch.column(3).to_pylist(), strict=True):
                if key == now:
                    hasher.update(b",")
                else:
                    if now is not None:
                        out.append((*now, hasher.hexdigest()))
                    now, hasher = key, hashlib.sha256()
                hasher.update(text.encode())
            yield _ended(out)
        if now is not None:
            yield _ended([(*now, hasher.hexdigest())])

    def _ended(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["e1", "e2", "sha"])

    blocks = ends.select(*_KEYS, "conv").repartitionByRange(*_KEYS, "conv").sortWithinPartitions(*_KEYS, "conv").mapInArrow(join, "e1 long, e2 long, first long, text string")
    return blocks.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "first").mapInArrow(digest, "e1 long, e2 long, sha string")


class DoubleArray:
    """Tries in one pair of arrays: the child of state s by code c is t = BASE[s] + c, if CHECK[t] is s. Codes are from 1; states 0 to `roots` - 1 are roots, the first free ones."""

    def __init__(self, roots: int, codes: int):
        self.codes = codes
        self.base = np.zeros(roots + codes + 1, np.int64)
        self.check = np.full(roots + codes + 1, -1, np.int64)
        self.check[:roots] = -2  # taken, and nobody's child
        self.top = roots  # all states from here on are free

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def add(self, states: np.ndarray, codes: np.ndarray) -> None:
        """Children of states that have none yet: pairs, each once, sorted by state and code."""
        starts = np.append(0, np.flatnonzero(states[1:] != states[:-1]) + 1)
        sizes = np.diff(np.append(starts, len(states)))
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            self._place(int(states[s]), codes[s : s + n])
        # only children fit anywhere: the next free states, one after the other
        alone = starts[sizes == 1]
        self._grow(self.top + len(alone) + self.codes + 1)
        t = self.top + np.arange(len(alone))
        self.base[states[alone]], self.check[t] = t - codes[alone], states[alone]
        self.top += len(alone)

    def _place(self, state: int, codes: np.ndarray) -> None:
        """The first of a few free states below `top` that leaves room for all codes, or what is beyond."""
        self._grow(self.top + 2 * self.codes + 2)
        low = max(0, self.top - 4 * self.codes)
        for free in (np.flatnonzero(self.check[low : self.top] == -1)[:16] + low).tolist():
            if (self.check[free - codes[0] + codes] == -1).all():
                break
        else:
            free = self.top
        at = free - codes[0] + codes
        self.base[state], self.check[at] = free - codes[0], state
        self.top = max(self.top, int(at[-1]) + 1)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of `states` by `codes`, -1 where there is none."""
        t = self.base[states] + codes
        inside = (t >= 0) & (t < len(self.check))
        return np.where(inside & (self.check[np.where(inside, t, 0)] == states), t, -1)


def forest(shard: np.ndarray, codes: np.ndarray, lens: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of rows of codes (from 1, one row after the other, `lens` of each), and the state of each code; row i begins at root shard[i]."""
    array = DoubleArray(int(shard.max(initial=-1)) + 1, int(codes.max(initial=0)))
    starts = np.append(0, np.cumsum(lens))[:-1]
    states = np.empty(len(codes), np.int64)
    now, live = shard.copy(), np.arange(len(lens))
    for d in range(int(lens.max(initial=0))):
        live = live[lens[live] > d]
        c = codes[starts[live] + d]
        pairs = np.unique(now[live] * (array.codes + 1) + c)
        array.add(pairs // (array.codes + 1), pairs % (array.codes + 1))
        now[live] = array.step(now[live], c)
        states[starts[live] + d] = now[live]
    return array, states


_PATH = "array<struct<e1: long, e2: long, top: boolean>>"
_PART = (
    "kind int, e1 long, e2 long, top boolean, f1 long, f2 long, f_top boolean, at_root boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    f"ends_sha256 string, words long, path {_PATH}"
)
_COLUMNS = [x.split()[0] for x in _PART.split(", ") if not x.startswith(("e2: ", "top: "))]
#: Of a row: final; final but for its parent, which is a shared node; a shard's part of a shared node, or of the prefix above a band's shards.
_FINAL, _OPEN, _SHARED = 0, 1, 2
_PATH_TYPE = pa.list_(pa.struct([("e1", pa.int64()), ("e2", pa.int64()), ("top", pa.bool_())]))
_EMPTY = hashlib.sha256(b"").hexdigest()


def _shard_nodes(rows: pa.Table, cuts: list[tuple[int, int]], band: int) -> pa.RecordBatch:
    """The nodes of whole shards, rows from cut to cut, as _PART."""
    number = lambda name: rows[name].to_numpy()
    lists = {c: rows[c].combine_chunks() for c in ("d1", "d2", "words")}
    lens = lists["d1"].value_lengths().to_numpy().astype(np.int64)
    d1, d2, words = (lists[c].flatten().to_numpy() for c in ("d1", "d2", "words"))
    starts = np.append(0, np.cumsum(lens))[:-1]
    shard = np.repeat(np.arange(len(cuts)), [b - a for a, b in cuts])
    local = np.arange(len(d1)) - np.repeat(starts, lens) + 1
    j, upper = number("j"), np.minimum(number("upper"), band)
    m1, m2 = _places(d1, d2, local + np.repeat(j * band, lens))
    r1, r2 = number("r1"), number("r2")
    above_root = [np.repeat(r, lens) for r in (r1, r2)]
    k1, k2 = (_running(m, starts, lens) ^ r.view(np.uint64) for m, r in zip((m1, m2), above_root, strict=True))
    ids = np.unique(np.stack([d1, d2], axis=1), axis=0, return_inverse=True)[1].ravel() + 1
    array, states = forest(shard, ids, lens)

    size = len(array.check)
    n, conv, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    weight, least = np.repeat(number("n"), lens), np.repeat(number("conv"), lens)
    np.add.at(n, states, weight)
    np.minimum.at(conv, states, least)
    nodes, where = np.unique(states, return_index=True)  # a place of each node
    depth[nodes] = local[where]
    parent = array.check
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    np.add.at(children, parent[nodes], 1)
    ends = states[starts + lens - 1] if len(lens) else np.empty(0, np.int64)
    sha = np.full(size, -1, np.int64)
    sha[ends] = np.arange(len(lens))
    for total, name in ((children, "kids"), (leaves, "more_leaves"), (saved, "more_saved")):
        total[ends] += number(name)  # what goes on in the next band
    own = (n[nodes] - 1) * words[where]
    shard_of, upper_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
    shard_of[nodes], upper_of[nodes] = np.repeat(shard, lens)[where], np.repeat(upper, lens)[where]
    shared = depth[nodes] < upper_of[nodes]
    # shared nodes' own share is settled when they are merged
    complete = nodes[~shared]
    leaves[complete] += children[complete] == 0
    saved[complete] += own[~shared]
    by_depth = nodes[np.argsort(-depth[nodes], kind="stable")]
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if len(by_depth) else []:
        up = parent[level]
        np.add.at(leaves, up, leaves[level])
        np.add.at(saved, up, saved[level])

    hashes, keys = rows["sha"].to_pylist(), np.stack([k1, k2]).view(np.int64)
    above_key = np.where(local > 1, np.roll(keys, 1, axis=1), np.stack(above_root))[:, where]
    kind = np.where(shared, _SHARED, np.where(depth[nodes] == upper_of[nodes], _OPEN, _FINAL))
    # shared children are counted when they are merged
    np.subtract.at(children, parent[nodes[shared]], 1)
    base_of, at_top = np.repeat(j * band, lens)[where], depth[nodes] == 1
    paths: list = [None] * len(nodes)
    for i in np.flatnonzero(shared).tolist():
        first, last = int(where[i]) - int(local[where[i]]) + 1, int(where[i]) + 1
        top = {"e1": int(above_root[0][where[i]]), "e2": int(above_root[1][where[i]]), "top": True}
        paths[i] = [top, *[{"e1": x, "e2": y, "top": False} for x, y in keys[:, first:last].T.tolist()]]
    no = np.zeros(len(nodes), bool)
    columns = [
        pa.array(kind.astype(np.int32)), *[pa.array(k[where]) for k in keys], pa.array(no), *[pa.array(k) for k in above_key], pa.array(at_top), pa.array(at_top & (base_of == 0)), pa.array(conv[nodes]), pa.array(depth[nodes] + base_of),
        pa.array(conv[parent[nodes]], mask=kind != _FINAL), *[pa.array(x[nodes]) for x in (n, children, leaves, saved)], pa.array([hashes[i] if i >= 0 else None for i in sha[nodes].tolist()], pa.string()), pa.array(words[where]),
        pa.array(paths, _PATH_TYPE),
    ]
    # the prefix above the shards of a band: the root, or the end of the band before
    firsts, roots, n_of = np.array([a for a, _ in cuts], np.int64), np.arange(len(cuts)), np.zeros(len(cuts), np.int64)
    np.add.at(n_of, shard, number("n"))
    conv_of = np.full(len(cuts), np.iinfo(np.int64).max)
    np.minimum.at(conv_of, shard, number("conv"))
    blank, no = (lambda kind: pa.nulls(len(cuts), kind)), np.zeros(len(cuts), bool)
    tops = [
        pa.array(np.full(len(cuts), _SHARED, np.int32)), pa.array(r1[firsts]), pa.array(r2[firsts]), pa.array(~no), blank(pa.int64()), blank(pa.int64()), pa.array(no), pa.array(no), pa.array(conv_of), pa.array(j[firsts] * band),
        blank(pa.int64()), pa.array(n_of), *[pa.array(x[roots]) for x in (children, leaves, saved)], blank(pa.string()), pa.array(np.zeros(len(cuts), np.int64)), blank(_PATH_TYPE),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(columns, tops, strict=True)], names=_COLUMNS)


def sharded(sequences: DataFrame, shard: int) -> DataFrame:
    """`sequences` with p1, p2 (the key of the beginning that a shard is of) and `upper`, how many turns that is.

    Beginnings of 1, 2, 4 and more turns are tried as long as one has over `shard` turns in more
    than one row; a row that is shorter is a beginning itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, 4096, 16):
            names = batch.schema.names
            d1, d2 = (batch.column(names.index(c)).flatten().to_numpy() for c in ("d1", "d2"))
            lens = batch.column(names.index("d1")).value_lengths().to_numpy().astype(np.int64)
            starts = np.append(0, np.cumsum(lens))[:-1]
            local = np.arange(len(d1)) - np.repeat(starts, lens) + 1
            keys = [_running(m, starts, lens).view(np.int64) for m in _places(d1, d2, local)]
            at = [starts[i] + np.unique(np.minimum(1 << np.arange(int(n).bit_length() + 1), n)) - 1 for i, n in enumerate(lens.tolist())]
            ends = pa.array(np.append(0, np.cumsum([len(x) for x in at])).astype(np.int32))
            flat = np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64)
            lists = [pa.ListArray.from_arrays(ends, pa.array(k[flat])) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*names, "c1", "c2"])

    rows = stage(sequences.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in sequences.schema)}, c1 array<long>, c2 array<long>").withColumn("t", F.lit(0)))
    level = 0
    cut = lambda c: F.get(c, F.least(F.col("t"), F.size(c) - 1))
    while True:
        here = rows.where(F.col("t") == level).select("r1", "r2", cut("c1").alias("p1"), cut("c2").alias("p2"), F.size("d1").alias("m"))
        heavy = stage(here.groupBy("r1", "r2", "p1", "p2").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("k")).where((F.col("m") > shard) & (F.col("k") > 1)).select("r1", "r2", "p1", "p2", F.lit(True).alias("heavy")))
        if heavy.isEmpty():
            break
        keyed = rows.withColumn("p1", cut("c1")).withColumn("p2", cut("c2"))
        grown = F.when(F.col("heavy") & (F.col("t") == level), level + 1).otherwise(F.col("t"))
        rows = stage(keyed.join(heavy, ["r1", "r2", "p1", "p2"], "left").withColumn("t", F.coalesce(grown, F.col("t"))).select(*rows.columns))
        level += 1
    return rows.withColumn("p1", cut("c1")).withColumn("p2", cut("c2")).withColumn("upper", F.expr("1L << t")).drop("c1", "c2", "t")


def _parts(sequences: DataFrame, band: int, shard: int) -> DataFrame:
    """The nodes of `sequences`, as _PART: final ones, and shards' parts of shared ones."""
    keys = ["r1", "r2", "p1", "p2"]
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sharded(sequences, shard).select(*keys, "j", "upper", "conv", "n", "kids", "more_leaves", "more_saved", "sha", "d1", "d2", "words").repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for table, cuts in runs(slices(batches, 2048, 16), 4):
            yield _shard_nodes(table, cuts, band)

    return dealt.mapInArrow(run, _PART)


def _merged(parts: DataFrame) -> DataFrame:
    """The shared nodes, each once, with all that is below them; without their parents' numbers."""
    key, sums = ["e1", "e2", "top"], ("n_convs", "n_children", "n_leaves", "saved_tokens")
    same = [F.max(c).alias(c) for c in ("f1", "f2", "f_top", "at_root", "depth", "ends_sha256", "words")]
    one = stage(parts.where(F.col("kind") == _SHARED).groupBy(*key).agg(*same, F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.first("path", True).alias("path")))
    more = one.where("not top").groupBy(F.col("f1").alias("e1"), F.col("f2").alias("e2"), F.col("f_top").alias("top")).agg(F.count(F.lit(1)).alias("more"))
    counted = stage(one.join(more, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    own = counted.where("not top").select(F.explode("path").alias("p"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    below = own.groupBy("p.e1", "p.e2", "p.top").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    added = {"n_leaves": F.col("n_leaves") + F.coalesce("leaf", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("own", F.lit(0))}
    return stage(counted.join(below, key, "left").withColumns(added).drop("leaf", "own", "path"))


def _key(name: str):
    return [F.col(f"r{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"{name}{i}") for i in (1, 2)]


def _rooted(cut: DataFrame, band: int) -> DataFrame:
    """`cut` with r1, r2: the key of the prefix before each band, zero for the first one."""
    zero = F.lit(0).cast("long")
    first, deep = cut.where(F.col("length") <= band), cut.where(F.col("length") > band)
    # a narrow row for each `band` turns of a conversation
    before = Window.partitionBy("conv").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    roots = deep.select("conv", "j", *[F.coalesce(F.bit_xor(f"x{i}").over(before), zero).alias(f"r{i}") for i in (1, 2)])
    return first.withColumns({"r1": zero, "r2": zero}).unionByName(deep.join(roots, ["conv", "j"]))


def _sequences(cut: DataFrame) -> DataFrame:
    """The different bands of `cut`, each with how many conversations have it, the smallest of them, and what follows them in the next bands."""
    firsts = [F.first(c).alias(c) for c in ("d1", "d2", "words")]
    same = cut.groupBy("r1", "r2", "j", "x1", "x2").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"), *firsts)
    return same.select("r1", "r2", *_key("e"), "j", "n", "conv", "more_leaves", "more_saved", "d1", "d2", "words")


def _with_next_bands(cut: DataFrame, band: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(cut, kids): `cut` with the leaves and saved tokens of the bands after each, counted at the smallest conversation that has them; and (e1, e2, kids), children of the bands' ends."""
    deep = cut.where(F.col("length") > band).withColumns({"more_leaves": F.lit(0).cast("long"), "more_saved": F.lit(0).cast("long")})
    goes_on = deep.where(F.col("length") > (F.col("j") + 1) * band).select(*_key("e")).distinct().withColumn("kids", F.lit(1).cast("long"))
    later = _sequences(deep.where("j > 0")).join(goes_on, _KEYS, "left").withColumns({"kids": F.coalesce("kids", F.lit(0).cast("long")), "sha": F.lit("")})
    tops = stage(_merged(_parts(later, band, shard)).where("top").select("e1", "e2", "conv_id", (F.col("depth") / band).cast("long").alias("j"), "n_children", "n_leaves", "saved_tokens"))
    own = deep.select("conv", "j").join(tops.select(F.col("conv_id").alias("conv"), "j", "n_leaves", "saved_tokens"), ["conv", "j"], "left")
    after = Window.partitionBy("conv").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.select("conv", "j", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(name) for c, name in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))])
    return cut.join(sums, ["conv", "j"], "left"), tops.select("e1", "e2", F.col("n_children").alias("kids"))


def prefix_trie(conversations: DataFrame, band: int = BAND, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see `rebuilt`) of `conversations` (conv_id, turn, role, text).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of
    each: its smallest member, its depth from the root at 0, its parent's smallest member (null
    for the root), its members, its children, the childless nodes of its subtree, itself
    included, the sum over the subtree of (members - 1) x words of the node's last text, and
    SHA-256 of the members that end here.

    Turns are ordered by `turn`, nulls first, equal ones by hashes of their role and text;
    repeated rows stay each for itself. Null roles and texts are empty. Rows without a conv_id
    take no part. An empty table gives an empty one, without a root. Texts and conversations of
    any length are read whole; other columns are not read.
    """
    spark = conversations.sparkSession
    lengths, turns = rebuilt(placed_turns(conversations))
    lengths = stage(lengths)
    all_ = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("length").alias("longest")).first()
    if not all_["n"]:
        return spark.createDataFrame([], _NODE)
    cut = stage(_rooted(stage(bands(turns, band)), band))

    last = cut.where((F.col("j") + 1) * band >= F.col("length")).select(*_key("e"), "conv")
    turnless = lengths.where("length = 0").select(F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2"), "conv")
    ends = stage(ends_hashes(last.unionByName(turnless)))
    nothing = F.lit(0).cast("long")
    if all_["longest"] > band:
        grown, kids = _with_next_bands(cut, band, shard)
        sequences = _sequences(grown).join(kids, _KEYS, "left")
    else:
        sequences = _sequences(cut.withColumns({"more_leaves": nothing, "more_saved": nothing})).withColumn("kids", nothing)
    totals = {c: F.coalesce(c, nothing) for c in ("kids", "more_leaves", "more_saved")}
    sequences = stage(sequences.join(ends, _KEYS, "left").withColumns(totals))
    parts = stage(_parts(sequences, band, shard))
    shared = _merged(parts)

    top = shared.where("top and depth = 0").select("n_children", "n_leaves", "saved_tokens").first() or (0, 0, 0)
    sha = ends.where("e1 = 0 and e2 = 0").select("sha").first()
    root = spark.createDataFrame([(all_["conv"], 0, None, all_["n"], top[0], max(1, top[1]), top[2], sha["sha"] if sha else _EMPTY)], _NODE)
    names = root.columns
    # parents of nodes that no shard knows: shared nodes, or the ends of the bands before
    of_shared = shared.where("not top").select(F.col("e1").alias("f1"), F.col("e2").alias("f2"), F.lit(False).alias("f_top"), F.col("conv_id").alias("parent"))
    of_bands = sequences.select(F.col("e1").alias("f1"), F.col("e2").alias("f2"), F.lit(True).alias("f_top"), F.col("conv").alias("parent"))
    parents = of_shared.unionByName(of_bands) if all_["longest"] > band else of_shared
    open_ = parts.where(F.col("kind") == _OPEN).drop("kind", "path").unionByName(shared.where("not top").withColumn("parent_conv_id", F.lit(None).cast("long")))
    below_root = open_.where("at_root").withColumn("parent_conv_id", F.lit(all_["conv"]).cast("long"))
    others = open_.where("not at_root").join(parents, ["f1", "f2", "f_top"], "left").withColumn("parent_conv_id", F.col("parent"))
    found = parts.where(F.col("kind") == _FINAL).select(*names).unionByName(below_root.select(*names)).unionByName(others.select(*names))
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).unionByName(root)
