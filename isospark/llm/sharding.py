"""Consistent hashing with bounded loads, in DataFrame functions only.

The ring is cut into cells. Virtual nodes own the cells up to the next node, clockwise. Rows
are counted by cell, a table of at most `cells` rows at any input size, and the counts are
placed: a shard takes its own cells' rows up to its bound, and rows over it continue clockwise
to the next virtual node whose shard has room. Rows find their shard by cell and rank in it.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.llm.common import ranked

CELL_BITS, NODES = 14, 400
_MIX = 0x9E3779B97F4A7C15


def _mixed(x: int) -> int:
    """A 64-bit mix of an integer, for the places of virtual nodes."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def ring(n_shards: int, cells: int, nodes: int = NODES) -> list[int]:
    """The shard of each cell: that of the last virtual node at or before it. Adding a shard adds nodes and moves none."""
    at: dict[int, tuple[int, int]] = {}
    for shard in range(n_shards):
        for node in range(nodes):
            place = _mixed((shard * nodes + node + 1) * _MIX & 0xFFFFFFFFFFFFFFFF)
            cell = place % cells
            at[cell] = min(at.get(cell, (place, shard)), (place, shard))
    owner = at[max(at)][1]
    return [owner := at[c][1] if c in at else owner for c in range(cells)]


def bounded_plan(counts: dict[int, int], n_shards: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, slot of the first) for the rows of each cell.

    The bounds are the even shares: the rows by the number of shards, one more for the first
    ones where that leaves a rest. They hold exactly all rows, so each shard is filled.
    """
    owners = ring(n_shards, cells)
    share, rest = divmod(sum(counts.values()), n_shards)
    room = [share + (s < rest) for s in range(n_shards)]
    filled, rows = [0] * n_shards, []

    def take(cell: int, first: int, left: int, shard: int) -> int:
        n = min(left, room[shard])
        if n:
            rows.append((cell, first, first + n - 1, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return n

    waiting: deque[tuple[int, int, int]] = deque()
    for cell in sorted(counts):
        n = take(cell, 0, counts[cell], owners[cell])
        if n < counts[cell]:
            waiting.append((cell, n, counts[cell] - n))
    for cell, first, left in waiting:
        at = cell
        while left:  # the bounds hold all rows, so there is room before the ring has been walked
            at = (at + 1) % cells
            n = take(cell, first, left, owners[at])
            first, left = first + n, left - n
    return rows


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cell_bits: int = CELL_BITS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row of `docs`, by the law `rows`.

    Shards' row counts are at most one apart, also with repeated rows, null ids and null texts
    (no bytes). A row's place on the ring is that of its id and its text's checksum, so that an
    id that many rows share does not fill one cell. Text is read once, for its size and
    checksum, and is never shuffled, whatever its length. An empty table gives an empty one;
    other columns are not read.
    """
    cells = 1 << cell_bits
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.withColumn("cell", F.shiftrightunsigned(F.xxhash64("id", "text_crc32"), 64 - cell_bits).cast("int"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    plan = docs.sparkSession.createDataFrame(bounded_plan(counts, n_shards, cells), "_cell int, _first long, _last long, shard int, _slot long")
    buckets = max(1, sum(counts.values()) // cells // 200_000)
    placed = ranked(rows, ["cell"], buckets, "_rank").join(F.broadcast(plan), (F.col("cell") == F.col("_cell")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
    slot = (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
