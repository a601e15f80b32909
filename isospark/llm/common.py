"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isospark.functions.staging import discard, stage  # noqa: F401  (used by the operators)

_held: dict = {}
#: Ranks that one row gives at a time.
RUN = 100_000


def held(key, make):
    """What `make` gives, kept in a Python worker for its next tasks, alone: another key's goes, as workers outlive stages."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For tasks that keep nothing: what an earlier stage kept goes."""
    _held.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes of texts, binaries and lists each row has."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_list(column.type):
            total += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return total


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, megabytes: int = 32) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most `rows` rows and `megabytes` MB; a row that is larger is a slice of its own."""
    for batch in batches:
        ends, start = np.cumsum(_row_bytes(batch)), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            fit = int(np.searchsorted(ends, before + (megabytes << 20), "right"))
            end = min(start + rows, max(start + 1, fit))
            yield batch.slice(start, end - start)
            start = end


def map_slices(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 512, megabytes: int = 32) -> DataFrame:
    """`df.mapInArrow(run, schema)` on bounded slices of batches; the session's settings are neither needed nor changed."""
    return df.mapInArrow(lambda batches: run(slices(batches, rows, megabytes)), schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return [x or "" for x in column.to_pylist()]


def ranked(df: DataFrame, group: list[str], buckets: int, rank: str = "rank") -> DataFrame:
    """Each row with a gapless rank from 0 in its group, without one task for a group. `group` holds no nulls.

    Equal rows are counted first (a key that fills a third of the table is one row then) and
    come back at the end, in runs of at most RUN ranks that are dealt out. A group is dealt to
    `buckets` hash buckets; the buckets' sizes, a table of at most groups x buckets rows, give
    where each one's ranks begin.
    """
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy(*group, "_b").agg(F.sum("_n").alias("_m"))
    first = sizes.select(*group, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy(*group, "_b").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_first") + F.coalesce(F.sum("_n").over(inner), F.lit(0))
    placed = counted.join(first, [*group, "_b"]).withColumn("_start", start)
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {RUN}"))))
    dealt = runs.repartition("_run", *cols)
    low, high = F.col("_run") * RUN, F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1
    return dealt.select(*cols, F.explode(F.sequence(F.col("_start") + low, F.col("_start") + high)).alias(rank))
