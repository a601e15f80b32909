"""How filters of a corpus interact, for each order in which they could be applied.

A document is a mask of the filters it fails. Masks are counted in Spark, so that each part of
the corpus is left with a few numbers. An order of the filters is a row of positions, the
inverse of its permutation. The step that removes a mask in an order is the smallest position
of a filter it fails: the min-plus product of the mask matrix (0 where it fails, infinity
elsewhere) with the transposed position matrix. Weights are scattered to these steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isospark.llm.common import let_go, slices, stage

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = r"[\x20\x09-\x0D]+"
#: What is counted beside the documents themselves.
_WEIGHTS = ("documents", "good", "toxic")
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions on a text alone, by letter; a null text is empty. A: under 200 words; B: under half of the words are different; C: over 2 % capitals A-Z; D: one of #$%&*|."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, _SPACES), lambda w: w != "")
    return {
        "A": F.regexp_count(whole, F.lit(_WORD)) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(whole, F.lit("[A-Z]")) * 100 > F.char_length(whole) * 2,
        "D": whole.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame | None, filters: dict[str, Column], repeats: bool = True, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, documents, good, toxic): how many documents of a part fail just the filters of `mask`, and how many of those have quality or toxic 1.

    Bit i of `mask` is the i-th of `filters`; the next one, if `repeats`, is set for a text
    that is the same as one of a smaller id, anywhere in the table. A null part is ''. A null id
    has no smaller one and is none, and has no labels; of several labels of an id the largest
    counts.

    Only digests of texts are shuffled, and equal rows are one. The smallest id of each digest
    is joined back on digest and id together, so a text that very many rows have is no hot key.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    counted = rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("documents"))
    if repeats:
        counted = stage(counted)
        # null ids repeat nothing, and nothing repeats them
        least = counted.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        again = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(filters)).otherwise(0)
        counted = counted.join(least, ["digest", "id"], "left").withColumn("mask", F.col("mask") + again)
    counted = counted.groupBy("id", "part", "mask").agg(F.sum("documents").alias("documents"))
    marks = {"good": "quality", "toxic": "toxic"}
    if labels is None:
        weighed = counted.withColumns({name: F.lit(0).cast("long") for name in marks})
    else:
        known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*[F.max(c).alias(f"_{name}") for name, c in marks.items()])
        weighed = counted.join(known, "id", "left").withColumns({name: F.when(F.col(f"_{name}") == 1, F.col("documents")).otherwise(0) for name in marks})
    return weighed.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in _WEIGHTS])


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders (n! x n, the filter of each step) and the step, from 0, at which each removes each mask (2**n x n!); n where none does."""
    orders = np.array(list(permutations(range(n_filters))), np.int64)
    positions = np.argsort(orders, axis=1)
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    costs = np.where(fails == 1, 0, n_filters)  # the min-plus mask matrix: n_filters is as good as infinity
    steps = np.full((1 << n_filters, len(orders)), n_filters, np.int64)
    for f in range(n_filters):
        np.minimum(steps, costs[:, f, None] + positions[None, :, f], out=steps)
    return orders, steps


def audit(weights: np.ndarray, orders: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each order and step (n! x n each) of one part, from its `weights` (2**n x 3: documents, good and toxic ones of each mask)."""
    n_orders, n = orders.shape
    at = (np.arange(n_orders) * (n + 1) + steps).ravel()  # the last slot is for what no filter removes
    lost = [np.bincount(at, np.repeat(w, n_orders), n_orders * (n + 1)).reshape(n_orders, n + 1)[:, :n].round().astype(np.int64) for w in weights.T.astype(float)]
    removed = lost[0]
    own = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    failing, only = own.T @ weights[:, 0], weights[1 << np.arange(n), 0]
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, removed)
    return {
        "kept": weights[:, 0].sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": failing[orders] - removed, "unique_fails": only[orders],
        "good_lost": lost[1], "toxic_lost": lost[2], "shapley": shapley[orders],
    }


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): n! x n rows for each part of `counted` (as `masks` gives it)."""
    n = len(letters)
    # at most 2**n entries for each part
    parts = counted.groupBy("part").agg(F.collect_list("mask").alias("mask"), *[F.collect_list(w).alias(w) for w in _WEIGHTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        orders, steps = removal_steps(n)
        names = np.array(["".join(letters[f] for f in order) for order in orders.tolist()])
        for batch in slices(batches, 64):
            found = {c: [] for c in _COUNTS}
            for i in range(batch.num_rows):
                at, *each = (np.array(c[i].as_py(), np.int64) for c in batch.columns[1:])
                weights = np.zeros((1 << n, len(_WEIGHTS)), np.int64)
                weights[at] = np.stack(each, axis=1)
                for c, x in audit(weights, orders, steps).items():
                    found[c].append(x.ravel())
            rows = pa.array(np.repeat(np.arange(batch.num_rows), len(orders) * n))
            order = pa.array(np.tile(np.repeat(names, n), batch.num_rows))
            step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), batch.num_rows * len(orders)))
            counts = [pa.array(np.concatenate([*found[c], np.empty(0, np.int64)]).astype(np.int64)) for c in _COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), order, step, *counts], names=["part", "filter_order", "step", *_COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of filters A to D on texts and E, repeats of a smaller id's text, in each source of `docs` and all 120 orders.

    Counts are of documents. Null texts are empty: they fail A, and E if a smaller id's is empty
    too. Rows with a null id fail no E and have no labels; repeated rows count each, and rows of
    one id don't repeat each other. A null source is ''. Whole texts of any length are read;
    an empty table gives an empty one; other columns are not read.
    """
    filters = text_filters()
    return interactions(masks(docs, labels, filters), "".join(filters) + "E")
