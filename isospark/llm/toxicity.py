"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each task learns from its share of the labelled rows, with a rate for each coordinate; the
shares' weights are averaged and the next round starts from the average. The L1 term leaves
most weights at zero, so what is broadcast is small: at most 2**BITS numbers at any input size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.llm.common import let_go, map_slices, slices, stage
from isospark.llm.pretokens import utf8

BITS = 20
THRESHOLD = 0.3
#: Labelled rows that a round learns from at most; more are sampled by a hash of their text, of equal rows as many as their part of all.
MOST_ROWS = 32_000
#: Rows of a share, about; rounds.
PER_SHARE, ROUNDS = 8_000, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.5
_NOT_LETTERS = r"[^\p{L}\p{N}]+"
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Features:
    """Hashes of the words, two-word runs and one-word skips of a batch of texts."""

    def __init__(self, texts: pa.Array):
        lower = pc.utf8_lower(utf8(texts))
        parts = pc.split_pattern_regex(lower, _NOT_LETTERS)
        flat = parts.flatten().dictionary_encode()
        hashes = pd.util.hash_array(np.array(flat.dictionary.to_pylist(), object), categorize=False).astype(np.uint64) if len(flat.dictionary) else np.empty(0, np.uint64)
        self.words = hashes[flat.indices.to_numpy(zero_copy_only=False)]
        self.ends = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)))

    def of(self, i: int) -> np.ndarray:
        """The different features of text i, each once."""
        w = self.words[self.ends[i] : self.ends[i + 1]]
        pairs = w[:-1] * _C[0] + w[1:] * _C[1]
        skips = w[:-2] * _C[2] + w[2:] * _C[1]
        mixed = np.concatenate([w, pairs, skips])
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _C[0]
        return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int32))


def ftrl(rows: list[tuple[np.ndarray, float]], start: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Weights and bias after one pass over `rows` (features, label) from `start`.

    z is set so that the closed form gives `start` until a coordinate is seen.
    """
    n, z = np.zeros(len(start) + 1), np.zeros(len(start) + 1)
    w0 = np.append(start, bias)
    z = -(w0 * (BETA / ALPHA + L2)) - np.sign(w0) * L1
    z[-1] = -w0[-1] * (BETA / ALPHA + L2)
    for features, label in rows:
        at = np.append(features, len(start))
        zi, ni = z[at], n[at]
        l1 = np.full(len(at), L1)
        l1[-1] = 0.0
        w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g
    l1 = np.append(np.full(len(start), L1), 0.0)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:-1], float(w[-1])


def learner(held, turn: int):
    """What a share does in a round: one pass over its rows, in an order drawn for the round, from the held weights."""

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        let_go()
        at, values, bias = held.value
        start = np.zeros(1 << BITS)
        start[at] = values
        group = group.sort_values(["h", "label", "i"], kind="stable")
        rows = [np.frombuffer(f, np.int32) for f in group["features"]]
        labels, order = group["label"].to_numpy(), np.random.default_rng(turn).permutation(len(group))
        w, b = ftrl([(rows[k], labels[k]) for k in order], start, bias)
        kept = np.flatnonzero(w)
        return pd.DataFrame({"at": np.append(kept, -1).astype(np.int64), "w": np.append(w[kept], b)})

    return learn


def hashed(rows: DataFrame) -> DataFrame:
    """`rows` with `features` (the text's different features as 32-bit integers) in place of `text`, which is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            features = Features(batch.column(batch.num_columns - 1))
            made = pa.array([features.of(i).tobytes() for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "features"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_slices(rows, run, f"{schema}, features binary")


def sampled(labelled: DataFrame, part: float, shares: int) -> DataFrame:
    """(h, label, i, share, text): a part of `labelled` (text, label), dealt to shares; h is a hash of the text, i counts its copies.

    Equal rows are counted first: of n, n * part are kept, and a hash of the text decides on the
    rest below one. The kept ones go to the shares in turn, so a text that very many rows have
    is in its part of the sample, and in no share alone.
    """
    keyed = labelled.withColumn("h", F.xxhash64("text", F.lit(1)))
    many = F.col("n") * F.lit(part)
    lucky = (F.pmod(F.col("h"), F.lit(1 << 30)) < F.floor((many - F.floor(many)) * (1 << 30))).cast("long")
    drawn = keyed.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n")).select("h", "label", (F.floor(many) + lucky).alias("kept")).where("kept > 0")
    # at most about as many rows as the sample
    texts = keyed.join(F.broadcast(drawn), ["h", "label"]).groupBy("h", "label", "kept").agg(F.min("text").alias("text"))
    copies = texts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kept") - 1)))
    share = F.pmod(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(shares)) + F.col("i"), F.lit(shares)).cast("int").alias("share")
    return copies.select("h", "label", "i", share, "text")


def train(labelled: DataFrame, most_rows: int = MOST_ROWS, per_share: int = PER_SHARE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias from `labelled` (text, label 0 or 1); rows with a null label are left out.

    Up to about `most_rows` rows are learned from, as `sampled` draws them. They are dealt to shares of about
    `per_share` rows, whose size and number are bounded however large the table is. Without any
    rows the weights are zero, so each score is 0.5.
    """
    spark = labelled.sparkSession
    labelled = labelled.where("label is not null").select("text", F.col("label").cast("double").alias("label"))
    known = labelled.count()
    part, shares = min(1.0, most_rows / max(1, known)), max(1, round(min(known, most_rows) / per_share))
    sample = stage(hashed(sampled(labelled, part, shares)))  # features are made once, not in each round
    weights, bias = np.zeros(1 << BITS), 0.0

    for turn in range(rounds):
        held = spark.sparkContext.broadcast((np.flatnonzero(weights).astype(np.int32), weights[np.flatnonzero(weights)], bias))

        learned = sample.groupBy("share").applyInPandas(learner(held, turn), "at long, w double")
        # one row for each weight that is not zero: at most 2**BITS
        found = learned.groupBy("at").agg((F.sum("w") / shares).alias("w")).toPandas().sort_values("at")
        held.unpersist()
        weights = np.zeros(1 << BITS)
        of = found[found["at"] >= 0]
        weights[of["at"].to_numpy()] = of["w"].to_numpy()
        bias = float(found.loc[found["at"] < 0, "w"].sum())
    return weights, bias


def scorer(spark: SparkSession, weights: np.ndarray, bias: float) -> Callable[[str], Column]:
    """A function that gives a text column's scores, from 0 to 1: texts go to Python once, and only scores come back.

    Null and empty texts are scored by the bias alone; texts of any length are scored whole.
    """
    at = np.flatnonzero(weights)
    held = spark.sparkContext.broadcast((at.astype(np.int32), weights[at], bias))

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        at, values, bias = held.value
        dense = np.zeros(1 << BITS)
        dense[at] = values
        for column in columns:
            margins = []
            for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
                features = Features(part.column(0))
                margins += [dense[features.of(i)].sum() + bias for i in range(part.num_rows)]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(margins, float), -35, 35))), pa.float64())

    return score


def scores(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of `docs`; see `scorer`. Other columns are not read; an empty table gives an empty one."""
    return docs.select(F.col(id_col), scorer(docs.sparkSession, weights, bias)(text_col).alias("score"))


def held_out(id_col: str = "doc_id"):
    """Whether a row's label may not be learned from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, **options) -> tuple[np.ndarray, float]:
    """`train` on the documents that have one label that is not held out; an id with several labels counts with the largest."""
    known = labels.where("toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return train(docs.select("doc_id", "text").where(~held_out()).join(known, "doc_id").select("text", "label"), **options)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`, learned from `labels` (doc_id, toxic).

    Null and empty texts have the bias's score; without labelled rows each score is 0.5. Repeated
    rows and null ids stay each for itself; an empty table gives an empty one; texts of any
    length are scored whole; other columns are not read. Rows with a null label are not learned
    from, and of several labels of an id the largest counts.
    """
    scored = scores(docs, *train_on(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
