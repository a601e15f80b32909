"""The corpus pipeline: documents are filtered, deduplicated, trimmed and packed, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.llm import packing, simhash, substrings, toxicity
from isospark.llm.common import discard, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the model learns from `labels` of these documents.

    Null and empty texts are judged by the model's bias alone. Without labelled documents each
    score is 0.5, so none stays. Repeated rows and null ids are judged each for itself; texts of
    any length are read whole; an empty table gives an empty one; other columns keep their values.
    """
    score = toxicity.scorer(spark, *toxicity.train_on(docs, table(spark, sf_dir, "labels")))
    return docs.where(score("text") < toxicity.THRESHOLD)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key, component) of each row: a hash of its text, and the component of that text.

    Links are pairs of different texts whose sets of five-word shingles have a Jaccard likeness of
    0.8 or more: SimHash fingerprints give the candidates, the shingle sets verify them. Null
    texts are empty ones; texts without words are like each other.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    texts = stage(keyed.groupBy("key").agg(F.first("text").alias("text")).withColumnRenamed("key", "node"))
    found = stage(simhash.near_texts(texts))
    discard(texts)
    return keyed.select("doc_id", "key").join(found.withColumnRenamed("node", "key"), "key")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id, and of that id's texts the one with the least hash.

    Rows with a null id stay. Of rows that are the same in id and text one stays: the first by
    their other columns that have an order.
    """
    known = near_copies(docs).where("doc_id is not null")
    first = known.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.doc_id", "first.key")
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"))
    keyed = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("key"))
    others = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    kept = keyed.join(first, ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.min_by("row", F.struct(F.lit(0), *others)).alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that a smaller id has; n_chars follows the text.

    Null texts stay null, with a null n_chars. For all else see `substrings.without_repeats`.
    """
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens; see `packing.packed_documents` for nulls, empty and long texts, empty tables and other columns."""
    return packing.packed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("substring_dedup", drop_repeats), ("packing", pack)]
#: The model and the tokenizer are out of SQL's reach; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's result is written, and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
