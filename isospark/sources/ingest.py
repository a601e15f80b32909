"""Landed inputs: index files, response tables, dataset files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from isospark.functions.schemas import NULL_TEXTS
from isospark.functions.staging import free_names, stage


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An index file, a JSON array of records, with the `ordinal` of each record from 0. An index is a short list; documents come as responses."""
    text = spark.read.text(path, wholetext=True)
    kind = ArrayType(_parse_datatype_string(schema)).simpleString()
    return text.select(F.posexplode(F.from_json("value", kind))).select(F.col("pos").cast("long").alias("ordinal"), "col.*")


def numbered(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """`df` with a dense ordinal from 0 by `key`: ranges of keys are ranked each for itself, after the sizes of those before."""
    part, n, least, first = free_names([*df.columns, ordinal], "_part", "_n", "_least", "_first")
    dealt = stage(df.repartitionByRange(key).withColumn(part, F.spark_partition_id()))
    # one row for each range
    before = Window.orderBy(least).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(n), F.min(key).alias(least))
    starts = parts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1
    return dealt.join(F.broadcast(starts), part).select((F.col(first) + rank).alias(ordinal), *df.columns)


def read_index_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An index of any length, written as JSON lines with the `ordinal` of each record."""
    return spark.read.schema(f"ordinal LONG, {schema}").json(path)


def head_fraction(df: DataFrame, fraction: float, ordinal: str = "ordinal") -> DataFrame:
    """The first ceil(fraction * n) rows by a dense ordinal from 0: a pushed filter, no sort."""
    n = df.count()
    keep = df.sparkSession.range(1).select(F.ceil(F.lit(float(fraction)) * F.lit(n)).alias("k")).first()["k"]
    return df.where(F.col(ordinal) < keep)


def detail_urls(df: DataFrame, key: str, template: str) -> DataFrame:
    """`df` with the address of each row's detail document; `template` has one %s."""
    return df.withColumn("url", F.format_string(template, F.col(key)))


def parse_responses(df: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) of a response table: documents as `doc`, and what has none, with the reason."""
    kind = _parse_datatype_string(schema)
    with_bad = StructType([*kind.fields, *_parse_datatype_string("_corrupt STRING").fields])
    doc = F.from_json("body", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    is_json = F.coalesce(F.col("content_type").startswith("application/json"), F.lit(False))
    reason: Column = (
        F.when(F.coalesce(F.col("status") != 200, F.lit(True)), "status")
        .when(~is_json, "content_type")
        .when(F.col("body").isNull() | F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull(), "body")
    )
    judged = df.select("ordinal", "key", "url", "status", "content_type", "body").withColumn("_doc", doc).withColumn("reason", reason)
    fields = F.struct(*[F.col(f"_doc.`{f.name}`").alias(f.name) for f in kind.fields])
    parsed = judged.where("reason is null").withColumn("doc", fields).select("ordinal", "key", "doc")
    return parsed, judged.where("reason is not null").select("ordinal", "key", "url", "status", "content_type", "reason")


def latest_valid(df: DataFrame, schema: str, attempt: str = "ordinal") -> DataFrame:
    """(key, doc, attempt) of the valid response with the greatest `attempt` of each key: of several tries, the last good one counts.

    Responses without a document, and those with a null key or attempt, don't count. Of valid
    ones with one attempt, the one with the greater body counts. It is an aggregation, so a
    stream of responses has it too, with one small state for each key.
    """
    body = df.withColumn("key", F.when(F.col(attempt).isNotNull(), F.col("key")))
    parsed = parse_responses(body.withColumn("ordinal", F.struct(F.col(attempt).alias("at"), "body")), schema)[0].where("key is not null")
    return parsed.groupBy("key").agg(F.max_by("doc", "ordinal").alias("doc"), F.max("ordinal.at").alias(attempt))


def experiments_from_docs(parsed: DataFrame) -> DataFrame:
    """The fields of the documents as columns."""
    return parsed.select("doc.*")


def host_names(parsed: DataFrame) -> DataFrame:
    """Each host's name, null where it has none."""
    return parsed.select(F.col("doc.name").alias("name"))


def guest_names(parsed: DataFrame) -> DataFrame:
    """Each guest's name, '' where it has none."""
    return parsed.select(F.coalesce("doc.name", F.lit("")).alias("name"))


def _typed(f: StructField) -> Column:
    """A dataset file's text as a value: several texts stand for null, arrays and structs are JSON."""
    value = F.when(~F.col(f.name).isin(*NULL_TEXTS), F.col(f.name))
    if isinstance(f.dataType, (ArrayType, StructType)):
        return F.from_json(value, f.dataType.simpleString()).alias(f.name)
    return value.try_cast(f.dataType).alias(f.name)


def read_dataset_csv(spark: SparkSession, path: str, schema: str, multiline: bool = True, in_parts: bool = False) -> DataFrame:
    """A `;`-separated dataset file; array columns are JSON text there, and several texts stand for null.

    With `multiline`, quoted values may hold line ends, so a file is one task's work; a very
    large file without such values is read in parts with it off. With `in_parts`, a very large
    file with such values is read in parts too (`csv_records`), which takes one scan more.
    """
    kind = _parse_datatype_string(schema)
    names = ", ".join(f"`{f.name}` STRING" for f in kind.fields)
    if in_parts:
        text = csv_records(spark, path).select(F.from_csv("record", names, {"sep": ";", "escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")
    else:
        text = spark.read.schema(names).option("sep", ";").option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", multiline).csv(path)
    return text.select(*map(_typed, kind.fields))


_WHOLE, _BEGIN, _GOES_ON, _END = 0, 1, 2, 3


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, kind, record) from lines in file order (file, block, value, open): whole records, and the pieces of those that reach over a block's edge."""
    now, state, kept, first = None, False, [], True

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "block", "kind", "record"])

    def rest() -> list[tuple]:
        return [(*now, _GOES_ON if first_open else _BEGIN, "\n".join(kept))] if kept else []

    first_open = False  # whether what is kept began in an earlier block
    for batch in batches:
        out: list[tuple] = []
        for file, block, line, opened in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (file, block):
                out += rest() if now is not None else []
                now, state, kept, first = (file, block), opened, [], block == 0
                first_open = opened
            kept.append(line)
            state ^= line.count('"') % 2 == 1
            if not state:
                record = "\n".join(kept)
                if first:
                    first = False  # the header
                elif first_open or record.strip("\r"):
                    out.append((*now, _END if first_open else _WHOLE, record))
                kept, first_open = [], False
        yield batch_of(out)
    yield batch_of(rest() if now is not None else [])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of each record of CSV files with headers, as text, line ends in quoted values included; the files' blocks are tasks of their own.

    Whether a block begins inside quotes is told by the number of quotes before it in its file:
    one scan counts them by block. In a second scan each block cuts its own records; the pieces
    of those that reach over an edge, at most two for a block, are put together at the end.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, "value")
    counted = lines.groupBy("file", "block").agg((F.sum(F.regexp_count("value", F.lit('"'))) % 2).alias("odd"))
    # one row for each block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_ = counted.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open")).where("open")
    # only blocks that begin inside a quoted value
    known = lines.join(F.broadcast(stage(open_)), ["file", "block"], "left").select("file", "block", "value", F.coalesce("open", F.lit(False)).alias("open"))
    cut = stage(known.mapInArrow(_records, "file string, block long, kind int, record string"))
    pieces = cut.where(F.col("kind") != _WHOLE)
    # at most two rows for each block
    chain = F.count_if(F.col("kind") == _BEGIN).over(Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == _BEGIN, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = pieces.withColumn("chain", chain).groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"))
    whole = joined.select(F.array_join("parts.record", "\n").alias("record"))
    return cut.where(F.col("kind") == _WHOLE).select("record").unionByName(whole).select(F.rtrim(F.col("record"), F.lit("\r")).alias("record"))
