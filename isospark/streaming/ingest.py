"""Landed responses as a stream: the same parsing, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isospark.functions.schemas import RESPONSE
from isospark.operators.isotherms import binary_mixture, single_component
from isospark.sources.ingest import experiments_from_docs, latest_valid, parse_responses


def response_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def measurements(responses: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(single, binary) measurements of a stream of experiment responses; row-local, so no state is kept."""
    experiments = experiments_from_docs(parse_responses(responses, schema)[0])
    return single_component(experiments), binary_mixture(experiments)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet what has arrived, then stop; a later call goes on from `checkpoint`."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def write_latest(responses: DataFrame, schema: str, path: str, checkpoint: str, attempt: str = "ordinal") -> StreamingQuery:
    """Keep the last valid try of each response up to date, in whatever order and batch tries arrive, then stop.

    The state has each key's best try so far. A batch writes the keys that it changes in a
    folder of its own, which a batch that is run again replaces; `read_latest` puts them together.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    found = latest_valid(responses, schema, attempt)
    return found.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """(key, doc, attempt column) of each key as the last batch that changed it left it."""
    found = spark.read.parquet(path)
    columns = [c for c in found.columns if c != "batch"]
    return found.groupBy("key").agg(F.max_by(F.struct(*[c for c in columns if c != "key"]), "batch").alias("x")).select("key", "x.*").select(*columns)
