"""Datasets as Parquet or `;`-separated CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """`df` with arrays, maps and structs as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema])


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        flatten_for_csv(df).write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
