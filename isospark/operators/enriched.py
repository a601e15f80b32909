"""Properties of the gas beside each measurement, by tables that are laid out for the join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a gas that go to one bucket, about; a gas with more is dealt to several.
SHARE = 1_000_000


def salts(measurements: DataFrame, name: str, share: int = SHARE) -> DataFrame:
    """(name, salts) of the gases with over `share` rows: how many shares they are dealt in."""
    counts = measurements.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > share).select("name", F.ceil(F.col("n") / share).cast("int").alias("salts"))


def lay_out(measurements: DataFrame, properties: DataFrame, name: str, tables: tuple[str, str], paths: tuple[str, str], buckets: int = 32, share: int = SHARE) -> None:
    """Write both as tables bucketed and sorted by (gas_key, salt): `measurements` by their gas `name`, `properties` by `name`, one row for each name in small letters.

    A few gases have nearly all rows. Those over `share` rows are dealt by a salt, and their
    properties repeated for each of its values, so a join of the tables moves no row and has no
    bucket that one gas fills. There are at most rows / `share` such gases.
    """
    known = measurements.sparkSession.createDataFrame([tuple(r) for r in salts(measurements, name, share).collect()], "name string, salts int")
    of = F.broadcast(known.select(F.struct("name", "salts").alias("_hot")))
    row = F.struct(*measurements.columns).alias("_row")
    dealt = measurements.select(row).join(of, F.lower(f"_row.`{name}`") == F.col("_hot.name"), "left")
    hashed = [F.col(f"_row.`{f.name}`") for f in measurements.schema if f.dataType.typeName() not in ("map", "variant")]
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*hashed), F.col("_hot.salts"))).otherwise(0).cast("int")
    _write(dealt.select(F.lower(f"_row.`{name}`").alias("gas_key"), salt.alias("salt"), "_row"), tables[0], paths[0], buckets)
    best = properties.groupBy(F.lower("name").alias("gas_key")).agg(F.min(F.struct(*[c for c in properties.columns if c != "name"])).alias("properties"))
    repeated = best.join(of, F.col("gas_key") == F.col("_hot.name"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("_hot.salts", F.lit(1)) - 1)))
    _write(repeated.select("gas_key", "salt", "properties"), tables[1], paths[1], buckets)


def _write(df: DataFrame, table: str, path: str, buckets: int) -> None:
    df.repartition(buckets, "gas_key", "salt").write.bucketBy(buckets, "gas_key", "salt").sortBy("gas_key", "salt").mode("overwrite").option("path", path).saveAsTable(table)


def with_properties(spark: SparkSession, tables: tuple[str, str]) -> DataFrame:
    """Each measurement with its gas's properties, null where there are none: both tables' buckets are joined where they lie. A column of both names is the measurement's."""
    one, other = (spark.table(t) for t in tables)
    joined = one.hint("merge").join(other, ["gas_key", "salt"], "left")
    own = one.schema["_row"].dataType.names
    return joined.select("_row.*", *[F.col(f"properties.`{c}`").alias(c) for c in other.schema["properties"].dataType.names if c not in own])
