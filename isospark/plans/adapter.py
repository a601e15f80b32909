"""Nested experiments, responses and registries made from the driver's flat tables: one order is one experiment, one line item one point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.functions.schemas import VALID_UPTAKE_UNITS

UNITS = (*VALID_UPTAKE_UNITS, "mmol/cm3", "molecules/cage")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    species = "struct((1 - l_discount) AS composition, l_quantity * (1 - l_discount) AS adsorption)"
    second = "struct((l_discount + 0.0D) AS composition, (l_quantity * l_discount + 0.0D) AS adsorption)"
    points = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.expr("sort_array(collect_set(l_returnflag))").alias("flags"),
        F.expr(f"""sort_array(collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1000 - 5 AS pressure,
            CASE WHEN l_tax <> 0 THEN l_quantity END AS total_adsorption,
            CASE WHEN l_linenumber % 5 = 0 THEN array({species}) ELSE array({species}, {second}) END AS species_data)))""").alias("pts"),
    )
    return table(spark, sf_dir, "orders").join(points, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("order-"), "o_orderkey").alias("filename"), F.lit("doi").alias("DOI"), F.col("o_orderstatus").alias("category"), F.expr("cast(o_orderdate as string)").alias("date"),
        F.lit("t").alias("tabular_data"), F.lit("i").alias("isotherm_type"), F.lit("d").alias("digitizer"), F.lit("a").alias("articleSource"), F.lit("c").alias("concentrationUnits"),
        F.struct(F.expr("cast(o_custkey as string)").alias("hashkey"), F.col("o_orderpriority").alias("name")).alias("adsorbent"),
        F.expr("transform(coalesce(flags, cast(array() as array<string>)), f -> struct(f AS InChIKey, concat('gas ', f) AS name))").alias("adsorbates"),
        F.expr("cast(o_orderkey % 101 as double) - 1").alias("temperature"), F.expr("if(o_custkey % 2 = 0, 'bar', 'Pa')").alias("pressureUnits"),
        F.get(F.array(*map(F.lit, UNITS)), F.expr("cast(o_custkey % 13 as int)")).alias("adsorptionUnits"),
        F.expr("transform(pts, p -> struct(p.pressure AS pressure, p.total_adsorption AS total_adsorption, p.species_data AS species_data))").alias("isotherm_data"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS ordinal", "cast(user_id as string) AS key", "concat('https://example.org/', event_id) AS url", "if(event_type = 'error', 500, 200) AS status",
        "if(event_id % 10 = 5, 'text/html', 'application/json; charset=utf-8') AS content_type", "if(event_id % 10 = 0, substr(props, 1, 4), props) AS body",
    )


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with supplier names as documents; every seventh has no name."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS ordinal", "cast(s_suppkey as string) AS key", "'' AS url", "200 AS status", "'application/json' AS content_type", "if(s_suppkey % 7 = 0, '{}', to_json(struct(s_name AS name))) AS body")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_name not like '% ring'").selectExpr(
        "p_name AS lookup_name", "cast(p_partkey as int) AS hit_rank", "p_brand AS atoms", "p_size AS heavy_atom_count", "p_type AS bonds", "split(p_name, ' ') AS elements", "p_retailprice AS molecular_weight",
        "p_brand AS molecular_formula", "p_type AS canonical_smiles", "p_size AS h_bond_acceptor_count", "p_size AS h_bond_donor_count",
    )


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("value").cast("decimal(18,6)")).cast("double").alias("mean"))


def wide_user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five numbers of each user: events, and mean, least, greatest and number of different values."""
    value = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(value.cast("decimal(18,6)")).cast("double").alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.countDistinct("event_type").cast("double").alias("kinds"),
    )


def gas_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of the gases, by parts in place of registry hits: gas A and gas N have some, gas R has none."""
    hits = table(spark, sf_dir, "part").selectExpr("concat('GAS ', substr('ANXY', cast(p_partkey % 4 as int) + 1, 1)) AS name", "p_partkey", "p_retailprice AS molecular_weight", "p_brand AS molecular_formula")
    return hits.groupBy("name").agg(F.min_by(F.struct("molecular_weight", "molecular_formula"), "p_partkey").alias("x")).select("name", "x.*")
