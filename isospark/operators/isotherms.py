"""Nested experiments to flat measurements. Row-local: no shuffle between scan and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.functions.schemas import METADATA_COLS

_COMMON = ["filename", "temperature", "pressureUnits", "adsorptionUnits", "numGuests", "adsorbent_name"]


def drop_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*METADATA_COLS)


def with_species(df: DataFrame) -> DataFrame:
    """`df` with ids and names of adsorbent and adsorbates."""
    return df.withColumns({
        "adsorbent_id": F.col("adsorbent.hashkey"), "adsorbent_name": F.col("adsorbent.name"),
        "adsorbates_id": F.col("adsorbates.InChIKey"), "adsorbates_name": F.col("adsorbates.name"),
    })


def with_num_guests(df: DataFrame) -> DataFrame:
    return df.withColumn("numGuests", F.size("adsorbates"))


def guest_cardinality(df: DataFrame) -> DataFrame:
    """Experiments by number of guests; those of other numbers than 1 and 2 are in neither dataset."""
    return with_num_guests(df).groupBy("numGuests").agg(F.count(F.lit(1)).alias("experiments"))


def split_by_guests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(single, binary): experiments with one guest and with two. Without any, an empty frame."""
    known = with_num_guests(df)
    return known.where("numGuests = 1"), known.where("numGuests = 2")


def exploded_single(df: DataFrame) -> DataFrame:
    """One row for each point of the single-guest experiments, nulls included. Field paths keep the scan to the two fields."""
    single = with_species(split_by_guests(drop_metadata(df))[0])
    points = F.arrays_zip(F.col("isotherm_data.pressure").alias("p"), F.col("isotherm_data.total_adsorption").alias("a"))
    rows = single.select(*_COMMON, "adsorbates_name", F.posexplode(points).alias("point_idx", "pt"))
    return rows.select(*_COMMON, "adsorbates_name", "point_idx", F.col("pt.p").cast("float").alias("pressure"), F.col("pt.a").cast("float").alias("adsorbed_amount"), F.lit(1.0).alias("composition"))


def single_component(df: DataFrame, not_null: list[str] | None = None) -> DataFrame:
    """Measurements of single gases. Rows with a null or NaN in `not_null`, by default any column, go."""
    return exploded_single(df).dropna("any", subset=not_null)


def binary_mixture(df: DataFrame, fill_missing_species: bool = True, keep_total_pressure: bool = False, not_null: list[str] | None = None) -> DataFrame:
    """Measurements of two-gas mixtures.

    Where a point has no second species, composition and uptake are 1.0, marked in
    compound_2_filled; with `fill_missing_species` off they are null, so the row goes.
    """
    binary = with_species(split_by_guests(drop_metadata(df))[1])
    points = F.arrays_zip(F.col("isotherm_data.pressure").alias("p"), F.col("isotherm_data.species_data").alias("s"))
    total = [F.col("isotherm_data.pressure").alias("total_pressure")] if keep_total_pressure else []
    rows = binary.select(*_COMMON, "adsorbates_name", *total, F.posexplode(points).alias("point_idx", "pt"))
    one, two = F.get("pt.s", F.lit(0)), F.get("pt.s", F.lit(1))
    filled = F.size("pt.s") < 2
    instead = F.lit(1.0) if fill_missing_species else F.lit(None).cast("double")
    rows = rows.withColumns({
        "c1": one["composition"], "a1": one["adsorption"], "compound_2_filled": filled,
        "c2": F.when(filled, instead).otherwise(two["composition"]), "a2": F.when(filled, instead).otherwise(two["adsorption"]),
    })
    flat = rows.select(
        *_COMMON, F.get("adsorbates_name", F.lit(0)).alias("compound_1"), F.get("adsorbates_name", F.lit(1)).alias("compound_2"), "point_idx",
        F.col("c1").cast("float").alias("compound_1_composition"), F.col("c2").cast("float").alias("compound_2_composition"),
        (F.col("c1") * F.col("pt.p")).cast("float").alias("compound_1_pressure"), (F.col("c2") * F.col("pt.p")).cast("float").alias("compound_2_pressure"),
        F.col("a1").cast("float").alias("compound_1_adsorption"), F.col("a2").cast("float").alias("compound_2_adsorption"), "compound_2_filled", *[c for c in rows.columns if c == "total_pressure"],
    )
    return flat.dropna("any", subset=not_null)
