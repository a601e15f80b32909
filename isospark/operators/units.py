"""Pressures in Pa and uptakes in mol/kg."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.functions.staging import stage

#: How much of the second unit one of the first is, and the power of the molar mass (g/mol) that comes with it.
PRESSURE_FACTORS = (
    ("bar", "Pa", 1e5, 0), ("mbar", "bar", 1e-3, 0), ("kPa", "Pa", 1e3, 0), ("MPa", "kPa", 1e3, 0), ("atm", "Pa", 101325.0, 0), ("Torr", "atm", 1 / 760, 0), ("mmHg", "Torr", 1.0, 0), ("psi", "Pa", 6894.757, 0),
)
#: 22.414 l is a mole of gas at standard conditions.
UPTAKE_FACTORS = (
    ("mmol/g", "mol/kg", 1.0, 0), ("mol/g", "mmol/g", 1e3, 0), ("mmol/kg", "mol/kg", 1e-3, 0), ("ml(STP)/g", "cm3(STP)/g", 1.0, 0), ("cm3(STP)/g", "mmol/g", 1 / 22.414, 0),
    ("mg/g", "mmol/g", 1.0, -1), ("g/g", "mg/g", 1e3, 0), ("g/100g", "g/g", 1e-2, 0), ("wt%", "g/100g", 1.0, 0), ("g Adsorbate / 100g Adsorbent", "g/100g", 1.0, 0),
)
FACTORS = "unit STRING, other STRING, factor DOUBLE, mass_power INT"


def factor_table(spark: SparkSession, factors: tuple = PRESSURE_FACTORS + UPTAKE_FACTORS) -> DataFrame:
    return spark.createDataFrame(list(factors), FACTORS)


def paths_to(factors: DataFrame, target: str) -> DataFrame:
    """(unit, factor, mass_power) of each unit that a path of `factors` (unit, other, factor, mass_power) takes to `target`, itself included.

    The graph is walked from the target outwards, both ways along each factor, until a round
    reaches no new unit; of several shortest paths, the one over the smallest unit counts.
    """
    both = factors.unionByName(factors.select(F.col("other").alias("unit"), F.col("unit").alias("other"), (1 / F.col("factor")).alias("factor"), (-F.col("mass_power")).alias("mass_power")))
    edges = stage(both.where("unit != other and factor != 0"))
    known = stage(factors.sparkSession.createDataFrame([(target, 1.0, 0)], "unit STRING, factor DOUBLE, mass_power INT"))
    new = known
    while True:
        steps = edges.join(new.select(F.col("unit").alias("other"), F.col("factor").alias("f"), F.col("mass_power").alias("m")), "other").join(known.select("unit"), "unit", "left_anti")
        best = steps.groupBy("unit").agg(F.min(F.struct("other", F.col("factor") * F.col("f"), F.col("mass_power") + F.col("m"))).alias("s"))
        new = stage(best.select("unit", F.col("s.col2").alias("factor"), F.col("s.col3").alias("mass_power")))
        if new.isEmpty():
            return known
        known = stage(known.unionByName(new))


def converted(df: DataFrame, value: str, unit: str, paths: DataFrame, out: str, mass: str | None = None) -> DataFrame:
    """`df` with `out`: `value` in the target unit of `paths`. Null where the unit is null or no path takes it there, or where the molar mass that it takes (`mass`) is null or not over 0."""
    # a row for each unit
    of = F.broadcast(paths.select(F.struct("unit", "factor", "mass_power").alias("_path")))
    joined = df.select(F.struct(*df.columns).alias("_row")).join(of, F.col(f"_row.`{unit}`") == F.col("_path.unit"), "left")
    grams = F.col(f"_row.`{mass}`") if mass else F.lit(None).cast("double")
    scaled = F.when(F.col("_path.mass_power") == 0, 1.0).when(grams > 0, F.pow(grams, F.col("_path.mass_power")))
    return joined.select("_row.*", (F.col(f"_row.`{value}`").cast("double") * F.col("_path.factor") * scaled).alias(out))


def in_pa_and_mol_per_kg(measurements: DataFrame, factors: DataFrame, mass: str | None = None) -> DataFrame:
    """`measurements` of single gases with pressure_pa and uptake_mol_kg; see `converted`."""
    pressures = converted(measurements, "pressure", "pressureUnits", paths_to(factors, "Pa"), "pressure_pa")
    return converted(pressures, "adsorbed_amount", "adsorptionUnits", paths_to(factors, "mol/kg"), "uptake_mol_kg", mass)


def conversion_report(converted_rows: DataFrame) -> DataFrame:
    """(pressureUnits, adsorptionUnits, measurements, without_pressure, without_uptake): what has no path, by units."""
    missing = lambda value, out: F.count_if(F.col(value).isNotNull() & F.col(out).isNull())
    return converted_rows.groupBy("pressureUnits", "adsorptionUnits").agg(F.count(F.lit(1)).alias("measurements"), missing("pressure", "pressure_pa").alias("without_pressure"), missing("adsorbed_amount", "uptake_mol_kg").alias("without_uptake"))
