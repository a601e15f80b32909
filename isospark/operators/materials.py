"""Guests and hosts: property enrichment and description prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_guests(names: DataFrame, registry: DataFrame, na_text: str | None = None) -> DataFrame:
    """Each row of `names` (name) with the properties of the best hit for its lower-cased name, null where there is none.

    `na_text` stands for null in text columns, for files that want it. Of hits of equal rank, the
    one whose other columns come first counts. Spark broadcasts the hits where their size allows.
    """
    others = [c for c in registry.columns if c not in ("lookup_name", "hit_rank")]
    best = registry.groupBy(F.lower("lookup_name").alias("_key")).agg(F.min(F.struct("hit_rank", *others)).alias("_best"))
    hits = best.select("_key", *[f"_best.{c}" for c in others])
    found = names.withColumn("_lower", F.lower("name")).join(hits, F.col("_lower") == F.col("_key"), "left")
    text = lambda c: F.coalesce(c, F.lit(na_text)) if na_text else c
    return found.select(
        "name", text(F.col("atoms")).alias("atoms"), F.col("heavy_atom_count").alias("heavy_atoms"), text(F.col("bonds")).alias("bonds"),
        text(F.when(F.col("elements").isNotNull(), F.concat_ws(" ", "elements"))).alias("elements"), "molecular_weight",
        text(F.col("molecular_formula")).alias("molecular_formula"), text(F.col("canonical_smiles")).alias("SMILE"),
        F.col("h_bond_acceptor_count").alias("H_acceptors"), F.col("h_bond_donor_count").alias("H_donors"),
    )


def description_prompts(hosts: DataFrame) -> DataFrame:
    """A prompt for each different name."""
    return hosts.select("name").distinct().withColumn("prompt", F.format_string("Provide a brief description of %s.", "name"))
