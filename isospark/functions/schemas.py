"""Schemas of landed inputs and datasets, and fixed lists."""

EXPERIMENT_INDEX = "filename STRING"
GUEST_INDEX = "InChIKey STRING"
HOST_INDEX = "hashkey STRING"
RESPONSE = "ordinal BIGINT, key STRING, url STRING, status INT, content_type STRING, body STRING"
EXPERIMENT = """
    filename STRING, DOI STRING, category STRING, date STRING, tabular_data STRING, isotherm_type STRING, digitizer STRING,
    articleSource STRING, concentrationUnits STRING, adsorbent STRUCT<hashkey: STRING, name: STRING>,
    adsorbates ARRAY<STRUCT<InChIKey: STRING, name: STRING>>, temperature DOUBLE, pressureUnits STRING, adsorptionUnits STRING,
    isotherm_data ARRAY<STRUCT<pressure: DOUBLE, total_adsorption: DOUBLE, species_data: ARRAY<STRUCT<composition: DOUBLE, adsorption: DOUBLE>>>>
"""
NAMED = "name STRING"
REGISTRY = """
    lookup_name STRING, hit_rank INT, atoms STRING, heavy_atom_count INT, bonds STRING, elements ARRAY<STRING>, molecular_weight DOUBLE,
    molecular_formula STRING, canonical_smiles STRING, h_bond_acceptor_count INT, h_bond_donor_count INT
"""
SINGLE = """
    filename STRING, temperature DOUBLE, pressureUnits STRING, adsorptionUnits STRING, numGuests INT, adsorbent_name STRING,
    adsorbates_name ARRAY<STRING>, point_idx INT, pressure FLOAT, adsorbed_amount FLOAT, composition DOUBLE
"""
BINARY = """
    filename STRING, temperature DOUBLE, pressureUnits STRING, adsorptionUnits STRING, numGuests INT, adsorbent_name STRING, compound_1 STRING, compound_2 STRING, point_idx INT,
    compound_1_composition FLOAT, compound_2_composition FLOAT, compound_1_pressure FLOAT, compound_2_pressure FLOAT, compound_1_adsorption FLOAT, compound_2_adsorption FLOAT,
    compound_2_filled BOOLEAN, total_pressure ARRAY<DOUBLE>
"""
GUEST_PROPERTIES = """
    name STRING, atoms STRING, heavy_atoms INT, bonds STRING, elements STRING, molecular_weight DOUBLE, molecular_formula STRING, SMILE STRING, H_acceptors INT, H_donors INT
"""
#: Columns that the datasets leave out.
METADATA_COLS = ("DOI", "category", "tabular_data", "isotherm_type", "digitizer", "articleSource", "concentrationUnits")
#: Units of uptake that count as valid.
VALID_UPTAKE_UNITS = ("mmol/g", "mol/kg", "mol/g", "mmol/kg", "mg/g", "g/g", "cm3(STP)/g", "wt%", "g Adsorbate / 100g Adsorbent", "g/100g", "ml(STP)/g")
#: Texts that a dataset file holds for a missing value.
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
