"""Spark jobs for adsorption-isotherm data and for training-data corpora."""
