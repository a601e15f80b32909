"""Training-data operators: near-duplicates, toxicity, search, packing, tokens, shards, licences.

Nothing else in the library imports this subpackage. Queries are in `queries`.
"""
