"""Training-data operators: sharding, packing, dedup, filters, formatting, output.

Each module holds one operator with its own general interface; ``queries``
holds the thin ``opN_*`` queries over the standard tables.
"""
