"""Training-data operators: filters, deduplication, mixing, sharding, tokenization.

Nothing else in the package imports this subpackage.
"""
