"""Training-data operators: deduplication, quality, tokenization, sharding, decontamination, chat formatting.

Nothing else in the library imports this subpackage.
"""
