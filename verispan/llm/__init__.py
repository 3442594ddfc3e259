"""Training-data operators: deduplication, classifiers, tokenization, formatting.

Nothing else in the library imports this subpackage.
"""
