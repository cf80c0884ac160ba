"""Training-data operators: language ID, near-duplicates, quality rules, archives, tokens, packing.

Nothing else in the package imports this subpackage.
"""
