"""Training-data operators: deduplication, filtering, packing and search at corpus scale.

Nothing else in the library imports this subpackage.
"""
