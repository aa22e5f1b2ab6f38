"""Training-data operators: packing, filtering, near-duplicates, archives.

Nothing else in the library imports this subpackage.
"""
