"""Training-data operators: dedup, mixing, archives, formatting, sharding, classification, filtering.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own general interface and
states its results for nulls, empty and long texts, ties, repeated rows and empty tables; ``queries`` binds them to the
standard tables.
"""
