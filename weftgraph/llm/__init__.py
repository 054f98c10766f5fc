"""Training-data operators: dedup, tokenising, packing, sharding, scoring, scanning, media.

Nothing else in the library imports this package.  Each operator is a module with
a general DataFrame interface; ``queries`` registers the contract queries.
"""
