"""Temporal property graphs on Spark: openCypher compiled to DataFrames over versioned node and edge tables."""
