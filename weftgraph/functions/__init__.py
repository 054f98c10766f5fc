"""Scalar, list, temporal and aggregate functions as Spark columns."""
