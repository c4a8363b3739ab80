"""Scalar helpers built from Spark functions."""
