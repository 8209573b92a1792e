"""Scalar functions Spark lacks."""
