"""Operators on one table or stream, grouped by the step of an analysis."""
