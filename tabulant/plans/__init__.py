"""Whole-flow plans and the registered queries."""
