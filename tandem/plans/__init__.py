"""Whole pipelines composed from the operators: search, compare, cluster."""
