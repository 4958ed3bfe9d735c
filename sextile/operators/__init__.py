"""Operators over DataFrames: split, features, metrics, analytics, registry."""
