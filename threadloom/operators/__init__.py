"""Operators over DataFrames: graph, normalisation, merge, search, checks, export, profile."""
