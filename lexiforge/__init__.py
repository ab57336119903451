"""Fuzzy and full-text search over DataFrames."""
