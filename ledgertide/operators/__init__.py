"""Analytic operators: plain functions from DataFrames to DataFrames. Case cubes are (state, district, f, d, case_type, n)."""
