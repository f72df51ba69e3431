"""Wildfire landscape tables as PySpark DataFrames keyed by pixel and year."""
