"""Raster and geo analytics as Spark DataFrames."""
